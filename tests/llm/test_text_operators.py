import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitedrift.llm import bpe, chat, lm, packing, quality, token_counts, vocab
from sitedrift.llm.word_ids import WordIds

TEXTS = [
    None, "", "  \n", "Hello world, it's 2024!", "a<|endoftext|>b <|startoftext|>", "naïve Σας 123 Größe x",
    "same same", "same same", "x" * 3000, "tab\tand\r\nlines\n\n  end ", "日本語 テキスト 🙂🙂",
]
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_and_counts_equal_the_library(path):
    lib, v = Tokenizer.from_file(path), vocab.parse(open(path, encoding="utf-8").read())
    want = [e.ids for e in lib.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]
    assert list(bpe.encode_texts(TEXTS, v)) == want
    assert [x.tolist() for x in WordIds(v).texts(TEXTS)] == want
    assert [token_counts.count_text(t, v) for t in TEXTS] == list(map(len, want))


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=["Cn", "Cs", "Co"]), max_size=40))
def test_byte_level_round_trip(text):
    v = vocab.parsed(open(BYTE, encoding="utf-8").read())
    assert bpe.decode_ids(next(bpe.encode_texts([text], v)), v) == text


def test_bpe_jobs(docs, spark):
    df = docs(enumerate(TEXTS))
    rows = {r.doc_id: r for r in bpe.bpe_round_trip(df, BYTE).collect()}
    lib = Tokenizer.from_file(BYTE)
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.bpe_decode(bpe.bpe_encode(df, BYTE), BYTE)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.bpe_round_trip(df.limit(0), BYTE).count() == 0


def test_token_count_job(docs):
    got = {r.doc_id: r for r in token_counts.token_counts(docs(enumerate(TEXTS)), WORD, limit=100).collect()}
    assert got[0].n_tokens == got[0].n_bytes == 0 and not got[0].over_limit
    assert got[8].n_bytes == 3000 and got[8].over_limit


def test_chats_round_trip(spark):
    rows = [
        (1, 0, "system", "~ be <| good"), (1, 1, "user", None), (1, 2, "assistant", "<|im_end|>\n~1"),
        (2, 0, "assistant", "first"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, None, ""), (5, 1, "us\n~er", "t"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rows", F.lit(1))
    out = chat.format_chats(df)
    assert [f.name for f in out.schema] == ["conv_id", "segments", "valid", "formatted"]
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    for c in {r[0] for r in rows}:
        want = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        assert [(x.role, x.text) for x in back[c].turns] == [w[1:] for w in want]
    assert back[1].loss_text == "<|im_end|>\n~1" and back[1].valid
    assert not back[2].valid and not back[3].valid and not back[4].valid
    assert chat.format_chats(df.limit(0)).count() == 0
    plan = chat.digest(chat.read_back(out))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_repeats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + 8))
    return len(hit)


def test_quality_features_and_cascade(docs):
    long = " ".join(f"w{i % 9}" for i in range(60)) + " tail"
    texts = [*TEXTS, long, "one two\none two\n\nthree", " ".join(f"word{i}" for i in range(40)), "A# " * 30]
    df = docs(enumerate(texts))
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_words == len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert got[i].n_repeat_words == brute_repeats(t)
    assert got[len(TEXTS) + 1].n_dup_lines == 1
    assert got[len(TEXTS) + 2].kept and not got[len(TEXTS)].kept and got[0].failed_rule == "few_words"
    kept = quality.passing(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    reverse = quality.quality_rules(df, quality.RULES[::-1]).select("doc_id", "kept")
    assert {r.doc_id: r.kept for r in reverse.collect()} == {i: r.kept for i, r in got.items()}
    assert quality.quality_rules(df.limit(0)).count() == quality.passing(df.limit(0)).count() == 0


def test_quality_keeps_columns_of_any_name(docs):
    df = docs([(1, " ".join(f"word{i}" for i in range(40))), (1, None), (None, " ".join(f"x{i}" for i in range(40)))])
    df = df.withColumns({"n_words": F.lit(777), "_words": F.lit("w"), "_verdict": F.lit(1), "failed_rule": F.lit("no")})
    kept = quality.passing(df)
    assert kept.columns == df.columns
    rows = sorted(kept.collect(), key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, r.n_words, r["_words"], r["_verdict"], r.failed_rule) for r in rows] == [
        (None, 777, "w", 1, "no"), (1, 777, "w", 1, "no"),
    ]


def test_quality_short_circuits(docs, spark):
    """A feature of a later rule isn't computed for a row that an earlier one rejects."""
    df = docs([(1, "few words")])
    never = quality.Rule("never", ("n_words",), lambda n: F.raise_error(F.lit("reached")).isNull() & (n > 0))
    first = quality.RULES[0]
    assert quality.apply_cascade(df, [first, never]).first().failed_rule == "few_words"
    try:
        quality.apply_cascade(df, [never, first]).collect()
    except Exception as e:
        assert "reached" in str(e)
    else:
        raise AssertionError("the first rule was passed over")


def test_cascade_orders_by_rejection_per_cost(docs):
    df = docs([*((i, "too short") for i in range(30)), *((100 + i, " ".join(f"w{j}" for j in range(30))) for i in range(30))])
    plan = quality.plan_cascade(df)
    assert plan[0][0].name == "few_words" and {m[2] for m in plan} == {0.0, 0.5}
    ratio = [m[2] / m[1] for m in plan]
    assert ratio == sorted(ratio, reverse=True) and len(plan) == len(quality.RULES)


def test_two_plans_agree(docs):
    """Costs are counted, so an order that is planned again, over other partitions, is the same."""
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(5 + i % 60)) + "\n" * (i % 3) + "!!" * (i % 5)) for i in range(300)]
    df = docs(rows)
    first = quality.plan_cascade(df)
    assert first == quality.plan_cascade(df) == quality.plan_cascade(df.repartition(7))
    cost = {m[0].name: m[1] for m in first}
    assert cost["repeats"] > cost["duplicate_lines"] > cost["few_words"] and cost["shouting"] == cost["few_words"]
    assert [m[0] for m in quality.plan_cascade(df.limit(0))] == sorted(quality.RULES, key=lambda r: r.name)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_long_words_take_n_log_n(path):
    """200,000 letters without a space, in seconds, with the library's ids."""
    rng = random.Random(11)
    long = "".join(rng.choices("etaoinshrdlu", k=200_000))
    v, lib = vocab.parse(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    began = time.perf_counter()
    (got,) = WordIds(v).texts([long])
    assert time.perf_counter() - began < 10
    assert got.tolist() == lib.encode(long, add_special_tokens=False).ids
    some = ["".join(rng.choices("abcß€ ", k=rng.randrange(1, 400))).replace(" ", "x") for _ in range(50)]
    assert [x.tolist() for x in WordIds(v).texts(some)] == [e.ids for e in lib.encode_batch(some, add_special_tokens=False)]


def test_packing_covers_each_token_once(docs):
    texts = [*TEXTS, *(" ".join(f"t{k}w{i % 50}" for i in range(k * 37)) for k in range(1, 40))]
    df = docs(enumerate(texts)).repartition(2)
    rows = packing.pack_documents(df, WORD, shard_tokens=20_000).collect()
    v = vocab.parse(open(WORD, encoding="utf-8").read())
    ids = {i: [*x.tolist(), 1] for i, x in enumerate(WordIds(v).texts(texts))}
    by_doc, by_seq = {}, {}
    for r in rows:
        part = b"".join(x.to_bytes(4, "little") for x in ids[r.doc_id][r.start : r.start + r.length])
        assert zlib.crc32(part) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in ids.items():
        spans = sorted(by_doc[i])
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert sum(spans[-1]) == len(x)
    fills = []
    for spans in by_seq.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
        fills.append(sum(spans[-1]))
    assert max(fills) <= 2048 and sum(f < 2048 for f in fills) <= 3
    many = packing.pack_documents(df.repartition(40), WORD, shard_tokens=20_000)
    padding = many.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    sizes = padding.collect()
    assert all(r.n == r.end <= 2048 for r in sizes) and sum(r.n for r in sizes) == sum(map(len, ids.values()))
    # each task leaves a remainder, and no two that would fit into one window are left apart
    left = sorted(r.n for r in sizes if r.n < 2048)
    assert len(left) < 30 and (len(left) < 2 or left[0] + left[1] > 2048)
    assert packing.pack_documents(df.limit(0), WORD).count() == 0


def plain_bm25(docs, seed):
    """Scores of all documents against one, by its definition, over all terms of it."""
    n, mean, out = len(docs), sum(map(len, docs)) / len(docs), []
    for d in docs:
        score = 0.0
        for term in set(docs[seed]):
            df = sum(term in x for x in docs)
            tf = d.count(term)
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            score += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        out.append(score)
    return out


def test_retrieval_equals_plain_bm25():
    rng = random.Random(3)
    docs = [[min(200, int(rng.expovariate(0.03))) for _ in range(rng.randint(1, 120))] for _ in range(60)]
    index = packing.Bm25([np.array(d, np.int32) for d in docs])
    closed = np.array([k % 3 == 0 for k in range(60)])
    for again in range(2):
        for seed in range(60):
            want = plain_bm25(docs, seed)
            found = [k for k in range(60) if want[k] > 0 and not (again and closed[k])]
            got = index.ask(seed).tolist()
            assert sorted(got) == found
            assert all(want[a] >= want[b] - 1e-9 for a, b in zip(got, got[1:], strict=False))
        index.keep(~closed)


def test_windows_are_filled_with_the_nearest_unused():
    topics = [np.array([k * 100 + j for j in range(40)] * 5, np.int32) for k in (1, 2, 1, 2, 1, 2)]
    assert packing.Bm25(topics).ask(0).tolist()[:3] == [0, 2, 4]
    assert [[d for d, _, _ in x] for x in packing.pack(topics, 600)] == [[0, 2, 4], [1, 3, 5]]
    # the one that doesn't fit is cut, and its rest seeds the next window
    assert [x for x in packing.pack(topics[:4], 300)] == [[(0, 0, 200), (2, 0, 100)], [(2, 100, 100), (1, 0, 200)], [(3, 0, 200)]]


def test_lm_base_scores_equal_brute_force(docs):
    import collections
    import math

    texts = [*TEXTS, *(f"the quick brown fox {k % 7} jumps over the lazy dog" for k in range(40))]
    df = docs(enumerate(texts))
    learnt = F.col("doc_id") % 5 != 1
    got = {r.doc_id: r for r in lm.lm_scores(df, learnt, BYTE).collect()}
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for i, t in enumerate(texts)}
    c = collections.Counter(w for i, ws in words.items() if i % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        want = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert abs(got[i].base_score - want) < 1e-8 and got[i].n_tokens == len(ws) and got[i].train_tokens == n
        assert got[i].n_known == sum(c[w] > 0 for w in ws) and got[i].score < 0
    assert got[6].score == pytest.approx(got[7].score)
    again = {r.doc_id: r.score for r in lm.lm_scores(df.repartition(7), learnt, BYTE).collect()}
    assert all(again[i] == pytest.approx(r.score, abs=1e-3) for i, r in got.items())
    untaught = lm.lm_scores(df, F.lit(False), BYTE).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in untaught} == {(0, 0, 0.0)} and all(r.score < 0 for r in untaught)
    assert lm.lm_scores(df.limit(0), learnt, BYTE).count() == 0


def test_lm_beats_its_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    scored = lm.lm_scores(docs, ~held_out, BYTE).where(held_out)
    sums = scored.agg(F.sum("base_score").alias("base"), F.sum("score").alias("model")).first()
    assert sums.model > 0.995 * sums.base
