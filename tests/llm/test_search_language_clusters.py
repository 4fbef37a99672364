import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest

from sitedrift.llm import bitslices, kmeans, langid

PIECES = P.path("piece_bpe_32k.model")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_search(docs, items, count=10):
    texts = [(i, Counter(TERM.findall(lowered(t)))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    n, total = len(texts), sum(c.total() for _, c in texts)
    out = []
    for item, text in items:
        scored = []
        for i, c in texts:
            m, score = 10 + 90 * c.total() * n // total, 0
            for t in set(TERM.findall(lowered(text))):
                df = sum(t in x for _, x in texts)
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:count])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id long, text string, doc_id int, rank string")


def random_docs(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)]
    weights = [1 / (k + 1) for k in range(200)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice((3, 30, 300))))) for i in range(n)]


def test_search_equals_scoring_all(docs, items):
    rows = random_docs(1, 150)
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # copies: ties go by id
    rows += [
        (2000, None), (2001, ""), (2002, "..!"), (2003, "Été É ÀB 日本 42"), (2003, "w1 w2 w3"), (2003, "w1 w2 w3"),
        (None, "w150 w151"), (2004, "w5 " * 20_000), (2005, " ".join(f"long{i}" for i in range(5_000)) + " w7"),
    ]
    asked = [
        (1, rows[7][1]), (2, "W1 w2, w150!"), (3, None), (4, ""), (5, "nothing here"), (6, "été 日本 42"), (6, "été 日本 42"),
        (7, "w5 w7 long17"), (None, "w9"),
    ]
    df = docs(rows)
    assert rows_of(bitslices.search(df, items(asked))) == brute_search(rows, asked)
    assert rows_of(bitslices.search(df, items(asked), count=3)) == brute_search(rows, asked, 3)
    assert bitslices.search(df.limit(0), items(asked)).count() == 0
    assert bitslices.search(df, items(asked).limit(0)).count() == 0


def test_search_in_blocks_and_with_texts_shuffled(docs, items, monkeypatch):
    rows, asked = random_docs(2, 80), [(k, f"w{k} w{2 * k} w{k * k % 200}") for k in range(12)]
    monkeypatch.setattr(bitslices, "BLOCK_ITEMS", 3)
    monkeypatch.setattr(bitslices, "SENT", 0)
    assert rows_of(bitslices.search(docs(rows), items(asked))) == brute_search(rows, asked)


def test_bounds_hold_and_leave_documents_out(docs):
    """No score is above its bound, and most bounds are close."""
    rows = random_docs(3, 120)
    shards = bitslices.Shards()
    counts = {i: Counter(TERM.findall(t)) for i, t in rows}
    full = [bitslices.sliced(*s) for i, c in counts.items() if (s := shards.add(i, c))]
    full += [bitslices.sliced(*s) for s in shards.open.items()]
    n, total = len(rows), sum(c.total() for c in counts.values())
    names = [f"w{k}" for k in range(0, 200, 3)] + ["absent"]
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for c in counts.values()) + 1))) for t in names])
    block = bitslices.Block([0], names, weights, np.zeros(len(names), np.int64), np.arange(len(names)), n, total)
    seen = exact = 0
    for s in full:
        ids, lengths = np.frombuffer(s["ids"], np.int64), np.frombuffer(s["lengths"], np.int64)
        slices = np.frombuffer(s["slices"], np.uint8).reshape(1 << s["bits"], -1)
        (bound,) = bitslices.bounds(block, s["bits"], lengths, slices, bitslices.hashes(names))
        for i, b in zip(ids.tolist(), bound.tolist(), strict=True):
            m = 10 + 90 * counts[i].total() * n // total
            score = sum(int(w) * (1_000_000_000 * counts[i][t] // (1000 * counts[i][t] + 8 * m)) for t, w in zip(names, weights, strict=True))
            assert score <= b
            seen, exact = seen + 1, exact + (b <= 1.05 * score + 1)
    assert seen == n and exact > 0.7 * n


def brute_likelihood(word, pieces, probs):
    """Sum over all segmentations, one after the other."""
    marked = "▁" + word
    total = np.zeros(probs.shape[1])
    for k in range(len(marked)):
        for cuts in combinations(range(1, len(marked)), k):
            p = np.ones(probs.shape[1])
            for b, e in zip((0, *cuts), (*cuts, len(marked)), strict=True):
                p = p * probs[pieces.get(marked[b:e], len(pieces) if e - b == 1 else -1)]
            total += p
    return total


def a_model(langs=2, seed=5):
    pieces = langid.vocabulary(PIECES)
    probs = np.zeros((len(pieces) + 2, langs))
    probs[:-1] = np.random.default_rng(seed).dirichlet(np.ones(len(pieces) + 1), langs).T
    return pieces, probs


def test_forward_sums_all_segmentations():
    pieces, probs = a_model()
    found = ["a", "the", "other", "größe", "zq", "日本", "thing", "another"]
    got = langid.likelihoods(found, pieces, probs)
    for w, x in zip(found, got, strict=True):
        assert np.allclose(x, np.log(brute_likelihood(w, pieces, probs)), rtol=1e-10)
        assert np.allclose(x, langid.long_word(w, pieces, probs), rtol=1e-10)
    longest = "abc" * 3_000
    assert np.isfinite(langid.likelihoods([longest], pieces, probs)).all()


def test_expected_counts_are_derivatives():
    """A piece's expected count is its probability times the derivative of the log likelihood."""
    pieces, probs = a_model(1)
    counts = langid.expected(["other", "there"], np.array([2.0, 3.0]), pieces, probs)
    value = lambda q: langid.likelihoods(["other", "there"], pieces, q)[:, 0] @ [2.0, 3.0]
    for piece in ("▁the", "re", "o", "▁"):
        k, up = pieces[piece], probs.copy()
        up[k] *= 1 + 1e-6
        assert counts[k] == pytest.approx((value(up) - value(probs)) / 1e-6, rel=1e-3, abs=1e-8)


def test_language_job(spark, monkeypatch):
    rng = random.Random(4)
    lexicon = {
        "de": "der und nicht straße über mädchen schön zeit wieder können".split(),
        "en": "the and with house thing would because people water never".split(),
    }
    rows = [(i, " ".join(rng.choices(lexicon[k], k=12)).title(), k) for i in range(300) for k in [("de", "en")[i % 2]]]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 !?", "en"), (1003, "Nicht " * 9_000, None), (1003, "Water " * 9, None)]
    rows += [(None, "schön wieder", None), (1004, "über" * 20_000, "de"), (1005, rows[0][1], "de"), (1005, rows[0][1], "de")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, score int, word string")
    model = langid.fit(df, PIECES, df.doc_id % 3 != 0)
    assert model.langs == ["de", "en"] and np.allclose(model.probs[:-1].sum(0), 1) and not model.probs[-1].any()
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(df, model).collect()]
    assert len(got) == len(rows)
    want = Counter((i, k) for i, _, k in rows if i is not None and i < 1000 or i == 1005)
    want += Counter([(1000, "und"), (1001, "und"), (1002, "und"), (1003, "de"), (1003, "en"), (None, "de")])
    assert Counter((i, k) for i, k, _ in got if i != 1004) == want
    assert all(0 <= s <= 1 and (k != "und" or s == 0) for _, k, s in got)
    monkeypatch.setattr(langid, "HELD_WORDS", 3)
    again = langid.fit(df, PIECES, df.doc_id % 3 != 0)
    assert np.allclose(again.probs, model.probs)
    none = langid.fit(df, PIECES, df.doc_id < 0)
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0
    few = langid.fit(df, PIECES, sample_docs=5)
    assert {r.lang_pred for r in langid.predict(df.where("doc_id = 2"), few).collect()} == {"de"}


def brute_clusters(rows, k, rounds, size):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))

    def assign():
        return [min((dist(v, c), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        to = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (_, n) in zip(kept, to, strict=True) if n == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    to = assign()
    inertia = Counter()
    for d, n in to:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inertia[n], inertia.total(), sha[n]) for (i, _), (d, n) in zip(kept, to, strict=True)), key=repr)


def cluster_rows(df, **options):
    return sorted(map(tuple, kmeans.clusters(df, **options).collect()), key=repr)


def test_clusters_equal_plain_search(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 4))
    rows = [(i, (centres[i % 5] + 0.3 * rng.normal(size=4)).tolist()) for i in range(300)]
    rows += [(400 + i, rows[3][1]) for i in range(100)]  # copies
    rows += [
        (500, None), (501, []), (502, [1.0] * 3), (503, [1.0, None, 0.0, 0.0]), (504, [math.nan] * 4), (505, [math.inf] * 4),
        (506, [0.0] * 4), (3, rows[8][1]), (None, [0.5] * 4), (507, [1000.0, -1000.0, 3.0, 1e-9]),
    ]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, x int")
    for rounds in (0, 1, 10):
        assert cluster_rows(df, size=4, rounds=rounds) == brute_clusters(rows, 8, rounds, 4)
    assert cluster_rows(df.where("vec_id < 5"), size=4) == brute_clusters([r for r in rows if r[0] is not None and r[0] < 5], 8, 10, 4)
    assert cluster_rows(df.limit(0), size=4) == []
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.cluster, r.distance) for r in kmeans.clusters(far, size=2).collect()) == [(0, 0), (1, 0)]


def test_pivots_spare_distances():
    rng = np.random.default_rng(7)
    x = (1024 * (rng.normal(size=(8, 16))[rng.integers(0, 8, 2_000)] * 3 + 0.2 * rng.normal(size=(2_000, 16)))).astype(np.int64)
    pivots, centroids = kmeans.choose_pivots(x[:64]), x[:8]
    table = np.sqrt(kmeans.squared(x[:, None], pivots[None]).astype(float))
    cluster, distance, made = kmeans.nearest(x, table, pivots, centroids)
    every = kmeans.squared(x[:, None], centroids[None])
    assert (distance == every.min(1)).all() and (cluster == every.argmin(1)).all() and made < 0.4 * every.size
