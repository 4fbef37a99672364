import io
import itertools
import math
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitedrift.llm import components, embeddings, minhash, toxicity, warc, zipfmt
from sitedrift.llm.shared import fresh_folder


def brute_components(ids, linked):
    uf = components.UnionFind()
    for a, b in itertools.combinations(sorted(ids), 2):
        if linked(a, b):
            uf.union(a, b)
    return {i: uf.find(i) for i in ids}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (None, 1), (30, 20), (20, 10), (10, 40)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {
        1: 1, 2: 1, 3: 1, 9: 7, 8: 7, 7: 7, 30: 10, 20: 10, 10: 10, 40: 10,
    }
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("finish", [0, 1000])
def test_components_of_an_ordered_chain_in_few_rounds(spark, monkeypatch, finish):
    n, rounds = 5000, []
    keep = components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: rounds.append(name) or keep(df, name))
    edges = spark.range(1, n).selectExpr("id AS a", "id - 1 AS b").union(spark.sql("SELECT 9000L, 9001L"))
    edges = edges.union(spark.range(20_000, 20_500).selectExpr("id", "19999L"))
    got = components.connected_components(edges, finish)
    want = [(0, n), (9000, 2), (19999, 501)]
    assert sorted(map(tuple, got.groupBy("component").count().collect())) == want
    assert got.count() == n + 503
    # at most 2 * log2(n) rounds
    assert rounds.count("step") <= 25


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"x{rng.randrange(5000)}"
        yield " ".join(w)


def test_minhash_equals_brute_force(docs):
    rng = random.Random(1)
    texts = [None, "", " \n", "One Two", "one two", "a b c", "a b c d", "É É É", "é é é"]
    for n, words, edits in ((60, 120, 5), (25, 60, 4), (10, 300, 20)):
        texts += family(rng, n, words, edits)
    texts += [" ".join(f"u{rng.randrange(9000)}" for _ in range(50)) for _ in range(40)] + ["long " * 20000]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for k, percent in ((3, 85), (5, 80)):
        sets = {}
        for i, t in enumerate(texts):
            w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
            sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()

        def linked(a, b, sets=sets, percent=percent):
            x, y = sets[a], sets[b]
            return bool(x) and bool(y) and 100 * len(x & y) >= percent * len(x | y)

        want = brute_components(sets, linked)
        got = {r.doc_id: r for r in minhash.near_duplicates(docs(enumerate(texts)), k, percent).collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert minhash.near_duplicates(docs([]), 3, 85).count() == 0


def test_minhash_blocks_of_large_buckets(docs, monkeypatch):
    """Buckets with one large component and others, in blocks of four members."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for step in range(70):
        w = list(base)
        for at in rng.sample(range(100), 1 if step < 45 else rng.randint(2, 9)):
            w[at] = f"x{step}-{at}"
        texts.append(" ".join(w))
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(98)} for i, t in enumerate(texts)}
    want = brute_components(sets, lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    found = minhash.near_duplicates(docs(enumerate(texts)), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in found} == want and len(set(want.values())) > 5


def test_minhash_repeats_and_missing_ids(docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (2, a + " tail"), (None, a), (7, b), (7, c), (7, c), (9, c), (None, b + " end"), (None, "q r"), (None, "q r"), (3, None), (4, "")]
    got = minhash.near_duplicates(docs(rows), 5, 80).collect()
    key = lambda r: (str(r.doc_id), r.n_shingles, r.component_id, r.kept)
    assert sorted(map(key, got)) == sorted(
        [("5", 56, 2, False), ("2", 57, 2, True), ("None", 56, 2, False), ("7", 56, 7, True), ("7", 56, 7, True), ("7", 56, 7, True),
         ("9", 56, 7, False), ("None", 57, 7, False), ("None", 1, None, False), ("None", 1, None, False), ("3", 0, 3, True), ("4", 0, 4, True)]
    )
    df = docs(rows).withColumns({"_kept": F.lit(1), "row": F.lit("r")})
    kept = minhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted(
        [("2", a + " tail"), ("7", b), ("7", c), ("None", "q r"), ("3", ""), ("4", "")]
    )
    assert minhash.one_of_each(docs([])).count() == 0


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(2)
    err = []
    for _ in range(150):
        shared, own = rng.integers(0, 2**62, 300).astype(np.uint64), rng.integers(0, 2**62, 100).astype(np.uint64)
        s = minhash.superminhash([np.unique(shared), np.unique(np.concatenate([shared[:200], own]))])
        err.append((s[0] == s[1]).mean() - 200 / 400)
    assert abs(np.mean(err)) < 0.01 and np.std(err) < (0.25 / minhash.POSITIONS) ** 0.5


@pytest.mark.parametrize(("similarity", "most"), [(0.85, 2e-5), (0.8, 1.1e-4), (0.9, 1e-8)])
def test_chance_that_a_similar_pair_is_not_verified(similarity, most):
    """Positions agree at least as often as independent ones would: a binomial tail bounds it."""
    threshold, n = min(similarity, 0.85), minhash.POSITIONS
    agreeing = math.ceil((threshold - minhash.SLACK) * n - 1e-9)
    chance = sum(math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k) for k in range(agreeing))
    assert chance <= most


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 32))
    rows = [(i, [float(x) for x in base[i % 6] + 0.1 * rng.standard_normal(32)]) for i in range(150)]
    rows += [(150 + i, [float(x) for x in rng.standard_normal(32)]) for i in range(80)]
    rows += [(300, None), (301, [0.0] * 32), (302, [float("nan")] * 32), (303, [None] * 32), (304, [1.0] * 5), (305, [2.0] * 5), (306, rows[0][1]), (307, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))
    unit = {}
    for i, v in rows:
        x = np.array([np.nan if e is None else e for e in v], np.float32).astype(float) if v is not None else np.zeros(0)
        if len(x) and np.isfinite(x).all() and np.linalg.norm(x) > 0:
            unit[i] = x / np.linalg.norm(x)
    linked = lambda a, b: a in unit and b in unit and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9
    ids = [i for i, _ in rows]
    want = brute_components(ids, linked)
    got = {r.vec_id: r for r in embeddings.near_vectors(df, window=32).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_links for i, r in got.items()} == {a: sum(linked(a, b) for b in ids if b != a) for a in ids}
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_zip_package_is_a_zip_and_reads_others():
    out = io.BytesIO()
    p = zipfmt.Package(out)
    at = p.add("a.bin", b"hello")
    p.add("dir/b.bin", b"")
    p.close()
    assert out.getvalue()[at : at + 5] == b"hello"
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None and z.read("a.bin") == b"hello"

    class Bytes:
        def __init__(self, raw):
            self.raw = raw

        def size(self):
            return len(self.raw)

        def read_at(self, n, where):
            return self.raw[where : where + n]

    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x", "one")
        z.comment = b"a comment"
    for raw, name, data in ((out.getvalue(), "a.bin", b"hello"), (other.getvalue(), "x", b"one")):
        m = {m.name: m for m in zipfmt.directory(Bytes(raw))}[name]
        begin = zipfmt.data_at(Bytes(raw), m)
        assert raw[begin : begin + m.size] == data


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "x"), (2, "http://b/\n ", "x"), (3, None, None), (4, "http://c/", ""), (5, "http://d/", "é" * 50_000), (6, "u", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    got = {r.page_id: r for r in warc.archive_and_read(df, fresh_folder(spark, "warc")).collect()}
    assert {i: r.record_type for i, r in got.items()} == {1: "revisit", 2: "revisit", 3: "revisit", 4: "response", 5: "response", 6: "response"}
    assert got[1].refers_to == got[2].refers_to == 6 and got[3].refers_to == 4 and got[5].refers_to is None
    assert bytes(got[5].payload).decode() == "é" * 50_000 and got[5].payload_bytes == 100_000
    assert got[2].url == "http://b/%0A%20" and got[1].payload is None and got[1].payload_digest == got[6].payload_digest
    large = warc.archive_and_read(df, fresh_folder(spark, "warc"), min_bytes=2)
    assert {r.record_type for r in large.collect()} == {"response"}
    assert warc.archive_and_read(df.limit(0), fresh_folder(spark, "warc")).count() == 0


def test_toxicity_learns_sentences(spark, docs):
    rng = random.Random(4)
    calm = [f"w{i}" for i in range(200)]
    texts, toxic = [], []
    for i in range(600):
        s = [" ".join(rng.choices(calm, k=8)) for _ in range(rng.randint(1, 6))]
        bad = i % 3 == 0
        if bad:
            s[rng.randrange(len(s))] += f" vile{rng.choice(['st', 'ness', 'ly', ''])} you"
        texts.append(". ".join(s) + ".")
        toxic.append(int(bad))
    df = docs([*enumerate(texts), (1000, None), (1001, ""), (1002, "...")])
    labels = spark.createDataFrame([*enumerate(toxic), (5, None), (7777, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [i for i in range(600) if i % 3 == 1]
    calls = [(got[i].score >= 0.7) == bool(toxic[i]) for i in range(600)]
    assert sum(calls) >= 590 and len(held) == 200
    assert got[1000].score == got[1001].score == got[1002].score < 0.5
    worst = got[0].offending[0]
    assert "vile" in texts[0][worst.begin : worst.end]
    kept = toxicity.keep_below(df, model, 0.7)
    assert kept.columns == df.columns and kept.count() == sum(r.score < 0.7 for r in got.values())
    assert toxicity.fit(df, labels.limit(0)).weights.sum() == 0


def test_vectors_of_extreme_lengths_link(spark):
    """Cosines don't depend on lengths, however near they come to what a double can hold."""
    rows = [
        (1, [1e200, 0.0]), (2, [1e200, 1e190]), (3, [1.0, 0.0]), (4, [1e-200, 0.0]), (5, [2e-200, 0.0]), (6, [5e-324, 0.0]),
        (7, [1.7e308, 1.7e308]), (8, [1e-310, 1e-310]), (9, [-1e300, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()}
    assert got == {**{i: (5, 1) for i in range(1, 7)}, 7: (1, 7), 8: (1, 7), 9: (0, 9)}


def test_pages_without_ids(spark):
    """They are records, revisit the largest id of their payload, and come back without an id; large ids stay exact beside them."""
    big = 2**60 + 1
    df = spark.createDataFrame([(None, "u", "same"), (3, "u", "same"), (big, "v", "same"), (None, "w", "alone"), (None, "w", "alone"), (5, None, None)], "page_id long, url string, html string")
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive_and_read(df, fresh_folder(spark, "warc")).collect()), key=repr)
    assert got == sorted([(0, "revisit", big, 4), (3, "revisit", big, 4), (big, "response", None, 4), (0, "response", None, 5), (0, "response", None, 5), (5, "response", None, 0)], key=repr)


def test_near_vectors_recall_on_planted_pairs(spark):
    """Pairs of cosine 0.9 to 0.92 among random vectors, a third of them in one dense group: at least 0.9 are found (the
    aim is all), and no link that isn't one."""
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    n, d, pairs = 6000, 64, 300
    x = unit(rng.standard_normal((n, d)))
    x[: n // 3] = unit(x[0] + 0.5 * x[: n // 3])
    a = rng.choice(n, pairs, replace=False)
    away = rng.standard_normal((pairs, d))
    away = unit(away - (away * x[a]).sum(1, keepdims=True) * x[a])
    c = rng.uniform(0.901, 0.92, (pairs, 1))
    y = c * x[a] + np.sqrt(1 - c**2) * away
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    every = np.concatenate([x, y])
    exact = (every @ every.T >= 0.9).sum(1) - 1
    found = sum(got[n + k].component_id == got[int(i)].component_id for k, i in enumerate(a))
    assert found >= 0.99 * pairs
    counted, there = sum(r.n_links for r in got.values()), int(exact.sum())
    assert 0.99 * there <= counted <= there and all(got[i].n_links <= exact[i] for i in got)
