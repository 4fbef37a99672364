"""corpus_pipeline stage by stage against plain versions, and the operators' queries over small tables."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sitedrift.llm import queries, toxicity
from sitedrift.llm.shared import stored

SF = "/root/testdata/sf0.001"
CLASHES = ("n_words", "_words", "_lines", "_kept", "row", "_row", "score", "failed_rule", "component", "node", "key")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def good(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"word{rng.integers(1000)}" for _ in range(n))


ROWS = [
    (1, good(1)), (2, good(1) + " more"), (3, None), (4, ""), (5, " \n "), (6, good(6)), (6, good(6)), (None, good(6)),
    (None, good(7)), (None, good(7)), (8, "too few words"), (9, good(9, 30_000)), (10, good(10) + " vilest vile"), (7, good(1)),
]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Labels beside a table of documents with clashing columns, nulls, repeats and a very long text."""
    folder = str(tmp_path_factory.mktemp("sf"))
    rng = np.random.default_rng(0)
    train = [(100 + i, f"{good(100 + i)}. {'vile vilest' if i % 2 else 'calm'} {good(500 + i, 5)}.") for i in range(300)]
    labels = [(i, int("vile" in t)) for i, t in train] + [(100, None), (None, 1), (9999, 1)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = [ROWS[i] for i in rng.permutation(len(ROWS))] + train
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumns({c: F.lit(f"v {c}") for c in CLASHES})
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages_equal_plain_versions(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "near_duplicates", "packing"]
    key = lambda r: (r.doc_id or -1, r.text or "")

    def through(name, df):
        out = stored(stages[name](spark, df, table), name)
        assert out.columns == docs.columns and out.where(F.col("n_words") != "v n_words").count() == 0
        return out, sorted(map(key, out.collect()))

    before = sorted(map(key, docs.collect()))
    calm, got = through("toxicity", docs)
    assert got == [k for k in before if "vile" not in k[1]]

    passed, got = through("quality", calm)
    assert got == [k for k in before if "vile" not in k[1] and len(words(k[1])) >= 20]
    everything, _ = through("quality", docs)
    assert everything.count() == sum(len(words(t)) >= 20 for _, t in before)

    alone, got = through("near_duplicates", passed)
    rows = sorted(passed.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words(r.text) for r in rows)]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = [new if g == old else g for g in group]
    assert got == sorted(key(rows[g]) for g in set(group))
    # without the filters before it: empty texts stay, one row for each
    whole, kept = through("near_duplicates", docs)
    assert sum(not words(t) for _, t in kept) == 3

    pieces = stages["packing"](spark, alone, table).collect()
    spans = {}
    for r in pieces:
        spans.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for parts in spans.values():
        at = 0
        for start, length, _ in sorted(parts):
            assert start == at
            at += length
        assert at == parts[0][2]
    assert set(spans) == {r.doc_id for r in alone.collect()}


def test_run_applies_all_stages(spark, table):
    got = corpus_pipeline.run(spark, table)
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert {1, 6, 9, None} <= ids and not ids & {2, 3, 4, 5, 7, 8, 10, 101}


def test_stages_of_an_empty_table(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, table).count() == 0


def plain_logits(text, weights, bias):
    """Logits of a text's sentences, a feature once for each: {feature: weight} by loops."""
    out = []
    for s in re.split(r"[.!?\n]+", (text or "").lower()):
        if found := re.findall(r"\w+", s):
            once = {f for w in found for f in toxicity.features(w)}
            out.append(bias + sum(float(weights[f]) for f in once))
    return np.array(out or [bias])


def plain_score(text, weights, bias):
    return 1 - np.prod(1 / (1 + np.exp(plain_logits(text, weights, bias))))


def test_toxicity_equals_plain_noisy_or(spark, table):
    """Scores from the model's weights by a loop over sentences and words."""
    docs = spark.read.parquet(f"{table}/documents.parquet").where("doc_id IS NOT NULL")
    repeated = spark.createDataFrame([(9_000, "awful " * 50), (9_001, "awful awfully. awful")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(repeated)
    model = toxicity.fit(docs, spark.read.parquet(f"{table}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        assert abs(r.score - plain_score(texts[r.doc_id], model.weights, model.bias)) < 1e-5


TRAINED = ["bad word. fine day", "fine day fine day", "bad bad bad", "calm words calm. fine\nbad", None, "x" * 50, "word. word. word"] * 4
TOXIC = [1, 0, 1, 1, 0, 0, 0] * 4


def plain_fit(steps):
    """AdaGrad with derivatives of the plain noisy-or loss by finite differences; all documents make one batch."""
    holding = Counter(f for t in TRAINED for f in {f for w in re.findall(r"\w+", t or "") for f in toxicity.features(w)})
    weights = dict.fromkeys(holding, 0.0)
    rate = np.mean(TOXIC)
    sentences = sum(len(plain_logits(t, weights, 0.0)) for t in TRAINED)
    bias = np.log(rate / max(1.0, sentences / len(TRAINED)))
    g2, bias_g2 = dict.fromkeys(holding, 1e-2), 1e-2

    def loss(weights, bias):
        p = np.array([plain_score(t, weights, bias) for t in TRAINED])
        return -np.mean(np.where(TOXIC, np.log(p), np.log1p(-p)))

    for _ in range(steps):
        grad, h = {}, 1e-6
        for f in weights:
            up, down = weights | {f: weights[f] + h}, weights | {f: weights[f] - h}
            grad[f] = (loss(up, bias) - loss(down, bias)) / (2 * h)
        of_bias = (loss(weights, bias + h) - loss(weights, bias - h)) / (2 * h)
        for f, g in grad.items():
            g2[f] += g * g
            weights[f] = max(0.0, weights[f] - toxicity.RATE / np.sqrt(g2[f]) * (g + toxicity.LASSO))
        bias_g2 += of_bias**2
        bias -= toxicity.RATE * 0.3 * of_bias / np.sqrt(bias_g2)
    return weights, bias


def test_toxicity_training_equals_plain_gradients(spark, monkeypatch):
    """Words repeat within sentences; the model that is trained is the one that scores."""
    monkeypatch.setattr(toxicity, "EPOCHS", 4)
    monkeypatch.setattr(toxicity, "MIN_STEPS", 4)
    weights, bias = plain_fit(4)
    model = toxicity.train(iter(TRAINED), TOXIC)
    assert abs(model.bias - bias) < 1e-4 and np.count_nonzero(model.weights) > 3
    for f, w in weights.items():
        assert abs(model.weights[f] - w) < 1e-4
    texts = [*TRAINED[:7], "bad " * 500, "fine bad fine bad. bad"]
    scored = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    for r in scored.collect():
        assert abs(r.score - plain_score(texts[r.doc_id], weights, bias)) < 1e-3
    assert toxicity.train(iter([]), []).bias == -np.inf


def test_toxicity_learns_one_text_of_an_id(spark):
    docs = spark.createDataFrame([(i, f"bad w{i}") for i in range(9)] + [(0, "also")] * 50 + [(None, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] * 3, "doc_id long, toxic int")
    once = spark.createDataFrame([(i, f"bad w{i}") for i in range(1, 9)] + [(0, "also")], "doc_id long, text string")
    a, b = toxicity.fit(docs, labels), toxicity.fit(once, labels)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_toxicity_sample_is_bounded_by_characters(spark):
    docs = spark.createDataFrame([(i, "x " * 500) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")

    def model(chars):
        return toxicity.fit(docs, labels, sample_chars=chars)

    assert model(40_000).bias != model(3_000).bias


@pytest.mark.parametrize("name", [q.__name__ for q in queries.OPERATORS])
def test_registered_queries_run_over_their_tables(spark, name):
    """Each query gives a row for each row (op2: conversation, op9, op11: at least one row) of its table."""
    of = {"op1": ("embeddings", "vec_id"), "op2": ("conversations", "conv_id"), "op6": ("pages", "page_id")}
    of |= {"op11": ("benchmark", "item_id"), "op13": ("embeddings", "vec_id")}
    table, key = of.get(name.split("_")[0], ("documents", "doc_id"))
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().collect()}
    got = [r[0] for r in queries.queries()[name](spark, SF).select(key).collect()]
    assert set(got) == want | ({-1} if table == "conversations" else set())
    if name not in ("op9_packing", "op11_bit_slices"):
        assert len(got) == len(set(got))
