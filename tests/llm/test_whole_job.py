"""Operators go through all of their input."""

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from sitedrift.llm import attention, embeddings, lm, vocab
from sitedrift.llm.word_ids import WordIds


@pytest.mark.parametrize("n_words", [0, 5, 31, 32, 33, 400])
def test_rounds_cover_every_training_window(n_words):
    stream = np.random.default_rng(5).integers(0, 40, n_words + 1)
    found = np.concatenate([lm.round_windows(stream, r) for r in range(lm.ROUNDS)])
    padded = np.concatenate([np.full(max(0, attention.WINDOW + 1 - len(stream)), stream[0]), stream])
    starts = range(0, len(stream) - 1 and len(padded) - 1, attention.WINDOW)
    wanted = [padded[min(i, len(padded) - 1 - attention.WINDOW) :][: attention.WINDOW + 1].tolist() for i in starts]
    assert sorted(found.tolist()) == sorted(wanted)
    pairs = set(zip(found[:, :-1].ravel().tolist(), found[:, 1:].ravel().tolist(), strict=True))
    assert pairs >= set(zip(stream[:-1].tolist(), stream[1:].tolist(), strict=True))


def test_every_training_document_is_in_one_shard(docs, spark, monkeypatch):
    """Shards hold all training documents whole, in order, and don't depend on how the input is split."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 60)
    path = P.path("byte_bpe_50k.json")
    rows = [(i, f"a{i % 5} bb{i} the end") for i in range(60)] + [(None, "no id"), (None, "no id"), (7, "again"), (8, None), (3, "")]
    df = docs(rows)
    learnt = F.coalesce(F.col("doc_id") % 5 != 1, F.lit(True))
    v = vocab.parsed(open(path, encoding="utf-8").read())
    end = v.specials["<|endoftext|>"]
    found = []
    for parts in (1, 5):
        chunks = lm._chunks(df.repartition(parts, "doc_id"), learnt, path, "doc_id", "text")
        tables = lm._tables(chunks, len(v.token_bytes))
        n = chunks.agg(F.sum("n_learnt")).first()[0]
        got = lm._shards(chunks, tables, end, n).collect()
        found.append(sorted((r.shard, lm._unpack(r.stream, "<i4").tolist()) for r in got))
    assert found[0] == found[1] and len(found[0]) > 3
    of = {int(b): i for i, b in enumerate(tables.bucket.tolist()) if tables.own_logp[i] == 0}
    want = []
    for i, t in rows:
        if i is None or i % 5 != 1:
            words = (t or "").split()
            want.append(tuple(x for w in words for x in WordIds(v).known([f" {w}"])[1].tolist()))
    flat = []
    for _, stream in found[0]:
        ids = [of[b] for b in stream]
        assert ids[0] == ids[-1] == end
        cuts = [k for k, x in enumerate(ids) if x == end]
        flat += [tuple(ids[a + 1 : b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert sorted(flat) == sorted(want)


def plain_probability(p, t, window):
    """log probability of window[-1] after the others: attention, layer and both softmaxes by loops."""
    x, y = window[:-1], window[-1]
    w = attention.WIDTH
    e = [p["emb"][b] + p["pos"][k] for k, b in enumerate(x)]
    q, key, value = (e[-1] @ p["qkv"][:, :w], [r @ p["qkv"][:, w : 2 * w] for r in e], [r @ p["qkv"][:, 2 * w :] for r in e])
    weight = [np.exp(q @ k / w**0.5) for k in key]
    o = sum(a * v for a, v in zip(weight, value, strict=True)) / sum(weight)
    h = e[-1] + o @ p["mix"]
    z = h + np.maximum(h @ p["up"] + p["bias"], 0) @ p["down"]
    context = t.context[x[-1]]
    of_class = np.array([z @ p["out"][:, c] + t.before[context, c] for c in range(len(t.edges) - 1)])
    c = int(np.searchsorted(t.edges, y, "right")) - 1
    inside = np.array([z @ p["own"][b] + t.inside[context, b] for b in range(t.edges[c], t.edges[c + 1])])
    return of_class[c] - np.log(np.exp(of_class).sum()) + inside[y - t.edges[c]] - np.log(np.exp(inside).sum())


def small_model(seed=0, n=70):
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.geometric(0.08, 3000), n) - 1
    counts = np.bincount(ids, minlength=n + 5)
    rank, size = attention.ranked(counts)
    pairs = np.zeros((min(size, attention.CONTEXTS), size), np.float32)
    np.add.at(pairs, (rank[ids[:-1]], rank[ids[1:]]), 1)
    t = attention.tables(counts, pairs)
    flat = attention.initial(t) + 0.3 * rng.standard_normal(len(attention.initial(t))).astype(np.float32)
    return t, flat, rng


def test_scores_equal_plain_loops():
    t, flat, rng = small_model()
    p = attention.named(flat.astype(np.float64), t)
    sizes = np.array([1, 5, 32, 33, 80])
    ids = rng.integers(0, 75, sizes.sum())
    end = 3
    got = attention.score_streams(flat, t, ids, sizes, end)
    at = 0
    for size, score in zip(sizes, got, strict=True):
        stream = [int(t.bucket[end]), *t.bucket[ids[at : at + size]].tolist()]
        want = float(t.own_logp[ids[at : at + size]].sum())
        step = attention.WINDOW - attention.OVERLAP
        for k in range(1, len(stream)):
            first = 0 if k <= attention.WINDOW else step * -(-(k - attention.WINDOW) // step)
            want += plain_probability(p, t, stream[first : k + 1])
        assert abs(score - want) < 1e-3 * size
        at += size


def test_probabilities_sum_to_one():
    t, flat, _ = small_model()
    assert len(t.bucket) == 75 and t.size == len(np.unique(t.bucket))
    given = [7, 2]
    total = sum(np.exp(attention.score_streams(flat, t, np.array([*given, i]), np.array([3]), 0) - attention.score_streams(flat, t, np.array(given), np.array([2]), 0))[0] for i in range(75))
    assert abs(total - 1) < 1e-4


def test_attention_gradient():
    t, flat, rng = small_model()
    flat = flat.astype(np.float64)
    windows = rng.integers(0, t.size, (3, attention.WINDOW + 1))
    t.before, t.inside = t.before.astype(np.float64), t.inside.astype(np.float64)
    loss = lambda f: attention.gradient(attention.named(f, t), t, windows)
    _, g = loss(flat)
    for name, part in attention.named(np.arange(len(flat)), t).items():
        for i in part.ravel()[np.argsort(-np.abs(g[part.ravel()]))[:3]]:
            up, down = flat.copy(), flat.copy()
            up[i] += 1e-4
            down[i] -= 1e-4
            assert abs((loss(up)[0] - loss(down)[0]) / 2e-4 - g[i]) < 1e-5, name


def test_training_lowers_the_loss_and_needs_attention():
    """Every other bucket is mostly that of two steps ago: only a look back can tell."""
    rng = np.random.default_rng(1)
    x = rng.integers(1, 20, 40_000)
    x[::2] = np.repeat(rng.integers(1, 20, 1000), 20)
    counts = np.bincount(x, minlength=20)
    rank, size = attention.ranked(counts)
    pairs = np.zeros((size, size), np.float32)
    np.add.at(pairs, (rank[x[:-1]], rank[x[1:]]), 1)
    t = attention.tables(counts, pairs)
    windows = attention.cut(t.bucket[np.concatenate([[1], x])])
    first, _ = attention.gradient(attention.named(attention.initial(t), t), t, windows[:64])
    flat = attention.train_windows(attention.initial(t), t, windows, 0.01, 300, 32)
    last, _ = attention.gradient(attention.named(flat, t), t, windows[:64])
    assert last < first - 0.3


def test_rounds_and_shared_context():
    assert (lm.ROUNDS, attention.OVERLAP) == (3, 8)


def test_no_training_documents_no_windows():
    assert attention.cut(np.zeros(1, np.int16)).shape == (0, attention.WINDOW + 1)


def test_passes_hold_the_miss_probability():
    assert [embeddings.passes_for(n) for n in (1, 25_000, 100_000, 400_000)] == [24, 24, 32, 46]
    for n in (200_000, 1_000_000, 10_000_000, 10**9):
        chance = 0.24 * 0.84 ** np.log2(n / 100_000)
        assert (1 - chance) ** embeddings.passes_for(n) <= embeddings.MISS
        assert (1 - chance) ** (embeddings.passes_for(n) - 1) > embeddings.MISS


def test_further_passes_while_they_join_components(spark):
    """A dense group of near but mostly unlinked vectors: one pass alone loses links."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal(32) + 0.55 * rng.standard_normal((400, 32))
    x[200:] = x[:200] + 0.2 * rng.standard_normal((200, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    classes = embeddings.stored(df.select(F.col("vec_id").alias("rep"), F.udf(_bytes, "binary")("embedding").alias("vec")), "v")
    few = embeddings.connected_components(embeddings._links(classes, 400, 0, 1, 4, 0.9).where(F.col("kind") == embeddings.LINK))
    whole = {r.rep: r.component for r in embeddings._components(classes, 400, 1, 4, 0.9).collect()}
    once = {r.node: r.component for r in few.collect()}
    parts = lambda d: len({d.get(i, i) for i in range(400)})
    assert parts(whole) < parts(once)
    assert set(once) <= set(whole)
    pairs = df.sparkSession.createDataFrame([(a, b) for a, b in once.items()], "a long, b long").collect()
    assert all(whole[r.a] == whole[r.b] for r in pairs)
    assert all(whole[c] == c <= i for i, c in whole.items())


def test_codes_bound_the_cosine():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 48))
    x[100:] = x[:100] + 0.48 * rng.standard_normal((100, 48))
    x[0] = [1.0] + [0.0] * 47
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = embeddings._codes(x)
    assert {len(c) for c in codes} == {8 + 48}
    back, rest = embeddings._decode(codes)
    exact = x @ x.T
    slack = rest[:, None] + rest + 3 * rest[:, None] * rest + 1e-5
    assert (np.abs(back @ back.T - exact) <= slack).all() and rest.max() < 0.02
    edges, doubts = embeddings._near((back, rest), None, 0.9)
    sets = embeddings.UnionFind()
    for i, j in edges:
        sets.union(i, j)
    sure = {(i, j) for i in range(200) for j in range(i) if sets.find(i) == sets.find(j)}
    linked = {(i, j) for i in range(200) for j in range(i) if exact[i, j] >= 0.9}
    doubtful = {(max(p), min(p)) for p in doubts}
    assert len(linked) > 20 and doubtful and linked <= sure | doubtful
    assert all(exact[i, j] >= 0.9 for i, j in sure if (i, j) in linked or len(sure) == 0)


def _bytes(v):
    return np.asarray(v, np.float64).tobytes()
