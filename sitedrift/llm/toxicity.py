"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's logit is a bias plus the weights, never negative, of its words' features (the word, and its beginnings of 3 to 6
characters, which catch inflected and compounded forms), each feature once however often the sentence has it. Noisy-or combines the sentences: a document is clean only if
each of them is. Weights are learnt from document labels through that combination, and the sentences with high scores
are the offending ones.

Training uses a bounded sample in one task: at most ``sample_docs`` labelled documents, those with the smallest hash of
their id, whole, as long as they begin within ``sample_chars`` characters; the weights have a fixed size. Scoring is a
map over all documents.

Defined results: null or empty text is one empty sentence, whose score is the bias's; rows without a label, or with a
null one, are not learnt from; of several labels of a document the largest counts, and of several texts of one id the
smallest is learnt from, so that sample_docs bounds the rows; without any labelled document all
scores are 0.0; repeated rows score alike; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents learnt from at most, and characters after which no further one begins.
SAMPLE_DOCS, SAMPLE_CHARS = 8_000, 40_000_000
FEATURE_BITS = 20
BEGINNINGS = (3, 4, 5, 6)
#: Features of fewer training documents keep weight 0.
MIN_DOCS = 3
#: LASSO: the pull to 0 of a weight in each step that touches it. Few labelled documents are gone through more often, up to MIN_STEPS steps.
EPOCHS, BATCH, RATE, LASSO, MIN_STEPS = 12, 128, 0.5, 1e-4, 300
#: Distinct words whose features are kept while texts are read for training.
KNOWN_WORDS = 200_000
#: Distinct words whose weighted features a worker keeps.
CACHE_WORDS = 300_000

TOKENS = re.compile(r"\w+|[.!?\n]+")
SENTENCE = re.compile(r"[^.!?\n]+")


@dataclass
class Model:
    """weights by feature, and a sentence's bias."""

    weights: np.ndarray
    bias: float


def features(word: str) -> list[int]:
    size = (1 << FEATURE_BITS) - 1
    out = [zlib.crc32(f"={word}".encode()) & size]
    for n in BEGINNINGS:
        if len(word) > n:
            out.append(zlib.crc32(f"{n}{word[:n]}".encode()) & size)
    return out


def sentences(text: str | None) -> list[list[str]]:
    """Lower-case words of each sentence that has any; at least one, empty, sentence."""
    out: list[list[str]] = [[]]
    for token in TOKENS.findall((text or "").lower()):
        if token[0] in ".!?\n":
            if out[-1]:
                out.append([])
        else:
            out[-1].append(token)
    return out if out[-1] or len(out) == 1 else out[:-1]


def train(texts: Iterable[str | None], toxic: Sequence[int]) -> Model:
    """AdaGrad on the noisy-or log loss. Sentences hold each feature once. toxic is read after texts.

    Memory: four bytes for each feature of a sentence, of all sentences, and once more while rare ones are dropped.
    """
    size = 1 << FEATURE_BITS
    known: dict[str, list[int]] = {}
    flat, sentence_at, doc_at = array("i"), array("q", [0]), array("q", [0])
    docs_with = np.zeros(size, np.int32)
    for text in texts:
        in_doc: set[int] = set()
        for words in sentences(text):
            found: set[int] = set()
            for w in words:
                if w not in known:
                    if len(known) >= KNOWN_WORDS:
                        known.clear()
                    known[w] = features(w)
                found.update(known[w])
            flat.extend(sorted(found))
            sentence_at.append(len(flat))
            in_doc |= found
        docs_with[np.fromiter(in_doc, np.int64, len(in_doc))] += 1
        doc_at.append(len(sentence_at) - 1)
    known.clear()
    n_docs = len(doc_at) - 1
    if not n_docs:
        return Model(np.zeros(size, np.float32), -np.inf)
    common = np.flatnonzero(docs_with >= MIN_DOCS)
    number = np.full(size, -1, np.int32)
    number[common] = np.arange(len(common))
    sentence_at, doc_at = np.array(sentence_at), np.array(doc_at)
    feats = number[np.frombuffer(flat, np.int32)] if len(flat) else np.zeros(0, np.int32)
    del flat
    kept = np.concatenate([[0], np.cumsum(feats >= 0)])
    sentence_at, feats = kept[sentence_at], feats[feats >= 0]
    del kept
    w, g2 = np.zeros(len(common)), np.full(len(common), 1e-2)
    toxic = np.asarray(toxic)
    rate_docs = min(max(toxic.mean(), 1e-3), 0.999)
    bias, bias_g2 = float(np.log(rate_docs / max(1.0, np.diff(doc_at).mean()))), 1e-2
    rng = np.random.default_rng(7)
    batches = -(-n_docs // BATCH)
    for _ in range(max(EPOCHS, -(-MIN_STEPS // batches))):
        order = rng.permutation(n_docs)
        for at in range(0, n_docs, BATCH):
            rows = np.sort(order[at : at + BATCH])
            s_rows = np.concatenate([np.arange(doc_at[d], doc_at[d + 1]) for d in rows])
            count = sentence_at[s_rows + 1] - sentence_at[s_rows]
            first = np.cumsum(count) - count
            ids = feats[np.repeat(sentence_at[s_rows] - first, count) + np.arange(count.sum())]
            owner = np.repeat(np.arange(len(s_rows)), count)
            z = bias + np.bincount(owner, w[ids], len(s_rows))
            doc = np.repeat(np.arange(len(rows)), doc_at[rows + 1] - doc_at[rows])
            total = np.bincount(doc, np.logaddexp(0, z), len(rows))
            p = -np.expm1(-total)
            push = np.where(toxic[rows] > 0, -(1 - p) / np.maximum(p, 1e-9), 1.0)
            g = push[doc] / (1 + np.exp(-z)) / len(rows)
            grad = np.bincount(ids, g[owner], len(common))
            touched = np.flatnonzero(grad)
            g2[touched] += grad[touched] ** 2
            step = RATE / np.sqrt(g2[touched])
            w[touched] = np.maximum(0.0, w[touched] - step * (grad[touched] + LASSO))
            bias_g2 += g.sum() ** 2
            bias -= RATE * 0.3 * g.sum() / np.sqrt(bias_g2)
    weights = np.zeros(size, np.float32)
    weights[common] = w
    return Model(weights, float(bias))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    sample_chars: int = SAMPLE_CHARS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> Model:
    """A model from labels (doc_id, toxic) of docs: the first sample_docs of them by the hash of their id, and of those
    the first whose texts together begin within sample_chars characters."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.max("toxic").alias("_toxic"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample_docs)
    )
    # sample_docs bounds this side, so it is sent to all tasks
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))
    in_order = Window.orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.coalesce(F.length("_text"), F.lit(0))).over(in_order), F.lit(0))
    rows = rows.withColumn("_before", before).where(F.col("_before") < sample_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: list[int] = []

        def texts() -> Iterator[str | None]:
            for b in batches:
                toxic.extend(b.column(1).to_pylist())
                yield from (t.as_py() for t in b.column(0))

        m = train(texts(), toxic)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias], pa.float64())], names=["weights", "bias"]
        )

    got = rows.select("_text", "_toxic").mapInArrow(run, "weights binary, bias double").first()
    return Model(np.frombuffer(got.weights, np.float32), got.bias) if got else train([], [])


class _Weighted(dict):
    """word: those of its features that have a weight."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        self[word] = x = tuple(f for f in features(word) if self.weights[f])
        return x


def sentence_scores(text: str | None, weighted: _Weighted, bias: float) -> np.ndarray:
    """softplus(logit), that is -log(1 - probability), of each sentence."""
    tokens = TOKENS.findall((text or "").lower())
    if not tokens:
        return np.logaddexp(0.0, np.array([bias]))
    ends = np.fromiter((t[0] in ".!?\n" for t in tokens), bool, len(tokens))
    group = np.cumsum(ends)
    has = np.bincount(group[~ends], minlength=group[-1] + 1) > 0
    if not has.any():
        return np.logaddexp(0.0, np.array([bias]))
    # a token that ends a sentence has no feature, as training knows words only
    found = map(weighted.__getitem__, tokens)
    once = dict.fromkeys((g, f) for g, fs, end in zip(group.tolist(), found, ends.tolist(), strict=True) if fs and not end for f in fs)
    logits = np.full(len(has), bias)
    for g, f in once:
        logits[g] += weighted.weights[f]
    return np.logaddexp(0.0, logits[has])


def score(
    docs: DataFrame, model: Model, offending: float = 0.5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, score, offending: array of (begin, end, score) of the sentences of that score or more, in code points."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    least = -np.log1p(-min(offending, 1 - 1e-12))
    held: dict[str, _Weighted] = {}

    def run(batches):
        weights, bias = shipped.value
        for b in batches:
            scores, spans = [], []
            for t in b.column(1):
                weighted = held.get("weighted")
                if weighted is None or len(weighted) > CACHE_WORDS:
                    weighted = held["weighted"] = _Weighted(weights)
                text = t.as_py()
                s = sentence_scores(text, weighted, bias)
                scores.append(float(-np.expm1(-s.sum())))
                found = []
                if s.max() >= least:
                    worded = (m for m in SENTENCE.finditer(text or "") if re.search(r"\w", m[0]))
                    for m, x in zip(worded, s, strict=False):
                        if x >= least:
                            found.append({"begin": m.start(), "end": m.end(), "score": float(-np.expm1(-x))})
                spans.append(found)
            span = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))],
                names=["doc_id", "score", "offending"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id long, score double, offending array<struct<begin: long, end: long, score: double>>"
    )


def keep_below(docs: DataFrame, model: Model, threshold: float, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores below threshold: a filter in one pass."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    held: dict[str, _Weighted] = {}
    at = docs.columns.index(text)

    def run(batches):
        weights, bias = shipped.value
        for b in batches:
            weighted = held.get("weighted")
            if weighted is None or len(weighted) > CACHE_WORDS:
                weighted = held["weighted"] = _Weighted(weights)
            clean = [-np.expm1(-sentence_scores(t.as_py(), weighted, bias).sum()) < threshold for t in b.column(at)]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
