"""Language identification by unigrams over a fixed vocabulary, marginalised over segmentations.

Each language has a probability for every piece of a public vocabulary. A word (letters, lower case, with the vocabulary's
sign of a word's beginning in front) can be cut into pieces in many ways; the forward algorithm sums the products of
all of them. A text's likelihood is the product over its words, and the language with the highest posterior is
predicted.

Piece probabilities are fitted by expectation-maximisation: words of the training rows are counted by language once,
then each round is a map over those counts that adds up expected piece counts by forward and backward sums.

Training uses a bounded sample: about ``sample_docs`` rows of each language, those with the smallest hashes of text,
whole, and of equal texts one. Prediction is a map over all rows. The model has languages times pieces numbers, which tasks get as a broadcast.

Defined results: a null text and one without letters is ``und`` with score 0.0; rows without a language are not learnt from;
without any training row all texts are ``und``; characters that no piece has are one piece of their own; of equally likely
languages the first by name; words of more than ``LONG`` letters are scored whole but not learnt from; repeated rows score alike; an empty
table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions, stored

#: Training rows of a language, in expectation.
SAMPLE_DOCS = 4_000
ROUNDS = 4
#: Counts that a language's pieces share by their frequency in all languages.
SMOOTHING = 2_000.0
#: Letters of a piece, and of a word that is learnt from and kept.
LONGEST_PIECE, LONG = 16, 24
#: Likelihoods below this are computed anew with rescaling.
LEAST = 1e-280
#: Distinct words that a task holds before it emits their counts, or forgets them.
HELD_WORDS = 300_000
WORD = regex.compile(r"\p{L}+")
BEGIN = "▁"
UND = "und"


@dataclass
class Model:
    """pieces: number of each piece; probs: by piece and language, the last piece is any other character."""

    pieces: dict[str, int]
    langs: list[str]
    log_prior: np.ndarray
    probs: np.ndarray


def vocabulary(path: str) -> dict[str, int]:
    """Number of each piece of a sentencepiece model that can occur in a lower-case word."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    word = regex.compile(rf"{BEGIN}?\p{{L}}*")
    own = [p for p in found if 0 < len(p) <= LONGEST_PIECE and word.fullmatch(p) and p == p.lower()]
    return {p: k for k, p in enumerate(dict.fromkeys([BEGIN, *own]))}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def lattice(group: list[str], pieces: dict[str, int]) -> list[tuple[int, int, np.ndarray]]:
    """(begin, end, piece of each word or -1) for the spans that are a piece of some word. All words have one length."""
    marked = [BEGIN + w for w in group]
    n, other = len(marked[0]), len(pieces)
    out = []
    for end in range(1, n + 1):
        for begin in range(max(0, end - LONGEST_PIECE), end):
            missing = other if end - begin == 1 else -1
            ids = np.fromiter((pieces.get(w[begin:end], missing) for w in marked), np.int32, len(marked))
            if (ids >= 0).any():
                out.append((begin, end, ids))
    return out


def by_length(found: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """(words of one length, their places)."""
    groups = defaultdict(list)
    for k, w in enumerate(found):
        groups[len(w)].append(k)
    for at in groups.values():
        yield [found[k] for k in at], at


def forward(spans: list[tuple[int, int, np.ndarray]], probs: np.ndarray) -> np.ndarray:
    """Sums over the segmentations of every beginning: (end, word, language). The last row of probs is 0, for no piece."""
    n = max(end for _, end, _ in spans)
    alpha = np.zeros((n + 1, len(spans[0][2]), probs.shape[1]))
    alpha[0] = 1.0
    for begin, end, ids in spans:  # in order of ends, so alpha[begin] is complete
        alpha[end] += alpha[begin] * probs[ids]
    return alpha


def expected(group: list[str], weights: np.ndarray, pieces: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """Expected counts by piece of words of one length in one language; probs: one column, the last row 0."""
    spans = lattice(group, pieces)
    alpha = forward(spans, probs)[..., 0]
    n = len(alpha) - 1
    beta = np.zeros_like(alpha)
    beta[n] = 1.0
    for begin, end, ids in sorted(spans, key=lambda s: -s[0]):
        beta[begin] += beta[end] * probs[ids, 0]
    total = np.where(alpha[n] > LEAST, weights, 0.0) / np.maximum(alpha[n], LEAST)
    out = np.zeros(len(probs))
    for begin, end, ids in spans:
        out += np.bincount(ids + (ids < 0) * len(probs), alpha[begin] * probs[ids, 0] * beta[end] * total, len(probs))
    return out


def long_word(word: str, pieces: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """Log likelihood by language of one word of any length, rescaled at each letter."""
    marked, other = BEGIN + word, len(pieces)
    window, log = np.zeros((LONGEST_PIECE, probs.shape[1])), np.zeros(probs.shape[1])
    window[-1] = 1.0
    for end in range(1, len(marked) + 1):
        ids = [
            pieces.get(marked[b:end], other if b == end - 1 else -1) if b >= 0 else -1
            for b in range(end - LONGEST_PIECE, end)
        ]
        now = (window * probs[ids]).sum(0)
        window = np.concatenate([window[1:], now[None]])
        if now.min() > 0:
            window, log = window / now, log + np.log(now)
    return log + np.log(window[-1])


def likelihoods(found: list[str], pieces: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """Log likelihood of each word in each language; probs ends with a row of 0."""
    out = np.zeros((len(found), probs.shape[1]))
    for group, at in by_length(found):
        short = len(group[0]) <= LONG
        total = forward(lattice(group, pieces), probs)[-1] if short else np.zeros((len(group), probs.shape[1]))
        out[at] = np.log(np.maximum(total, LEAST))
        for i in np.flatnonzero(total.min(1) <= LEAST):
            out[at[i]] = long_word(group[i], pieces, probs)
    return out


def _counted(rows: DataFrame) -> DataFrame:
    """lang int, word, n: words of rows (lang int, text), counted."""

    def run(batches):
        held: dict[int, Counter] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            flat = [(k, w, n) for k, c in held.items() for w, n in c.items()]
            held.clear()
            columns = [pa.array(c, t) for c, t in zip(zip(*flat, strict=True), (pa.int32(), pa.string(), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held[lang].update(w for w in words(text.as_py()) if len(w) <= LONG)
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield flush()
        if any(held.values()):
            yield flush()

    parts = rows.select("lang", "text").mapInArrow(run, "lang int, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _round(counts: DataFrame, pieces: dict[str, int], probs: np.ndarray) -> np.ndarray:
    """Expected counts (piece, language) of all counted words under probs. At most languages times pieces rows come back."""
    shipped = counts.sparkSession.sparkContext.broadcast((pieces, probs))

    def run(batches):
        pieces, probs = shipped.value
        sums = np.zeros_like(probs)
        for b in batches:
            langs, found = b.column(0).to_numpy(), b.column(1).to_pylist()
            n = b.column(2).to_numpy().astype(float)
            for lang in np.unique(langs):
                rows = np.flatnonzero(langs == lang)
                for group, at in by_length([found[i] for i in rows]):
                    sums[:, lang] += expected(group, n[rows[at]], pieces, probs[:, [lang]])
        piece, lang = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(sums[piece, lang])],
            names=["piece", "lang", "n"],
        )

    parts = counts.mapInArrow(run, "piece int, lang int, n double")
    got = parts.groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros_like(probs)
    out[got["piece"], got["lang"]] = got["n"]
    return out


def maximise(counts: np.ndarray) -> np.ndarray:
    """Probabilities from expected counts, smoothed towards those of all languages; the last row stays 0."""
    shared = counts[:-1].sum(1) + 0.1
    shared /= shared.sum()
    out = np.zeros_like(counts)
    out[:-1] = (counts[:-1] + SMOOTHING * shared[:, None]) / (counts[:-1].sum(0) + SMOOTHING)
    return out


def fit(
    docs: DataFrame,
    vocab_path: str,
    learn: Column | bool = True,
    sample_docs: int = SAMPLE_DOCS,
    rounds: int = ROUNDS,
    text: str = "text",
    lang: str = "lang",
) -> Model:
    """A model from the rows of docs where learn is true and text and language aren't null."""
    pieces = vocabulary(vocab_path)
    rows = docs.where(F.lit(True) if learn is True else learn)
    rows = rows.select(F.col(lang).alias("name"), F.col(text).alias("text")).where("name IS NOT NULL AND text IS NOT NULL")
    sizes = {r["name"]: r["count"] for r in rows.groupBy("name").count().collect()}
    langs = sorted(sizes)
    none = np.zeros((len(pieces) + 2, len(langs)))
    if not langs:
        return Model(pieces, langs, np.zeros(0), none)
    # one row for each language: the number of it and the share of its rows that are learnt from
    shares = docs.sparkSession.createDataFrame(
        [(name, k, min(1.0, sample_docs / sizes[name])) for k, name in enumerate(langs)], "name string, lang int, share double"
    )
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.join(F.broadcast(shares), "name").where(chance < F.col("share")).dropDuplicates(["lang", "text"])
    counts = stored(_counted(sample).repartition(partitions(docs.sparkSession)), "words")
    none[:-1] = 1.0 / (len(pieces) + 1)
    probs = none
    for _ in range(rounds):
        probs = maximise(_round(counts, pieces, probs))
    n = np.array([sizes[k] for k in langs], float)
    return Model(pieces, langs, np.log((n + 1) / (n.sum() + len(n))), probs)


class Known:
    """Log likelihoods of words that were met before."""

    def __init__(self, pieces: dict[str, int], probs: np.ndarray):
        self.pieces, self.probs = pieces, probs
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, self.probs.shape[1]))

    def texts(self, found: list[list[str]]) -> np.ndarray:
        """Log likelihood of each list of words in each language."""
        if len(self.at) > HELD_WORDS:
            self.clear()
        fresh = list({w for f in found for w in f}.difference(self.at))
        if fresh:
            base = len(self.at)
            self.rows = np.concatenate([self.rows[:base], likelihoods(fresh, self.pieces, self.probs)])
            self.at.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        at = self.at.__getitem__
        return np.array([self.rows[list(map(at, f))].sum(0) for f in found]).reshape(len(found), -1)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", step: int = 512) -> DataFrame:
    """doc_id, lang_pred, score: the posterior of the predicted language."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    held: dict[str, Known] = {}

    def run(batches):
        m = shipped.value
        if "known" not in held:
            held["known"] = Known(m.pieces, m.probs)
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                found = [words(t) if t else [] for t in part.column(1).to_pylist()]
                names, scores = [UND] * len(found), np.zeros(len(found))
                if m.langs:
                    z = held["known"].texts(found) + m.log_prior
                    p = np.exp(z - z.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    best = p.argmax(1)
                    for k, f in enumerate(found):
                        if f:
                            names[k], scores[k] = m.langs[best[k]], p[k, best[k]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"]
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
