"""Quality rules as a short-circuit cascade of DataFrame expressions.

A ``Feature`` is an expression over the text alone; a ``Rule`` rejects on a condition over features. ``plan_cascade``
estimates every rule's cost and selectivity on a bounded random sample and orders the rules by rejection per cost.
``apply_cascade`` and ``passing`` evaluate them one after the other: a feature is part of the condition of its rule
and isn't derived below it, so it is computed only for rows that no earlier rule rejected. The order changes the work
and which rule is named, never the verdict.

Costs are counted, not timed: the passes over characters, words and lines that a rule's features take (``_work``), summed
over the sample's texts. So they follow what the texts are like and are the same whenever they are estimated; ties go by name.

Defined results: null or empty text has no words and fails ``few_words``; windows that repeat are compared by 64-bit
hash within one text; repeated rows are judged alike; an empty table gives no rows. ``passing`` returns the columns of
its input, whatever their names. ``quality_rules`` adds the features asked for, failed_rule and kept; a column of one of
these names is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]"
WINDOW = 8
#: Rows of the sample on which costs and selectivities are estimated, and its seed.
SAMPLE_ROWS, SEED = 500, 17


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")


def lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def repeated_words(text: Column) -> Column:
    """Words inside windows of WINDOW words that the text holds more than once, the first one included."""

    def grams(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    def starts_of_repeats(ranked: Column) -> Column:
        hit = lambda k: F.coalesce(F.get(ranked, k)["h"], F.lit(0))
        last = F.size(ranked) - 1
        twice = F.filter(
            ranked, lambda e, k: ((k > 0) & (hit(k - 1) == e["h"])) | ((k < last) & (hit(k + 1) == e["h"]))
        )
        return F.array_sort(F.transform(twice, lambda e: e["p"]))

    def covered(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, p: F.struct(
                (p + WINDOW).alias("end"), (a["n"] + (p + WINDOW) - F.greatest(a["end"], p)).alias("n")
            ),
            lambda a: a["n"],
        )

    def count(g: Column) -> Column:
        ranked = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        # only texts in which some window repeats pay for the sort
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            let(ranked, lambda r: covered(starts_of_repeats(r)))
        )

    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.when(F.size(h) < WINDOW, F.lit(0)).otherwise(let(grams(h), count)))


#: name: expression over a text that isn't null. All are longs.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(words(t)),
    "word_chars": lambda t: F.length(t) - F.regexp_count(t, F.lit(SPACE)),
    "n_lines": lambda t: F.size(lines(t)),
    "n_dup_lines": lambda t: let(lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))),
    "n_symbols": lambda t: F.regexp_count(t, F.lit("[#*$%&|<>]")),
    "n_upper": lambda t: F.regexp_count(t, F.lit("[A-Z]")),
    "n_exclaims": lambda t: F.regexp_count(t, F.lit("[!?]{2,}")),
    "n_repeat_words": repeated_words,
}


def feature(name: str, text: str) -> Column:
    return FEATURES[name](F.coalesce(F.col(text), F.lit(""))).cast("long")


@dataclass(frozen=True)
class Rule:
    """Rejects where ``reject`` of the values of these features is true."""

    name: str
    features: tuple[str, ...]
    reject: Callable[..., Column]

    def on(self, value: Callable[[str], Column]) -> Column:
        return F.coalesce(self.reject(*(value(f) for f in self.features)), F.lit(False))


RULES: tuple[Rule, ...] = (
    Rule("few_words", ("n_words",), lambda n: n < 20),
    Rule("repeats", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda d, n: 10 * d > 3 * n),
    Rule("short_words", ("word_chars", "n_words"), lambda c, n: c < 2 * n),
    Rule("long_words", ("word_chars", "n_words"), lambda c, n: c > 15 * n),
    Rule("shouting", ("n_upper", "word_chars"), lambda u, c: 2 * u > c),
    Rule("exclaiming", ("n_exclaims", "n_words"), lambda e, n: 10 * e > n),
)


def _work(name: str) -> Callable[[Column], Column]:
    """Characters that a feature reads of a text, or steps that take as long."""
    length, n_words, n_lines = F.length, lambda t: F.size(words(t)), lambda t: F.regexp_count(t, F.lit("\n")) + 1
    return {
        # a split copies what it reads
        "n_words": lambda t: 2 * length(t),
        "n_lines": lambda t: 2 * length(t) + n_lines(t),
        "n_dup_lines": lambda t: 2 * length(t) + 3 * n_lines(t),
        # hashes of words and of their windows; a sort only where a window repeats
        "n_repeat_words": lambda t: 2 * length(t)
        + n_words(t) * (1 + WINDOW)
        + F.when(feature("n_repeat_words", "text") > 0, n_words(t) * F.ceil(F.log2(n_words(t) + F.lit(1)))).otherwise(0),
    }.get(name, length)


def plan_cascade(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> list[tuple[Rule, float, float]]:
    """Rules with (cost by row, share rejected) on a sample of about sample_rows texts, best rejection per cost first. The
    sample is drawn in all partitions and summed there in one job; texts don't reach the driver."""
    total = docs.count()
    share = min(1.0, sample_rows / max(1, total))
    sample = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = sample.sample(fraction=share, seed=SEED) if share < 1 else sample
    sums = [F.count(F.lit(1)).alias("n")]
    for k, rule in enumerate(rules):
        cost = reduce(Column.__add__, [_work(f)(F.col("text")) for f in rule.features])
        sums += [F.sum(cost.cast("long")).alias(f"cost{k}"), F.count_if(rule.on(lambda f: feature(f, "text"))).alias(f"hits{k}")]
    got = sample.agg(*sums).first()
    n = max(1, got["n"])
    measured = [(rule, max(1.0, (got[f"cost{k}"] or 0) / n), got[f"hits{k}"] / n) for k, rule in enumerate(rules)]
    return sorted(measured, key=lambda m: (-m[2] / m[1], m[1], m[0].name))


def apply_cascade(docs: DataFrame, rules: Sequence[Rule], text: str = "text", given: Sequence[str] = ()) -> DataFrame:
    """Adds failed_rule: the first rule in this order that rejects, null where none does. Features named in given are
    taken from columns of docs; the others are computed where their rule is reached."""
    value = lambda f: F.col(f) if f in given else feature(f, text)
    case: Column | None = None
    for rule in rules:
        cond = rule.on(value)
        case = F.when(cond, F.lit(rule.name)) if case is None else case.when(cond, F.lit(rule.name))
    return docs.withColumn("failed_rule", F.lit(None).cast("string") if case is None else case)


def quality_rules(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    features: Sequence[str] = tuple(FEATURES),
) -> DataFrame:
    """docs with failed_rule, kept and the features asked for; these are computed for every row, the others by need."""
    order = [m[0] for m in plan_cascade(docs, rules, text, sample_rows)]
    featured = docs.withColumns({f: feature(f, text) for f in features})
    return apply_cascade(featured, order, text, features).withColumn("kept", F.col("failed_rule").isNull())


def passing(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """The rows of docs, their own columns, that no rule rejects: one filter whose terms stop at the first rejection."""
    order = [m[0] for m in plan_cascade(docs, rules, text, sample_rows)]
    terms = [~rule.on(lambda f: feature(f, text)) for rule in order]
    return docs.where(reduce(Column.__and__, terms)) if terms else docs
