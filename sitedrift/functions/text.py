"""Texts as columns: line diffs, truncation, titles, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines of a side in a preview, and in a prompt for a model.
PREVIEW_LINES, PROMPT_LINES = 3, 40
LINE_CHARS, CHANGE_CHARS = 160, 8000


def lines_not_in(left: Column, right: Column) -> Column:
    """Lines of the left text that the right lacks, in order and with repeats. Each line is looked for in all of the other
    side, so this is for short texts; snapshots.line_diffs takes any."""
    other = F.split(right, "\n", -1)
    return F.filter(F.split(left, "\n", -1), lambda x: ~F.array_contains(other, x))


def preview_of(added: Column, n_added: Column, removed: Column, n_removed: Column, lines: int = PREVIEW_LINES) -> Column:
    """struct(preview, totalAdded, totalRemoved) of the first lines of both sides and how many there are; a line over 160
    characters is cut to 157 and an ellipsis."""

    def side(rows: Column, n: Column, sign: str) -> Column:
        cut = F.transform(
            F.slice(rows, 1, lines),
            lambda x: F.when(F.length(x) > LINE_CHARS, F.concat(F.substring(x, 1, LINE_CHARS - 3), F.lit("…"))).otherwise(x),
        )
        return F.when(n > 0, F.concat(F.lit(f"{sign} "), F.array_join(cut, f"\n{sign} ")))

    return F.struct(
        F.concat_ws("\n", side(added, n_added, "+"), side(removed, n_removed, "-")).alias("preview"),
        n_added.cast("long").alias("totalAdded"),
        n_removed.cast("long").alias("totalRemoved"),
    )


def diff_preview(before: Column, after: Column, lines: int = PREVIEW_LINES) -> Column:
    """struct(preview, totalAdded, totalRemoved) of two short texts (see lines_not_in)."""
    added, removed = lines_not_in(after, before), lines_not_in(before, after)
    return preview_of(added, F.size(added), removed, F.size(removed), lines)


def prompt_text(d: Column) -> Column:
    """A preview (struct) under a line of totals; a placeholder where no line differs."""
    head = F.concat(
        F.lit("Total lines added: "), d["totalAdded"], F.lit(", removed: "), d["totalRemoved"], F.lit("\n\n")
    )
    return F.when(F.trim(d["preview"]) == "", F.lit("(no line-level diff available)")).otherwise(
        F.concat(head, d["preview"])
    )


def diff_for_prompt(before: Column, after: Column) -> Column:
    return prompt_text(diff_preview(before, after, PROMPT_LINES))


def parse_diff(preview: Column) -> Column:
    """array of struct(kind add, del or ctx, text) of a preview's lines."""

    def line(x: Column) -> Column:
        plus, minus = F.startswith(x, F.lit("+ ")), F.startswith(x, F.lit("- "))
        return F.struct(
            F.when(plus, F.lit("add")).when(minus, F.lit("del")).otherwise(F.lit("ctx")).alias("kind"),
            F.when(plus | minus, F.substring(x, 3, 1 << 30)).otherwise(x).alias("text"),
        )

    return F.transform(F.split(preview, "\n", -1), line)


def truncate_text(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def truncate_change(text: Column) -> Column:
    return F.when(F.length(text) <= CHANGE_CHARS, text).otherwise(
        F.concat(F.substring(text, 1, CHANGE_CHARS - 20), F.lit("\n… (truncated)"))
    )


def strip_postfix(text: Column, postfix: str | None) -> Column:
    """Without a trailing attribution."""
    if not postfix:
        return text
    trimmed = F.regexp_replace(text, "\\s+$", "")
    short = F.regexp_replace(F.substring(trimmed, F.lit(1), F.length(trimmed) - len(postfix)), "\\s+$", "")
    return F.when(F.endswith(trimmed, F.lit(postfix)), short).otherwise(text)


def append_postfix(text: Column, postfix: str | None) -> Column:
    if not postfix:
        return text
    trimmed = F.regexp_replace(text, "\\s+$", "")
    return F.when(F.endswith(trimmed, F.lit(postfix)), trimmed).otherwise(F.concat(trimmed, F.lit(f" {postfix}")))


def alert_title(title: Column, postfix: str | None = None) -> Column:
    return F.regexp_replace(strip_postfix(title, postfix), "https?://", "")


def valid_slack_url(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike("^(?i:https://hooks\\.slack\\.com)(:443)?/services/\\S*$"), F.lit(False))


def valid_webhook_url(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike("^(?i)https?://[^/?#\\s@:]+(:[0-9]+)?([/?#]\\S*)?$"), F.lit(False))


def parse_emails(raw: Column) -> Column:
    """Valid addresses of a list separated by commas or lines."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), "[\\n,]+", -1), lambda p: F.trim(p))
    return F.filter(
        parts,
        lambda p: p.rlike("^[A-Za-z0-9_+-]+(\\.[A-Za-z0-9_+-]+)*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\\.)+[A-Za-z]{2,}$"),
    )
