"""Chat formatting with DataFrame functions only.

A ``ChatTemplate`` declares the markers, the allowed turn order and the roles that carry loss. ``format_chats`` gathers
each conversation once, walks the role automaton over its sorted turns and emits text segments, each with a loss flag.
``read_back`` recovers turns and loss text from that output alone.

Defined results: null text is the empty text, a null role the empty role (never a valid one); rows of equal turn are
ordered by role, then text; rows with a null conversation id form one conversation with a null id; an empty table
gives no rows; columns besides the four used are ignored. Control strings inside texts and roles are escaped, so a
text can neither close its turn nor open another. A conversation's output is one row, so its turns meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BAD = "", "!"


@dataclass(frozen=True)
class ChatTemplate:
    """Markers around a turn, the automaton's edges (state: roles that may follow; a state is the last role), and the
    roles whose text carries loss."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    control: str = "<|"
    loss_roles: tuple[str, ...] = ("assistant",)
    order: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )


def escape(text: Column, t: ChatTemplate) -> Column:
    """``~`` becomes ``~0``, then the control prefix ``~1`` and a newline of a role ``~2`` (see escape_role)."""
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit(t.control), F.lit("~1"))


def unescape(text: Column, t: ChatTemplate) -> Column:
    """The inverse of escape and escape_role: the marker of ``~`` itself goes last."""
    return F.replace(
        F.replace(F.replace(text, F.lit("~2"), F.lit("\n")), F.lit("~1"), F.lit(t.control)), F.lit("~0"), F.lit("~")
    )


def escape_role(role: Column, t: ChatTemplate) -> Column:
    return F.replace(escape(role, t), F.lit("\n"), F.lit("~2"))


def _next_state(t: ChatTemplate, state: Column, role: Column) -> Column:
    allowed = reduce(
        lambda acc, kv: acc | ((state == kv[0]) & role.isin(*kv[1])),
        t.order.items(),
        F.lit(False),
    )
    return F.when(allowed, role).otherwise(F.lit(BAD))


def format_chats(
    turns: DataFrame,
    template: ChatTemplate = ChatTemplate(),
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: conv id, segments array<struct<text, loss>>, formatted text, valid (turn order)."""
    t = template
    rows = turns.select(
        F.col(conv),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("row"),
    )
    gathered = rows.groupBy(conv).agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def pieces(r: Column) -> Column:
        def segment(x: Column, loss: Column) -> Column:
            return F.struct(x.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(t.open), escape_role(r["role"], t), F.lit(t.after_role))
        return F.array(
            segment(head, F.lit(False)),
            segment(escape(r["text"], t), r["role"].isin(*t.loss_roles)),
            segment(F.lit(t.close), F.lit(False)),
        )

    state = F.aggregate("rows", F.lit(START), lambda s, r: _next_state(t, s, r["role"]))
    return gathered.select(
        conv,
        F.flatten(F.transform("rows", pieces)).alias("segments"),
        (state != BAD).alias("valid"),
    ).withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def read_back(formatted: DataFrame, template: ChatTemplate = ChatTemplate(), conv: str = "conv_id") -> DataFrame:
    """Turns (array<struct<role, text>>) parsed from the formatted text, and the loss text from the loss segments."""
    t = template
    parts = F.filter(F.split("formatted", "\\Q" + t.open + "\\E", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, t.after_role)
        begin = at + len(t.after_role)
        return F.struct(
            unescape(F.substring(p, F.lit(1), at - 1), t).alias("role"),
            unescape(F.substring(p, begin, F.length(p) - begin - len(t.close) + 1), t).alias("text"),
        )

    lost = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t))
    return formatted.select(
        conv,
        F.transform(parts, turn).alias("turns"),
        F.array_join(lost, "").alias("loss_text"),
        "formatted",
        "valid",
    )


def digest(read: DataFrame, conv: str = "conv_id") -> DataFrame:
    joined = F.array_join(
        F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""
    )
    return read.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
