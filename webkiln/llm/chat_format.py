"""Chat formatting with a finite-state machine and a declarative template.

Native DataFrame code only.  The template says how each role opens a turn, how a
turn ends, which roles carry loss and which turn may follow which; everything else
is derived from it as Catalyst expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What marks turns, and the machine that accepts their order.

    ``header`` maps known roles to the text that opens their turns; any other role
    is written, escaped, between ``other_open`` and ``other_close``.  ``controls``
    are the strings, of two characters or more and without backslashes, that must not
    occur in a text as they are: a backslash is put after their first character, and
    every backslash of a text is doubled before.
    ``moves`` maps state to {role: next state}; ``final`` are accepting states.
    """

    header: dict[str, str] = field(
        default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
    )
    other_open: str = "### ["
    other_close: str = "]: "
    end: str = "</turn>"
    controls: tuple[str, ...] = ("</turn>", "###", "]: ")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "primed", "user": "asked"},
            "primed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)


DEFAULT = ChatTemplate()


def escape(text: Column, template: ChatTemplate) -> Column:
    """No control string is left in the result; ``unescape`` gives the text back.

    Controls are looked for at every place, so overlapping ones (as in a run of marks)
    are all broken.
    """
    quoted = [(re.escape(c[0]), re.escape(c[1:])) for c in template.controls]
    places = "|".join(f"{first}(?={rest})" for first, rest in quoted)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({places})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column, template: ChatTemplate) -> Column:
    known = F.create_map(*[F.lit(x) for pair in template.header.items() for x in pair])
    other = F.concat(F.lit(template.other_open), escape(role, template), F.lit(template.other_close))
    return F.coalesce(F.try_element_at(known, role), other)


def _machine(roles: Column, template: ChatTemplate) -> Column:
    """Fold the roles through the moves: the last state and the first bad turn's index."""
    moves = F.create_map(
        *[F.lit(x) for s, to in template.moves.items() for r, t in to.items() for x in (f"{s}\n{r}", t)]
    )

    def step(at: Column, role: Column) -> Column:
        to = F.try_element_at(moves, F.concat(at["state"], F.lit("\n"), role))
        bad = F.when(at["bad"].isNull() & to.isNull(), at["seen"]).otherwise(at["bad"])
        return F.struct(
            F.coalesce(to, at["state"]).alias("state"), bad.cast("int").alias("bad"), (at["seen"] + 1).alias("seen")
        )

    first = F.struct(
        F.lit(template.start).alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("seen")
    )
    return F.aggregate(roles, first, step)


def format_chats(
    turns: DataFrame,
    template: ChatTemplate = DEFAULT,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: segments with loss flags, the formatted text, validity.

    ``segments`` is array<struct<text, loss>>; ``formatted`` is their concatenation;
    ``valid`` tells whether the machine accepts the roles, ``bad_turn`` the index of
    the first turn it refuses.  Invalid conversations are formatted as well.  Rows
    are ordered by turn, ties by role and text; repeated rows are turns of their own.
    Null role or text: empty.  Rows with a null conversation id form one
    conversation.  Texts of any length are written whole; a conversation, like the
    output row it becomes, is put together in one task.  Other columns of ``turns`` are
    not read, whatever their names.  An empty table gives no rows.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("row"),
    )
    chats = rows.groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    end = F.lit(template.end)
    segments = F.flatten(
        F.transform(
            "rows",
            lambda r: F.array(
                F.struct(_header(r["role"], template).alias("text"), F.lit(False).alias("loss")),
                F.struct(
                    escape(r["text"], template).alias("text"), r["role"].isin(*template.loss_roles).alias("loss")
                ),
                F.struct(end.alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    chats = chats.select(
        "conv", segments.alias("segments"), _machine(F.transform("rows", lambda r: r["role"]), template).alias("at")
    )
    return chats.select(
        F.col("conv").alias(conv_col),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("at.bad").isNull() & F.col("at.state").isin(*template.final)).alias("valid"),
        F.col("at.bad").alias("bad_turn"),
    )


def read_turns(formatted: Column, template: ChatTemplate = DEFAULT) -> Column:
    """The turns of a formatted text as array<struct<role, text>>, unescaped."""
    pieces = F.split(formatted, "\\Q" + template.end + "\\E", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def parse(piece: Column) -> Column:
        role, body = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, header in template.header.items():
            is_it = F.startswith(piece, F.lit(header))
            role = F.coalesce(role, F.when(is_it, F.lit(name)))
            body = F.coalesce(body, F.when(is_it, F.substr(piece, F.lit(len(header) + 1))))
        start = len(template.other_open) + 1
        close = F.position(F.lit(template.other_close), piece)
        other_role = F.substr(piece, F.lit(start), close - start)
        other_body = F.substr(piece, close + len(template.other_close))
        return F.struct(
            unescape(F.coalesce(role, other_role)).alias("role"), unescape(F.coalesce(body, other_body)).alias("text")
        )

    return F.transform(pieces, parse)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: unescape(s["text"])), "")
