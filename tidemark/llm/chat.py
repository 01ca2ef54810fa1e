"""Chat formatting: turns to segments of text with loss flags, from a declarative template.

A finite-state machine over roles says whether a conversation's turns are in order. Texts are
escaped reversibly, so that no text can forge a mark of the template.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

REFUSED = "refused"


@dataclass(frozen=True)
class Template:
    """``moves[state][role]`` is the next state; a role that has no move is refused for good."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    after_role: str = "\n"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    first: str = "empty"
    accepted: tuple[str, ...] = ("answered",)
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "empty": {"system": "instructed", "user": "asked"},
            "instructed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )

    def states(self) -> list[str]:
        named = {self.first, *self.moves, *(s for to in self.moves.values() for s in to.values())}
        return [*sorted(named), REFUSED]


CHATML = Template()


def escape(text: Column) -> Column:
    """Put one more backslash between ``<`` and ``|``, so that no mark is left in the text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand on one line before the text, so line ends and ``<`` are spelled out."""
    spelled = F.replace(role, F.lit("%"), F.lit("%25"))
    spelled = F.replace(spelled, F.lit("\n"), F.lit("%0A"))
    return F.replace(spelled, F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    plain = F.replace(role, F.lit("%0A"), F.lit("\n"))
    plain = F.replace(plain, F.lit("%3C"), F.lit("<"))
    return F.replace(plain, F.lit("%25"), F.lit("%"))


def _segments(row: Column, template: Template) -> Column:
    loss = row["role"].isin(*template.loss_roles) if template.loss_roles else F.lit(False)
    head = F.concat(F.lit(template.start), escape_role(row["role"]), F.lit(template.after_role))
    return F.array(
        F.struct(head.alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(row["text"]).alias("text"), loss.alias("loss")),
        F.struct(F.lit(template.end + template.after_turn).alias("text"), F.lit(False).alias("loss")),
    )


def _moves(roles: Column, template: Template) -> Column:
    """What a run of roles does to every state: state -> state."""
    table = F.create_map(
        *(
            F.lit(x)
            for state, to in template.moves.items()
            for role, after in to.items()
            for x in (f"{state}\x00{role}", after)
        )
    )
    states = template.states()

    def after(state: Column, role: Column) -> Column:
        found = F.try_element_at(table, F.concat(state, F.lit("\x00"), role))
        return F.coalesce(found, F.lit(REFUSED))

    begin = F.array(*(F.lit(s) for s in states))
    return F.map_from_arrays(begin, F.transform(begin, lambda s: F.aggregate(roles, s, after)))


def format_chat(
    turns: DataFrame, template: Template = CHATML, turns_per_block: int = 256
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``n_turns``, ``valid``, ``segments`` (text, loss).

    The joined texts of the segments are the formatted conversation. Turns go by ``turn`` (null
    first), ties by role, then text; repeated rows are repeated turns. A null role or text is empty;
    an empty or unknown role is formatted but makes the conversation invalid. A null ``conv_id`` is
    a conversation of its own. Other columns are ignored; an empty table gives no rows.

    Long conversations are formatted in blocks of consecutive turns: blocks of one conversation are
    separate groups, each reduced to its segments and to what it does to the states of the machine
    (functions that compose), before the conversation is put together in its one result row.
    """
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("block", F.floor(F.col("turn") / turns_per_block))
    blocks = (
        rows.groupBy("conv_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
        .select(
            "conv_id",
            "block",
            F.size("rows").cast("long").alias("n"),
            F.flatten(F.transform("rows", lambda r: _segments(r, template))).alias("segments"),
            _moves(F.col("rows.role"), template).alias("moves"),
        )
    )
    whole = blocks.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.array_sort(
            F.collect_list(F.struct("block", "segments", "moves")),
            lambda a, b: F.when(a["block"].eqNullSafe(b["block"]), 0)
            .when(a["block"].isNull() | (a["block"] < b["block"]), -1)
            .otherwise(1),
        ).alias("blocks"),
    )
    last = F.aggregate(
        "blocks", F.lit(template.first), lambda s, b: F.element_at(b["moves"], s)
    )
    return whole.select(
        "conv_id",
        "n_turns",
        last.isin(*template.accepted).alias("valid"),
        F.flatten(F.col("blocks.segments")).alias("segments"),
    )


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column, template: Template = CHATML) -> Column:
    """Parse a formatted conversation back to its turns (role, text)."""
    parts = F.split(text, re.escape(template.start))
    line = template.after_role

    def turn(part: Column) -> Column:
        role = F.substring_index(part, line, 1)
        rest = F.substr(part, F.length(role) + len(line) + 1)
        return F.struct(
            unescape_role(role).alias("role"),
            unescape(F.substring_index(rest, template.end, 1)).alias("text"),
        )

    return let(parts, lambda p: F.transform(F.slice(p, F.lit(2), F.size(p)), turn))


def loss_text(segments: Column) -> Column:
    """Everything under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), ""
    )
