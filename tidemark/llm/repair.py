"""Repair of conversations: the cheapest edits that give a legal order of roles.

Every row is kept, given another role, or deleted, and empty turns can be inserted, each at a cost. The
result must read ``(s?(ua)+)?`` by the initials of its roles. The weight of a way to edit is one big
integer: its high digits are the cost, and below them stand, in octal places of fixed number, the letters
of the audit from left to right, zeros behind the last. The integer that is least is the cheapest way,
and of those the one whose audit comes first in ASCII. A dynamic program over (rows read, state) keeps
the least integer of each node. (Of two ways to one node neither audit begins the other: both hold one
letter a row and end with a row's letter, since insertions are written just before the row they precede.
So the places that follow cannot turn their order.)

Spark deals rows out by ranges of (conversation, turn), so that a long conversation lies in many tasks.
A task reads its range in order and forgets each block of rows when it is done. A conversation that lies
in one block is settled at once. Of the others each block tells the least weight from every state to
every state, a pass over these, last block first, settles the states between blocks, and the blocks are
then edited apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import BLANKS, staged

USER, ASSISTANT = "user", "assistant"
#: Rows and characters of a block.
BLOCK_ROWS = 128
BLOCK_CHARS = 1 << 20
#: Copies of each repeated turn's first place, over which the rows of one conversation are dealt.
SALTS = 16

# States: nothing yet, after the system's turn, after a user's, after an assistant's.
BEGIN, SYSTEM, ASKED, ANSWERED = range(4)
STATES = range(4)
#: The states that may follow each state, and the initials that lead there.
NEXT = {BEGIN: {"s": SYSTEM, "u": ASKED}, SYSTEM: {"u": ASKED}, ASKED: {"a": ANSWERED}, ANSWERED: {"u": ASKED}}
#: The initial an edit can write in each state.
WRITES = {BEGIN: "u", SYSTEM: "u", ASKED: "a", ANSWERED: "u"}
#: Insertions that end a conversation legally.
CLOSING = {BEGIN: 0, SYSTEM: 2, ASKED: 1, ANSWERED: 0}
LEGAL_PAIRS = {"su", "ua", "au"}
# Audit letters in the order of ASCII; zero is the end.
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = " DIKR"


@dataclass(frozen=True)
class Costs:
    """What edits cost. Insertion must cost something."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


Row = tuple[str, str, bool, bool]  # role, text, must go, is truncated


def width(rows: int) -> int:
    """Octal places for the audit of a block: a letter and an insertion a row."""
    return 2 * rows


def block_weights(rows: list[Row], entries: Iterable[int], costs: Costs) -> dict[tuple[int, int], int]:
    """The least weight from each entry state to each state after the rows."""
    bits = 3 * width(len(rows))
    found = {}
    for entry in entries:
        # state -> (weight, bits left below the last letter)
        best = {entry: (0, bits)}
        for role, _, must_go, truncated in rows:
            steps: dict[int, tuple[int, int]] = {}
            initial = role[:1]
            added = costs.truncated if truncated else 0
            for state, (weight, left) in best.items():
                ways = [(state, weight + (costs.delete << bits) + (DELETE << left - 3), left - 3)]
                if not must_go:
                    ways += _kept(state, initial, weight, left, bits, costs, added)
                    inserted = weight + (costs.insert << bits) + (INSERT << left - 3)
                    between = NEXT[state][WRITES[state]]
                    ways += _kept(between, initial, inserted, left - 3, bits, costs, added)
                for to, total, rest in ways:
                    if to not in steps or total < steps[to][0]:
                        steps[to] = total, rest
            best = steps
        for state, (weight, _) in best.items():
            found[entry, state] = weight
    return found


def _kept(
    state: int, initial: str, weight: int, left: int, bits: int, costs: Costs, added: int
) -> list[tuple[int, int, int]]:
    """The ways to let a row stand after ``state``: as it is, or under the role that must follow."""
    ways = []
    if initial in NEXT[state]:
        letter = (costs.keep + added << bits) + (KEEP << left - 3)
        ways.append((NEXT[state][initial], weight + letter, left - 3))
    if initial != WRITES[state]:
        letter = (costs.rerole + added << bits) + (REROLE << left - 3)
        ways.append((NEXT[state][WRITES[state]], weight + letter, left - 3))
    return ways


@dataclass
class Rest:
    """The cheapest ways from each state to the end: their cost, and the rank of their audit."""

    cost: dict[int, int]
    rank: dict[int, int]

    @staticmethod
    def end(costs: Costs) -> Rest:
        return Rest({s: n * costs.insert for s, n in CLOSING.items()}, dict(CLOSING))

    def before(self, weights: dict[tuple[int, int], int], rows: int) -> tuple[Rest, dict[int, int]]:
        """The same one block earlier, and the state each entry leaves that block in."""
        bits = 3 * width(rows)
        best: dict[int, tuple[int, int]] = {}
        for (entry, state), weight in weights.items():
            whole = (weight + (self.cost[state] << bits) << 3) + self.rank[state]
            if entry not in best or whole < best[entry][0]:
                best[entry] = whole, state
        low = (1 << bits + 3) - 1
        order = {audit: i for i, audit in enumerate(sorted({w & low for w, _ in best.values()}))}
        return (
            Rest({e: w >> bits + 3 for e, (w, _) in best.items()}, {e: order[w & low] for e, (w, _) in best.items()}),
            {e: s for e, (_, s) in best.items()},
        )


def letters(weight: int, rows: int) -> str:
    low = weight & ((1 << 3 * width(rows)) - 1)
    spelled = f"{low:0{width(rows)}o}".rstrip("0")
    return "".join(LETTERS[int(x)] for x in spelled)


def edited(rows: list[Row], audit: str, state: int) -> list[tuple[str, str]]:
    """The turns an audit makes of the rows, begun in a state."""
    left, turns = iter(rows), []
    for letter in audit:
        role, text, _, _ = ("", "", False, False) if letter == "I" else next(left)
        if letter == "D":
            continue
        initial = role[:1] if letter == "K" else WRITES[state]
        if letter != "K":
            role = USER if initial == "u" else ASSISTANT
        turns.append((role, text))
        state = NEXT[state][initial]
    return turns


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:]))


# -- rows


def _is_blank(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS)) == ""


def _ends_open(text: Column) -> Column:
    return ~F.right(F.btrim(text, F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?")


def spelled_rows(turns: DataFrame) -> DataFrame:
    """Rows with a hash of role and text (``said``), and whether the text is ``blank`` or ends open
    (``truncated``). Null roles and texts are one space."""
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.select(
        "*",
        F.unhex(F.sha2(said.cast("binary"), 256)).alias("said"),
        _is_blank(F.col("text")).alias("blank"),
        _ends_open(F.col("text")).alias("truncated"),
    )


def places_of(rows: DataFrame) -> DataFrame:
    """Where what is said stands and how often (``n``), without the texts; written to the shared folder."""
    found = rows.groupBy("conv_id", "turn", "said").agg(
        F.count(F.lit(1)).alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")
    )
    return staged(found, "places")


def first_places(places: DataFrame) -> DataFrame:
    """The earliest turn of what stands under several turn numbers, once for each salt; written to the shared
    folder, so that Spark knows its size before it plans to move texts for it."""
    several = (
        places.groupBy("conv_id", "said")
        .agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("turn")).alias("first_place"))
        .where("places > 1")
    )
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt")
    return staged(
        several.select(F.col("conv_id").alias("of_conv"), F.col("said").alias("of_said"), "first_place", salts), "first"
    )


def with_first(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Rows with ``first``: is it the earliest of its role and text in the conversation?

    The rows of one conversation and text are dealt to as many tasks as there are salts.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int"))
    found = salted.join(
        first,
        F.col("conv_id").eqNullSafe(F.col("of_conv"))
        & (F.col("said") == F.col("of_said"))
        & (F.col("salt") == F.col("of_salt")),
        "left",
    )
    is_first = F.col("first_place").isNull() | F.col("first_place.turn").eqNullSafe(F.col("turn"))
    return found.select(*rows.columns, is_first.alias("first"))


def fault_counts(rows: DataFrame) -> DataFrame:
    """Per conversation, from places with ``first``: ``gaps`` in its turn numbers, and ``blank``,
    ``duplicate`` and ``truncated`` rows, each row by its first fault."""
    original = F.when(F.col("first"), 1).otherwise(0)
    turns = rows.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("n") - original).otherwise(0)).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & F.col("truncated"), original).otherwise(0)).alias("truncated"),
    )
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
    )


# -- blocks


def _fields(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


_BLOCK = (
    "part int, block int, n_rows long, whole boolean, first_role string, last_role string, illegal long, "
    "cost long, audit string, turns array<struct<role: string, text: string, must_go: boolean, truncated: boolean>>, "
    "weights array<struct<entry: int, state: int, weight: string>>"
)
_TURN_TYPE = pa.struct([("role", pa.string()), ("text", pa.string())])
_ROW_TYPE = pa.struct([*_TURN_TYPE, ("must_go", pa.bool_()), ("truncated", pa.bool_())])
_WEIGHT_TYPE = pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("weight", pa.string())])
_BLOCK_TYPES = {
    "part": pa.int32(), "block": pa.int32(), "n_rows": pa.int64(), "whole": pa.bool_(),
    "first_role": pa.string(), "last_role": pa.string(), "illegal": pa.int64(), "cost": pa.int64(),
    "audit": pa.string(), "turns": pa.list_(_ROW_TYPE), "weights": pa.list_(_WEIGHT_TYPE),
}


def _rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, int, Row]]:
    """Conversation, partition and row; equal rows one by one, all but the first to be deleted."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text", "n", "first", "blank", "truncated")]
        for conv, part, role, text, n, first, blank, truncated in zip(*columns):
            yield conv, part, (role, text, blank or not first, truncated and first and not blank)
            for _ in range(n - 1):
                yield conv, part, (role, "", True, False)


def _cut(rows: Iterable[tuple[object, int, Row]]) -> Iterator[tuple[object, int, list[Row], bool]]:
    """Blocks of one conversation's consecutive rows, and whether the conversation goes on behind."""
    for conv, group in groupby(rows, key=lambda r: r[0]):
        block: list[Row] = []
        chars = 0
        for _, part, row in group:
            if len(block) == BLOCK_ROWS or (block and chars + len(row[1]) > BLOCK_CHARS):
                yield conv, part, block, True
                block, chars = [], 0
            block.append(row)
            chars += len(row[1])
        yield conv, part, block, False


def _in_batches(rows: Iterable[dict], conv_type: pa.DataType, types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Record batches of at most 512 rows or some 8 MB of text."""
    types = {"conv_id": conv_type, **types}
    held: list[dict] = []
    chars = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], t) for c, t in types.items()], names=list(types))

    for row in rows:
        held.append(row)
        chars += row.pop("chars", 0)
        if len(held) >= 512 or chars > 1 << 23:
            yield batch()
            held, chars = [], 0
    if held:
        yield batch()


def _block_maker(costs: Costs):
    def blocks(rows: Iterator[tuple[object, int, Row]]) -> Iterator[dict]:
        cut = _cut(rows)
        number, continues, is_first = 0, False, True
        ahead = next(cut, None)
        while ahead is not None:
            conv, part, block, goes_on = ahead
            ahead = next(cut, None)
            number = number + 1 if continues else 0
            # A conversation at an edge of the task may have rows in another task.
            whole = not (continues or goes_on or is_first or ahead is None)
            is_first, continues = is_first and goes_on, goes_on
            yield _block_row(conv, part, number, block, whole)

    def _block_row(conv: object, part: int, number: int, rows: list[Row], whole: bool) -> dict:
        weights = block_weights(rows, (BEGIN,) if whole else STATES, costs)
        initials = [r[0][:1] for r in rows]
        row = {
            "conv_id": conv, "part": part, "block": number, "n_rows": len(rows), "whole": whole,
            "first_role": initials[0], "last_role": initials[-1], "illegal": illegal_pairs(initials),
            "cost": None, "audit": None, "weights": None, "chars": sum(len(r[1]) for r in rows),
        }
        as_dicts = [dict(zip(("role", "text", "must_go", "truncated"), r)) for r in rows]
        if not whole:
            spelled = [{"entry": e, "state": s, "weight": format(w, "x")} for (e, s), w in weights.items()]
            return row | {"turns": as_dicts, "weights": spelled}
        rest, leaves = Rest.end(costs).before(weights, len(rows))
        state = leaves[BEGIN]
        audit = letters(weights[BEGIN, state], len(rows)) + "I" * CLOSING[state]
        turns = [
            {"role": r, "text": t, "must_go": False, "truncated": False} for r, t in edited(rows, audit, BEGIN)
        ]
        return row | {"cost": rest.cost[BEGIN], "audit": audit, "turns": turns}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            kind = first.schema.field("conv_id").type
            yield from _in_batches(blocks(_rows_of(chain([first], batches))), kind, _BLOCK_TYPES)

    return make


_LEAVES = {"part": pa.int32(), "block": pa.int32(), "leaves": pa.list_(pa.int32()), "cost": pa.int64(), "last": pa.bool_()}
_PATH = {
    "part": pa.int32(), "block": pa.int32(), "entry": pa.int32(), "state": pa.int32(),
    "cost": pa.int64(), "last": pa.bool_(),
}
_EDITED = {
    "part": pa.int32(), "block": pa.int32(), "n_rows": pa.int64(), "whole": pa.bool_(), "first_role": pa.string(),
    "last_role": pa.string(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "turns": pa.list_(_TURN_TYPE),
}
_EDITED_DDL = (
    "part int, block int, n_rows long, whole boolean, first_role string, last_role string, illegal long, cost long, "
    "audit string, turns array<struct<role: string, text: string>>"
)
_SUMMARY = {"illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}


def _mapper(rows_to_rows, types: dict[str, pa.DataType]):
    """A function of record batches from one of rows; the type of ``conv_id`` is kept."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            kind = first.schema.field("conv_id").type
            rows = (row for batch in chain([first], batches) for row in batch.to_pylist())
            yield from _in_batches(rows_to_rows(rows), kind, types)

    return make


def _leaves_of(costs: Costs):
    """Blocks of conversations, last block first: the state in which each entry leaves a block, and what
    the rest of the conversation costs from its beginning."""

    def settle(rows: Iterator[dict]) -> Iterator[dict]:
        for _, blocks in groupby(rows, key=lambda r: r["conv_id"]):
            rest = Rest.end(costs)
            for i, row in enumerate(blocks):
                weights = {(w["entry"], w["state"]): int(w["weight"], 16) for w in row["weights"]}
                rest, leaves = rest.before(weights, row["n_rows"])
                yield row | {"leaves": [leaves[s] for s in STATES], "cost": rest.cost[BEGIN], "last": i == 0}

    return settle


def _path(rows: Iterator[dict]) -> Iterator[dict]:
    """Blocks of conversations, first block first: the states each begins and ends in; the cost of the
    conversation stands with its first block."""
    for _, blocks in groupby(rows, key=lambda r: r["conv_id"]):
        state = BEGIN
        for i, row in enumerate(blocks):
            entry, state = state, row["leaves"][state]
            yield row | {"entry": entry, "state": state, "cost": 0 if i else row["cost"]}


def _edit(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        weight = next(
            int(w["weight"], 16) for w in row["weights"] if (w["entry"], w["state"]) == (row["entry"], row["end_state"])
        )
        audit = letters(weight, row["n_rows"]) + "I" * (CLOSING[row["end_state"]] if row["last"] else 0)
        block = [(t["role"], t["text"], t["must_go"], t["truncated"]) for t in row["turns"]]
        turns = [{"role": r, "text": t} for r, t in edited(block, audit, row["entry"])]
        yield row | {"audit": audit, "turns": turns, "chars": sum(len(t["text"]) for t in turns)}


def _summarise(rows: Iterator[dict]) -> Iterator[dict]:
    """Edited blocks in order: one row per conversation, its text hashed block by block."""
    for conv, blocks in groupby(rows, key=lambda r: r["conv_id"]):
        digest, before, any_turn = hashlib.sha256(), None, False
        audit, cost, illegal = [], 0, 0
        for row in blocks:
            audit.append(row["audit"])
            cost += row["cost"]
            illegal += row["illegal"]
            if before is not None:
                illegal += before + row["first_role"] not in LEGAL_PAIRS
            before = row["last_role"]
            for turn in row["turns"]:
                digest.update(f"{chr(10) if any_turn else ''}{turn['role']}:{turn['text']}".encode())
                any_turn = True
        yield {
            "conv_id": conv, "illegal": illegal, "cost": cost, "audit": "".join(audit),
            "repaired_sha256": digest.hexdigest(),
        }


PLACE = ["conv_id", "part", "block"]
_PARTS = ("n_rows", "whole", "first_role", "last_role", "illegal")


def repaired_parts(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Repaired conversations from different rows with their number ``n`` and ``first``, mostly one row each.

    Columns: ``conv_id``, ``part``, ``block`` (the order of a conversation's parts), ``whole`` (is it the only
    one?), ``n_rows``, ``first_role`` and ``last_role`` (initials before the repair), ``illegal``, ``cost`` (of
    the conversation, in its first part; else 0), ``audit``, ``turns`` (role, text).
    """
    conv = rows.schema["conv_id"]

    def schema(ddl: str) -> StructType:
        return StructType([conv, *_fields(ddl)])

    order = ["conv_id", "turn", "role", "said"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = staged(
        dealt.select("conv_id", F.spark_partition_id().alias("part"), "role", "text", "n", "first", "blank", "truncated")
        .mapInArrow(_block_maker(costs), schema(_BLOCK)),
        "blocks",
    )
    turn = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    whole = blocks.where("whole").select(*PLACE, *_PARTS, "cost", "audit", F.transform("turns", turn).alias("turns"))
    cut = blocks.where("not whole")
    narrow = cut.select(*PLACE, "n_rows", "weights").repartition("conv_id")
    backward = narrow.sortWithinPartitions("conv_id", F.desc("part"), F.desc("block")).mapInArrow(
        _mapper(_leaves_of(costs), _LEAVES), schema("part int, block int, leaves array<int>, cost long, last boolean")
    )
    forward = backward.repartition("conv_id").sortWithinPartitions(*PLACE).mapInArrow(
        _mapper(_path, _PATH), schema("part int, block int, entry int, state int, cost long, last boolean")
    )
    path = staged(forward.withColumnsRenamed({c: f"to_{c}" for c in PLACE}), "path")
    same = F.col("conv_id").eqNullSafe(F.col("to_conv_id")) & (F.col("part") == F.col("to_part")) & (
        F.col("block") == F.col("to_block")
    )
    asked = cut.drop("cost", "audit").join(path, same).withColumn("end_state", F.col("state"))
    edits = asked.select(*PLACE, *_PARTS, "cost", "turns", "weights", "entry", "end_state", "last").mapInArrow(
        _mapper(_edit, _EDITED), schema(_EDITED_DDL)
    )
    return whole.unionByName(edits)


def summaries(parts: DataFrame) -> DataFrame:
    """Per conversation with rows: ``illegal``, ``cost``, ``audit`` and ``repaired_sha256``, the hash of all
    ``role:text`` joined by newlines."""
    conv = parts.schema["conv_id"]
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    digest = F.sha2(F.array_join(lines, "\n").cast("binary"), 256)
    whole = parts.where("whole").select("conv_id", "illegal", "cost", "audit", digest.alias("repaired_sha256"))
    schema = StructType([conv, *_fields("illegal long, cost long, audit string, repaired_sha256 string")])
    streamed = (
        parts.where("not whole")
        .repartition("conv_id")
        .sortWithinPartitions(*PLACE)
        .mapInArrow(_mapper(_summarise, _SUMMARY), schema)
    )
    return whole.unionByName(streamed)


def repair(turns: DataFrame, costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """The repaired conversations in parts (see ``repaired_parts``), and one row of findings for each
    ``conv_id`` of the rows: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit``, ``repaired_sha256``.

    Rows go by ``turn`` (null first), ties by role, then by a hash of the text; repeated rows are repeated
    turns, so that all but the first are duplicates. A null ``conv_id`` is a conversation of its own, null
    roles and texts are one space. A role is known by its first character; one with no known initial cannot
    be kept. Other columns are ignored, whatever their names. An empty table gives no rows.

    Equal rows are counted before they move. Texts are moved twice, to be counted and into their ranges, and
    written once, in blocks; faults are counted without them.
    """
    rows = spelled_rows(turns)
    places = places_of(rows)
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    first = first_places(places)
    parts = repaired_parts(with_first(counted, first), costs)
    found = summaries(parts).withColumnRenamed("conv_id", "of_conv")
    counts = fault_counts(with_first(places, first))
    both = counts.join(found, F.col("conv_id").eqNullSafe(F.col("of_conv")))
    return parts, both.drop("of_conv")
