"""Fill-in-the-middle: cut texts at unit boundaries and move the middle to the end, reversibly.

A unit is a word with the blanks before it, or the blanks at the end of a text. Each text is cut into
fixed blocks of bytes; a Fenwick tree over the blocks holds their numbers of unit ends and of code points.
A cut after the k-th unit descends the tree by binary lifting to the block that holds that unit's end,
and only that block is searched for the place. Spark deals the texts out; the helper in Python returns
three numbers a text, from which Spark builds the output and, apart from that, the text again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Bytes in a block.
BLOCK = 4096

_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Marks:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class Fenwick:
    """Prefix sums of two counts over blocks, and the block in which the k-th unit ends."""

    def __init__(self, units: list[int], chars: list[int]) -> None:
        self.n = len(units)
        self.units, self.chars = [0, *units], [0, *chars]
        for i in range(1, self.n + 1):
            above = i + (i & -i)
            if above <= self.n:
                self.units[above] += self.units[i]
                self.chars[above] += self.chars[i]

    def descend(self, k: int) -> tuple[int, int, int]:
        """The number of blocks that together hold fewer than ``k`` units, their units and code points."""
        at = units = chars = 0
        step = 1 << self.n.bit_length() >> 1
        while step:
            if at + step <= self.n and units + self.units[at + step] < k:
                at += step
                units += self.units[at]
                chars += self.chars[at]
            step >>= 1
        return at, units, chars


class BlockedText:
    """One text in UTF-8, counted by blocks."""

    def __init__(self, data: np.ndarray, block: int = BLOCK) -> None:
        self.data, self.block = data, block
        starts = np.arange(0, len(data), block)
        units = [int(np.count_nonzero(self._ends(i))) for i in range(len(starts))]
        chars = [int(np.count_nonzero(self._chars(i))) for i in range(len(starts))]
        self.n_units, self.tree = sum(units), Fenwick(units, chars)

    def _ends(self, i: int) -> np.ndarray:
        """For each byte of a block: does a unit end there? Units end before a blank, and with the text."""
        stop = (i + 1) * self.block
        blank = _IS_BLANK[self.data[i * self.block : stop + 1]]
        if stop < len(self.data):
            return ~blank[:-1] & blank[1:]
        ends = ~blank
        ends[:-1] &= blank[1:]
        ends[-1] = True
        return ends

    def _chars(self, i: int) -> np.ndarray:
        """For each byte of a block: does a code point begin there?"""
        return (self.data[i * self.block : (i + 1) * self.block] & 0xC0) != 0x80

    def chars_before(self, k: int) -> int:
        """The code points of the first ``k`` units."""
        if k <= 0:
            return 0
        at, units, chars = self.tree.descend(k)
        place = np.flatnonzero(self._ends(at))[k - units - 1] + 1
        return chars + int(np.count_nonzero(self._chars(at)[:place]))


def cut(text: bytes, first: int, second: int, block: int = BLOCK) -> tuple[int, int, int]:
    """Units of a text, and the code points of its prefix and middle for two draws."""
    if not text:
        return 0, 0, 0
    blocks = BlockedText(np.frombuffer(text, dtype=np.uint8), block)
    a, b = sorted((first % (blocks.n_units + 1), second % (blocks.n_units + 1)))
    before = blocks.chars_before(a)
    return blocks.n_units, before, blocks.chars_before(b) - before


_CUTS = StructType([StructField(c, LongType()) for c in ("n", "prefix_chars", "middle_chars")])


@F.arrow_udf(_CUTS)
def _cuts(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    found = [cut(t.as_buffer(), a.as_py(), b.as_py()) for t, a, b in zip(text, first, second)]
    columns = zip(*found) if found else ([], [], [])
    return pa.StructArray.from_arrays(
        [pa.array(c, pa.int64()) for c in columns], ["n", "prefix_chars", "middle_chars"]
    )


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of seed and id; a null id is spelled as nothing."""
    spelled = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(spelled.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    seed: int = 42,
    percent: int = 50,
    spm_percent: int = 80,
    marks: Marks = Marks(),
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n`` (units), ``form``, ``prefix_chars``,
    ``middle_chars``, ``text``, ``output``.

    ``percent`` of the texts are cut at two drawn units into prefix, middle and suffix, and written as
    suffix, prefix, middle (form ``spm``, ``spm_percent`` of those cut) or prefix, suffix, middle
    (``psm``), each part behind its mark. All others, the empty texts and those that hold a mark are
    ``plain``: the output is the text, both counts are null. Draws depend on seed and id alone, so
    repeated rows come out alike and reruns agree.

    A null text is empty (no units), a null id is drawn for as one spelled with no digits. Parts may be
    empty. Columns other than ``doc_id`` and ``text`` are ignored, whatever their names. An empty table
    gives no rows. A task holds a batch of texts and the counts of one text's blocks.
    """
    first, second, third, fourth = draws(F.col("doc_id"), seed)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marked = F.lit(False)
    for mark in marks.all():
        marked = marked | F.contains("text", F.lit(mark))
    form = (
        F.when((F.col("text") == "") | marked | (third % 100 >= percent), "plain")
        .when(fourth % 100 < spm_percent, "spm")
        .otherwise("psm")
    )
    cuts = _cuts(F.col("text").cast("binary"), first, second)
    found = rows.select("doc_id", "text", form.alias("form"), cuts.alias("cuts"))
    is_cut = F.col("form") != "plain"
    n, m = F.col("cuts.prefix_chars"), F.col("cuts.middle_chars")
    whole = F.length("text").cast("long")
    part = lambda start, length: F.substr("text", start.cast("int"), length.cast("int"))
    prefix = F.concat(F.lit(marks.prefix), part(F.lit(1), n))
    middle = F.concat(F.lit(marks.middle), part(n + 1, m))
    suffix = F.concat(F.lit(marks.suffix), part(n + m + 1, whole))
    return found.select(
        "doc_id",
        F.col("cuts.n").alias("n"),
        "form",
        F.when(is_cut, n).alias("prefix_chars"),
        F.when(is_cut, m).alias("middle_chars"),
        "text",
        F.when(F.col("form") == "spm", F.concat(suffix, prefix, middle))
        .when(F.col("form") == "psm", F.concat(prefix, suffix, middle))
        .otherwise(F.col("text"))
        .alias("output"),
    )


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text again, from output and form alone: no part holds a mark, and a part's end and the mark
    after it cannot make one, so the first mark found is the true one."""
    second = F.when(form == "spm", marks.prefix).otherwise(marks.suffix)
    head = F.split_part(output, second, F.lit(1))
    tail = F.substr(output, F.length(head) + F.length(second) + 1)
    tail_first = F.split_part(tail, F.lit(marks.middle), F.lit(1))
    tail_last = F.substr(tail, F.length(tail_first) + len(marks.middle) + 1)
    body = F.substr(head, F.when(form == "spm", len(marks.suffix)).otherwise(len(marks.prefix)) + 1)
    return (
        F.when(form == "spm", F.concat(tail_first, tail_last, body))
        .when(form == "psm", F.concat(body, tail_last, tail_first))
        .otherwise(output)
    )
