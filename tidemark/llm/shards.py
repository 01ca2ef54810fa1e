"""Sharding by jump consistent hashing, without a ring table and without a shuffle.

A row's shard depends on its key and the number of shards only. With one more shard, a row stays
where it is or moves into the new one. The published generator steps a 64-bit key; products modulo
2**64 are put together from 32-bit halves, since SQL arithmetic may not overflow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

# Fixed value: multiplier of the published generator.
MULTIPLIER = 2862933555777941757
HALF = (1 << 32) - 1
FIRST_STEPS = 48


def _step(state: Column, shards: int) -> Column:
    """One jump. ``key * MULTIPLIER + 1`` modulo 2**64, by halves."""
    high, low = state["high"], state["low"]
    m_high, m_low = MULTIPLIER >> 32, MULTIPLIER & HALF
    m_mid, m_end = m_low >> 16, m_low & 0xFFFF
    middle = low * F.lit(m_mid)
    bottom = (
        low * F.lit(m_end) + F.shiftleft(middle.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    )
    from_high = high * F.lit(m_end) + F.shiftleft(
        (high * F.lit(m_mid)).bitwiseAND(F.lit(0xFFFF)), 16
    )
    top = F.shiftright(bottom, 32) + F.shiftright(middle, 16) + low * F.lit(m_high) + from_high

    def jumped(halves: Column) -> Column:
        spread = F.lit(float(1 << 31)) / (F.shiftright(halves["high"], 1) + 1).cast("double")
        return F.struct(
            state["next"].alias("at"),
            ((state["next"] + 1).cast("double") * spread).cast("long").alias("next"),
            halves["high"].alias("high"),
            halves["low"].alias("low"),
        )

    halves = F.struct(
        top.bitwiseAND(F.lit(HALF)).alias("high"), bottom.bitwiseAND(F.lit(HALF)).alias("low")
    )
    moved = F.element_at(F.transform(F.array(halves), jumped), 1)
    return F.when(state["next"] < shards, moved).otherwise(state)


def jump_shard(key: Column, shards: int) -> Column:
    """Shard from 0 to ``shards - 1`` of a 64-bit key; a null key counts as 0.

    A key takes about ln(shards) jumps. The first pass makes up to 48; the rare key that needs more
    gets as many as there are shards, which always suffices.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.lit(-1).cast("long").alias("at"),
        F.lit(0).cast("long").alias("next"),
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(F.lit(HALF)).alias("low"),
    )
    steps = F.sequence(F.lit(1), F.lit(min(shards, FIRST_STEPS)))
    if shards <= FIRST_STEPS:
        return F.aggregate(steps, start, lambda s, _: _step(s, shards), lambda s: s["at"].cast("int"))
    first = F.aggregate(steps, start, lambda s, _: _step(s, shards))
    return F.element_at(
        F.transform(
            F.array(first),
            lambda s: F.aggregate(
                F.when(s["next"] < shards, F.sequence(F.lit(1), F.lit(shards))).otherwise(
                    F.array().cast("array<int>")
                ),
                s,
                lambda t, _: _step(t, shards),
                lambda t: t["at"].cast("int"),
            ),
        ),
        1,
    )


def stable_key(df: DataFrame, key: str) -> Column:
    """Whole numbers are their own key; anything else is hashed."""
    kind = dict(df.dtypes)[key]
    column = F.col(f"`{key}`")
    return column.cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(column)


def assign_shards(df: DataFrame, key: str, shards: int, out: str = "shard") -> DataFrame:
    """All columns and the shard. Narrow: no shuffle, whatever the skew of other columns.

    Rows with the same key, null included, share a shard. An empty table stays empty. A column
    that is already named like ``out`` is replaced.
    """
    return df.withColumn(out, jump_shard(stable_key(df, key), shards))


def number_in_shard(
    df: DataFrame, shard: str, order: list[str], out: str = "slot", rows_per_block: int = 16_384
) -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Each shard is cut into blocks by a hash of the ordering columns, so their number grows with the
    rows. Blocks are counted, their counts added up (a row per block), and rows numbered inside
    blocks; no task sees a whole shard. Order: block, then the ordering columns; rows equal in all
    of these get adjacent numbers in any order.
    """
    blocks = max(1, math.ceil(df.count() / rows_per_block))
    columns = [F.col(f"`{c}`") for c in order]
    rows = df.select(
        F.struct("*").alias("row"),
        F.col(f"`{shard}`").alias("_shard"),
        F.pmod(F.xxhash64(F.lit(17), *columns), F.lit(blocks)).alias("_block"),
        F.struct(*columns).alias("_order"),
    )
    counts = rows.groupBy("_shard", "_block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_shard").orderBy("_block")
    offsets = staged(
        counts.select("_shard", "_block", (F.sum("n").over(before) - F.col("n")).alias("first")),
        "offsets",
    )
    inside = Window.partitionBy("_shard", "_block").orderBy("_order")
    numbered = rows.withColumn("_number", F.row_number().over(inside) - 1)
    kept = [F.col(f"row.`{c}`").alias(c) for c in df.columns if c != out]
    return numbered.join(offsets, ["_shard", "_block"]).select(
        *kept, (F.col("first") + F.col("_number")).cast("long").alias(out)
    )
