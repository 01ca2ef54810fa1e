"""Loads that can be run again: a load is known by what it holds, and rows it has already written stay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .tables import append_table, create_table

LOAD_KEY = "load_key"


def content_key(rows: DataFrame) -> str:
    """A name for what the rows hold: the same in any order and any partitioning, other with other rows.

    Their number and two sums of 64-bit hashes with different seeds, from one pass and in one result row.
    """
    columns = [F.col(f"`{c}`") for c in sorted(rows.columns)]
    hashes = [F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)") for seed in (1, 2)]
    n, *sums = rows.agg(F.count(F.lit(1)), *(F.sum(h) for h in hashes)).first()
    return "-".join(f"{int(x or 0) % 2**64:016x}" for x in (n, *sums))


def create_loaded_table(rows: DataFrame, table: str, compression: str = "snappy") -> None:
    """An empty table for ``load_once``: the rows' columns and, as partition, the load they came with."""
    create_table(
        rows.sparkSession, table, f"{rows.schema.toDDL()}, {LOAD_KEY} STRING", compression, partitioned_by=[LOAD_KEY]
    )


def load_once(rows: DataFrame, table: str, key: str | None = None) -> int:
    """Append the rows of a load that ``table`` does not have from it yet; returns how many that were.

    A load that broke half-way and is run again adds what is missing; one that had ended adds nothing;
    rows that occur several times in it are there as often. Another load may hold equal rows: loads are
    kept apart by ``key``, by default the key of their content. Only the load's own partition is read. Both
    sides are counted by content before they meet, so a row that occurs very often is one row there.
    """
    if LOAD_KEY in rows.columns:
        raise ValueError(f"the rows have a column {LOAD_KEY} of their own")
    spark, key = rows.sparkSession, content_key(rows) if key is None else key
    columns = [c for c in spark.table(table).columns if c != LOAD_KEY]
    there = spark.table(table).where(F.col(LOAD_KEY) == key)

    def counted(df: DataFrame, prefix: str) -> DataFrame:
        own = df.groupBy(*(F.col(f"`{c}`").alias(f"{prefix}_{i}") for i, c in enumerate(columns)))
        return own.agg(F.count(F.lit(1)).alias(f"{prefix}_n"))

    same = reduce(
        Column.__and__, (F.col(f"new_{i}").eqNullSafe(F.col(f"old_{i}")) for i in range(len(columns)))
    )
    both = counted(rows, "new").join(counted(there, "old"), same, "left")
    missing = both.withColumn("missing", F.col("new_n") - F.coalesce("old_n", F.lit(0))).where("missing > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("missing"))).alias("copy")
    written = Observation()
    wanted = missing.select(
        *(F.col(f"new_{i}").alias(c) for i, c in enumerate(columns)), F.lit(key).alias(LOAD_KEY), copies
    ).drop("copy")
    append_table(wanted.observe(written, F.count(F.lit(1)).alias("n")), table)
    return written.get["n"]
