"""Name pipelines and the migration of a directory of files into a table."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaned_name, filled_score, part_count
from ..operators import Transform, VersionedTable, days
from ..sources import append_table, create_table, load_directory, overwrite_table_partitions
from ..sources.conform import ROWS

# Table layouts and labels.
NAME_INPUT = "id BIGINT, full_name STRING"
NAME_OUTPUT = (
    "id BIGINT, original_full_name STRING, processed_full_name STRING, "
    "name_parts_count INT, processing_timestamp TIMESTAMP"
)
MIGRATED_INPUT = (
    "id BIGINT, full_name STRING, first_name STRING, last_name STRING, "
    "processed_date TIMESTAMP, source_system STRING"
)
SCORED_OUTPUT = f"{NAME_OUTPUT}, pipeline_version STRING, data_quality_score DOUBLE"
SOURCE_SYSTEM = "legacy_migration"
PIPELINE_VERSION = "v1.0"
NAME_CODEC = "gzip"
NAME_DAY = days("processing_timestamp")


def _moment(run_ts: str | datetime | None) -> Column:
    return F.current_timestamp() if run_ts is None else F.lit(str(run_ts)).cast("timestamp")


def summarize_names(df: DataFrame, run_ts: str | datetime | None = None) -> DataFrame:
    """Clean each name and count its parts. Column 0 is the id and column 1 the name, whatever
    they are called; a missing id column counts as 1 and a missing name column as empty."""
    given = [F.col(f"`{name}`") for name in df.columns[:2]]
    row_id, name = given + [F.lit(1).cast("long"), F.lit("")][len(given) :]
    return df.select(
        row_id.alias("id"),
        name.alias("original_full_name"),
        cleaned_name(name).alias("processed_full_name"),
        part_count(name).alias("name_parts_count"),
        _moment(run_ts).alias("processing_timestamp"),
    )


def score_names(
    df: DataFrame, run_ts: str | datetime | None = None, version: str = PIPELINE_VERSION
) -> DataFrame:
    """``summarize_names`` on the columns ``id`` and ``full_name``, with version and quality."""
    return summarize_names(df.select("id", "full_name"), run_ts).select(
        "*",
        F.lit(version).alias("pipeline_version"),
        filled_score(F.col("original_full_name")).alias("data_quality_score"),
    )


def create_output(
    spark: SparkSession, path: str, schema: str, by: Transform = days("processing_timestamp")
) -> VersionedTable:
    return VersionedTable.create(
        spark, path, schema, partition_by=[by], compression=NAME_CODEC, if_not_exists=True
    )


def run_names(
    source: DataFrame,
    target: VersionedTable,
    transform: Callable[..., DataFrame] = summarize_names,
    run_ts: str | datetime | None = None,
) -> int:
    """Transform ``source`` and append it to ``target``; returns the number of rows written.

    Running twice appends twice. Rows of one run share one timestamp and so one partition, which
    is why they are not shuffled before the write. The count is the commit's own.
    """
    if source.isEmpty():
        raise ValueError("the name pipeline has no input rows")
    before = target.refresh().record_count()
    target.append(transform(source, run_ts=run_ts), rebalance=False)
    return target.record_count() - before


def create_output_table(spark: SparkSession, table: str, schema: str = NAME_OUTPUT) -> None:
    """The same output as a table of the catalog; its UTC day is a column of its own, the last."""
    create_table(spark, table, f"{schema}, {NAME_DAY.name} DATE", NAME_CODEC, [NAME_DAY.name])


def run_names_table(
    spark: SparkSession,
    source: str,
    target: str,
    transform: Callable[..., DataFrame] = summarize_names,
    run_ts: str | datetime | None = None,
    overwrite: bool = False,
) -> int:
    """``run_names`` from one catalog table to another, both given by name.

    ``overwrite`` replaces the days this run writes and leaves the others; otherwise rows are added.
    The number of rows is observed while they are written.
    """
    given = spark.table(source)
    if given.isEmpty():
        raise ValueError("the name pipeline has no input rows")
    rows = transform(given, run_ts=run_ts)
    written = Observation()
    counted = rows.select("*", NAME_DAY.derived(rows.schema)).observe(
        written, F.count(F.lit(1)).alias("n")
    )
    (overwrite_table_partitions if overwrite else append_table)(counted, target)
    return written.get["n"]


def migrate_directory(
    spark: SparkSession,
    path: str,
    target: VersionedTable,
    run_ts: str | datetime | None = None,
    source_system: str = SOURCE_SYSTEM,
) -> int:
    """Append a directory's files to ``target`` with the run's time and origin; 0 if none fit.

    Types come from the target. Columns it does not have are refused. A value of a text file that does not
    cast is NULL; a warning says how many there are in which column, counted while they are written."""
    stamps = {
        "processed_date": _moment(run_ts),
        "source_system": F.lit(source_system),
    }
    lost = Observation()
    df = load_directory(spark, path, target.current().schema, lost)
    if df is None:
        return 0
    before = target.refresh().record_count()
    target.append(df.withColumns(stamps), rebalance=False, fill_missing=True)
    failed = {name: n for name, n in lost.get.items() if n and name not in (ROWS, *stamps)}
    if failed:
        warnings.warn(f"values of {path} that do not cast are NULL: {failed}")
    return target.record_count() - before
