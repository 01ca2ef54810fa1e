"""Catalog tables: DDL, registration of files, partition overwrite, verification, listing."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..codecs import codec_options
from .files import load_file

PREVIEW_COLUMNS = 5
PREVIEW_ROWS = 5
OVERVIEW_COLUMNS = 10
# A task sorts what it inserts by partition, unless so many partitions can be open: rows of one day are then
# written as they come, and rows of further ones are sorted as before.
UNSORTED = {"spark.sql.maxConcurrentOutputFileWriters": "1"}
DYNAMIC = {"spark.sql.sources.partitionOverwriteMode": "dynamic"}


def create_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    quoted = (location or "").replace("\\", "\\\\").replace("'", "\\'")
    place = f" LOCATION '{quoted}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{place}")


def create_table(
    spark: SparkSession,
    table: str,
    schema: str,
    compression: str = "snappy",
    partitioned_by: Sequence[str] = (),
) -> None:
    """An empty Parquet table of the catalog, unless it is there already."""
    names = ", ".join(f"`{name}`" for name in partitioned_by)
    options = ", ".join(f"'{key}' = '{value}'" for key, value in codec_options(compression).items())
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet "
        f"OPTIONS ({options})" + (f" PARTITIONED BY ({names})" if names else "")
    )


def append_table(df: DataFrame, table: str) -> None:
    """Add rows to a table of the catalog, by column name; the columns must be the table's."""
    with _set_for_a_while(df.sparkSession, UNSORTED):
        _by_name(df, table).write.mode("append").insertInto(table)


def overwrite_table_partitions(df: DataFrame, table: str) -> None:
    """Replace exactly those partitions of a catalog table that occur in ``df``.

    Inserts into catalog tables take this mode from the session alone; it is set back afterwards.
    """
    with _set_for_a_while(df.sparkSession, UNSORTED | DYNAMIC):
        _by_name(df, table).write.mode("overwrite").insertInto(table)


@contextmanager
def _set_for_a_while(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _by_name(df: DataFrame, table: str) -> DataFrame:
    columns = df.sparkSession.table(table).columns
    if set(columns) != set(df.columns):
        raise ValueError(f"{table} has the columns {columns}, not {df.columns}")
    return df.select(*(f"`{name}`" for name in columns))


def drop_table(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def register_file(
    spark: SparkSession,
    path: str,
    database: str,
    table: str,
    fmt: str | None = None,
    schema: StructType | str | None = None,
    mode: str = "compat",
    location: str | None = None,
) -> DataFrame:
    """Load a file and make it the table ``database.table``, replacing any earlier one.

    The rows are written under another name first, and the earlier table is only dropped when the new one
    has its name: if a step fails, the earlier table is there under its own. Returns the verification row.
    Counts come from the written table, so the file is not read a second time for them.
    """
    df = load_file(spark, path, fmt, schema, mode)
    create_database(spark, database, location)
    name = f"`{database}`.`{table}`"
    fresh = f"`{database}`.`{table}__new`"
    drop_table(spark, fresh)
    df.write.format("parquet").saveAsTable(fresh)
    earlier = f"`{database}`.`{table}__earlier`"
    replaces = spark.catalog.tableExists(name)
    if replaces:
        drop_table(spark, earlier)
        spark.sql(f"ALTER TABLE {name} RENAME TO {earlier}")
    try:
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
    except Exception:
        if replaces:
            spark.sql(f"ALTER TABLE {earlier} RENAME TO {name}")
        raise
    drop_table(spark, earlier)
    return verify(spark, [name])


def verify(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """Row and column count of each table."""
    return reduce(DataFrame.unionAll, (count_row(t, spark.table(t)) for t in tables))


def count_row(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("record_count")).select(
        F.lit(name.replace("`", "")).alias("table_name"),
        "record_count",
        F.lit(len(df.columns)).alias("column_count"),
    )


def preview(df: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """The first five columns of five rows; ordered by ``order_by`` if rows must be the same."""
    rows = df.orderBy(*order_by) if order_by else df
    return rows.select(*df.columns[:PREVIEW_COLUMNS]).limit(PREVIEW_ROWS)


def schema_overview(df: DataFrame) -> list[str]:
    """The first ten columns with their types, and how many more there are."""
    lines = [f"{f.name}: {f.dataType.simpleString()}" for f in df.schema]
    hidden = len(lines) - OVERVIEW_COLUMNS
    return lines[:OVERVIEW_COLUMNS] + ([f"... and {hidden} more columns"] if hidden > 0 else [])


def describe(df: DataFrame, filled: bool = False) -> DataFrame:
    """Columns in order with their types. ``filled`` adds how many rows have a value in each
    column, at the price of one pass over the data."""
    names = df.columns
    counts = df.agg(*(F.count(f"`{name}`").alias(f"c{i}") for i, name in enumerate(names)))
    base = counts if filled else df.sparkSession.range(1)
    lines = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            *([F.col(f"c{i}").alias("filled")] if filled else []),
        )
        for i, field in enumerate(df.schema)
    ]
    return base.select(F.explode(F.array(*lines)).alias("line")).select("line.*")


def overwrite_partitions(df: DataFrame, path: str, partition_columns: Sequence[str]) -> None:
    """Replace exactly the partitions that occur in ``df``; all others stay."""
    (
        df.hint("rebalance", *partition_columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_columns)
        .parquet(path)
    )


def inventory_listing(spark: SparkSession) -> DataFrame:
    """(catalog, schema, table) of everything in the session's catalogs, temporary views excluded."""
    here = spark.catalog.currentCatalog()
    rows = [(c.name, None, None) for c in spark.catalog.listCatalogs()]
    for database in spark.catalog.listDatabases():
        rows.append((here, database.name, None))
        rows += [
            (here, database.name, t.name)
            for t in spark.catalog.listTables(database.name)
            if not t.isTemporary
        ]
    return spark.createDataFrame(rows, "catalog STRING, schema STRING, `table` STRING")
