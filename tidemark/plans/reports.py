"""Reports on versioned tables. Every report is a lazy DataFrame; snapshot ids are settled first,
from the table's events, so each read is an ordinary pruned scan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import MAIN, ROW_ID, VersionedTable

MEASURE = "total_spent"
TIER = "customer_tier"

# Labels and texts that appear in results.
CURRENT_CONTEXT = "Current Data"
FIRST_CONTEXT = "First Snapshot - The Beginning"
EARLIEST_CONTEXT = "Data from earliest state"
NO_TIER = "Not Set"
PERIODS = ("Early Days", "Growth Phase", "Current State")
STATES = ("Initial State", "Current State")
SOURCES = ("main branch", "early snapshot")
SCHEMA_SOURCES = ("Old Snapshot (no customer_tier)", "Current Data (with customer_tier)")
MAIN_DESCRIPTION = "Production Data"
BRANCH_DESCRIPTIONS = {"main": "Production Branch", "dev": "Development Branch (Spark-created)"}
SNAPSHOT_TYPES = ("Initial Data", "Latest Data", "Historical Point")
SERVICE_CATALOGS = ("system", "tpcds", "tpch", "jmx", "memory")
SERVICE_SCHEMA = "information_schema"
TOP_CUSTOMERS = 10


def _number(newest_first: bool = False) -> Column:
    """Position of a snapshot in time. Snapshots are few, so one window over all is fine."""
    keys = [F.col("committed_at"), F.col("snapshot_id")]
    return F.row_number().over(Window.orderBy(*(k.desc() if newest_first else k for k in keys)))


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _total(column: str) -> Column:
    return F.round(F.sum(column), 2)


def _summary(key: str) -> Column:
    return F.coalesce(F.try_element_at("summary", F.lit(key)), F.lit("0")).cast("long")


def _by_id(rows: DataFrame) -> DataFrame:
    """Sorted by id. The hidden row identity breaks ties, so that one id that fills a third of
    the table still spreads over many range partitions."""
    return rows.orderBy("id", *ROW_ID).drop(*ROW_ID)


# -- state of the table at one point -------------------------------------------------------


def connectivity(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(1).alias("connection_test"))


def current_top(table: VersionedTable, k: int = TOP_CUSTOMERS) -> DataFrame:
    return (
        table.current()
        .select(
            "id",
            "name",
            "country",
            MEASURE,
            F.coalesce(TIER, F.lit(NO_TIER)).alias(TIER),
            F.lit(CURRENT_CONTEXT).alias("time_context"),
        )
        .orderBy(F.desc(MEASURE), "id")
        .limit(k)
    )


def first_snapshot_rows(table: VersionedTable) -> DataFrame:
    rows = table.first(with_row_id=True).select(
        "id",
        "name",
        "country",
        MEASURE,
        F.lit(FIRST_CONTEXT).alias("time_context"),
        *ROW_ID,
    )
    return _by_id(rows)


def rows_at(table: VersionedTable, timestamp: str | datetime) -> DataFrame:
    return _by_id(table.as_of(timestamp=timestamp, with_row_id=True))


def rows_with_first_commit(table: VersionedTable) -> DataFrame:
    """Current rows next to the time of the first commit, which is one value, not a join."""
    rows = table.current(with_row_id=True).withColumns(
        {
            "first_snapshot_time": table.committed_at(table.first_id()),
            "context": F.lit(EARLIEST_CONTEXT),
        }
    )
    return _by_id(rows)


def lookup(table: VersionedTable, row_id: int, ref: str = MAIN) -> DataFrame:
    return table.as_of(ref=ref).filter(F.col("id") == row_id)


# -- comparisons between snapshots ---------------------------------------------------------


def evolution(table: VersionedTable, by: str = "label") -> DataFrame:
    """First, middle and current state with the change from row to row.

    Rows are compared in the order of their labels; ``by="time"`` compares them in the order in
    which the states occurred.
    """
    numbered = table.snapshots().select(
        "snapshot_id",
        _number().alias("n"),
        F.count("*").over(Window.partitionBy()).alias("total"),
    )
    middle = numbered.filter("n = greatest(2, total div 2)").first()
    ids = [table.first_id(), middle.snapshot_id if middle else table.first_id()]
    states = [table.as_of(version=i) for i in ids] + [table.current()]
    return _growth(
        _states("period", PERIODS, states, F.sum(MEASURE)), "period", "customers", "revenue", by
    )


def first_vs_current(table: VersionedTable, by: str = "label") -> DataFrame:
    states = [table.first(), table.current()]
    rows = _states("data_state", STATES, states, _total(MEASURE))
    rows = rows.withColumnsRenamed({"customers": "customer_count", "revenue": "total_revenue"})
    return _growth(rows, "data_state", "customer_count", "total_revenue", by)


def _states(
    label: str, names: Sequence[str], states: Sequence[DataFrame], revenue: Column
) -> DataFrame:
    return _union(
        [
            state.agg(F.count("*").alias("customers"), revenue.alias("revenue")).select(
                F.lit(name).alias(label), "customers", "revenue", F.lit(i).alias("position")
            )
            for i, (name, state) in enumerate(zip(names, states))
        ]
    )


def _growth(rows: DataFrame, label: str, count: str, money: str, by: str) -> DataFrame:
    """Differences between consecutive rows; the input has a handful of rows."""
    if by not in ("label", "time"):
        raise ValueError(f"unknown order: {by}")
    order = label if by == "label" else "position"
    before = Window.orderBy(order)
    return (
        rows.select(
            label,
            count,
            F.round(money, 2).alias(money),
            (F.col(count) - F.lag(count).over(before)).alias("customer_growth"),
            F.round(F.col(money) - F.lag(money).over(before), 2).alias("revenue_growth"),
            "position",
        )
        .orderBy(order)
        .drop("position")
    )


def schema_evolution_counts(table: VersionedTable) -> DataFrame:
    old = table.as_of(version=table.first_id(), reconcile=True)
    return _union(
        [
            state.agg(
                F.count("*").alias("customers"), F.count(TIER).alias("customers_with_tier")
            ).select(F.lit(name).alias("data_source"), "customers", "customers_with_tier")
            for name, state in zip(SCHEMA_SOURCES, [old, table.current()])
        ]
    )


def main_vs_first(table: VersionedTable) -> DataFrame:
    states = [table.as_of(ref=MAIN), table.first()]
    return _states("source", SOURCES, states, _total(MEASURE)).drop("position")


def totals_as_of(table: VersionedTable, versions: Sequence[int]) -> DataFrame:
    """Row count and revenue at chosen snapshots; 0 where a snapshot is empty."""
    return _union(
        [
            table.as_of(version=v)
            .agg(
                F.count("*").alias("historical_count"),
                F.coalesce(_total(MEASURE), F.lit(0)).alias("historical_revenue"),
            )
            .select(F.lit(v).cast("long").alias("snapshot_id"), "historical_count", "historical_revenue")
            for v in versions
        ]
    )


def revenue_growth(table: VersionedTable) -> DataFrame:
    """Current and first revenue and their difference, in one row."""
    now = table.current().agg(_total(MEASURE).alias("current_revenue"))
    then = table.first().agg(F.coalesce(_total(MEASURE), F.lit(0)).alias("historical_revenue"))
    both = now.unionByName(then, allowMissingColumns=True).agg(
        F.max("current_revenue").alias("current_revenue"),
        F.max("historical_revenue").alias("historical_revenue"),
    )
    return both.withColumn("growth", F.col("current_revenue") - F.col("historical_revenue"))


# -- branches ------------------------------------------------------------------------------


def main_totals(table: VersionedTable) -> DataFrame:
    return (
        table.as_of(ref=MAIN)
        .agg(F.count("*").alias("customers"), _total(MEASURE).alias("total_revenue"))
        .select(
            F.lit(MAIN).alias("branch_name"),
            "customers",
            "total_revenue",
            F.lit(MAIN_DESCRIPTION).alias("description"),
        )
    )


def product_count(table: VersionedTable, ref: str = MAIN) -> DataFrame:
    return table.as_of(ref=ref).agg(F.count("*").alias("product_count"))


def compare_branches(table: VersionedTable, refs: Sequence[str] = ("main", "dev")) -> DataFrame:
    return _union(
        [
            product_count(table, ref).select(
                F.lit(ref).alias("branch_name"),
                "product_count",
                F.lit(BRANCH_DESCRIPTIONS.get(ref, ref)).alias("description"),
            )
            for ref in refs
        ]
    ).orderBy("branch_name")


def list_refs(table: VersionedTable) -> DataFrame:
    return (
        table.refs()
        .select(F.col("name").alias("branch_or_tag_name"), "type", "snapshot_id")
        .orderBy("type", "branch_or_tag_name")
    )


# -- snapshots as rows ---------------------------------------------------------------------


def snapshot_history(table: VersionedTable) -> DataFrame:
    return (
        table.snapshots()
        .select(
            _number().alias("snapshot_number"),
            "snapshot_id",
            "committed_at",
            "operation",
            _summary("total-records").alias("record_count"),
        )
        .orderBy("snapshot_number")
    )


def snapshot_timeline(table: VersionedTable) -> DataFrame:
    initial, latest, other = SNAPSHOT_TYPES
    return (
        table.snapshots()
        .select(
            "snapshot_id",
            "committed_at",
            "operation",
            F.when(_number() == 1, initial)
            .when(_number(newest_first=True) == 1, latest)
            .otherwise(other)
            .alias("snapshot_type"),
            "summary",
        )
        .orderBy("committed_at", "snapshot_id")
    )


def latest_commit(table: VersionedTable) -> DataFrame:
    return (
        table.snapshots()
        .orderBy(F.desc("committed_at"), F.desc("snapshot_id"))
        .limit(1)
        .select(
            "snapshot_id",
            "committed_at",
            "operation",
            _summary("total-records").alias("record_count"),
        )
    )


def _as_text(moment: str) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def overview(table: VersionedTable) -> DataFrame:
    """Every snapshot with what happened in it, its true row count and the call that reads it."""
    n = F.col("snapshot_number")
    count = F.col("approx_customers").cast("string")
    update = F.col("operation") == "overwrite"
    happened = (
        F.when(n == 1, "Table Creation (empty)")
        .when(n == 2, F.concat(F.lit("Initial Data ("), count, F.lit(" customers)")))
        .when(n == 3, F.concat(F.lit("More Customers ("), count, F.lit(" total)")))
        .when(update & (n == 4), f"Schema Evolution ({TIER} added)")
        .when(update, "Customer Updates/Promotions")
        .otherwise("Data Changes")
    )
    return (
        table.snapshots()
        .withColumns(
            {
                "snapshot_number": _number(),
                "approx_customers": _summary("total-records"),
            }
        )
        .select(
            "snapshot_number",
            F.col("snapshot_id").cast("string").alias("snapshot_id"),
            F.col("committed_at").alias("timestamp"),
            "operation",
            happened.alias("what_happened"),
            "approx_customers",
            F.concat(F.lit("Use as_of(timestamp='"), _as_text("committed_at"), F.lit("')")).alias(
                "time_travel_syntax"
            ),
        )
        .orderBy("snapshot_number")
    )


def timepoints(table: VersionedTable) -> DataFrame:
    """Choices for a picker: the time as text, and a label."""
    numbered = table.snapshots().withColumn("n", _number())
    when = _as_text("committed_at")
    label = F.concat(F.lit("#"), "n", F.lit(" - "), when, F.lit(" ("), "operation", F.lit(")"))
    return numbered.select("n", when.alias("timepoint"), label.alias("label")).orderBy("n")


def operations(table: VersionedTable) -> DataFrame:
    return (
        table.snapshots()
        .groupBy("operation")
        .agg(
            F.count("*").alias("operation_count"),
            F.sum(_summary("added-records")).alias("records_added"),
            F.sum(_summary("changed-records")).alias("records_changed"),
        )
        .orderBy(F.desc("operation_count"))
    )


# -- files ---------------------------------------------------------------------------------


def file_summary(table: VersionedTable) -> DataFrame:
    return (
        table.files()
        .groupBy("file_format")
        .agg(
            F.count("*").alias("file_count"),
            F.sum("record_count").alias("total_records"),
            F.round(F.sum("file_size_in_bytes") / (1024.0 * 1024.0), 2).alias("total_size_mb"),
        )
        .orderBy(F.desc("total_records"))
    )


def evolution_summary(table: VersionedTable) -> DataFrame:
    """Number of snapshots, files and branches, and the bytes in use."""
    refs = table.refs().filter("type = 'BRANCH'").count()
    return table.files().agg(
        F.lit(len(table.snapshot_ids)).alias("total_snapshots"),
        F.count("*").alias("total_files"),
        F.lit(refs).alias("branches"),
        F.sum("file_size_in_bytes").alias("total_bytes"),
    )


def readiness(table: VersionedTable) -> DataFrame:
    """Has rows, has history, has the later column: read off the events, not the data."""
    rows = table.record_count()
    snapshots = len(table.snapshot_ids)
    return table.spark.range(1).select(
        F.lit(rows).cast("long").alias("customers"),
        F.lit(rows > 0).alias("has_customers"),
        F.lit(snapshots > 1).alias("has_history"),
        F.lit(TIER in table.schema.names).alias("has_tier_column"),
        F.lit(rows > 0 and snapshots > 1).alias("ready"),
    )


# -- business summaries --------------------------------------------------------------------


def count_by_tier(df: DataFrame) -> DataFrame:
    return df.groupBy(TIER).agg(F.count("*").alias("count")).orderBy(F.desc("count"))


def revenue_by_country(df: DataFrame) -> DataFrame:
    return df.groupBy("country").agg(_total(MEASURE).alias("revenue")).orderBy(F.desc("revenue"))


def grand_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("customers"), _total(MEASURE).alias("total_revenue"))


def inventory(listing: DataFrame, catalog: str) -> DataFrame:
    """Catalogs, schemas of one catalog, and tables of each of its schemas, as counted lists.

    ``listing`` has one or more rows (catalog, schema, table) per table. It is read once and
    reduced to different names before each shuffle, however often one of them occurs.
    """
    column = {name: F.col(f"`{name}`") for name in ("catalog", "schema", "table")}
    here = (column["catalog"] == catalog) & (column["schema"] != SERVICE_SCHEMA)
    entries = [
        (~column["catalog"].isin(*SERVICE_CATALOGS), F.lit("Available Catalogs"), "catalog"),
        (here, F.lit(f"Schemas in {catalog}"), "schema"),
        (here, F.concat(F.lit(f"Tables in {catalog}."), column["schema"]), "table"),
    ]
    lines = [
        F.when(shown, F.struct(kind.alias("resource_type"), column[name].alias("item")))
        for shown, kind, name in entries
    ]
    names = F.array_sort(F.collect_set("line.item"))
    kind = F.col("resource_type")
    rank = F.when(kind.like("Available Catalogs%"), 1).when(kind.like("Schemas in%"), 2).otherwise(3)
    return (
        listing.select("catalog", "schema", "table")
        .distinct()
        .select(F.explode(F.array(*lines)).alias("line"))
        .filter("line.item IS NOT NULL")
        .groupBy("line.resource_type")
        .agg(
            F.size(names).cast("long").alias("count"),
            F.array_join(names, ", ").alias("available_items"),
        )
        .orderBy(rank, "resource_type")
    )
