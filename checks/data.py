"""Bindings of the library to the driver's tables. Everything derived is built once per session
and data folder, below one work folder."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, TimestampType

from tidemark import VersionedTable, days, months
from tidemark.operators import RowLog
from tidemark.plans import story
from tidemark.session import apply_settings, new_work_dir

START = "2024-01-01 00:00:00"
RUN_TS = "2024-03-01 08:30:00"
NEXT_RUN_TS = "2024-03-02 08:30:00"
CUSTOMERS = (
    "id BIGINT, name STRING, country STRING, segment STRING, total_orders INT, "
    "total_spent DECIMAL(10,2)"
)
FIRST_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE")

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

T = TypeVar("T")
_built: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, what: str, build: Callable[[], T]) -> T:
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _built:
        _built[key] = build()
    return _built[key]


def work_dir(spark: SparkSession, sf_dir: str) -> str:
    return once(spark, sf_dir, "work", lambda: new_work_dir(spark, "checks"))


def fresh_dir(spark: SparkSession, sf_dir: str, label: str) -> str:
    """A folder nobody wrote to yet, for queries that write on every call."""
    counter = once(spark, sf_dir, "counter", lambda: [0])
    counter[0] += 1
    return f"{work_dir(spark, sf_dir)}/{label}-{counter[0]}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def comparable(df: DataFrame) -> DataFrame:
    """Types both engines share: wide decimals, timestamps without zone."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, DecimalType):
            column = column.cast("decimal(38,2)")
        elif isinstance(field.dataType, TimestampType):
            column = column.cast("timestamp_ntz")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with its country's name and its number of orders, pre-aggregated by customer."""
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(orders, customer.c_custkey == orders.o_custkey, "left")
        .select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.col("n_name").alias("country"),
            F.col("c_mktsegment").alias("segment"),
            F.coalesce("n", F.lit(0)).cast("int").alias("total_orders"),
            F.col("c_acctbal").cast("decimal(10,2)").alias("total_spent"),
        )
    )


def customer_story(spark: SparkSession, sf_dir: str) -> VersionedTable:
    def build() -> VersionedTable:
        rows = customers(spark, sf_dir)
        first = F.col("segment").isin(*FIRST_SEGMENTS)
        path = f"{work_dir(spark, sf_dir)}/customers"
        return story.tell_customers(
            spark, path, rows.filter(first), rows.filter(~first), CUSTOMERS, START
        )

    return once(spark, sf_dir, "customers", build)


def created_customers(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """Created from rows, so the first snapshot is not empty; then one update."""

    def build() -> VersionedTable:
        table = VersionedTable.create(
            spark,
            f"{work_dir(spark, sf_dir)}/created_customers",
            rows=customers(spark, sf_dir),
            committed_at="2024-01-01 01:00:00",
        )
        table.update("total_spent < 0", {"total_spent": "0"}, committed_at="2024-01-01 02:00:00")
        return table

    return once(spark, sf_dir, "created_customers", build)


def product_story(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """part on main, and every part once more on the branch, under a negative id."""

    def build() -> VersionedTable:
        rows = read(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        )
        dev_rows = rows.withColumn("id", -1 - F.col("id"))
        path = f"{work_dir(spark, sf_dir)}/products"
        return story.tell_products(spark, path, rows, dev_rows, START)

    return once(spark, sf_dir, "products", build)


def events_by_day(spark: SparkSession, sf_dir: str) -> VersionedTable:
    """events by day of ts; then every error moves to the next day, and so to its partition."""

    def build() -> VersionedTable:
        table = VersionedTable.create(
            spark,
            f"{work_dir(spark, sf_dir)}/events",
            rows=read(spark, sf_dir, "events"),
            partition_by=[days("ts")],
            committed_at="2024-01-01 01:00:00",
        )
        table.update(
            "event_type = 'error'",
            {"ts": "ts + INTERVAL 1 DAY"},
            committed_at="2024-01-01 02:00:00",
        )
        return table

    return once(spark, sf_dir, "events", build)


def orders_by_month(spark: SparkSession, sf_dir: str) -> VersionedTable:
    return once(
        spark,
        sf_dir,
        "orders",
        lambda: VersionedTable.create(
            spark,
            f"{work_dir(spark, sf_dir)}/orders",
            rows=read(spark, sf_dir, "orders"),
            partition_by=[months("o_orderdate")],
        ),
    )


def order_log(spark: SparkSession, sf_dir: str) -> RowLog:
    """Three commits over all orders, from one scan: all are written; then open ones get dearer, written
    twice in the commit, and finished ones of the highest priority are deleted; then the deleted ones of
    1997 and later come back for one, and those in process are deleted."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    price = F.col("o_totalprice").cast("decimal(15,2)")
    urgent = (status == "F") & (priority == "1-URGENT")

    def version(commit: int, sequence: int, amount, deleted: bool, when=None):
        row = F.struct(
            F.lit(commit).alias("commit_id"),
            F.lit(sequence).alias("sequence"),
            F.lit(f"2024-01-01 0{commit}:00:00").cast("timestamp_ntz").alias("committed_at"),
            F.lit(deleted).alias("deleted"),
            amount.cast("decimal(15,2)").alias("price"),
        )
        return row if when is None else F.when(when, row)

    versions = F.array(
        version(1, 0, price, False),
        version(2, 0, price + 1, False, status == "O"),
        version(2, 1, price + 100, False, status == "O"),
        version(2, 0, price, True, urgent),
        version(3, 0, F.lit(1), False, urgent & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))),
        version(3, 0, price, True, status == "P"),
    )
    rows = read(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.explode(F.filter(versions, lambda v: v.isNotNull())).alias("version"),
    )
    return RowLog(rows.select("o_orderkey", "o_custkey", "o_orderstatus", "version.*"), ["o_orderkey"])


def lineitem_by_month(spark: SparkSession, sf_dir: str, mode: str) -> VersionedTable:
    """lineitem by month of shipment; late returns lose their discount, in the given mode."""

    def build() -> VersionedTable:
        table = VersionedTable.create(
            spark,
            f"{work_dir(spark, sf_dir)}/lineitem_{mode}",
            rows=read(spark, sf_dir, "lineitem"),
            partition_by=[months("l_shipdate")],
        )
        late = "l_shipdate >= TIMESTAMP_NTZ '2000-06-15 00:00:00' AND l_returnflag = 'R'"
        table.update(late, {"l_discount": "0", "l_linestatus": "'X'"}, mode=mode)
        return table

    return once(spark, sf_dir, f"lineitem_{mode}", build)


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("full_name")
    )


def source_file(spark: SparkSession, sf_dir: str, fmt: str, table: str, df=None, **options) -> str:
    """The path of a table written once in another format."""

    def build() -> str:
        path = f"{work_dir(spark, sf_dir)}/{table}.{fmt}"
        rows = read(spark, sf_dir, table) if df is None else df
        rows.write.format(fmt).options(**options).save(path)
        return path

    return once(spark, sf_dir, f"{table}.{fmt}", build)


def database(spark: SparkSession, sf_dir: str) -> str:
    """A database below the work folder, with every driver table registered in it."""
    from tidemark.sources import create_database

    def build() -> str:
        folder = work_dir(spark, sf_dir)
        name = "checks_" + "".join(c if c.isalnum() else "_" for c in folder.rsplit("/", 1)[-1])
        create_database(spark, name, f"{folder}/warehouse")
        for table in TABLES:
            path = f"{sf_dir.rstrip('/')}/{table}.parquet"
            spark.catalog.createTable(f"{name}.{table}", path=path, source="parquet")
        return name

    return once(spark, sf_dir, "database", build)


def own_database(spark: SparkSession, sf_dir: str) -> str:
    """A second database, for the tables that queries write."""
    from tidemark.sources import create_database

    def build() -> str:
        name = f"{database(spark, sf_dir)}_written"
        create_database(spark, name, f"{work_dir(spark, sf_dir)}/written")
        return name

    return once(spark, sf_dir, "own_database", build)


def prepared(spark: SparkSession) -> SparkSession:
    return apply_settings(spark)
