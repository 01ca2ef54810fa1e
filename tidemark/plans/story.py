"""The demonstration story: a customers table with seven snapshots, a products table with a
branch, and the seed rows for both. The same steps run on any DataFrames of that shape."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from ..operators import VersionedTable

# Seed rows, thresholds and names.
CUSTOMER_SCHEMA = (
    "id BIGINT, name STRING, email STRING, country STRING, signup_date DATE, "
    "total_orders INT, total_spent DECIMAL(10,2)"
)
FIRST_CUSTOMERS = [
    (1, "John Doe", "john.doe@email.com", "USA", date(2023, 1, 15), 5, Decimal("299.99")),
    (2, "Jane Smith", "jane.smith@email.com", "Canada", date(2023, 2, 20), 3, Decimal("150.75")),
    (3, "Carlos Rodriguez", "carlos@email.com", "Mexico", date(2023, 3, 10), 8, Decimal("445.20")),
]
MORE_CUSTOMERS = [
    (4, "Emma Wilson", "emma.wilson@email.com", "UK", date(2023, 1, 25), 2, Decimal("89.50")),
    (5, "Yuki Tanaka", "yuki.tanaka@email.com", "Japan", date(2023, 4, 5), 12, Decimal("678.90")),
]
PRODUCT_SCHEMA = "id BIGINT, name STRING, category STRING, price DECIMAL(10,2)"
PRODUCTS = [
    (1, "Laptop", "Electronics", Decimal("999.99")),
    (2, "Coffee Mug", "Kitchen", Decimal("12.50")),
    (3, "Desk Chair", "Furniture", Decimal("149.99")),
]
DEV_PRODUCTS = [(99, "Dev Product", "Testing", Decimal("1.00"))]
NAMES = [
    (1, "John Michael Doe"),
    (2, "Jane Elizabeth Smith-Wilson"),
    (3, "Carlos Rodriguez Martinez"),
    (4, "Emma Wilson"),
    (5, "Yuki Tanaka Sato"),
    (6, "Dr. Sarah Connor-Johnson PhD"),
    (7, "Muhammad Ali Hassan"),
    (8, "Maria Garcia Lopez"),
    (9, "David Kim"),
    (10, "Anna-Marie O'Sullivan"),
]
TIER_COLUMN = "customer_tier"
TIERS = [
    ("platinum", "total_spent > 500"),
    ("gold", "total_spent BETWEEN 200 AND 500"),
    ("silver", "customer_tier IS NULL"),
]
PROMOTED = "customer_tier IN ('platinum', 'gold')"
PROMOTION = {"total_orders": "total_orders + 1", "total_spent": "total_spent * 1.1"}
DEV_BRANCH = "dev"
RELEASE_TAG = "v1_0_0"


class Clock:
    """Commit times: one hour apart when a start is given, else the time of the commit."""

    def __init__(self, start: str | None = None):
        self.time = datetime.fromisoformat(start) if start else None

    def tick(self) -> datetime | None:
        if self.time:
            self.time += timedelta(hours=1)
        return self.time


def tell_customers(
    spark: SparkSession,
    path: str,
    first: DataFrame,
    more: DataFrame,
    schema: str = CUSTOMER_SCHEMA,
    start: str | None = None,
) -> VersionedTable:
    """Create, two inserts, a new column, three tier updates and a promotion: seven snapshots.

    Steps that a former run has done are not repeated.
    """
    clock = Clock(start)
    table = VersionedTable.create(spark, path, schema, committed_at=clock.tick(), if_not_exists=True)
    if table.append_if_empty(first, committed_at=clock.tick()):
        table.append(more, committed_at=clock.tick())
    if table.add_column(TIER_COLUMN, "STRING", if_not_exists=True):
        for tier, where in TIERS:
            table.update(where, {TIER_COLUMN: f"'{tier}'"}, committed_at=clock.tick())
        table.update(PROMOTED, PROMOTION, committed_at=clock.tick())
    return table


def tell_products(
    spark: SparkSession, path: str, rows: DataFrame, dev_rows: DataFrame, start: str | None = None
) -> VersionedTable:
    """Create and fill, tag the release, then add rows on a branch that main does not see."""
    clock = Clock(start)
    table = VersionedTable.create(
        spark, path, PRODUCT_SCHEMA, committed_at=clock.tick(), if_not_exists=True
    )
    if table.append_if_empty(rows, committed_at=clock.tick()):
        table.create_tag(RELEASE_TAG)
        table.create_branch(DEV_BRANCH)
        table.append(dev_rows, ref=DEV_BRANCH, committed_at=clock.tick())
    return table


def seed_customers(spark: SparkSession, path: str, start: str | None = None) -> VersionedTable:
    first = spark.createDataFrame(FIRST_CUSTOMERS, CUSTOMER_SCHEMA)
    more = spark.createDataFrame(MORE_CUSTOMERS, CUSTOMER_SCHEMA)
    return tell_customers(spark, path, first, more, start=start)


def seed_products(spark: SparkSession, path: str, start: str | None = None) -> VersionedTable:
    rows = spark.createDataFrame(PRODUCTS, PRODUCT_SCHEMA)
    dev_rows = spark.createDataFrame(DEV_PRODUCTS, PRODUCT_SCHEMA)
    return tell_products(spark, path, rows, dev_rows, start)


def seed_names(spark: SparkSession, path: str) -> VersionedTable:
    from .pipelines import NAME_CODEC, NAME_INPUT

    table = VersionedTable.create(
        spark, path, NAME_INPUT, compression=NAME_CODEC, if_not_exists=True
    )
    table.append_if_empty(spark.createDataFrame(NAMES, NAME_INPUT))
    return table
