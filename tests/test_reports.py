from datetime import datetime
from decimal import Decimal

import pytest

from tidemark.plans import reports, story


def rows(df):
    return [tuple(r) for r in df.collect()]


def money(text):
    return Decimal(text)


def test_connectivity(spark):
    assert rows(reports.connectivity(spark)) == [(1,)]


def test_current_top(customers):
    found = rows(reports.current_top(customers, k=2))
    assert [(r[0], str(r[3]), r[4], r[5]) for r in found] == [
        (5, "746.79", "platinum", "Current Data"),
        (3, "489.72", "gold", "Current Data"),
    ]


def test_unset_tier_has_a_name(spark, tmp_path):
    table = story.seed_customers(spark, str(tmp_path / "c"))
    table.update("id = 2", {"customer_tier": "NULL"})
    found = {r.id: r.customer_tier for r in reports.current_top(table).collect()}
    assert found[2] == "Not Set" and found[1] == "gold"


def test_story_is_told_once(spark, tmp_path):
    table = story.seed_customers(spark, str(tmp_path / "c"))
    again = story.seed_customers(spark, str(tmp_path / "c"))
    assert again.snapshot_ids == table.snapshot_ids == [1, 2, 3, 4, 5, 6, 7]
    products = story.seed_products(spark, str(tmp_path / "p"))
    assert story.seed_products(spark, str(tmp_path / "p")).snapshot_ids == products.snapshot_ids


def test_evolution(customers):
    assert rows(reports.evolution(customers)) == [
        ("Current State", 5, money("1806.75"), None, None),
        ("Early Days", 0, None, -5, None),
        ("Growth Phase", 5, money("1664.34"), 5, None),
    ]
    assert rows(reports.evolution(customers, by="time")) == [
        ("Early Days", 0, None, None, None),
        ("Growth Phase", 5, money("1664.34"), 5, None),
        ("Current State", 5, money("1806.75"), 0, money("142.41")),
    ]
    with pytest.raises(ValueError):
        reports.evolution(customers, by="name")


def test_first_vs_current(customers):
    assert rows(reports.first_vs_current(customers)) == [
        ("Current State", 5, money("1806.75"), None, None),
        ("Initial State", 0, None, -5, None),
    ]


def test_schema_evolution(customers):
    assert rows(reports.schema_evolution_counts(customers)) == [
        ("Old Snapshot (no customer_tier)", 0, 0),
        ("Current Data (with customer_tier)", 5, 5),
    ]


def test_totals(customers):
    assert rows(reports.totals_as_of(customers, [1, 2])) == [
        (1, 0, money("0.00")),
        (2, 3, money("895.94")),
    ]
    assert rows(reports.main_totals(customers)) == [
        ("main", 5, money("1806.75"), "Production Data")
    ]
    assert rows(reports.main_vs_first(customers)) == [
        ("main branch", 5, money("1806.75")),
        ("early snapshot", 0, None),
    ]
    assert rows(reports.revenue_growth(customers)) == [
        (money("1806.75"), money("0.00"), money("1806.75"))
    ]


def test_rows_at_a_time_follow_the_old_schema(customers):
    early = reports.rows_at(customers, "2024-01-01 03:00:00")
    assert [r.id for r in early.collect()] == [1, 2, 3, 4, 5]
    assert "customer_tier" not in early.columns
    assert reports.first_snapshot_rows(customers).isEmpty()


def test_first_commit_next_to_rows(customers):
    plan = reports.rows_with_first_commit(customers)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = reports.rows_with_first_commit(customers).collect()
    assert [r.id for r in found] == [1, 2, 3, 4, 5]
    assert {(r.first_snapshot_time, r.context) for r in found} == {
        (datetime(2024, 1, 1, 1), "Data from earliest state")
    }


def test_branches(products):
    assert rows(reports.compare_branches(products)) == [
        ("dev", 4, "Development Branch (Spark-created)"),
        ("main", 3, "Production Branch"),
    ]
    assert rows(reports.product_count(products)) == [(3,)]
    assert rows(reports.lookup(products, 99, "dev")) == [
        (99, "Dev Product", "Testing", money("1.00"))
    ]
    assert rows(reports.lookup(products, 99)) == []
    assert rows(reports.list_refs(products)) == [
        ("dev", "BRANCH", 3),
        ("main", "BRANCH", 2),
        ("v1_0_0", "TAG", 2),
    ]


def test_snapshot_reports(customers):
    history = rows(reports.snapshot_history(customers))
    assert [(r[0], r[1], r[3], r[4]) for r in history][:3] == [
        (1, 1, "append", 0),
        (2, 2, "append", 3),
        (3, 3, "append", 5),
    ]
    kinds = [r.snapshot_type for r in reports.snapshot_timeline(customers).collect()]
    assert kinds == ["Initial Data"] + ["Historical Point"] * 5 + ["Latest Data"]
    assert rows(reports.latest_commit(customers)) == [
        (7, datetime(2024, 1, 1, 7), "overwrite", 5)
    ]
    assert rows(reports.operations(customers)) == [
        ("overwrite", 4, 0, 8),
        ("append", 3, 5, 0),
    ]


def test_overview(customers):
    found = rows(reports.overview(customers))
    assert [r[4] for r in found] == [
        "Table Creation (empty)",
        "Initial Data (3 customers)",
        "More Customers (5 total)",
        "Schema Evolution (customer_tier added)",
        "Customer Updates/Promotions",
        "Customer Updates/Promotions",
        "Customer Updates/Promotions",
    ]
    assert [r[5] for r in found] == [0, 3, 5, 5, 5, 5, 5]
    assert found[1][6] == "Use as_of(timestamp='2024-01-01 02:00:00.000000')"


def test_timepoints_can_be_read(customers):
    points = reports.timepoints(customers).collect()
    assert points[0].label == "#1 - 2024-01-01 01:00:00.000000 (append)"
    assert [customers.snapshot_at(p.timepoint) for p in points] == [1, 2, 3, 4, 5, 6, 7]


def test_business_summaries(customers):
    now = customers.current()
    assert dict(rows(reports.count_by_tier(now))) == {"gold": 2, "silver": 2, "platinum": 1}
    assert rows(reports.revenue_by_country(now)) == [
        ("Japan", money("746.79")),
        ("Mexico", money("489.72")),
        ("USA", money("329.99")),
        ("Canada", money("150.75")),
        ("UK", money("89.50")),
    ]
    assert rows(reports.grand_totals(now)) == [(5, money("1806.75"))]


def test_files_and_readiness(customers, products):
    summary = reports.file_summary(customers).first()
    assert (summary.file_format, summary.total_records) == ("PARQUET", 5)
    totals = reports.evolution_summary(products).first()
    assert (totals.total_snapshots, totals.branches) == (3, 2)
    assert totals.total_bytes > 0
    assert rows(reports.readiness(customers)) == [(5, True, True, True, True)]


def test_inventory(spark):
    listing = spark.createDataFrame(
        [
            ("lake", "demo", "customers"),
            ("lake", "demo", "orders"),
            ("lake", "demo", "orders"),
            ("lake", "empty", None),
            ("lake", "information_schema", "tables"),
            ("other", "x", "y"),
            ("system", "a", "b"),
        ],
        "catalog STRING, schema STRING, `table` STRING",
    )
    assert rows(reports.inventory(listing, "lake")) == [
        ("Available Catalogs", 2, "lake, other"),
        ("Schemas in lake", 2, "demo, empty"),
        ("Tables in lake.demo", 2, "customers, orders"),
    ]
