import random
import re
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark import UnknownVersion, VersionedTable, days, months


def plan_of(df):
    return df._jdf.queryExecution().toString()


def folders(df):
    """The log folders a DataFrame would read, without the names of their attempts."""
    return {re.sub("/attempt=[0-9a-f]+", "", path.split("/log/")[1].rsplit("/", 1)[0]) for path in df.inputFiles()}


def ids(df):
    return sorted(row.id for row in df.select("id").collect())


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable.create(spark, str(tmp_path / "t"), "id BIGINT, v BIGINT")


def numbers(spark, low, high):
    return spark.range(low, high).select("id", (F.col("id") * 10).alias("v"))


# -- the seed story's snapshots ------------------------------------------------------------

GOLDEN_TOTALS = [
    (1, "append", 0, None, 0),
    (2, "append", 3, Decimal("895.94"), 0),
    (3, "append", 5, Decimal("1664.34"), 0),
    (4, "overwrite", 5, Decimal("1664.34"), 1),
    (5, "overwrite", 5, Decimal("1664.34"), 3),
    (6, "overwrite", 5, Decimal("1664.34"), 5),
    (7, "overwrite", 5, Decimal("1806.75"), 5),
]


@pytest.mark.parametrize("seq, operation, rows, total, tiers", GOLDEN_TOTALS)
def test_every_snapshot_of_the_story(customers, seq, operation, rows, total, tiers):
    state = customers.as_of(version=seq, reconcile=True)
    row = state.agg(F.count("*"), F.sum("total_spent"), F.count("customer_tier")).first()
    assert tuple(row) == (rows, total, tiers)
    commit = customers.snapshots().filter(F.col("snapshot_id") == seq).first()
    assert commit.operation == operation
    assert customers.record_count(seq) == rows


def test_totals_in_one_pass_equal_the_single_reads(customers):
    rows = customers.totals_by_snapshot("total_spent").orderBy("snapshot_id").collect()
    assert [tuple(r) for r in rows] == [
        (seq, n, total or Decimal("0.00")) for seq, _, n, total, _ in GOLDEN_TOTALS
    ]


def test_final_rows(customers):
    rows = customers.current().orderBy("id").collect()
    assert [(r.id, r.total_orders, str(r.total_spent), r.customer_tier) for r in rows] == [
        (1, 6, "329.99", "gold"),
        (2, 3, "150.75", "silver"),
        (3, 9, "489.72", "gold"),
        (4, 2, "89.50", "silver"),
        (5, 13, "746.79", "platinum"),
    ]


def test_old_snapshot_has_no_later_column(customers):
    old = customers.as_of(version=3)
    assert "customer_tier" not in old.columns
    with pytest.raises(AnalysisException, match="UNRESOLVED_COLUMN"):
        old.select("customer_tier")
    assert customers.as_of(version=3, reconcile=True).filter("customer_tier IS NOT NULL").isEmpty()


def test_point_in_time_is_inclusive(customers):
    assert customers.snapshot_at("2024-01-01 03:00:00") == 3
    assert customers.snapshot_at("2024-01-01 02:59:59.999999") == 2
    assert customers.snapshot_at("2030-01-01 00:00:00") == 7
    with pytest.raises(UnknownVersion):
        customers.as_of(timestamp="2024-01-01 00:59:59")


def test_times_may_be_text_or_datetime(customers):
    for row in customers.snapshots().select("snapshot_id", "committed_at").collect():
        assert customers.snapshot_at(row.committed_at) == row.snapshot_id
        assert customers.snapshot_at(str(row.committed_at)) == row.snapshot_id


def test_number_is_a_snapshot_and_text_a_reference(products):
    assert products.as_of(version=2).count() == 3
    assert products.as_of(version="dev").count() == 4
    assert products.as_of(version="v1_0_0").count() == 3
    for wrong in (99, "nowhere"):
        with pytest.raises(UnknownVersion):
            products.as_of(version=wrong)
    with pytest.raises(ValueError):
        products.as_of(version=1, ref="dev")


def test_branch_rows_stay_off_main(products):
    assert ids(products.current()) == [1, 2, 3]
    assert ids(products.as_of(ref="dev")) == [1, 2, 3, 99]


def test_new_column_makes_no_snapshot(customers):
    assert customers.snapshot_ids == [1, 2, 3, 4, 5, 6, 7]


def test_history_and_refs(customers, products):
    assert customers.history().count() == 7
    assert products.history().count() == 2
    assert products.history("dev").count() == 3
    refs = {(r.name, r.type, r.snapshot_id) for r in products.refs().collect()}
    assert refs == {("main", "BRANCH", 2), ("dev", "BRANCH", 3), ("v1_0_0", "TAG", 2)}


# -- branches ------------------------------------------------------------------------------


def test_branch_of_a_branch_is_isolated(spark, table):
    table.append(numbers(spark, 0, 4))
    table.create_branch("dev")
    table.update("id = 1", {"v": "111"}, ref="dev")
    table.create_branch("deeper", at="dev")
    table.append(numbers(spark, 50, 51), ref="deeper")
    table.update("id = 2", {"v": "222"}, ref="deeper")
    table.update("id < 3", {"v": "v + 1"})

    def state(ref):
        return {r.id: r.v for r in table.as_of(ref=ref).collect()}

    assert state("main") == {0: 1, 1: 11, 2: 21, 3: 30}
    assert state("dev") == {0: 0, 1: 111, 2: 20, 3: 30}
    assert state("deeper") == {0: 0, 1: 111, 2: 222, 3: 30, 50: 500}


def test_dropped_branch_can_be_made_again_empty(spark, table):
    table.append(numbers(spark, 0, 2))
    table.create_branch("dev")
    table.append(numbers(spark, 10, 12), ref="dev")
    table.drop_branch("dev")
    assert [r.name for r in table.refs().collect()] == ["main"]
    with pytest.raises(UnknownVersion):
        table.as_of(ref="dev")
    table.create_branch("dev")
    assert ids(table.as_of(ref="dev")) == [0, 1]


def test_tags_do_not_move(spark, table):
    table.append(numbers(spark, 0, 2))
    table.create_tag("v1", at=2)
    table.append(numbers(spark, 2, 4))
    assert ids(table.as_of(ref="v1")) == [0, 1]
    with pytest.raises(ValueError):
        table.append(numbers(spark, 5, 6), ref="v1")
    with pytest.raises(ValueError):
        table.create_branch("v1")
    with pytest.raises(ValueError):
        table.drop_branch("main")
    table.drop_tag("v1")
    assert [r.name for r in table.refs().collect()] == ["main"]


# -- writes --------------------------------------------------------------------------------


def test_rows_are_a_multiset(spark, table):
    for _ in range(2):
        table.append(numbers(spark, 0, 3))
    table.update("id = 1", {"v": "v + 1"})
    assert sorted((r.id, r.v) for r in table.current().collect()) == [
        (0, 0), (0, 0), (1, 11), (1, 11), (2, 20), (2, 20),
    ]


def test_expressions_see_the_old_row(spark, table):
    table.append(numbers(spark, 1, 3))
    table.update(F.col("id") > 0, {"id": F.col("v"), "v": F.col("id")})
    assert sorted((r.id, r.v) for r in table.current().collect()) == [(10, 1), (20, 2)]


def test_column_names_of_the_metadata_are_free(spark, tmp_path):
    rows = spark.range(6).selectExpr("id AS snapshot_id", "id AS ended", "id AS n", "id AS part", "id AS old")
    table = VersionedTable.create(spark, str(tmp_path / "n"), rows=rows)
    table.update("part = 3", {"n": "100"})
    table.update("old < 2", {"ended": "-1"}, mode="copy")
    found = table.totals_by_snapshot("n").orderBy("snapshot_id").collect()
    assert [tuple(r) for r in found] == [(1, 6, 15), (2, 6, 112), (3, 6, 112)]


def test_update_without_matches_changes_nothing(spark, table):
    table.append(numbers(spark, 0, 3))
    table.update("id = 77", {"v": "0"})
    assert table.record_count() == 3
    assert ids(table.current()) == [0, 1, 2]


def test_null_condition_does_not_match(spark, table):
    table.append(spark.createDataFrame([(1, None), (2, 5)], "id BIGINT, v BIGINT"))
    table.update("v > 0", {"v": "-1"})
    assert {r.id: r.v for r in table.current().collect()} == {1: None, 2: -1}


def test_unknown_and_missing_columns(spark, table):
    with pytest.raises(ValueError, match="extra"):
        table.append(spark.range(1).select("id", F.lit(1).alias("extra")))
    with pytest.raises(ValueError, match="extra"):
        table.update("id = 1", {"extra": "1"})
    with pytest.raises(ValueError, match="missing"):
        table.append(spark.range(1))
    assert table.is_empty() and len(table.refresh().snapshot_ids) == 1
    table.append(spark.range(1), fill_missing=True)
    assert table.current().first().v is None


def test_reserved_names(spark, tmp_path, table):
    with pytest.raises(ValueError):
        VersionedTable.create(spark, str(tmp_path / "u"), "id BIGINT, commit_seq BIGINT")
    with pytest.raises(ValueError):
        table.add_column("_replaces", "BIGINT")
    with pytest.raises(ValueError):
        table.add_column("v", "BIGINT")
    assert table.add_column("v", "BIGINT", if_not_exists=True) is False


def test_seeding_happens_once(spark, table):
    assert table.append_if_empty(numbers(spark, 0, 3)) is True
    assert table.append_if_empty(numbers(spark, 0, 3)) is False
    assert table.record_count() == 3


def test_create_guards(spark, table):
    with pytest.raises(ValueError):
        VersionedTable.create(spark, table.path, "id BIGINT")
    again = VersionedTable.create(spark, table.path, "id BIGINT", if_not_exists=True)
    assert again.schema.names == ["id", "v"]


def test_create_from_rows(spark, tmp_path):
    made = VersionedTable.create(spark, str(tmp_path / "m"), rows=numbers(spark, 0, 5))
    made.update("id = 0", {"v": "5"})
    assert ids(made.first()) == [0, 1, 2, 3, 4]
    assert made.record_count(1) == 5
    assert made.current().filter("id = 0").first().v == 5


def test_leftovers_of_a_failed_write_are_not_seen(spark, table):
    table.append(numbers(spark, 0, 2))
    rows = spark.read.parquet(f"{table.path}/log/commit_seq=2")
    rows.write.parquet(f"{table.path}/log/commit_seq=3")
    assert ids(table.refresh().current()) == [0, 1]
    table.append(numbers(spark, 7, 8))
    assert ids(table.current()) == [0, 1, 7]


def test_failing_commits_leave_the_table_as_it_was(spark, table):
    table.append(numbers(spark, 0, 4))
    broken = numbers(spark, 0, 50).withColumn("v", F.expr("IF(id = 40, raise_error('bad row'), v)"))
    with pytest.raises(Exception, match="bad row"):
        table.append(broken)
    for mode in ("merge", "copy"):
        with pytest.raises(Exception, match="bad row"):
            table.update("id > 1", {"v": "IF(id = 3, raise_error('bad row'), 0)"}, mode=mode)
    assert table.refresh().snapshot_ids == [1, 2]
    assert sorted(r.v for r in table.current().collect()) == [0, 10, 20, 30]
    assert table.append(numbers(spark, 4, 5)) == 3
    assert ids(table.current()) == [0, 1, 2, 3, 4]


def test_a_read_keeps_its_snapshot(spark, table):
    table.append(numbers(spark, 0, 4))
    before = table.current()
    table.update("id = 1", {"v": "-1"}, mode="copy")
    table.append(numbers(spark, 4, 9))
    assert before.count() == 4 and before.filter("v < 0").isEmpty()


def test_racing_writers_are_detected(spark, table):
    other = VersionedTable(spark, table.path)
    table.create_tag("a")
    other._state.refs.pop("a", None)
    with pytest.raises(RuntimeError, match="two writers"):
        other._record("tag", "b", snapshot_id=1)


def test_a_racing_writer_overwrites_no_rows(spark, table):
    """The slower of two writers with one commit number writes beside the other, and is then found out."""
    slower = VersionedTable(spark, table.path)
    slower.refresh = lambda: slower
    table.append(numbers(spark, 0, 5))
    mine = table.current()
    slower.append(numbers(spark, 50, 60))
    assert ids(mine) == [0, 1, 2, 3, 4]
    with pytest.raises(RuntimeError, match="two writers"):
        table.refresh()


def test_other_sessions_see_commits(spark, table):
    other = VersionedTable(spark, table.path)
    table.append(numbers(spark, 0, 2))
    assert other.is_empty() and not other.refresh().is_empty()


# -- plans ---------------------------------------------------------------------------------


def test_appended_rows_are_read_without_a_join(spark, table):
    for low in (0, 10, 20):
        table.append(numbers(spark, low, low + 10))
    plan = plan_of(table.current().filter("v > 100").select("id"))
    assert "Join" not in plan and "Exchange" not in plan
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,100)]" in plan
    assert "ReadSchema: struct<id:bigint,v:bigint>" in plan


def test_replaced_commits_are_not_read(spark, table):
    table.append(numbers(spark, 0, 10))
    table.append(numbers(spark, 10, 20))
    table.update("id < 10", {"v": "0"})
    table.update("id = 15", {"v": "0"})
    plan = table.read_plan(table.head())
    assert (plan.intact, plan.partial, plan.replacing) == ([(4, ""), (5, "")], [(3, "")], [5])
    assert plan.replacements == 1
    assert folders(table.current()) == {"commit_seq=3", "commit_seq=4", "commit_seq=5"}


def test_one_row_updates_write_one_row_whatever_went_before(spark, table):
    table.append(numbers(spark, 0, 1000))
    table.update("id < 600", {"v": "-1"})
    table.update("id = 700", {"v": "-2"})
    assert spark.read.parquet(f"{table.path}/log/commit_seq=4").count() == 1
    assert "broadcast" not in table.current()._jdf.queryExecution().logical().toString().lower()
    assert table.current().agg(F.sum("v")).first()[0] == -600 - 2 + sum(i * 10 for i in range(600, 1000) if i != 700)


def test_condition_is_evaluated_once(spark, table):
    table.append(numbers(spark, 0, 2000))
    seq = table.update("rand() < 0.5", {"v": "-1"})
    told = table.snapshots().where(f"snapshot_id = {seq}").first().summary["changed-records"]
    assert int(told) == table.current().where("v = -1").count()
    with pytest.raises(ValueError, match="deterministic"):
        table.update("rand() < 0.5", {"v": "-2"}, mode="copy")


def test_updates_that_rewrite_what_they_touch(spark, table):
    table.append(numbers(spark, 0, 10))
    table.append(numbers(spark, 10, 20))
    table.update("id IN (1, 11)", {"v": "-1"})
    assert table.read_plan(4).partial == [(2, ""), (3, "")]
    table.update("id = 12", {"v": "-2"}, mode="copy")
    plan = table.read_plan(5)
    assert (plan.partial, plan.replacements) == ([(2, "")], 1)
    table.update("id < 5", {"v": "v - 100"}, mode="copy")
    assert table.read_plan(6).partial == []
    read = plan_of(table.current())
    assert "Join" not in read and "Exchange" not in read
    wanted = {i: i * 10 for i in range(20)} | {1: -1, 11: -1, 12: -2}
    wanted |= {i: wanted[i] - 100 for i in range(5)}
    assert {r.id: r.v for r in table.current().collect()} == wanted
    changed = table.snapshots().orderBy("snapshot_id").select("summary").collect()
    assert [int(r.summary["changed-records"]) for r in changed] == [0, 0, 0, 2, 1, 5]
    assert table.record_count() == 20
    last = table.totals_by_snapshot("v").orderBy("snapshot_id").collect()[-1]
    assert (last.row_count, last.total) == (20, sum(wanted.values()))


def test_names_differing_in_case_and_times_going_back_are_refused(spark, table):
    with pytest.raises(ValueError, match="exists"):
        table.add_column("ID", "BIGINT")
    assert table.add_column("Id", "BIGINT", if_not_exists=True) is False
    table.append(numbers(spark, 0, 3), committed_at="2030-01-02 00:00:00")
    with pytest.raises(ValueError, match="before"):
        table.append(numbers(spark, 3, 5), committed_at="2030-01-01 00:00:00")
    assert table.refresh().current().count() == 3


def test_days_are_utc_in_every_zone(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS id, timestamp'2024-01-10 02:00:00Z' AS ts UNION ALL SELECT 2L, timestamp'1969-12-31 23:00:00Z'")
    table = VersionedTable.create(spark, str(tmp_path / "zones"), rows=rows, partition_by=[days("ts")])
    own = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        plain = table.current().where("ts BETWEEN '2024-01-09 17:00:00' AND '2024-01-09 19:00:00'").count()
        assert table.between("ts", "2024-01-09 17:00:00", "2024-01-09 19:00:00").count() == plain == 1
        table.append(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", own)
    found = {str(r.ts_day): r.record_count for r in table.partitions().collect()}
    assert found == {"2024-01-10": 2, "1969-12-31": 2}


# -- partitions and files ------------------------------------------------------------------


@pytest.fixture
def by_day(spark, tmp_path):
    rows = spark.range(48).select(
        "id", F.expr("TIMESTAMP '2024-05-01 00:00:00' + make_interval(0,0,0,0,id)").alias("ts")
    )
    return VersionedTable.create(
        spark, str(tmp_path / "d"), rows=rows, partition_by=[days("ts")], compression="gzip"
    )


def test_partition_by_day(by_day):
    assert by_day.current().columns == ["id", "ts"]
    found = {str(r.ts_day): r.record_count for r in by_day.partitions().collect()}
    assert found == {"2024-05-01": 24, "2024-05-02": 24}
    by_day.update("id = 0", {"ts": "ts + INTERVAL 1 DAY"})
    found = {str(r.ts_day): r.record_count for r in by_day.partitions().collect()}
    assert found == {"2024-05-01": 23, "2024-05-02": 25}


def test_rewrites_stay_within_partitions(spark, by_day):
    by_day.update("id < 3", {"id": "id + 100"}, mode="copy")
    plan = by_day.read_plan(2)
    assert plan.intact == [(1, "ts_day=2024-05-02"), (2, "ts_day=2024-05-01")]
    assert folders(by_day.current()) == {"commit_seq=1/ts_day=2024-05-02", "commit_seq=2/ts_day=2024-05-01"}
    assert ids(by_day.current()) == [*range(3, 48), 100, 101, 102]
    by_day.update("id = 47", {"ts": "NULL"}, mode="merge")
    by_day.update("id = 100", {"ts": "ts + INTERVAL 1 DAY"}, mode="copy")
    found = {str(r.ts_day): r.record_count for r in by_day.partitions().collect()}
    assert found == {"2024-05-01": 23, "2024-05-02": 24, "None": 1}
    by_day.update("ts IS NULL", {"id": "-1"}, mode="copy")
    assert ids(by_day.current())[0] == -1 and by_day.current().count() == 48
    sizes = by_day.totals_by_snapshot("id").orderBy("snapshot_id").collect()
    assert [r.row_count for r in sizes] == [48] * 5
    assert sizes[-1].total == by_day.current().agg(F.sum("id")).first()[0]


def test_range_read_prunes_partitions(by_day):
    rows = by_day.between("ts", "2024-05-02 01:00:00", "2024-05-02 03:00:00")
    assert ids(rows) == [25, 26, 27]
    assert "PartitionFilters: [isnotnull(ts_day" in plan_of(rows)


def test_codec(by_day):
    paths = [r.file_path for r in by_day.files().collect()]
    assert paths and all(p.endswith(".gz.parquet") for p in paths)


def test_partition_by_month(spark, tmp_path):
    sales = spark.sql(
        "SELECT id, 7L AS customer_id, CAST(id AS DECIMAL(10,2)) AS amount, "
        "date_add(DATE '2024-01-30', CAST(id AS INT)) AS sale_date FROM range(4)"
    )
    table = VersionedTable.create(spark, str(tmp_path / "s"), rows=sales, partition_by=[months("sale_date")])
    found = {str(r.sale_date_month): r.record_count for r in table.partitions().collect()}
    assert found == {"2024-01-01": 2, "2024-02-01": 2}


def test_files_hold_all_rows_that_are_read(spark, table):
    table.append(numbers(spark, 0, 10))
    table.append(numbers(spark, 10, 20))
    table.update("id = 3", {"v": "0"})
    files = table.files()
    assert files.agg(F.sum("record_count")).first()[0] == 21
    assert files.filter("file_size_in_bytes <= 0 OR file_format != 'PARQUET'").isEmpty()


def test_views_for_sql(spark, products):
    products.register_views("shelf")
    assert spark.sql("SELECT count(*) FROM shelf").first()[0] == 3
    assert spark.sql("SELECT count(*) FROM `shelf$snapshots`").first()[0] == 3
    assert spark.sql("SELECT type FROM `shelf$refs` WHERE name = 'v1_0_0'").first()[0] == "TAG"


# -- against a model -----------------------------------------------------------------------


@pytest.mark.parametrize("seed, modes", [(1, ["merge"]), (2, ["merge", "copy"])])
def test_random_commits_equal_a_model(spark, tmp_path, seed, modes):
    """Random appends and updates on three branches, each snapshot compared with plain dicts."""
    rng = random.Random(seed)
    table = VersionedTable.create(spark, str(tmp_path / "r"), "id BIGINT, v BIGINT")
    heads, states, next_id = {"main": {}}, {1: {}}, 0
    for step in range(9):
        if step in (2, 4):
            name = f"b{step}"
            parent = rng.choice(sorted(heads))
            table.create_branch(name, at=parent)
            heads[name] = dict(heads[parent])
        ref = rng.choice(sorted(heads))
        state = dict(heads[ref])
        if rng.random() < 0.4 or not state:
            fresh = range(next_id, next_id + rng.randint(1, 6))
            next_id = fresh.stop
            state.update({i: i for i in fresh})
            seq = table.append(spark.range(fresh.start, fresh.stop).select("id", F.col("id").alias("v")), ref)
        else:
            modulus, rest = rng.randint(1, 3), rng.randint(0, 2)
            state = {i: v + 100 if i % modulus == rest else v for i, v in state.items()}
            seq = table.update(f"id % {modulus} = {rest}", {"v": "v + 100"}, ref, mode=rng.choice(modes))
        heads[ref], states[seq] = state, state
    for seq, state in states.items():
        assert {r.id: r.v for r in table.as_of(version=seq).collect()} == state
        assert table.record_count(seq) == len(state)
    for ref, state in heads.items():
        assert {r.id: r.v for r in table.as_of(ref=ref).collect()} == state
        for row in table.totals_by_snapshot("v", ref).collect():
            known = states[row.snapshot_id]
            assert (row.row_count, row.total) == (len(known), sum(known.values()))


# -- skew ----------------------------------------------------------------------------------


def test_hot_partition_is_written_by_several_tasks(spark, tmp_path):
    """Two thirds of all rows on one day: its rows are split, the small days are merged."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32kb")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16kb")
    try:
        day = F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 20).cast("int")
        rows = spark.range(0, 30_000, 1, 8).select(
            "id", F.date_add(F.lit("2024-01-01").cast("date"), day).alias("d"), F.sha2(F.col("id").cast("string"), 256).alias("x")
        )
        table = VersionedTable.create(spark, str(tmp_path / "hot"), rows=rows, partition_by=[days("d")])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    per_day = {}
    for row in table.files().collect():
        per_day.setdefault(row.file_path.split("d_day=")[1][:10], []).append(row.record_count)
    assert len(per_day["2024-01-01"]) > 4
    assert max(per_day["2024-01-01"]) < 15_000
    assert table.record_count() == 30_000


def test_hot_id_spreads_over_the_sort(spark, tmp_path):
    from tidemark.plans.reports import _by_id

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("id"))
        table = VersionedTable.create(spark, str(tmp_path / "hot"), rows=rows)
        placed = _by_id(table.current(with_row_id=True)).groupBy(F.spark_partition_id()).count()
        sizes = [row["count"] for row in placed.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 9_000 and len(sizes) == 4
    assert max(sizes) < 3_500
