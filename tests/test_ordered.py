"""Numbers, earlier rows, running sums and joined text over whole tables, against plain Python."""

import random
from datetime import datetime, timedelta
from decimal import Decimal
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tidemark.operators import first_and_last, in_order, joined_text, number, previous, range_of, running_sum

R = random.Random(4)
START = datetime(2024, 1, 1)


def low(x):
    return (x is not None, x)


@pytest.fixture(scope="module")
def rows():
    """A third of the rows share one time, another part has none."""
    times = [START, *(START + timedelta(minutes=i) for i in range(200)), None]
    weights = [100, *[1] * 200, 40]
    return [
        (i, R.choices(times, weights)[0], R.choice([None, i, -i]), Decimal(R.randrange(10**6)).scaleb(-2), f"t{i % 7}")
        for i in range(3000)
    ]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, ts timestamp, v long, d decimal(12,2), range_of_rows string").repartition(7)


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_items_in_order(table, rows, ranges):
    found = in_order(
        table, ["ts", "id"], ranges, place=number(), back=number(descending=True), before=previous("v", -1),
        d_before=previous("d"), total=running_sum("v"), worth=running_sum("d"),
    )
    assert found.columns == [*table.columns, "place", "back", "before", "d_before", "total", "worth"]
    got = sorted(found.collect(), key=lambda r: r.place)
    wanted = sorted(rows, key=lambda r: (low(r[1]), r[0]))
    assert [r.id for r in got] == [r[0] for r in wanted]
    assert [(r.place, r.back) for r in got] == [(i + 1, len(rows) - i) for i in range(len(rows))]
    assert [r.before for r in got] == [-1, *(r[2] for r in wanted[:-1])]
    assert [r.d_before for r in got] == [None, *(r[3] for r in wanted[:-1])]
    add = lambda a, b: a if b is None else b if a is None else a + b
    assert [r.total for r in got] == list(accumulate((r[2] for r in wanted), add))
    assert [r.worth for r in got] == list(accumulate((r[3] for r in wanted), add))


def test_a_common_value_spreads_over_ranges(table):
    sizes = {r["at"]: r["count"] for r in table.groupBy(range_of(table, ["ts", "id"], 20).alias("at")).count().collect()}
    assert len(sizes) == 20 and max(sizes.values()) < 3000 * 0.15
    tied = {r["at"]: r["count"] for r in table.groupBy(range_of(table, ["ts"], 20).alias("at")).count().collect()}
    assert len(tied) == 20 and max(tied.values()) < 3000 * 0.15


def test_ranges_rise_with_the_order(table):
    found = table.select("ts", "id", range_of(table, ["ts", "id"], 20).alias("at")).collect()
    places = [r["at"] for r in sorted(found, key=lambda r: (low(r.ts), r.id))]
    assert places == sorted(places)


def test_rows_alike_empty_tables_and_types(spark):
    same = spark.createDataFrame([(1, "x")] * 50 + [(None, "y")] * 3, "k int, s string")
    got = in_order(same, ["k"], 4, place=number(), before=previous("s")).collect()
    assert sorted(r.place for r in got) == list(range(1, 54))
    assert sorted(r.place for r in got if r.k is None) == [1, 2, 3]
    empty = in_order(same.limit(0), ["k"], place=number(), total=running_sum("k"))
    assert empty.count() == 0 and empty.columns == ["k", "s", "place", "total"]
    mixed = spark.createDataFrame(
        [(float(i), f'"{i % 3}\n\\', bytes([i]), START.date() + timedelta(i % 5), [i]) for i in range(100)],
        "x double, s string, b binary, day date, list array<int>",
    )
    got = in_order(mixed, ["day", "s", "b", "list", "x"], 9, place=number()).collect()
    wanted = sorted((r.day, r.s, bytes(r.b), r.x) for r in got)
    assert [(r.day, r.s, bytes(r.b), r.x) for r in sorted(got, key=lambda r: r.place)] == wanted


def test_no_window_without_partitions(table, capsys):
    in_order(table, ["ts"], place=number(), total=running_sum("v")).explain()
    plan = capsys.readouterr().out
    assert "SinglePartition" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("ranges", [1, 16])
def test_joined_text(spark, rows, table, ranges):
    named = table.withColumn("s", F.when(F.col("v").isNotNull(), F.concat(F.lit("n"), "id"))).withColumn(
        "g", F.when(F.col("id") < 2000, "big").when(F.col("id") < 2900, F.col("range_of_rows"))
    )
    got = {r.g: r.joined for r in joined_text(named, ["g"], "s", ["ts", "id"], " | ", ranges=ranges).collect()}
    group = lambda r: "big" if r[0] < 2000 else r[4] if r[0] < 2900 else None
    for g in {group(r) for r in rows}:
        own = sorted((r for r in rows if group(r) == g and r[2] is not None), key=lambda r: (low(r[1]), r[0]))
        assert got[g] == " | ".join(f"n{r[0]}" for r in own)
    none = spark.createDataFrame([(1, None), (1, None)], "g int, s string")
    assert joined_text(none, ["g"], "s", ["s"]).collect() == [(1, None)]
    assert joined_text(none.limit(0), ["g"], "s", ["s"]).count() == 0


@pytest.mark.parametrize("order", [["ts", "id"], ["id"], ["range_of_rows", "id"], ["ts", "d", "id"]])
def test_first_and_last(rows, table, order):
    groups = table.withColumn("g", F.when(F.col("id") >= 2000, F.col("id") - F.col("id") % 100))
    names = ["id", "ts", "v", "d", "range_of_rows"]
    got = {r.g: r for r in first_and_last(groups, ["g"], order, names).collect()}
    at = [names.index(c) for c in order]
    for g in {r[0] - r[0] % 100 if r[0] >= 2000 else None for r in rows}:
        own = [r for r in rows if (r[0] - r[0] % 100 if r[0] >= 2000 else None) == g and r[at[0]] is not None]
        own.sort(key=lambda r: [low(r[i]) for i in at])
        assert [got[g][f"first_{c}"] for c in names] == list(own[0])
        assert [got[g][f"last_{c}"] for c in names] == list(own[-1])


def test_packed_orders_need_no_sort(spark, capsys):
    df = spark.createDataFrame([(1, START, 2**63 - 1), (1, START, -(2**63)), (1, START + timedelta(microseconds=1), -(2**63))], "g int, ts timestamp, k long")
    found = first_and_last(df, ["g"], ["ts", "k"], ["k", "ts"])
    assert found.collect() == [(1, -(2**63), START, -(2**63), START + timedelta(microseconds=1))]
    found.explain()
    assert "Sort" not in capsys.readouterr().out


def test_names_never_clash(spark):
    names = ["n", "range", "of_range", "rows_before", "before_0", "within_0", "tie_of_rows", "group", "items", "pieces"]
    df = spark.createDataFrame([tuple(range(i, i + 10)) for i in range(30)], ", ".join(f"`{c}` int" for c in names))
    found = in_order(df, ["n"], 4, total=running_sum("range"), key=previous("of_range"), place=number(), last=running_sum("n"))
    got = sorted(found.collect(), key=lambda r: r.place)
    assert found.columns[:10] == names and [r.total for r in got] == list(accumulate(range(1, 31)))
    assert [r.key for r in got] == [None, *range(2, 31)]
    text = joined_text(df.withColumn("v", F.col("n").cast("string")), ["group", "items", "pieces"], "v", ["range"], ranges=3)
    assert text.columns == ["group", "items", "pieces", "joined"] and text.count() == 30
