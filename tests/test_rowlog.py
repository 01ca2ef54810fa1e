"""States, totals, layers, differences and update chains against plain Python."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import RowLog, Update, compare, fold_updates, overlay

R = random.Random(9)
START = datetime(2024, 1, 1)
LOG = "k long, name string, worth decimal(10,2), commit_id int, sequence int, committed_at timestamp, deleted boolean"


@pytest.fixture(scope="module")
def versions():
    """Twelve commits; one key has a third of all versions, one key is NULL."""
    rows = []
    for commit in range(1, 13):
        for sequence in range(60):
            k = 7 if sequence % 3 == 0 else R.choice([None, *range(30)])
            worth = R.choice([None, Decimal(R.randrange(9999)).scaleb(-2)])
            gone = R.choice([True, False, None, None])
            rows.append((k, R.choice("abc"), worth, commit, sequence, START + timedelta(hours=commit), gone))
    rows.append((99, "stray", None, None, 0, None, False))
    return rows


@pytest.fixture(scope="module")
def log(spark, versions):
    return RowLog(spark.createDataFrame(versions, LOG).repartition(5), ["k"])


def replay(versions, until):
    table = {}
    for k, name, worth, commit, _, _, gone in sorted((v for v in versions if v[3]), key=lambda v: (v[3], v[4])):
        if commit <= until:
            table[k] = None if gone else (name, worth)
    return {k: row for k, row in table.items() if row}


def test_states(log, versions):
    as_dict = lambda df: {r.k: (r.name, r.worth) for r in df.collect()}
    for version in (0, 1, 5, 12):
        assert as_dict(log.state(version=version)) == replay(versions, version)
        at = START + timedelta(hours=version)
        assert as_dict(log.state(timestamp=at)) == replay(versions, version)
        assert as_dict(log.state(timestamp=at + timedelta(minutes=59))) == replay(versions, version)
    assert as_dict(log.state()) == replay(versions, 12)
    names = log.state(columns=["name"])
    assert names.columns == ["k", "name"] and {r.k: r.name for r in names.collect()} == {
        k: row[0] for k, row in replay(versions, 12).items()
    }
    with pytest.raises(ValueError):
        log.state(version=1, timestamp=START)


def test_a_hot_key_is_reduced_before_the_shuffle(log, capsys):
    log.state().explain()
    plan = capsys.readouterr().out
    assert "partial_max" in plan and plan.count("Exchange hashpartitioning(k") == 1 and "Window" not in plan


def test_totals_at_every_commit(log, versions):
    got = {r.commit_id: (r.total_rows, r.total_worth) for r in log.totals(["worth"], ranges=3).collect()}
    for commit in range(1, 13):
        rows = replay(versions, commit).values()
        assert got[commit] == (len(rows), sum((w for _, w in rows if w is not None), Decimal(0)))
    assert set(got) == set(range(1, 13))


def test_empty_log(spark):
    log = RowLog(spark.createDataFrame([], LOG), ["k"])
    assert log.state().count() == 0 and log.totals(["worth"]).count() == 0


def test_overlay_and_differences(spark):
    schema = "a int, b string, v double, gone boolean"
    base = spark.createDataFrame([(i, "x", float(i), None) for i in range(6)] + [(None, None, 1.0, False)], schema)
    top = spark.createDataFrame(
        [(1, "x", 10.0, False), (2, "x", None, True), (8, "y", 8.0, None), (None, None, None, False), (3, "z", 0.0, False)], schema
    )
    back = spark.createDataFrame([(2, "x", 22.0, False)], schema).select("gone", "v", "b", "a")
    over = overlay([base, top, back], ["a", "b"], "gone")
    assert over.columns == ["a", "b", "v"]
    wanted = {(i, "x"): float(i) for i in range(6)} | {(1, "x"): 10.0, (2, "x"): 22.0, (8, "y"): 8.0, (None, None): None, (3, "z"): 0.0}
    assert {(r.a, r.b): r.v for r in over.collect()} == wanted
    hidden = overlay([base, top], ["a", "b"], "gone")
    assert (2, "x") not in {(r.a, r.b) for r in hidden.collect()}
    differ = {(r.a, r.b): r for r in compare(base.drop("gone"), hidden, ["a", "b"]).collect()}
    assert {k: r.status for k, r in differ.items()} == {
        (0, "x"): "same", (1, "x"): "changed", (2, "x"): "removed", (3, "x"): "same", (4, "x"): "same", (5, "x"): "same",
        (None, None): "changed", (8, "y"): "added", (3, "z"): "added",
    }
    assert differ[1, "x"].changed_columns == ["v"] and differ[1, "x"].right_row.v == 10.0
    assert differ[0, "x"].changed_columns is None and differ[8, "y"].left_row is None
    assert compare(base.limit(0), base.limit(0), ["a", "b"]).count() == 0


def test_overlay_is_one_aggregate(spark, capsys):
    layer = spark.range(5).withColumn("v", F.lit(1))
    overlay([layer, layer, layer], ["id"]).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_update_chain(spark, capsys):
    df = spark.createDataFrame([(1, 50, None), (2, 500, "x"), (3, None, "y"), (4, 999, None)], "id int, hit_1 int, tier string")
    updates = [
        Update("hit_1 > 100", {"tier": "'high'", "hit_1": "hit_1 + 1000"}),
        Update("hit_1 > 1500", {"tier": "upper(tier)"}),
        Update(F.col("tier").isNull(), {"tier": F.lit("none"), "hit_1": "id * 1.9"}),
    ]
    found = fold_updates(df, updates, "hits")
    assert found.collect() == [(1, 1, "none", [3]), (2, 1500, "high", [1]), (3, None, "y", []), (4, 1999, "HIGH", [1, 2])]
    assert fold_updates(df, []).collect() == df.collect()
    # Values are those of the row before the update, as in one UPDATE statement.
    swapped = fold_updates(spark.createDataFrame([(1, 2)], "a int, b int"), [Update("true", {"a": "b", "b": "a"})])
    assert swapped.collect() == [(2, 1)]
    with pytest.raises(ValueError, match="nope"):
        fold_updates(df, [Update("true", {"nope": "1"})])
    fold_updates(spark.range(9).withColumn("v", F.lit(1)), updates=[Update("id > 3", {"v": "v + 1"})] * 5).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and plan.count("Range") == 1
