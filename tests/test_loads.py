"""Files whose headers differ, rescued values, and loads that are run again."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources import (
    append_table,
    conform,
    content_key,
    create_database,
    create_loaded_table,
    header_lines,
    load_by_header,
    load_directory,
    load_once,
    quarantine,
)

def TARGET():  # noqa: N802
    return StructType.fromDDL("id BIGINT, first_name STRING, last_name STRING")


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(folder)


@pytest.mark.parametrize("names", [("a", "b"), ("b", "a")])
def test_columns_go_by_each_files_header(spark, tmp_path, names):
    path = write(
        tmp_path / "in put",
        **{
            names[0]: "id,first_name,last_name\n1,Bob,Ray\n",
            names[1]: "\ufeffid,last_name,FIRST_NAME\n2,Ray,Bob\n",
            "c [1] {x}, %41": '\n\n"last_name",id\n"O\'Hara, Jr.",3\n',
            "d": "",
            "e": "id,first_name,last_name\n",
        },
    )
    found = load_directory(spark, path, TARGET())
    assert {tuple(r) for r in found.select("id", "first_name", "last_name").collect()} == {
        (1, "Bob", "Ray"), (2, "Bob", "Ray"), (3, None, "O'Hara, Jr."),
    }
    assert dict(found.dtypes)["id"] == "bigint"
    assert sorted(map(len, header_lines(spark, path).values())) == [1, 1, 2]


@pytest.mark.parametrize("names", [("a", "b"), ("b", "a")])
def test_extra_columns_are_refused_in_any_file(spark, tmp_path, names):
    path = write(tmp_path / "in", **{names[0]: "id,first_name\n1,x\n", names[1]: "id,nick\n2,y\n"})
    with pytest.raises(ValueError, match="nick"):
        load_directory(spark, path, TARGET())
    twice = write(tmp_path / "twice", a="id,ID\n1,2\n")
    with pytest.raises(ValueError, match="twice"):
        load_directory(spark, twice, TARGET())
    assert load_by_header(spark, write(tmp_path / "none", a="", b="\n")) is None
    assert load_directory(spark, str(tmp_path / "none"), TARGET()) is None


def test_many_files_are_one_scan_per_header(spark, tmp_path, capsys):
    path = write(tmp_path / "in", **{f"f{i}": f"{'a,b' if i % 2 else 'b,a'}\n{i},{-i}\n" for i in range(30)})
    found = load_by_header(spark, path)
    rows = {(r.a, r.b) for r in found.collect()}
    assert rows == {(str(i), str(-i)) if i % 2 else (str(-i), str(i)) for i in range(30)}
    found.explain()
    assert capsys.readouterr().out.count("FileScan csv") == 2


def test_rescued_values_give_the_input_back(spark):
    text = spark.createDataFrame(
        [("1", "2.5", "[1,2]", "e"), ("x", None, "nope", None), ("3", "y", None, "f"), (None, None, None, None)],
        "id string, price string, tags string, extra string",
    )
    target = StructType.fromDDL("id INT, price DECIMAL(5,1), tags ARRAY<INT>, missing DATE")
    found = conform(text, target, mode="json", rescue="lost")
    assert found.columns == ["id", "price", "tags", "missing", "lost"]
    assert [r.lost for r in found.collect()] == [
        {"extra": "e"}, {"id": "x", "tags": "nope"}, {"price": "y", "extra": "f"}, None,
    ]
    good, bad = quarantine(conform(text.drop("extra"), target, mode="json", rescue="lost"), "lost")
    assert good.columns == target.names and [r.id for r in good.collect()] == [1, None]
    assert [(r.id, r.lost) for r in bad.collect()] == [(None, {"id": "x", "tags": "nope"}), (3, {"price": "y"})]
    with pytest.raises(ValueError, match="PRICE"):
        conform(text, target, rescue="PRICE")


def test_content_key_knows_rows_not_order(spark):
    rows = spark.createDataFrame([(i, f"x{i % 3}") for i in range(50)] + [(None, None)], "a int, b string")
    key = content_key(rows)
    assert key == content_key(rows.repartition(7).select("b", "a"))
    assert key != content_key(rows.union(rows.limit(1))) and key != content_key(rows.where("a != 3"))
    assert content_key(rows.limit(0)) == "-".join(["0" * 16] * 3)


def test_a_broken_load_is_finished_and_never_doubled(spark, tmp_path):
    create_database(spark, "loads", str(tmp_path / "loads"))
    rows = spark.createDataFrame(
        [(i % 40, None if i % 5 == 0 else f"x{i % 3}", float(i % 2)) for i in range(200)] + [(1, "same", 0.0)] * 300,
        "a int, `b c` string, v double",
    )
    table = "loads.target"
    create_loaded_table(rows, table)
    key = content_key(rows)
    half = rows.where("a < 17 and not `b c` <=> 'same'").union(rows.where("`b c` = 'same'").limit(120)).withColumn("load_key", F.lit(key))
    append_table(half, table)
    assert load_once(rows, table) == 500 - half.count() > 0
    assert load_once(rows.repartition(3), table) == 0
    count = lambda df: Counter(tuple(r) for r in df.drop("load_key").collect())
    assert count(spark.table(table)) == count(rows)
    assert load_once(rows, table, "again") == 500 and spark.table(table).count() == 1000
    assert load_once(rows.limit(0), table, "nothing") == 0
    with pytest.raises(ValueError, match="load_key"):
        load_once(half, table)
