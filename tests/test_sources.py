import datetime
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources import files
from tidemark.sources import (
    append_table,
    conform,
    create_database,
    create_table,
    describe,
    detect_format,
    drop_table,
    inventory_listing,
    load_directory,
    load_file,
    overwrite_partitions,
    preview,
    register_file,
    schema_from,
    schema_overview,
    verify,
)

TARGET = "id BIGINT, name STRING, score DOUBLE, tags ARRAY<STRING>, missing DATE"
TEXT = "id STRING, name STRING, score STRING, tags STRING, extra STRING"


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


# -- formats -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "path, fmt",
    [
        ("a/b.csv", "csv"),
        ("a/b.PARQUET", "parquet"),
        ("b.json", "json"),
        ("b.orc", "orc"),
        ("b.avro", "avro"),
        ("b.txt", "csv"),
        ("noextension", "csv"),
    ],
)
def test_format_by_extension(path, fmt):
    assert detect_format(path) == fmt


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json", "orc"])
def test_round_trip(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(1, "x", 1.5), (2, "y", None)], "a BIGINT, b STRING, c DOUBLE")
    path = str(tmp_path / f"rows.{fmt}")
    rows.write.format(fmt).option("header", True).save(path)
    found = load_file(spark, path).select("a", "b", "c").orderBy("a").collect()
    assert [tuple(r) for r in found] == [(1, "x", 1.5), (2, "y", None)]


def test_csv_types_are_inferred(spark, tmp_path):
    path = write(tmp_path / "t.csv", "a,b,c,d", "1,x,2.5,2024-01-02", "2,y,3.5,2024-01-03")
    kinds = [f.dataType.simpleString() for f in load_file(spark, path).schema]
    assert kinds == ["int", "string", "double", "date"]


def test_flat_schema_goes_by_position(spark, tmp_path):
    path = write(tmp_path / "t.csv", "b,a", "1,2")
    assert load_file(spark, path, schema="a INT, b INT").first().asDict() == {"a": 1, "b": 2}
    strict = load_file(spark, path, schema="a INT, b INT", enforceSchema="false")
    with pytest.raises(Exception, match="header"):
        strict.collect()


def test_wrong_inputs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_file(spark, str(tmp_path / "none.csv"))
    path = write(tmp_path / "t.csv", "a", "1")
    with pytest.raises(ValueError, match="unsupported"):
        load_file(spark, path, "xml")
    with pytest.raises(ValueError, match="spark-avro"):
        load_file(spark, path, "avro")


@pytest.mark.parametrize(
    "names, fmt",
    [
        (["a.json"], "json"),
        (["a.json", "b.CSV", "c.txt"], "csv"),
        (["a.json", "b.csv", "c.Parquet"], "parquet"),
    ],
)
def test_directory_precedence(spark, tmp_path, monkeypatch, names, fmt):
    for name in names:
        write(tmp_path / name, "x")
    monkeypatch.setattr(files, "load_file", lambda spark, path, fmt: (path, fmt))
    assert load_directory(spark, str(tmp_path)) == (str(tmp_path), fmt)


def test_directory_is_read_whole(spark, tmp_path):
    for low in (0, 5):
        spark.range(low, low + 2).write.mode("append").parquet(str(tmp_path / "d"))
    assert load_directory(spark, str(tmp_path / "d")).count() == 4


def test_directory_without_data(spark, tmp_path):
    write(tmp_path / "notes.txt", "nothing")
    assert load_directory(spark, str(tmp_path)) is None
    assert load_directory(spark, str(tmp_path / "none")) is None


# -- schemas -------------------------------------------------------------------------------


def test_schema_from_all_forms(spark, tmp_path):
    wanted = StructType.fromDDL("a BIGINT, b ARRAY<STRING>")
    assert schema_from(spark, wanted) == wanted
    assert schema_from(spark, "a BIGINT, b ARRAY<STRING>") == wanted
    assert schema_from(spark, wanted.json()) == wanted
    assert schema_from(spark, write(tmp_path / "s.json", wanted.json())) == wanted
    assert schema_from(spark, write(tmp_path / "s.ddl", "a BIGINT,", "b ARRAY<STRING>")) == wanted
    assert schema_from(spark, None) is None


def test_unusable_schema_file_falls_back_to_inference(spark, tmp_path):
    data = write(tmp_path / "t.csv", "a", "1")
    with pytest.warns(UserWarning, match="inferred"):
        df = load_file(spark, data, schema=str(tmp_path / "none.json"))
    assert df.schema["a"].dataType.simpleString() == "int"
    broken = write(tmp_path / "broken.json", json.dumps({"type": "struct"}))
    with pytest.warns(UserWarning, match="inferred"):
        assert schema_from(spark, broken) is None


# -- conforming ----------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, wanted",
    [
        ('["a","b"]', ["a", "b"]),
        ("['x', 'y']", ["x", " y"]),
        ("[]", [""]),
        ("", []),
        (None, []),
        ('["O\'Neil","p,q"]', ["ONeil", "p", "q"]),
        ("[[a],[b]]", ["[a]", "[b]"]),
    ],
)
def test_array_text(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "tags STRING")
    assert conform(df, StructType.fromDDL("tags ARRAY<STRING>")).first().tags == wanted


def test_conform_to_target(spark):
    df = spark.createDataFrame([("1", "n", "x", "[a]", "e"), ("z", "m", "2.5", None, "e")], TEXT)
    out = conform(df, StructType.fromDDL(TARGET))
    assert out.columns == ["id", "name", "score", "tags", "missing"]
    assert out.schema["missing"].dataType.simpleString() == "date"
    rows = [tuple(r) for r in out.collect()]
    assert rows == [(1, "n", None, ["a"], None), (None, "m", 2.5, [], None)]


def test_arrays_of_other_types(spark):
    df = spark.createDataFrame([("[1,2]",)], "n STRING")
    target = StructType.fromDDL("n ARRAY<INT>")
    assert conform(df, target).first().n == ["1", "2"]
    assert conform(df, target, mode="json").first().n == [1, 2]
    with pytest.raises(ValueError):
        conform(df, target, mode="other")


def test_json_mode_keeps_quoted_commas(spark):
    df = spark.createDataFrame([('["O\'Neil","p,q"]',)], "tags STRING")
    out = conform(df, StructType.fromDDL("tags ARRAY<STRING>"), mode="json")
    assert out.first().tags == ["O'Neil", "p,q"]


def test_structs_and_maps_from_text(spark):
    df = spark.createDataFrame([('{"a": 1}', '{"k": "v"}')], "s STRING, m STRING")
    row = conform(df, StructType.fromDDL("s STRUCT<a: INT>, m MAP<STRING,STRING>")).first()
    assert row.s.a == 1 and row.m == {"k": "v"}


def test_typed_columns_stay(spark):
    df = spark.createDataFrame([(["a,b"], datetime.date(2024, 1, 2))], "tags ARRAY<STRING>, d DATE")
    row = conform(df, StructType.fromDDL("d TIMESTAMP, tags ARRAY<STRING>")).first()
    assert row.tags == ["a,b"] and row.d == datetime.datetime(2024, 1, 2)


def test_nested_csv(spark, tmp_path):
    path = write(tmp_path / "t.csv", "extra,id,tags,name", 'e,1,"[\'x\', \'y\']",n', "e,2,,m")
    rows = load_file(spark, path, schema=TARGET).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [
        (1, "n", None, ["x", " y"], None),
        (2, "m", None, [], None),
    ]


# -- catalog -------------------------------------------------------------------------------


def test_registration_replaces(spark, tmp_path):
    first = write(tmp_path / "a.csv", "id,name", "1,x", "2,y")
    second = write(tmp_path / "b.csv", "id", "7")
    row = register_file(spark, first, "demo_r", "t").first()
    assert tuple(row) == ("demo_r.t", 2, 2)
    row = register_file(spark, second, "demo_r", "t").first()
    assert (row.record_count, row.column_count) == (1, 1)
    assert spark.table("demo_r.t").first().id == 7
    drop_table(spark, "demo_r.t")
    drop_table(spark, "demo_r.t")
    with pytest.raises(AnalysisException):
        spark.table("demo_r.t").collect()


def test_registration_with_location(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id", "1")
    register_file(spark, path, "demo_l", "t", location=str(tmp_path / "wh"))
    assert (tmp_path / "wh" / "t").is_dir()


def test_catalog_table_is_created_once_and_appended(spark, tmp_path):
    create_database(spark, "demo_a", str(tmp_path / "wh"))
    for _ in range(2):
        create_table(spark, "demo_a.t", "id BIGINT, name STRING", "gzip")
    rows = spark.createDataFrame([("x", 1)], "name STRING, id BIGINT")
    for _ in range(2):
        append_table(rows, "demo_a.t")
    assert [tuple(r) for r in spark.table("demo_a.t").collect()] == [(1, "x")] * 2
    assert all(p.name.endswith(".gz.parquet") for p in (tmp_path / "wh" / "t").glob("part-*"))
    with pytest.raises(ValueError):
        append_table(rows.drop("name"), "demo_a.t")


def test_listing(spark, tmp_path):
    create_database(spark, "demo_list")
    create_database(spark, "demo_list")
    spark.range(1).write.mode("overwrite").saveAsTable("demo_list.only")
    rows = {tuple(r) for r in inventory_listing(spark).collect()}
    assert ("spark_catalog", "demo_list", "only") in rows
    assert ("spark_catalog", None, None) in rows


def test_verify_preview_and_overview(spark):
    wide = spark.range(9).select("id", *(F.lit(i).alias(f"c{i}") for i in range(11)))
    wide.write.mode("overwrite").saveAsTable("wide_table")
    assert tuple(verify(spark, ["wide_table"]).first()) == ("wide_table", 9, 12)
    head = preview(wide, ["id"])
    assert head.columns == ["id", "c0", "c1", "c2", "c3"]
    assert [r.id for r in head.collect()] == [0, 1, 2, 3, 4]
    lines = schema_overview(wide)
    assert lines[0] == "id: bigint" and lines[-1] == "... and 2 more columns" and len(lines) == 11
    assert len(schema_overview(spark.range(1))) == 1


def test_describe(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a BIGINT, b STRING")
    assert [tuple(r) for r in describe(df).collect()] == [(1, "a", "bigint"), (2, "b", "string")]
    assert [r.filled for r in describe(df, filled=True).orderBy("position").collect()] == [2, 1]


def test_overwrite_only_touches_its_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id BIGINT, k STRING")
    overwrite_partitions(rows, path, ["k"])
    overwrite_partitions(spark.createDataFrame([(9, "a")], "id BIGINT, k STRING"), path, ["k"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(9, "a"), (3, "b")}


def test_failed_registration_keeps_the_earlier_table(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "good.parquet"))
    register_file(spark, str(tmp_path / "good.parquet"), "kept", "t", location=str(tmp_path / "it's"))
    bad = tmp_path / "bad.parquet"
    spark.range(4).coalesce(1).write.parquet(str(bad))
    (bad / "part-99999.parquet").write_bytes(b"PAR1 cut off PAR1")
    with pytest.raises(Exception):
        register_file(spark, str(bad), "kept", "t")
    assert spark.table("kept.t").count() == 3
    spark.range(5).write.parquet(str(tmp_path / "more.parquet"))
    register_file(spark, str(tmp_path / "more.parquet"), "kept", "t")
    assert spark.table("kept.t").count() == 5
    assert [t.name for t in spark.catalog.listTables("kept")] == ["t"]
    spark.sql("DROP DATABASE kept CASCADE")
