import datetime
import time
import warnings

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.functions import cleaned_name, filled_score, part_count
from tidemark.plans import pipelines, story
from tidemark.sources import tables

RUN = "2024-02-01 10:00:00"

GOLDEN_NAMES = [
    (1, "John Michael Doe", "John Michael Doe", 3),
    (2, "Jane Elizabeth Smith-Wilson", "Jane Elizabeth SmithWilson", 3),
    (3, "Carlos Rodriguez Martinez", "Carlos Rodriguez Martinez", 3),
    (4, "Emma Wilson", "Emma Wilson", 2),
    (5, "Yuki Tanaka Sato", "Yuki Tanaka Sato", 3),
    (6, "Dr. Sarah Connor-Johnson PhD", "Dr Sarah ConnorJohnson PhD", 4),
    (7, "Muhammad Ali Hassan", "Muhammad Ali Hassan", 3),
    (8, "Maria Garcia Lopez", "Maria Garcia Lopez", 3),
    (9, "David Kim", "David Kim", 2),
    (10, "Anna-Marie O'Sullivan", "AnnaMarie OSullivan", 2),
]


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize(
    "name, cleaned, parts, score",
    [
        ("", "", 1, 0.0),
        (" lead trail ", " lead trail ", 4, 1.0),
        ("José Ñandú", "Jos and", 2, 1.0),
        ("a\tb\nc", "a\tb\nc", 3, 1.0),
        (None, None, -1, 0.0),
    ],
)
def test_name_functions(spark, ansi, name, cleaned, parts, score):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(name,)], "n STRING")
        row = df.select(cleaned_name(F.col("n")), part_count(F.col("n")), filled_score(F.col("n")))
        assert tuple(row.first()) == (cleaned, parts, score)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.fixture
def output(spark, tmp_path):
    return pipelines.create_output(spark, str(tmp_path / "out"), pipelines.NAME_OUTPUT)


def test_name_pipeline(spark, tmp_path, output):
    names = story.seed_names(spark, str(tmp_path / "in"))
    assert pipelines.run_names(names.current(), output, run_ts=RUN) == 10
    rows = output.current().orderBy("id").collect()
    assert [tuple(r)[:4] for r in rows] == GOLDEN_NAMES
    assert {r.processing_timestamp for r in rows} == {datetime.datetime(2024, 2, 1, 10)}
    assert [str(r[0]) for r in output.partitions().collect()] == ["2024-02-01"]
    assert all(r.file_path.endswith(".gz.parquet") for r in output.files().collect())
    # A second run appends the same rows again.
    assert pipelines.run_names(names.current(), output, run_ts=RUN) == 10
    assert output.record_count() == 20
    story.seed_names(spark, str(tmp_path / "in"))
    assert names.refresh().record_count() == 10


def test_one_run_has_one_time(spark, output):
    pipelines.run_names(spark.createDataFrame(story.NAMES, pipelines.NAME_INPUT), output)
    first = output.current().select("processing_timestamp").distinct().collect()
    again = output.current().select("processing_timestamp").distinct().collect()
    assert len(first) == 1 and first == again


def test_empty_input_stops_the_pipeline(spark, output):
    with pytest.raises(ValueError, match="no input"):
        pipelines.run_names(spark.createDataFrame([], pipelines.NAME_INPUT), output)
    assert output.refresh().snapshot_ids == [1]


def test_columns_go_by_position(spark):
    df = spark.createDataFrame([(7, "Ann Lee", "x")], "key BIGINT, who STRING, more STRING")
    row = pipelines.summarize_names(df, RUN).first()
    assert tuple(row)[:4] == (7, "Ann Lee", "Ann Lee", 2)
    row = pipelines.summarize_names(df.select("key"), RUN).first()
    assert tuple(row)[:4] == (7, "", "", 1)
    row = pipelines.summarize_names(df.select(), RUN).first()
    assert tuple(row)[:4] == (1, "", "", 1)


def test_own_transformation(spark, tmp_path):
    from tidemark.operators import days

    target = pipelines.create_output(
        spark, str(tmp_path / "own"), "id BIGINT, at TIMESTAMP", days("at")
    )

    def mine(df, run_ts):
        return df.select("id", F.lit(run_ts).cast("timestamp").alias("at"))

    source = spark.createDataFrame(story.NAMES, pipelines.NAME_INPUT)
    assert pipelines.run_names(source, target, mine, RUN) == 10


def test_scored_pipeline(spark, tmp_path):
    target = pipelines.create_output(spark, str(tmp_path / "s"), pipelines.SCORED_OUTPUT)
    names = spark.createDataFrame([(1, "A B"), (2, ""), (3, None)], pipelines.NAME_INPUT)
    pipelines.run_names(names, target, pipelines.score_names, RUN)
    found = {r.id: (r.data_quality_score, r.pipeline_version) for r in target.current().collect()}
    assert found == {1: (1.0, "v1.0"), 2: (0.0, "v1.0"), 3: (0.0, "v1.0")}
    target.add_column("data_lineage", "STRING")
    assert target.current().columns[-1] == "data_lineage"


def test_migration(spark, tmp_path):
    spark.createDataFrame(
        [(1, "Ann Lee", "Ann", "Lee")], "id BIGINT, full_name STRING, first_name STRING, last_name STRING"
    ).write.parquet(str(tmp_path / "legacy"))
    target = pipelines.create_output(
        spark, str(tmp_path / "m"), pipelines.MIGRATED_INPUT, pipelines.days("processed_date")
    )
    assert pipelines.migrate_directory(spark, str(tmp_path / "none"), target, RUN) == 0
    assert pipelines.migrate_directory(spark, str(tmp_path / "legacy"), target, RUN) == 1
    assert tuple(target.current().first()) == (
        1, "Ann Lee", "Ann", "Lee", datetime.datetime(2024, 2, 1, 10), "legacy_migration",
    )


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_migration_takes_types_from_the_target(spark, tmp_path, fmt):
    legacy = [("07", "Ann Lee", "Ann", "Lee"), ("x", "Bo", "Bo", None)]
    rows = spark.createDataFrame(legacy, "id STRING, full_name STRING, first_name STRING, last_name STRING")
    if fmt == "json":
        rows = rows.selectExpr("try_cast(id AS BIGINT) AS id", "full_name", "first_name", "last_name")
    rows.write.format(fmt).option("header", True).save(str(tmp_path / "legacy"))
    target = pipelines.create_output(
        spark, str(tmp_path / "m"), pipelines.MIGRATED_INPUT, pipelines.days("processed_date")
    )
    assert pipelines.migrate_directory(spark, str(tmp_path / "legacy"), target, RUN) == 2
    found = {tuple(r)[:4] for r in target.current().collect()}
    assert found == {(7, "Ann Lee", "Ann", "Lee"), (None, "Bo", "Bo", None)}


def legacy_files(tmp_path, fmt, names, rows):
    """Lines of JSON text, or CSV with the same values; None leaves a field out."""
    path = tmp_path / "legacy"
    path.mkdir()
    if fmt == "json":
        each = (", ".join(f'"{n}": {v}' for n, v in zip(names, r) if v is not None) for r in rows)
        lines = [f"{{{fields}}}" for fields in each]
    else:
        lines = [",".join(names)] + [",".join((v or "").strip('"') for v in r) for r in rows]
    (path / f"part.{fmt}").write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture
def migrated(spark, tmp_path):
    return pipelines.create_output(
        spark, str(tmp_path / "m"), pipelines.MIGRATED_INPUT, pipelines.days("processed_date")
    )


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_migration_keeps_quoted_and_decimal_numbers(spark, tmp_path, migrated, fmt):
    ids = ['"7"', "8.0", "9", "1e2", '"010"', str(2**63 - 1), None]
    path = legacy_files(tmp_path, fmt, ("ID", "full_name"), [(i, f'"n{k}"') for k, i in enumerate(ids)])
    with warnings.catch_warnings():
        warnings.filterwarnings("error", message="values of")
        assert pipelines.migrate_directory(spark, path, migrated, RUN) == 7
    found = {r.full_name: r.id for r in migrated.current().collect()}
    assert [found[f"n{k}"] for k in range(7)] == [7, 8, 9, 100, 10, 2**63 - 1, None]


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_migration_reports_values_that_do_not_cast(spark, tmp_path, migrated, fmt):
    rows = [('"x"', '"a"'), ("8.5", '"b"'), ("1e30", '"c"'), (None, '"d"'), ("4", None)]
    path = legacy_files(tmp_path, fmt, ("id", "full_name"), rows)
    with pytest.warns(UserWarning, match=r"do not cast are NULL: \{'id': 3\}"):
        assert pipelines.migrate_directory(spark, path, migrated, RUN) == 5
    found = {r.full_name: r.id for r in migrated.current().collect()}
    assert found == {"a": None, "b": None, "c": None, "d": None, None: 4}


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_migration_refuses_columns_the_target_lacks(spark, tmp_path, migrated, fmt):
    path = legacy_files(tmp_path, fmt, ("id", "Phone"), [("1", None), ("2", '"55"')])
    with pytest.raises(ValueError, match=r"columns not in the table: \['Phone'\]"):
        pipelines.migrate_directory(spark, path, migrated, RUN)
    assert migrated.refresh().is_empty("main")


def test_migration_refuses_json_that_is_cut_off(spark, tmp_path, migrated):
    path = legacy_files(tmp_path, "json", ("id",), [("1",), ('"2',)])
    with pytest.raises(ValueError, match="_corrupt_record"):
        pipelines.migrate_directory(spark, path, migrated, RUN)


@pytest.mark.parametrize("fmt, text", [("csv", "id,full_name\n"), ("csv", ""), ("json", "")])
def test_migration_of_files_without_rows(spark, tmp_path, migrated, fmt, text):
    (tmp_path / "legacy").mkdir()
    (tmp_path / "legacy" / f"part.{fmt}").write_text(text)
    assert pipelines.migrate_directory(spark, str(tmp_path / "legacy"), migrated, RUN) == 0


def test_pipeline_between_catalog_tables(spark):
    spark.createDataFrame(story.NAMES, pipelines.NAME_INPUT).write.mode("overwrite").saveAsTable("names_given")
    spark.sql("DROP TABLE IF EXISTS names_done")
    pipelines.create_output_table(spark, "names_done")
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    run = pipelines.run_names_table
    assert run(spark, "names_given", "names_done", run_ts="2024-02-01 10:00:00") == 10
    assert run(spark, "names_given", "names_done", run_ts="2024-02-02 10:00:00") == 10
    assert run(spark, "names_given", "names_done", run_ts="2024-02-02 11:00:00") == 10
    assert spark.table("names_done").count() == 30
    assert run(spark, "names_given", "names_done", run_ts="2024-02-02 12:00:00", overwrite=True) == 10
    days = spark.table("names_done").groupBy("processing_timestamp_day", "processing_timestamp").count()
    assert sorted((str(d), str(t), n) for d, t, n in days.collect()) == [
        ("2024-02-01", "2024-02-01 10:00:00", 10),
        ("2024-02-02", "2024-02-02 12:00:00", 10),
    ]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
    spark.sql("TRUNCATE TABLE names_given")
    with pytest.raises(ValueError):
        run(spark, "names_given", "names_done")
    spark.sql("DROP TABLE names_done")
    spark.sql("DROP TABLE names_given")


def test_cleaning_keeps_ascii_letters_and_white_space_of_all_characters(spark):
    every = [chr(c) for c in (*range(0x1, 0xD800), *range(0xE000, 0x11000), 0x1F600, 0x10FFFF)]
    df = spark.createDataFrame([("".join(every), every)], "n STRING, each ARRAY<STRING>")
    plain = F.regexp_replace("n", r"[^a-zA-Z\s]", "")
    found, told, parted = df.select(
        cleaned_name(F.col("n")), plain, F.transform("each", lambda c: cleaned_name(c))
    ).first()
    assert found == told == "".join(parted)
    assert sorted(found) == sorted("\t\n\x0b\f\r abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def test_cleaning_long_texts_takes_less_time_than_with_ranges(spark):
    text = F.concat(F.lit("Some Words, of a text - with 12 marks. "), F.col("id").cast("string"))
    df = spark.range(0, 4000, 1, 1).select(F.repeat(text, 200).alias("n")).cache()
    df.count()

    def seconds(column):
        taken = []
        for _ in range(4):
            start = time.perf_counter()
            df.select(column).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        return min(taken)

    name = F.col("n")
    assert seconds(cleaned_name(name)) < 0.7 * seconds(F.regexp_replace(name, r"[^a-zA-Z\s]", ""))
    df.unpersist()


def _chunk_bytes(folder):
    files = [p for p in folder.rglob("*.parquet") if not any(x.startswith(("_", ".")) for x in p.parts)]
    groups = [pq.ParquetFile(p).metadata.row_group(0) for p in files]
    assert groups and {g.column(1).compression for g in groups} == {"GZIP"}
    return sum(g.column(1).total_compressed_size for g in groups)


@pytest.mark.parametrize("catalog", [True, False])
def test_names_are_written_with_the_quick_level_of_gzip(spark, tmp_path, catalog):
    words = F.expr("aggregate(sequence(1, 400), '', (t, k) -> concat(t, ' ', hex(pmod(xxhash64(id, k), 5000))))")
    names = spark.range(0, 500, 1, 1).select("id", words.alias("full_name"))
    sizes = {}
    for level in ("THREE", "DEFAULT_COMPRESSION"):
        at = tmp_path / level
        names.write.options(**{"compression": "gzip", "zlib.compress.level": level}).parquet(str(at))
        sizes[level] = _chunk_bytes(at)
    if catalog:
        names.write.mode("overwrite").saveAsTable("level_given")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS levels LOCATION '{tmp_path}/levels'")
        pipelines.create_output_table(spark, "levels.done")
        pipelines.run_names_table(spark, "level_given", "levels.done", run_ts=RUN)
        found = _chunk_bytes(tmp_path / "levels")
        spark.sql("DROP DATABASE levels CASCADE")
        spark.sql("DROP TABLE level_given")
    else:
        target = pipelines.create_output(spark, str(tmp_path / "own"), pipelines.NAME_OUTPUT)
        pipelines.run_names(names, target, run_ts=RUN)
        found = _chunk_bytes(tmp_path / "own" / "log")
    assert sizes["DEFAULT_COMPRESSION"] < 0.99 * sizes["THREE"]
    assert abs(found - sizes["THREE"]) < 0.002 * sizes["THREE"]


def test_inserts_do_not_sort_whole_texts_by_day(spark, monkeypatch):
    plans, by_name = [], tables._by_name

    def noted(df, table):
        df.createOrReplaceTempView("to_insert")
        plans.append(spark.sql(f"EXPLAIN INSERT INTO {table} SELECT * FROM to_insert").first()[0])
        spark.catalog.dropTempView("to_insert")
        return by_name(df, table)

    spark.createDataFrame(story.NAMES, pipelines.NAME_INPUT).write.mode("overwrite").saveAsTable("unsorted_given")
    spark.sql("DROP TABLE IF EXISTS unsorted_done")
    pipelines.create_output_table(spark, "unsorted_done")
    monkeypatch.setattr(tables, "_by_name", noted)
    keys = ("spark.sql.maxConcurrentOutputFileWriters", "spark.sql.sources.partitionOverwriteMode")
    before = [spark.conf.get(k) for k in keys]
    for overwrite in (False, True):
        pipelines.run_names_table(spark, "unsorted_given", "unsorted_done", run_ts=RUN, overwrite=overwrite)

    def by_id(df, run_ts):
        """Days that change from row to row."""
        at = F.timestamp_add("DAY", F.col("id") % 3, F.lit(run_ts).cast("timestamp"))
        return pipelines.summarize_names(df, run_ts).withColumn("processing_timestamp", at)

    pipelines.run_names_table(spark, "unsorted_given", "unsorted_done", by_id, RUN, overwrite=True)
    assert len(plans) == 3 and all("CollectMetrics" in p and "Sort" not in p for p in plans)
    found = spark.table("unsorted_done").select("id", F.col("processing_timestamp_day").cast("string")).collect()
    assert sorted(map(tuple, found)) == [(k, f"2024-02-0{1 + k % 3}") for k in range(1, 11)]
    assert [spark.conf.get(k) for k in keys] == before
    spark.sql("DROP TABLE unsorted_done")
    spark.sql("DROP TABLE unsorted_given")
