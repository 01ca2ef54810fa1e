"""One query per feature, over the driver's tables. Names follow the coverage list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import VersionedTable, days
from tidemark.functions import array_from_text
from tidemark.operators import (
    Update,
    compare,
    first_and_last,
    fold_updates,
    in_order,
    joined_text,
    number,
    overlay,
    previous,
    running_sum,
)
from tidemark.plans import pipelines, reports, story
from tidemark.sources import (
    append_table,
    conform,
    create_loaded_table,
    create_table,
    describe,
    drop_table,
    load_file,
    load_once,
    overwrite_partitions,
    preview,
    quarantine,
    register_file,
    verify,
)

from . import data

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Microseconds survive the text formats only when the pattern spells them out.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
NESTED_TARGET = (
    "id BIGINT, name STRING, score DOUBLE, tags ARRAY<STRING>, missing DATE"
)
ORDERS_SCHEMA = (
    "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
)


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return data.comparable(function(data.prepared(spark), sf_dir))

    QUERIES[function.__name__] = run
    return function


# -- sources -------------------------------------------------------------------------------


@query
def src_csv_infer(spark, sf):
    path = data.source_file(spark, sf, "csv", "customer", header=True)
    return load_file(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query
def src_csv_schema(spark, sf):
    path = data.source_file(spark, sf, "csv", "orders", header=True)
    return load_file(spark, path, schema=ORDERS_SCHEMA)


@query
def src_csv_complex(spark, sf):
    part = data.read(spark, sf, "part")
    quoted = [F.concat(F.lit('"'), c, F.lit('"')) for c in ("p_brand", "p_type", "p_name")]
    text = part.select(
        F.col("p_name").alias("name"),
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_type") == "PROMO", "x").otherwise(F.col("p_retailprice").cast("string")).alias("score"),
        F.when(F.col("p_size") > 40, None)
        .otherwise(F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]")))
        .alias("tags"),
        F.col("p_size").alias("extra"),
    )
    path = data.source_file(spark, sf, "csv", "part_text", text, header=True)
    return load_file(spark, path, schema=NESTED_TARGET).select(
        "id",
        "name",
        "score",
        F.array_join("tags", "|").alias("tags"),
        F.size("tags").alias("n_tags"),
        F.col("missing").isNull().alias("missing_is_null"),
    )


@query
def src_parquet(spark, sf):
    return load_file(spark, f"{sf}/lineitem.parquet")


@query
def src_json(spark, sf):
    path = data.source_file(spark, sf, "json", "events", timestampNTZFormat=MICROS)
    return load_file(spark, path)


@query
def src_orc(spark, sf):
    return load_file(spark, data.source_file(spark, sf, "orc", "lineitem"))


@query
def scan_table(spark, sf):
    return spark.table(f"{data.database(spark, sf)}.part")


@query
def conform_schema(spark, sf):
    orders = data.read(spark, sf, "orders")
    price = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string"))
    text = orders.select(
        F.col("o_orderdate").cast("string").alias("o_orderdate"),
        price.alias("o_totalprice"),
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        "o_orderpriority",
    )
    target = StructType.fromDDL(
        "o_orderkey BIGINT, o_totalprice DOUBLE, o_orderdate DATE, note STRING"
    )
    return conform(text, target).select(
        "o_orderkey", "o_totalprice", "o_orderdate", F.col("note").isNull().alias("note_is_null")
    )


@query
def conform_array_text(spark, sf):
    said = F.concat(F.lit('["'), "role", F.lit("\", '"), "text", F.lit("']"))
    rows = data.read(spark, sf, "conversations").select("conv_id", "turn", said.alias("tags"))
    parsed = rows.withColumn("tags", array_from_text(F.col("tags")))
    return parsed.select(
        "conv_id", "turn", F.array_join("tags", "|").alias("tags"), F.size("tags").alias("n_tags")
    )


def migrated_names(spark, sf):
    name = F.split("p_name", " ")
    return data.read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("full_name"),
        name[0].alias("first_name"),
        name[1].alias("last_name"),
    )


def migrated(spark, sf, fmt, **options):
    legacy = migrated_names(spark, sf)
    path = data.source_file(spark, sf, fmt, "legacy_names", legacy, **options)
    target = pipelines.create_output(
        spark, data.fresh_dir(spark, sf, "migrated"), pipelines.MIGRATED_INPUT, days("processed_date")
    )
    pipelines.migrate_directory(spark, path, target, data.RUN_TS)
    return target.current()


@query
def migrate_dir(spark, sf):
    return migrated(spark, sf, "json")


@query
def migrate_dir_csv(spark, sf):
    return migrated(spark, sf, "csv", header=True)


@query
def migrate_dir_parquet(spark, sf):
    return migrated(spark, sf, "parquet")


# -- sinks and DDL -------------------------------------------------------------------------


@query
def register_table(spark, sf):
    path = data.source_file(spark, sf, "csv", "orders", header=True)
    name = data.own_database(spark, sf)
    register_file(spark, path, name, "orders_registered", schema=ORDERS_SCHEMA)
    return spark.table(f"{name}.orders_registered")


@query
def append_twice(spark, sf):
    target = pipelines.create_output(spark, data.fresh_dir(spark, sf, "twice"), pipelines.NAME_OUTPUT)
    for _ in range(2):
        pipelines.run_names(data.names(spark, sf), target, run_ts=data.RUN_TS)
    return target.current()


@query
def append_plain(spark, sf):
    """The same for a plain catalog table: two inserts of the whole of customer."""
    table = f"{data.own_database(spark, sf)}.customer_twice"
    customer = data.read(spark, sf, "customer")
    drop_table(spark, table)
    create_table(spark, table, customer.schema.toDDL(), "gzip")
    for _ in range(2):
        append_table(customer, table)
    return spark.table(table)


@query
def overwrite_partitions_by_day(spark, sf):
    path = data.fresh_dir(spark, sf, "overwritten")
    events = data.read(spark, sf, "events").select(
        "event_id", "event_type", "value", F.to_date("ts").alias("day")
    )
    overwrite_partitions(events, path, ["day"])
    later = events.filter("day >= DATE '2024-01-16' AND event_type != 'error'")
    overwrite_partitions(later.withColumn("value", F.col("value") + 1), path, ["day"])
    return spark.read.schema(events.schema).parquet(path)


@query
def partition_days(spark, sf):
    return data.events_by_day(spark, sf).current()


@query
def time_range(spark, sf):
    table = data.events_by_day(spark, sf)
    return table.between("ts", "2024-01-10 00:00:00", "2024-01-20 12:00:00")


@query
def partition_months(spark, sf):
    return data.orders_by_month(spark, sf).partitions()


@query
def table_partitions(spark, sf):
    return data.events_by_day(spark, sf).partitions()


@query
def describe_table(spark, sf):
    return describe(spark.table(f"{data.database(spark, sf)}.orders"), filled=True)


@query
def show_tables(spark, sf):
    name = data.database(spark, sf)
    tables = [t.name for t in spark.catalog.listTables(name) if not t.isTemporary]
    counted = verify(spark, [f"{name}.{t}" for t in tables])
    return counted.withColumn("table_name", F.substring_index("table_name", ".", -1))


@query
def verify_table(spark, sf):
    path = f"{sf}/customer.parquet"
    row = register_file(spark, path, data.own_database(spark, sf), "customer_registered")
    return row.withColumn("table_name", F.substring_index("table_name", ".", -1))


@query
def preview_rows(spark, sf):
    return preview(spark.table(f"{data.database(spark, sf)}.part"), ["p_partkey"])


# -- pipelines -----------------------------------------------------------------------------


@query
def ip_sum(spark, sf):
    target = pipelines.create_output(spark, data.fresh_dir(spark, sf, "names"), pipelines.NAME_OUTPUT)
    pipelines.run_names(data.names(spark, sf), target, run_ts=data.RUN_TS)
    return target.current()


@query
def ip_sum_documents(spark, sf):
    documents = data.read(spark, sf, "documents").select("doc_id", "text")
    return documents.transform(pipelines.summarize_names, run_ts=data.RUN_TS)


@query
def ip_sum_table(spark, sf):
    """Documents from one catalog table to another: two days, the second one again in its place."""
    source = f"{data.database(spark, sf)}.documents"
    target = f"{data.own_database(spark, sf)}.document_names"
    drop_table(spark, target)
    pipelines.create_output_table(spark, target)

    def id_and_text(df, run_ts):
        return pipelines.summarize_names(df.select("doc_id", "text"), run_ts)

    for day, again in ((data.RUN_TS, False), (data.NEXT_RUN_TS, False), (data.NEXT_RUN_TS, True)):
        pipelines.run_names_table(spark, source, target, id_and_text, day, again)
    return spark.table(target)


@query
def quality_score(spark, sf):
    said = data.read(spark, sf, "conversations").select(
        F.col("conv_id").alias("id"), F.col("text").alias("full_name")
    )
    target = pipelines.create_output(
        spark, data.fresh_dir(spark, sf, "scored"), pipelines.SCORED_OUTPUT
    )
    pipelines.run_names(said, target, pipelines.score_names, data.RUN_TS)
    return target.current()


# -- time travel ---------------------------------------------------------------------------


@query
def totals_as_of(spark, sf):
    return reports.totals_as_of(data.customer_story(spark, sf), [1, 2, 5])


@query
def totals_all_snapshots(spark, sf):
    return data.customer_story(spark, sf).totals_by_snapshot(reports.MEASURE)


@query
def rows_at_timestamp(spark, sf):
    return reports.rows_at(data.customer_story(spark, sf), "2024-01-01 05:30:00")


@query
def first_snapshot_rows(spark, sf):
    return reports.first_snapshot_rows(data.created_customers(spark, sf))


@query
def current_topk(spark, sf):
    return reports.current_top(data.customer_story(spark, sf))


@query
def cross_first_commit(spark, sf):
    return reports.rows_with_first_commit(data.customer_story(spark, sf))


@query
def assign_tiers(spark, sf):
    table = data.customer_story(spark, sf)
    return table.as_of(version=6).select("id", "total_orders", "total_spent", reports.TIER)


@query
def apply_promo(spark, sf):
    table = data.customer_story(spark, sf)
    return table.current().select("id", "total_orders", "total_spent", reports.TIER)


@query
def update_merged(spark, sf):
    return data.lineitem_by_month(spark, sf, "merge").current()


@query
def update_rewritten(spark, sf):
    return data.lineitem_by_month(spark, sf, "copy").current()


@query
def schema_evolution_counts(spark, sf):
    return reports.schema_evolution_counts(data.customer_story(spark, sf))


@query
def evolution_3(spark, sf):
    return reports.evolution(data.customer_story(spark, sf))


@query
def first_vs_current(spark, sf):
    return reports.first_vs_current(data.created_customers(spark, sf))


@query
def branch_vs_snapshot(spark, sf):
    return reports.main_vs_first(data.created_customers(spark, sf))


@query
def revenue_growth(spark, sf):
    return reports.revenue_growth(data.created_customers(spark, sf))


@query
def snapshot_history(spark, sf):
    return reports.snapshot_history(data.customer_story(spark, sf))


@query
def snapshot_timeline(spark, sf):
    timeline = reports.snapshot_timeline(data.customer_story(spark, sf))
    keys = ("added-records", "changed-records", "total-records")
    counts = {k.replace("-", "_"): F.try_element_at("summary", F.lit(k)) for k in keys}
    return timeline.withColumns(
        {k: F.coalesce(c, F.lit("0")).cast("long") for k, c in counts.items()}
    ).drop("summary")


@query
def table_history(spark, sf):
    table = data.customer_story(spark, sf)
    total = F.element_at("summary", F.lit("total-records")).cast("long")
    sizes = table.snapshots().select("snapshot_id", total.alias("record_count"))
    return table.history().join(sizes, "snapshot_id").drop("parent_id")


@query
def latest_commit(spark, sf):
    return reports.latest_commit(data.customer_story(spark, sf))


@query
def tt_overview(spark, sf):
    return reports.overview(data.customer_story(spark, sf))


@query
def timepoints(spark, sf):
    return reports.timepoints(data.customer_story(spark, sf))


@query
def ops_histogram(spark, sf):
    return reports.operations(data.customer_story(spark, sf))


@query
def readiness(spark, sf):
    return reports.readiness(data.customer_story(spark, sf))


# -- branches ------------------------------------------------------------------------------


@query
def main_totals(spark, sf):
    return reports.main_totals(data.customer_story(spark, sf))


@query
def main_count(spark, sf):
    return reports.product_count(data.product_story(spark, sf))


@query
def branch_count(spark, sf):
    return reports.product_count(data.product_story(spark, sf), "dev")


@query
def branch_compare(spark, sf):
    return reports.compare_branches(data.product_story(spark, sf))


@query
def branch_lookup(spark, sf):
    return reports.lookup(data.product_story(spark, sf), -1, "dev")


@query
def tag_totals(spark, sf):
    tagged = data.product_story(spark, sf).as_of(ref="v1_0_0")
    return tagged.agg(F.count("*").alias("products"), F.sum("price").alias("total_price"))


@query
def refs_list(spark, sf):
    table = data.product_story(spark, sf)
    total = F.element_at("summary", F.lit("total-records")).cast("long")
    sizes = table.snapshots().select("snapshot_id", total.alias("record_count"))
    return reports.list_refs(table).join(sizes, "snapshot_id")


# -- files and business summaries ----------------------------------------------------------


@query
def table_files(spark, sf):
    return data.customer_story(spark, sf).files()


@query
def file_summary(spark, sf):
    """File number and size differ from run to run; they are checked for being there."""
    return reports.file_summary(data.customer_story(spark, sf)).select(
        "file_format",
        "total_records",
        (F.col("file_count") > 0).alias("has_files"),
        (F.col("total_size_mb") >= 0).alias("has_size"),
    )


@query
def evolution_summary(spark, sf):
    return reports.evolution_summary(data.product_story(spark, sf)).select(
        "total_snapshots",
        "branches",
        (F.col("total_files") > 0).alias("has_files"),
        (F.col("total_bytes") > 0).alias("has_bytes"),
    )


@query
def count_by_tier(spark, sf):
    return reports.count_by_tier(data.customer_story(spark, sf).current())


@query
def revenue_by_country(spark, sf):
    return reports.revenue_by_country(data.customer_story(spark, sf).current())


@query
def grand_totals(spark, sf):
    return reports.grand_totals(data.customer_story(spark, sf).current())


@query
def inventory(spark, sf):
    """Regions as catalogs, market segments as schemas, the countries of customers as tables."""
    customer, nation = data.read(spark, sf, "customer"), data.read(spark, sf, "nation")
    region = data.read(spark, sf, "region")
    listing = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("catalog"),
            F.col("c_mktsegment").alias("schema"),
            F.col("n_name").alias("table"),
        )
    )
    return reports.inventory(listing, "ASIA")


# -- one green row each for small features -------------------------------------------------


@query
def formats_detected(spark, sf):
    """customer from four files whose names alone say how to read them; an unknown name is read as CSV."""
    found = []
    for fmt, suffix in (("parquet", "PARQUET"), ("json", "json"), ("orc", "Orc"), ("csv", "data")):
        path = f"{data.work_dir(spark, sf)}/detected.{suffix}"
        rows = data.read(spark, sf, "customer")
        data.once(spark, sf, path, lambda: rows.write.format(fmt).option("header", True).save(path))
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema]
        found.append(load_file(spark, path).select(F.lit(fmt).alias("format"), *typed))
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query
def src_schema_file(spark, sf):
    """orders as CSV under a schema that a file holds, in either notation."""
    path = data.source_file(spark, sf, "csv", "orders", header=True)
    found = []
    for kind, text in (("ddl", ORDERS_SCHEMA), ("json", StructType.fromDDL(ORDERS_SCHEMA).json())):
        schema = f"{data.work_dir(spark, sf)}/orders_schema.{kind}"
        file = spark.range(1, numPartitions=1).select(F.lit(text).alias("value"))
        data.once(spark, sf, schema, lambda: file.write.text(schema))
        found.append(load_file(spark, path, schema=schema).withColumn("schema_kind", F.lit(kind)))
    return found[0].unionByName(found[1])


@query
def gzip_files(spark, sf):
    """customer in a versioned table written with gzip, with what the files' names say."""
    customer = data.read(spark, sf, "customer")
    path = data.fresh_dir(spark, sf, "gzip")
    VersionedTable.create(spark, path, rows=customer, compression="gzip")
    files = spark.read.option("recursiveFileLookup", True).schema(customer.schema).parquet(f"{path}/log")
    return files.select("*", F.col("_metadata.file_name").endswith(".gz.parquet").alias("is_gzip"))


@query
def strict_old_schema(spark, sf):
    """The customers before the tier column was there: read without it."""
    return data.customer_story(spark, sf).as_of(version=3)


@query
def seeded_once(spark, sf):
    """Customers seeded twice into a table that takes rows only while it is empty."""
    rows = data.customers(spark, sf)
    table = VersionedTable.create(spark, data.fresh_dir(spark, sf, "seeded"), schema=rows.schema)
    for _ in range(2):
        table.append_if_empty(rows)
    return table.current()


@query
def branch_dropped(spark, sf):
    """The main line after a branch with other parts was written and dropped."""
    part = data.read(spark, sf, "part")
    table = VersionedTable.create(spark, data.fresh_dir(spark, sf, "dropped"), rows=part)
    table.create_branch("trial")
    table.append(part.withColumn("p_partkey", -F.col("p_partkey") - 1), ref="trial")
    table.drop_branch("trial")
    return table.current().withColumn("branches", F.lit(table.refs().where("type = 'BRANCH'").count()))


@query
def names_stamped_now(spark, sf):
    """Cleaned names of a run without a given time: every row bears one time, and it is now."""
    found = pipelines.summarize_names(data.names(spark, sf))
    age = F.unix_seconds(F.current_timestamp()) - F.unix_seconds("processing_timestamp")
    return found.select("id", "processed_full_name", age.between(-5, 600).alias("is_now"))


# -- one order over whole tables -----------------------------------------------------------


@query
def order_numbers(spark, sf):
    """Every order's place by date and key, from both ends."""
    orders = data.read(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return in_order(
        orders, ["o_orderdate", "o_orderkey"], place=number(), from_end=number(descending=True)
    )


def event_steps(spark, sf, ts):
    events = data.read(spark, sf, "events").select(
        "event_id", ts.alias("ts"), "event_type", F.col("value").cast("decimal(18,4)").alias("value")
    )
    return in_order(
        events,
        ["ts", "event_id"],
        place=number(),
        value_before=previous("value", 0),
        type_before=previous("event_type"),
        total=running_sum("value"),
    ).withColumn("total", F.col("total").cast("decimal(38,2)"))


@query
def event_running(spark, sf):
    """The event before and the running total over all events by time."""
    return event_steps(spark, sf, F.col("ts"))


@query
def event_running_tied(spark, sf):
    """The same where every event of three types has one and the same time, earlier than all others."""
    tied = F.col("event_type").isin("click", "view", "error")
    return event_steps(spark, sf, F.when(~tied, F.col("ts")))


@query
def nation_names(spark, sf):
    """All names of a nation's customers in one text, by balance, then key."""
    customer = data.read(spark, sf, "customer").select("c_nationkey", "c_name", "c_acctbal", "c_custkey")
    return joined_text(customer, ["c_nationkey"], "c_name", ["c_acctbal", "c_custkey"], "; ", "names")


@query
def customer_first_last(spark, sf):
    """The first and the last order of every customer."""
    orders = data.read(spark, sf, "orders")
    return first_and_last(
        orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate", "o_totalprice"]
    )


# -- a table as a log of row versions ------------------------------------------------------


def log_state(version=None, timestamp=None):
    def run(spark, sf):
        return data.order_log(spark, sf).state(version, timestamp)

    return run


for name, at in (
    ("log_version_1", {"version": 1}),
    ("log_version_2", {"version": 2}),
    ("log_current", {}),
    ("log_time_between", {"timestamp": "2024-01-01 02:30:00"}),
    ("log_time_exact", {"timestamp": "2024-01-01 03:00:00"}),
):
    state = log_state(**at)
    state.__name__ = name
    query(state)


@query
def log_totals(spark, sf):
    """Rows and value of the table after every commit, from one pass over the log."""
    return data.order_log(spark, sf).totals(["price"])


def branch(spark, sf):
    """What a branch holds that began at the second commit: its own new prices and deletions on top."""
    log = data.order_log(spark, sf)
    changed = log.state(version=2).where("o_orderstatus != 'O'").select(
        "o_orderkey",
        "o_custkey",
        F.lit("B").alias("o_orderstatus"),
        (F.col("price") * 2).cast("decimal(15,2)").alias("price"),
        (F.col("o_orderstatus") == "P").alias("deleted"),
    )
    new = data.read(spark, sf, "customer").select(
        (-F.col("c_custkey") - 1).alias("o_orderkey"),
        F.col("c_custkey").alias("o_custkey"),
        F.lit("N").alias("o_orderstatus"),
        F.col("c_acctbal").cast("decimal(15,2)").alias("price"),
    )
    return overlay([log.state(version=2), changed, new.withColumn("deleted", F.lit(False))], ["o_orderkey"], "deleted")


@query
def branch_overlay(spark, sf):
    return branch(spark, sf)


@query
def branch_differences(spark, sf):
    """Every key of the main line now and of the branch: added, removed, changed or the same."""
    differ = compare(data.order_log(spark, sf).state(), branch(spark, sf), ["o_orderkey"])
    return differ.select(
        "o_orderkey",
        "status",
        F.array_join("changed_columns", ",").alias("changed_columns"),
        F.col("left_row.price").alias("price_main"),
        F.col("right_row.price").alias("price_branch"),
    )


CUSTOMER_UPDATES = (
    *(Update(where, {story.TIER_COLUMN: f"'{tier}'"}) for tier, where in story.TIERS),
    Update(story.PROMOTED, story.PROMOTION),
)


def untiered(spark, sf):
    return data.customers(spark, sf).withColumn(story.TIER_COLUMN, F.lit(None).cast("string"))


@query
def update_chain(spark, sf):
    """Tiers and promotion of all customers, four updates in one projection, and which of them hit."""
    chained = fold_updates(untiered(spark, sf), CUSTOMER_UPDATES, "hits")
    return chained.withColumn("hits", F.array_join(F.transform("hits", lambda x: x.cast("string")), ","))


# -- files with other headers, rescued values, loads run again -----------------------------


@query
def migrate_csv_headers(spark, sf):
    """One directory whose files name the same columns in three orders, one of them without a column."""
    legacy = migrated_names(spark, sf)

    def build():
        path = f"{data.work_dir(spark, sf)}/legacy_headers.csv"
        size = F.when(F.col("full_name") < "h", 0).when(F.col("full_name") < "q", 1).otherwise(2)
        for i, columns in enumerate(
            (
                ["id", "full_name", "first_name", "last_name"],
                ["last_name", "first_name", "id", "full_name"],
                ["LAST_NAME", "full_name", "id"],
            )
        ):
            rows = legacy.where(size == i).withColumnRenamed("last_name", columns[0] if i == 2 else "last_name")
            rows.select(*columns).write.mode("append").option("header", True).csv(path)
        return path

    path = data.once(spark, sf, "legacy_headers", build)
    target = pipelines.create_output(
        spark, data.fresh_dir(spark, sf, "migrated"), pipelines.MIGRATED_INPUT, days("processed_date")
    )
    pipelines.migrate_directory(spark, path, target, data.RUN_TS)
    return target.current()


RESCUE_TARGET = "l_orderkey BIGINT, l_linenumber INT, l_quantity DECIMAL(12,2), l_shipdate DATE"


def spoiled_lines(spark, sf):
    """lineitem as text; quantities of returned lines and dates of open ones do not cast."""
    line = data.read(spark, sf, "lineitem")
    text = lambda c: F.col(c).cast("string")
    returned, is_open = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    quantity = F.col("l_quantity").cast("decimal(12,2)").cast("string")
    return line.select(
        text("l_orderkey").alias("l_orderkey"),
        text("l_linenumber").alias("l_linenumber"),
        F.when(returned, F.concat(quantity, F.lit(" pcs"))).otherwise(quantity).alias("l_quantity"),
        F.when(is_open, F.lit("soon")).otherwise(F.col("l_shipdate").cast("date").cast("string")).alias("l_shipdate"),
        F.col("l_returnflag"),
    )


@query
def rescue_values(spark, sf):
    """The text of every line again, from conformed values and rescued texts."""
    target = StructType.fromDDL(RESCUE_TARGET)
    found = conform(spoiled_lines(spark, sf), target, rescue="rescued")
    back = [F.coalesce(F.col(c).cast("string"), F.col("rescued")[c]).alias(c) for c in target.names]
    return found.select(*back, F.col("rescued")["l_returnflag"].alias("l_returnflag"), F.size("rescued").alias("n_rescued"))


@query
def quarantine_rows(spark, sf):
    """Lines that lost a value, and those that did not, each counted and summed by what is left."""
    text = spoiled_lines(spark, sf).drop("l_returnflag")
    good, bad = quarantine(conform(text, StructType.fromDDL(RESCUE_TARGET), rescue="rescued"), "rescued")
    sides = [
        side.withColumn("quarantined", F.lit(flag)).select("quarantined", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
        for side, flag in ((good, False), (bad, True))
    ]
    return sides[0].unionByName(sides[1])


@query
def load_once_again(spark, sf):
    """All events, loaded when a first try had broken after some types, then once more after the end, and
    then as another load with the same rows."""
    events = data.read(spark, sf, "events")
    table = f"{data.own_database(spark, sf)}.events_loaded"
    drop_table(spark, table)
    create_loaded_table(events, table)
    half = events.where("event_type NOT IN ('error', 'click')")
    append_table(half.withColumn("load_key", F.lit("first")), table)
    for key in ("first", "first", "second", "second"):
        load_once(events, table, key)
    return spark.table(table)


for new, old in (("overwrite_partitions", "overwrite_partitions_by_day"), ("preview", "preview_rows")):
    QUERIES[new] = QUERIES.pop(old)
