"""Command line: ``python -m tidemark <command> --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import VersionedTable
from .plans import pipelines, reports, story
from .session import get_session
from .sources import create_database, preview, register_file, schema_overview


def register(spark: SparkSession, args: argparse.Namespace) -> None:
    register_file(
        spark,
        args.data_file,
        args.schema,
        args.table,
        fmt=args.format,
        schema=args.schema_file,
        mode=args.array_mode,
    ).show(truncate=False)
    table = spark.table(f"`{args.schema}`.`{args.table}`")
    print("\n".join(schema_overview(table)))
    preview(table).show()


def init_names(spark: SparkSession, args: argparse.Namespace) -> None:
    table = story.seed_names(spark, f"{args.folder}/full_name_input")
    pipelines.create_output(spark, f"{args.folder}/ip_sum_output", pipelines.NAME_OUTPUT)
    preview(table.current(), ["id"]).show(truncate=False)


def run_names(spark: SparkSession, args: argparse.Namespace) -> None:
    source, target = VersionedTable(spark, args.input), VersionedTable(spark, args.output)
    written = pipelines.run_names(source.current(), target, run_ts=args.run_ts)
    print(f"{written} rows written")
    preview(target.current(), ["id"]).show(truncate=False)


def migrate(spark: SparkSession, args: argparse.Namespace) -> None:
    create = pipelines.create_output
    legacy = create(
        spark,
        f"{args.folder}/full_name_migrated",
        pipelines.MIGRATED_INPUT,
        pipelines.days("processed_date"),
    )
    output = create(spark, f"{args.folder}/ip_sum_scored", pipelines.SCORED_OUTPUT)
    print(f"{pipelines.migrate_directory(spark, args.path, legacy, args.run_ts)} rows migrated")
    names = legacy.current().select("id", "full_name")
    written = pipelines.run_names(names, output, pipelines.score_names, args.run_ts)
    output.add_column("data_lineage", "STRING", if_not_exists=True)
    print(f"{written} rows written")
    reports.snapshot_timeline(output).show(truncate=False)


def demo(spark: SparkSession, args: argparse.Namespace) -> None:
    customers = story.seed_customers(spark, f"{args.folder}/customers")
    products = story.seed_products(spark, f"{args.folder}/products")
    for report in (
        reports.overview(customers),
        reports.current_top(customers),
        reports.evolution(customers),
        reports.first_vs_current(customers),
        reports.compare_branches(products),
        reports.list_refs(products),
        reports.file_summary(customers),
        reports.readiness(customers),
    ):
        report.show(truncate=False)


def show_tables(spark: SparkSession, args: argparse.Namespace) -> None:
    from .sources import inventory_listing

    create_database(spark, args.schema)
    listing = inventory_listing(spark)
    reports.inventory(listing, spark.catalog.currentCatalog()).show(truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, function, help):
        sub = commands.add_parser(name, help=help)
        sub.set_defaults(run=function)
        return sub

    sub = command("register", register, "make a table from a file")
    sub.add_argument("-d", "--data-file", required=True, help="CSV, Parquet, JSON, ORC or Avro")
    sub.add_argument("-s", "--schema", required=True, help="database of the table")
    sub.add_argument("-t", "--table", required=True)
    sub.add_argument("-f", "--format", help="taken from the extension if left out")
    sub.add_argument("--schema-file", help="DDL or JSON schema, or the path of a file with one")
    sub.add_argument("--array-mode", choices=("compat", "json"), default="compat")

    sub = command("init-names", init_names, "create the name pipeline's tables and sample rows")
    sub.add_argument("folder")

    sub = command("run-names", run_names, "run the name pipeline from one table to another")
    sub.add_argument("input")
    sub.add_argument("output")
    sub.add_argument("--run-ts")

    sub = command("migrate", migrate, "load a directory of files and score its names")
    sub.add_argument("path")
    sub.add_argument("folder")
    sub.add_argument("--run-ts")

    sub = command("demo", demo, "build the demonstration tables and print the reports")
    sub.add_argument("folder")

    sub = command("inventory", show_tables, "list catalogs, databases and tables")
    sub.add_argument("--schema", default="default")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or get_session(), args)


if __name__ == "__main__":
    main()
