"""Reading files: CSV, Parquet, JSON lines, ORC, and Avro where its package is on the class path."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .conform import ROWS, conform, has_nested, schema_from

# The formats known by extension, and the order in which a directory's are tried.
FORMATS = ("csv", "parquet", "json", "orc", "avro")
FALLBACK_FORMAT = "csv"
DIRECTORY_ORDER = ("parquet", "csv", "json")


def detect_format(path: str) -> str:
    """Format by extension; anything unknown counts as CSV."""
    extension = path.lower().rsplit(".", 1)[-1]
    return extension if extension in FORMATS else FALLBACK_FORMAT


def load_file(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: StructType | str | None = None,
    mode: str = "compat",
    **options: str,
) -> DataFrame:
    """A file (or a folder of one format) as a DataFrame.

    ``schema`` only matters for CSV; the other formats describe themselves. A flat schema is
    applied by position, as Spark's CSV reader does; pass ``enforceSchema="false"`` to have the
    header checked. With nested target types the file is read as text and then conformed by
    name. Without a schema, types are inferred, which costs a second pass over the file: give a
    schema for anything large.
    """
    fmt = (fmt or detect_format(path)).lower()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported file format: {fmt}")
    try:
        if fmt == "csv":
            return _load_csv(spark, path, schema_from(spark, schema), mode, options)
        return spark.read.options(**options).format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"data file not found: {path}") from error
        if fmt == "avro" and "Failed to find data source" in str(error):
            raise ValueError("reading Avro needs the spark-avro package on the class path") from error
        raise


def _load_csv(
    spark: SparkSession, path: str, schema: StructType | None, mode: str, options: dict[str, str]
) -> DataFrame:
    reader = spark.read.option("header", True).options(**options)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    if has_nested(schema):
        return conform(reader.csv(path), schema, mode)
    return reader.schema(schema).csv(path)


def load_directory(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    lost: Observation | None = None,
) -> DataFrame | None:
    """A directory through one reader: Parquet if it holds any, else CSV, else JSON, else None.

    With a ``schema`` no types are inferred: the fields of CSV and JSON are read as text and cast to the
    columns of the same name, in any case; other fields are refused, as appending refuses them. JSON is
    read once more for its field names, CSV for the header line of each file: files with one header are
    read together, and columns go by name however the files order them. ``lost`` observes how many values of each column did not cast.
    Names of files are listed through Spark's file index; no job runs.
    """
    try:
        found = [fmt for fmt in DIRECTORY_ORDER if _holds(spark, path, fmt)]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if not found:
        return None
    if schema is None or found[0] == "parquet":
        df = load_file(spark, path, found[0])
        return df if lost is None else df.observe(lost, F.count(F.lit(1)).alias(ROWS))
    if found[0] == "json":
        names = spark.read.option("primitivesAsString", True).json(path).columns
        text = spark.read.schema(StructType([StructField(n, StringType()) for n in names])).json(path)
    else:
        text = load_by_header(spark, path, schema.names)
        if text is None:
            return None
    given = {name.lower(): name for name in text.columns}
    if extra := set(given) - {name.lower() for name in schema.names}:
        raise ValueError(f"columns not in the table: {sorted(given[name] for name in extra)}")
    known = StructType([field for field in schema if field.name.lower() in given])
    named = text.withColumnsRenamed({given[name.lower()]: name for name in known.names})
    return conform(named, known, "json" if found[0] == "json" else "compat", lost)


def header_lines(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The first line that is not blank of each file below ``path``, with the files that begin with it.

    Lines are numbered where they are read; what reaches the driver is one name per file, as for any
    listing, and one line for all files alike.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.regexp_replace("value", "^\\uFEFF", "").alias("line"),
    )
    first = (
        lines.where((F.trim("line") != "") & (F.col("block") == 0))
        .groupBy("file")
        .agg(F.min(F.struct("place", "line")).alias("first"))
    )
    alike = first.groupBy("first.line").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return {row["line"]: [_as_path(file) for file in row["files"]] for row in alike.orderBy("line").collect()}


def _as_path(url: str) -> str:
    """A path the reader takes literally, from the encoded one it reports."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(url))


def load_by_header(
    spark: SparkSession, path: str, allowed: Sequence[str] | None = None, separator: str = ","
) -> DataFrame | None:
    """The CSV files below ``path`` as text columns, by the names in each file's own header line.

    Files that share a header are one scan; scans are put together by name, in any case of letters, and
    columns a file lacks are NULL. Columns outside ``allowed`` are refused, whichever file has them, and so
    is a header that names a column twice. None if no file has a line.
    """
    scans = []
    for line, files in header_lines(spark, path).items():
        names = next(csv.reader([line], delimiter=separator))
        lower = [name.lower() for name in names]
        if len(set(lower)) < len(lower):
            raise ValueError(f"a column twice in the header {line!r} of {files[0]}")
        if allowed is not None and (extra := set(lower) - {name.lower() for name in allowed}):
            raise ValueError(f"columns not in the table: {sorted(n for n in names if n.lower() in extra)} in {files[0]}")
        schema = StructType([StructField(name, StringType()) for name in names])
        scans.append(spark.read.schema(schema).options(header=True, sep=separator).csv(files))
    if not scans:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def _holds(spark: SparkSession, path: str, extension: str) -> bool:
    pattern = "*." + "".join(f"[{c}{c.upper()}]" for c in extension)
    return bool(spark.read.option("pathGlobFilter", pattern).text(path).inputFiles())
