"""Helpers shared by the operators of this package."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
_own_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session in this one process may go without; it gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.partition("[")[0] == "local":
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="tidemark-llm-")
        return _own_folders[app]
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; all of one application lie in one folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/tidemark-llm-{app}/{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs a re-read and not the whole job, and tells
    Spark the true size: a small table is then broadcast by Spark's own threshold, a large one is not.
    """
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lowest(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The ``most`` rows that are lowest by ``order``, a column of 64-bit hashes; all if they are fewer.

    Hashes are counted in at most 513 classes, eight to a doubling, and only rows of the classes that
    hold the lowest are sorted, a tenth more than wanted: what tasks send to the driver does not grow
    with their number. Ties go by the other columns.
    """
    level = F.floor(F.log2(F.col(order).cast("double") + F.lit(2.0**63) + F.lit(1.0)) * 8)
    sizes = sorted(rows.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect())
    sums = accumulate(r["n"] for r in sizes)
    enough = next((r["level"] for r, total in zip(sizes, sums) if total >= most), None)
    some = rows if enough is None else rows.where(level <= F.lit(enough))
    return some.orderBy(order, *(c for c in rows.columns if c != order)).limit(most)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def blank_words(text: Column) -> Column:
    """The runs of characters other than blanks; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, BLANK_RUN)
    )
