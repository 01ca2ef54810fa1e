"""States of a table kept as a log of row versions: as of a commit or a time, totals at every commit,
layers over each other, and what differs between two states.

A log is an ordinary table: the columns of the row, the commit that wrote it, the commit's time, a place
within the commit, and whether the row was written or deleted. Every question is an aggregate or a join
over it. A key that holds most of the log is reduced in each task before anything moves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_work_dir
from .ordered import in_order, running_sum

ADDED, REMOVED, CHANGED, SAME = "added", "removed", "changed", "same"


@dataclass(frozen=True)
class RowLog:
    """``rows`` with the names of the columns that say which row, in which commit, when, where and how.

    Of the versions of one key the one with the highest (commit, sequence) stands; of versions that tie in
    both, the greatest by its other columns. ``deleted`` names a boolean column; NULL is not deleted. A
    NULL key is a key like others; rows without a commit are in no state.
    """

    rows: DataFrame
    keys: Sequence[str]
    commit: str = "commit_id"
    sequence: str = "sequence"
    time: str = "committed_at"
    deleted: str = "deleted"

    def columns(self) -> list[str]:
        """The columns of the row itself, keys first."""
        about = {*self.keys, self.commit, self.sequence, self.time, self.deleted}
        return [*self.keys, *(c for c in self.rows.columns if c not in about)]

    def until(self, version: int | None = None, timestamp: str | datetime | None = None) -> DataFrame:
        """The log up to a commit, or up to a time, both inclusive; filters reach the scan."""
        if version is not None and timestamp is not None:
            raise ValueError("give a version or a timestamp, not both")
        rows = self.rows.where(F.col(self.commit).isNotNull())
        if version is not None:
            return rows.where(F.col(self.commit) <= version)
        if timestamp is not None:
            limit = F.lit(timestamp).cast(self.rows.schema[self.time].dataType)
            return rows.where(F.col(self.time) <= limit)
        return rows

    def state(
        self,
        version: int | None = None,
        timestamp: str | datetime | None = None,
        columns: Sequence[str] | None = None,
    ) -> DataFrame:
        """The rows as they stood; ``columns`` keeps the others out of the aggregate and of the scan."""
        data = [c for c in (self.columns() if columns is None else columns) if c not in self.keys]
        newest = F.max(F.struct(self.commit, self.sequence, self._gone().alias("gone"), F.struct(*self._data(data)).alias("row")))
        found = self.until(version, timestamp).groupBy(*self.keys).agg(newest.alias("newest"))
        return found.where("not newest.gone").select(*self.keys, *(F.col("newest.row")[c].alias(c) for c in data))

    def versions(self, columns: Sequence[str]) -> DataFrame:
        """One row per key and commit that touched it: the version it left, and the one before it.

        Rows of a commit are reduced to the last before they move, so that a window over one key sees
        one row a commit, however often the key was written.
        """
        row = F.struct(self._gone().alias("gone"), *self._data(columns))
        left = F.max(F.struct(F.col(self.sequence), row.alias("row")))
        collapsed = self.until().groupBy(*self.keys, self.commit).agg(left.alias("left"))
        own = Window.partitionBy(*self.keys).orderBy(self.commit)
        return collapsed.select(
            *self.keys, self.commit, F.col("left.row").alias("after"), F.lag("left.row").over(own).alias("before")
        )

    def totals(self, measures: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
        """Per commit: its rows and the sum of each measure in the state it left, from one pass.

        Each version counts as what it adds less what it takes away; these changes are summed by commit,
        written to the work folder, a row a commit, and then run up over the commits.
        """
        versions = self.versions(measures)

        def change(value: Column | str) -> Column:
            def part(side: str) -> Column:
                alive = F.col(side).isNotNull() & ~F.col(f"{side}.gone")
                worth = F.lit(1) if value == "" else F.col(f"{side}.{value}")
                return F.when(alive, F.coalesce(worth, F.lit(0))).otherwise(0)

            return F.sum(part("after") - part("before"))

        names = {"rows": "", **{m: m for m in measures}}
        changes = versions.groupBy(self.commit).agg(*(change(c).alias(n) for n, c in names.items()))
        spark = self.rows.sparkSession
        path = f"{new_work_dir(spark, 'totals')}/changes"
        changes.write.parquet(path)
        known = spark.read.schema(changes.schema).parquet(path)
        totals = in_order(known, [self.commit], ranges, **{f"total_{n}": running_sum(n) for n in names})
        return totals.select(self.commit, *(f"total_{n}" for n in names))

    def _gone(self) -> Column:
        return F.coalesce(F.col(self.deleted), F.lit(False))

    def _data(self, columns: Sequence[str]) -> list[Column]:
        return [F.col(f"`{c}`") for c in columns]


def overlay(layers: Sequence[DataFrame], keys: Sequence[str], deleted: str | None = None) -> DataFrame:
    """Layers with the same columns over each other, the last on top: one row per key, the topmost.

    A row whose ``deleted`` is true hides those below and is not shown itself. One aggregate over the
    union; no layer is joined to another. In a layer that has a key twice the greatest row counts.
    """
    columns = [c for c in layers[0].columns if c not in keys and c != deleted]

    def ranked(i: int, layer: DataFrame) -> DataFrame:
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted in layer.columns else F.lit(False)
        return layer.select(*keys, F.struct(F.lit(i).alias("layer"), gone.alias("gone"), F.struct(*columns).alias("row")).alias("top"))

    union = reduce(DataFrame.unionByName, (ranked(i, layer) for i, layer in enumerate(layers)))
    top = union.groupBy(*keys).agg(F.max("top").alias("top"))
    return top.where("not top.gone").select(*keys, *(F.col("top.row")[c].alias(c) for c in columns))


def compare(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Every key of two states: ``status`` (added, removed, changed or same, seen from ``left``),
    ``changed_columns``, and both rows (``left_row``, ``right_row``).

    Keys identify rows in each state; a NULL key matches a NULL key. ``columns`` are compared, NULL equal
    to NULL; by default all that both have.
    """
    both = [c for c in left.columns if c in right.columns and c not in keys] if columns is None else list(columns)

    def side(df: DataFrame, name: str) -> DataFrame:
        own = [F.col(f"`{k}`").alias(f"{name}_key_{i}") for i, k in enumerate(keys)]
        return df.select(*own, F.struct(*(F.col(f"`{c}`") for c in both)).alias(f"{name}_row"))

    same_key = reduce(
        Column.__and__, (F.col(f"left_key_{i}").eqNullSafe(F.col(f"right_key_{i}")) for i in range(len(keys)))
    )
    joined = side(left, "left").join(side(right, "right"), same_key, "full")
    differ = F.filter(
        F.array(*(F.when(~F.col("left_row")[c].eqNullSafe(F.col("right_row")[c]), F.lit(c)) for c in both)),
        lambda c: c.isNotNull(),
    )
    status = (
        F.when(F.col("left_row").isNull(), ADDED)
        .when(F.col("right_row").isNull(), REMOVED)
        .when(F.size(differ) > 0, CHANGED)
        .otherwise(SAME)
    )
    key = lambda i, k: F.when(F.col("left_row").isNull(), F.col(f"right_key_{i}")).otherwise(F.col(f"left_key_{i}")).alias(k)
    return joined.select(
        *(key(i, k) for i, k in enumerate(keys)),
        status.alias("status"),
        F.when(status == CHANGED, differ).alias("changed_columns"),
        "left_row",
        "right_row",
    )


@dataclass(frozen=True)
class Update:
    """Rows that meet ``condition`` get the values of ``sets``, each worked out from the row as it was."""

    condition: str | Column
    sets: Mapping[str, str | Column]


def fold_updates(df: DataFrame, updates: Sequence[Update], hits: str | None = None) -> DataFrame:
    """``df`` after a chain of updates, each seeing what those before it made: projections only, so one
    scan and no write in between, however long the chain.

    Values take the type of their column. A condition that is NULL does not hit. ``hits`` names an extra
    column with the numbers of the updates, from 1, that hit the row.
    """
    as_column = lambda x: F.expr(x) if isinstance(x, str) else x
    columns, flags = df.columns, []
    types = {f.name: f.dataType for f in df.schema}
    taken = {c.lower() for c in columns}
    for i, update in enumerate(updates):
        if unknown := set(update.sets) - set(columns):
            raise ValueError(f"columns not in the table: {sorted(unknown)}")
        flag = f"hit_{i + 1}"
        while flag in taken:
            flag += "_"
        flags.append(flag)
        df = df.withColumn(flag, F.coalesce(as_column(update.condition).cast("boolean"), F.lit(False)))
        df = df.withColumns(
            {
                name: F.when(F.col(flag), as_column(value).cast(types[name])).otherwise(F.col(f"`{name}`"))
                for name, value in update.sets.items()
            }
        )
    if hits is None:
        return df.select(*(f"`{c}`" for c in columns))
    numbers = F.array(*(F.when(F.col(flag), F.lit(i + 1)) for i, flag in enumerate(flags)))
    found = F.filter(numbers, lambda x: x.isNotNull())
    return df.select(*(f"`{c}`" for c in columns), found.alias(hits))
