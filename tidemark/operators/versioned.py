"""Versioned tables kept as ordinary Parquet data sets.

A table is a folder with two data sets:

``log/commit_seq=N/attempt=A``  the rows commit N wrote: the user's columns, the row's identity (the
                      commit that inserted it and its number there: ``_row_commit``, ``_row_num``) and,
                      for a row that takes another version's place, where that version lies
                      (``_replaces``, ``_replaces_part``).
``meta``              one small row per event: a commit, a new or dropped reference, a new column.

A commit writes its log rows first, into a folder of its own that its event names, and the event last: a
failed write stays invisible, and no writer touches what another one wrote. Commits form a chain through ``parent_id``; a branch or tag is
a name for one commit, and a branch read only follows the chain behind its head. One writer per
table is assumed; two writers that race are detected by their equal event numbers.

Only events are ever brought to the driver. Each says how many rows its commit wrote to which
partition and how many it replaced where. So a read knows, before touching data, which folders
are intact (plain scan), which are fully replaced (not even listed) and which are partly replaced
(scan and anti-join).
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from ..codecs import codec_options
from .partitioning import Transform

MAIN = "main"
COMMIT = "commit_seq"
ROW_ID = ("_row_commit", "_row_num")
REPLACES = "_replaces"
REPLACES_PART = "_replaces_part"
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"  # fixed value: Spark's folder name for NULL

META_SCHEMA = (
    "event BIGINT, kind STRING, ref STRING, snapshot_id BIGINT, parent_id BIGINT, "
    "committed_at TIMESTAMP, operation STRING, table_schema STRING, "
    "summary MAP<STRING,STRING>, written MAP<STRING,BIGINT>, replaced MAP<STRING,BIGINT>, attempt STRING"
)

# A folder of the log: the commit, and the partition below it ("" in an unpartitioned table).
Unit = tuple[int, str]


_HIDDEN = {
    **dict.fromkeys(ROW_ID, LongType()),
    REPLACES: LongType(),
    REPLACES_PART: StringType(),
    COMMIT: LongType(),
}


class UnknownVersion(ValueError):
    """No snapshot, reference or point in time matches the request."""


@dataclass
class _Commit:
    parent: int | None
    micros: int
    schema: StructType
    total: int
    written: dict[Unit, int]
    replaced: dict[Unit, int]
    attempt: str


@dataclass
class _State:
    """The table's events, folded. Size: commits, their partitions and references, never data."""

    events: int = 0
    commits: dict[int, _Commit] = field(default_factory=dict)
    refs: dict[str, tuple[str, int]] = field(default_factory=dict)
    schema: StructType = field(default_factory=StructType)
    partition_by: list[Transform] = field(default_factory=list)
    compression: str = ""

    def chain(self, snapshot_id: int | None) -> list[int]:
        """The commits a snapshot is made of, oldest first."""
        ids: list[int] = []
        while snapshot_id is not None:
            ids.append(snapshot_id)
            snapshot_id = self.commits[snapshot_id].parent
        return ids[::-1]

    def plan(self, snapshot_id: int) -> "ReadPlan":
        """How to read a snapshot."""
        chain = [self.commits[seq] for seq in self.chain(snapshot_id)]
        written = {unit: n for commit in chain for unit, n in commit.written.items()}
        changes = {seq: self.commits[seq].replaced for seq in self.chain(snapshot_id)}
        gone: Counter[Unit] = Counter()
        for change in changes.values():
            gone.update(change)
        partial = {unit for unit, n in written.items() if 0 < gone[unit] < n}
        replacing = [seq for seq, change in changes.items() if partial & change.keys()]
        commits = {seq for seq, _ in partial}
        return ReadPlan(
            intact=sorted(unit for unit, n in written.items() if n and not gone[unit]),
            partial=sorted(partial),
            replacing=replacing,
            replacements=sum(
                n for seq in replacing for unit, n in changes[seq].items() if unit[0] in commits
            ),
        )


@dataclass(frozen=True)
class ReadPlan:
    """Which folders a snapshot read touches, and how."""

    intact: list[Unit]  # scanned as they are
    partial: list[Unit]  # scanned, minus replaced rows
    replacing: list[int]  # commits that hold the replacements
    replacements: int  # exact number of keys in the anti-join

    def only(self, units: set[Unit]) -> "ReadPlan":
        return replace(
            self,
            intact=[u for u in self.intact if u in units],
            partial=[u for u in self.partial if u in units],
        )


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._attempts: dict[int, str] = {}
        self.refresh()

    # -- life cycle ------------------------------------------------------------------------

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        try:
            return not spark.read.schema(META_SCHEMA).parquet(f"{path.rstrip('/')}/meta").isEmpty()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return False
            raise

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        path: str,
        schema: StructType | str | None = None,
        rows: DataFrame | None = None,
        partition_by: Sequence[Transform] = (),
        compression: str = "snappy",
        committed_at: str | datetime | None = None,
        if_not_exists: bool = False,
    ) -> "VersionedTable":
        """Create a table, empty or from ``rows``; the creation is its first snapshot."""
        if cls.exists(spark, path):
            if if_not_exists:
                return cls(spark, path)
            raise ValueError(f"table exists: {path}")
        if schema is None:
            if rows is None:
                raise ValueError("a new table needs a schema or rows")
            schema = rows.schema
        if isinstance(schema, str):
            schema = StructType.fromDDL(schema)
        taken = {*_HIDDEN, *(t.name for t in partition_by)}
        if clash := taken & set(schema.names):
            raise ValueError(f"reserved column names: {sorted(clash)}")
        table = cls.__new__(cls)
        table.spark, table.path, table._attempts = spark, path.rstrip("/"), {}
        table._state = _State(
            schema=schema, partition_by=list(partition_by), compression=compression
        )
        written = {} if rows is None else table._write_new(rows, 1, None, False)
        added = sum(written.values())
        table._record(
            "commit",
            MAIN,
            snapshot_id=1,
            committed_at=committed_at,
            operation="append",
            summary={
                "added-records": added,
                "changed-records": 0,
                "total-records": added,
                "partition-by": ";".join(map(str, partition_by)),
                "compression": compression,
            },
            written=written,
        )
        return table

    def refresh(self) -> "VersionedTable":
        """Read the events again, to see what other sessions committed."""
        rows = (
            self._meta()
            .withColumn("micros", F.unix_micros("committed_at"))
            .drop("committed_at")
            .collect()
        )
        state = _State(events=len(rows))
        if len({row.event for row in rows}) != len(rows):
            raise RuntimeError(f"two writers committed to {self.path} at the same time")
        for row in sorted(rows, key=lambda r: r.event):
            if row.table_schema:
                state.schema = _schema_of(row.table_schema)
            if row.kind == "commit":
                state.commits[row.snapshot_id] = _Commit(
                    parent=row.parent_id,
                    micros=row.micros,
                    schema=state.schema,
                    total=int(row.summary["total-records"]),
                    written={(row.snapshot_id, part): n for part, n in row.written.items()},
                    replaced={_unit(key): n for key, n in row.replaced.items()},
                    attempt=row.attempt,
                )
                if row.snapshot_id == 1:
                    spec = row.summary["partition-by"]
                    state.partition_by = [Transform.parse(t) for t in spec.split(";") if t]
                    state.compression = row.summary["compression"]
            if row.kind == "drop":
                state.refs.pop(row.ref, None)
            elif row.ref is not None:
                state.refs[row.ref] = ("TAG" if row.kind == "tag" else "BRANCH", row.snapshot_id)
        self._state = state
        return self

    # -- description -----------------------------------------------------------------------

    @property
    def schema(self) -> StructType:
        return self._state.schema

    @property
    def partition_by(self) -> list[Transform]:
        return self._state.partition_by

    @property
    def snapshot_ids(self) -> list[int]:
        return sorted(self._state.commits)

    def first_id(self) -> int:
        return min(self._state.commits, key=lambda i: (self._state.commits[i].micros, i))

    def committed_at(self, snapshot_id: int) -> Column:
        """The time of a commit, as a constant."""
        return F.timestamp_micros(F.lit(self._state.commits[snapshot_id].micros))

    def head(self, ref: str = MAIN) -> int:
        if ref not in self._state.refs:
            raise UnknownVersion(f"no branch or tag named {ref!r}")
        return self._state.refs[ref][1]

    def lineage(self, ref: str = MAIN) -> list[int]:
        return self._state.chain(self.head(ref))

    def record_count(self, version: int | str = MAIN) -> int:
        """Rows in a snapshot, from its summary: no data is read."""
        return self._state.commits[version if isinstance(version, int) else self.head(version)].total

    def is_empty(self, ref: str = MAIN) -> bool:
        return self.record_count(ref) == 0

    # -- writes ----------------------------------------------------------------------------

    def append(
        self,
        df: DataFrame,
        ref: str = MAIN,
        committed_at: str | datetime | None = None,
        rebalance: bool | None = None,
        fill_missing: bool = False,
    ) -> int:
        """Add rows in one commit and return its snapshot id. Columns go by name; other ones are refused,
        and so is a lack of columns unless ``fill_missing`` asks for NULLs in their place.

        ``rebalance`` clusters rows by partition before the write, with adaptive execution
        splitting hot partitions and merging small ones. It is on for partitioned tables; turn
        it off when the rows all fall into a few partitions or arrive clustered.
        """
        self._writable(ref)
        seq = self._next_id()
        written = self._write_new(df, seq, rebalance, fill_missing)
        return self._commit(seq, ref, committed_at, "append", written, {}, 0)

    def append_if_empty(self, df: DataFrame, ref: str = MAIN, **options) -> bool:
        """Seed a table once: append only while the branch has no rows."""
        if not self.refresh().is_empty(ref):
            return False
        self.append(df, ref, **options)
        return True

    def update(
        self,
        where: Column | str,
        assign: Mapping[str, Column | str],
        ref: str = MAIN,
        committed_at: str | datetime | None = None,
        mode: str = "merge",
    ) -> int:
        """Change the matching rows in one commit; every expression sees the old row.

        ``merge`` writes new versions of the matching rows only, in one scan at any size, and reads
        drop the old ones with an anti-join. ``copy`` rewrites every folder that holds a match, without
        a shuffle, and reads stay plain scans; it evaluates the condition twice, so the condition has to
        be deterministic.
        """
        if mode not in ("merge", "copy"):
            raise ValueError(f"unknown mode: {mode}")
        self._writable(ref)
        if unknown := set(assign) - set(self.schema.names):
            raise ValueError(f"columns not in the table: {sorted(unknown)}")
        where = F.expr(where) if isinstance(where, str) else where
        types = {c.name: c.dataType for c in self.schema}
        changed = {
            name: (F.expr(value) if isinstance(value, str) else value).cast(types[name])
            for name, value in assign.items()
        }
        seq, plan = self._next_id(), self._state.plan(self.head(ref))
        found = self._read(plan).filter(where)
        if mode == "merge":
            rows = found
        else:
            if not found._jdf.queryExecution().analyzed().deterministic():
                raise ValueError("a condition that is not deterministic can only be merged")
            counts = found.groupBy(COMMIT, self._part().alias("part")).count()
            matches = {(row[COMMIT], row["part"]): row["count"] for row in counts.collect()}
            if not matches:
                return self._commit(seq, ref, committed_at, "overwrite", {}, {}, 0)
            rows = self._read(plan.only(set(matches)))
            hit = F.coalesce(where, F.lit(False))
            changed = {n: F.when(hit, e).otherwise(F.col(f"`{n}`")) for n, e in changed.items()}
        rows = rows.withColumns(
            {**changed, REPLACES: F.col(COMMIT), REPLACES_PART: self._part()}
        ).select(*(f"`{n}`" for n in self.schema.names), *ROW_ID, REPLACES, REPLACES_PART)
        # Matches lie scattered over the table, and moved rows over partitions; a rewrite in place
        # keeps the layout it reads.
        moves = any(t.column in assign for t in self.partition_by)
        self._write(self._rebalanced(rows) if mode == "merge" or moves else rows, seq)
        written: Counter[str] = Counter()
        replaced: Counter[Unit] = Counter()
        for row in (
            self._scan([(seq, "")])
            .groupBy(REPLACES, REPLACES_PART, self._part().alias("part"))
            .count()
            .collect()
        ):
            written[row["part"]] += row["count"]
            replaced[row[REPLACES], row[REPLACES_PART]] += row["count"]
        count = sum((replaced if mode == "merge" else matches).values())
        return self._commit(seq, ref, committed_at, "overwrite", written, replaced, count)

    def add_column(self, name: str, data_type: str, if_not_exists: bool = False) -> bool:
        """Add a column. This makes no snapshot: earlier snapshots keep their own columns."""
        self.refresh()
        if name.lower() in map(str.lower, self.schema.names):
            if if_not_exists:
                return False
            raise ValueError(f"column exists: {name}")
        if name.lower() in (n.lower() for n in [*_HIDDEN, *(t.name for t in self.partition_by)]):
            raise ValueError(f"reserved column name: {name}")
        self._state.schema = StructType(
            [*self.schema.fields, *StructType.fromDDL(f"`{name}` {data_type}").fields]
        )
        self._record("schema", None)
        return True

    # -- references ------------------------------------------------------------------------

    def create_branch(self, name: str, at: int | str = MAIN) -> None:
        self._create_ref("branch", name, at)

    def create_tag(self, name: str, at: int | str = MAIN) -> None:
        self._create_ref("tag", name, at)

    def drop_branch(self, name: str) -> None:
        self._drop_ref("BRANCH", name)

    def drop_tag(self, name: str) -> None:
        self._drop_ref("TAG", name)

    # -- reads -----------------------------------------------------------------------------

    def current(self, with_row_id: bool = False) -> DataFrame:
        return self.as_of(ref=MAIN, with_row_id=with_row_id)

    def first(self, with_row_id: bool = False) -> DataFrame:
        return self.as_of(version=self.first_id(), with_row_id=with_row_id)

    def as_of(
        self,
        version: int | str | None = None,
        timestamp: str | datetime | None = None,
        ref: str | None = None,
        reconcile: bool = False,
        with_row_id: bool = False,
    ) -> DataFrame:
        """The table at a snapshot id, a branch or tag, or a point in time (inclusive).

        A number as ``version`` is a snapshot id, a string a branch or tag. A branch is read
        with the table's present columns, everything else with the columns of its snapshot;
        ``reconcile`` adds columns that came later, as NULL.
        """
        if isinstance(version, str):
            version, ref = None, version
        if version is not None and (timestamp is not None or ref is not None):
            raise ValueError("give a version, a timestamp or a ref")
        if version is not None:
            snapshot_id = version
            if snapshot_id not in self._state.commits:
                raise UnknownVersion(f"no snapshot {snapshot_id}")
        elif timestamp is not None:
            snapshot_id = self.snapshot_at(timestamp, ref or MAIN)
        else:
            snapshot_id = self.head(ref or MAIN)
            reconcile = reconcile or self._state.refs[ref or MAIN][0] == "BRANCH"
        schema = self.schema if reconcile else self._state.commits[snapshot_id].schema
        columns = [F.col(f"`{name}`") for name in schema.names]
        if with_row_id:
            columns += map(F.col, ROW_ID)
        return self._rows(snapshot_id).select(*columns)

    def snapshot_at(self, timestamp: str | datetime, ref: str = MAIN) -> int:
        """The newest snapshot on ``ref`` committed at or before ``timestamp``."""
        micros = self.spark.range(1).select(F.unix_micros(_timestamp(timestamp))).first()[0]
        for snapshot_id in reversed(self.lineage(ref)):
            if self._state.commits[snapshot_id].micros <= micros:
                return snapshot_id
        raise UnknownVersion(f"{ref!r} has no snapshot at or before {timestamp}")

    def between(
        self,
        column: str,
        low: str | datetime,
        high: str | datetime,
        version: int | None = None,
        ref: str = MAIN,
    ) -> DataFrame:
        """Rows with ``low <= column <= high``, reading only the partitions in that range."""
        snapshot_id = self.head(ref) if version is None else version
        schema = self.schema if version is None else self._state.commits[version].schema
        kind = schema[column].dataType
        bounds = [F.lit(str(bound)).cast(kind) for bound in (low, high)]
        rows = self._rows(snapshot_id).filter(F.col(column).between(*bounds))
        for transform in self.partition_by:
            if transform.column == column:
                low_day, high_day = (transform.apply(bound, kind) for bound in bounds)
                rows = rows.filter(F.col(transform.name).between(low_day, high_day))
        return rows.select(*(F.col(f"`{name}`") for name in schema.names))

    def read_plan(self, snapshot_id: int) -> ReadPlan:
        """Sort a snapshot's folders into intact, partly replaced and (left out) fully replaced."""
        return self._state.plan(snapshot_id)

    def totals_by_snapshot(self, column: str, ref: str = MAIN) -> DataFrame:
        """Row count and sum of ``column`` at every snapshot of ``ref``, in one pass.

        A version counts from its own commit on and stops counting at the commit that replaced
        it. The table is reduced to one row per folder: a fully replaced folder ends at the commit
        that replaced the last of its rows. Only rows that were replaced earlier or singly are
        looked up, by identity, to be taken off when they ended.
        """
        chain = self.lineage(ref)
        commits = {seq: self._state.commits[seq] for seq in chain}
        written = {unit: n for c in commits.values() for unit, n in c.written.items() if n}
        gone: Counter[Unit] = Counter()
        last: dict[Unit, int] = {}
        for seq, commit in commits.items():
            gone.update(commit.replaced)
            last.update(dict.fromkeys(commit.replaced, seq))
        ended_at = {unit: seq for unit, seq in last.items() if gone[unit] == written[unit]}
        single = {
            (seq, unit): n
            for seq, commit in commits.items()
            for unit, n in commit.replaced.items()
            if ended_at.get(unit) != seq
        }
        ended = self.spark.createDataFrame(
            [(*unit, seq) for unit, seq in ended_at.items()],
            f"{COMMIT} BIGINT, part STRING, ended BIGINT",
        )

        def change(at: str, sign: int) -> Column:
            n, x = (F.col(c) * sign for c in ("n", "x"))
            return F.struct(F.col(at).alias("snapshot_id"), n.alias("n"), x.alias("x"))

        def changes_of(totals: DataFrame, start: str, sign: int) -> DataFrame:
            """Each total counts with ``sign`` from ``start`` on, and no more once ``ended``."""
            both = F.array(change(start, sign), change("ended", -sign))
            return totals.select(F.explode(both).alias("change")).select("change.*")

        value = F.col(column).alias("value")
        sums = [F.count("*").alias("n"), F.sum("value").alias("x")]
        folders = (
            self._scan(sorted(written))
            .select(COMMIT, self._part().alias("part"), value)
            .groupBy(COMMIT, "part")
            .agg(*sums)
        )
        changes = changes_of(folders.join(ended, [COMMIT, "part"], "left"), COMMIT, 1)
        if single:
            replaced = F.col(REPLACES).alias("old"), F.col(REPLACES_PART).alias("part")
            keys = (
                self._scan([(seq, "") for seq in sorted({seq for seq, _ in single})])
                .select(*ROW_ID, *replaced, F.col(COMMIT).alias("snapshot_id"))
                .join(ended.withColumnRenamed(COMMIT, "old"), ["old", "part"], "left")
                .filter("ended IS NULL OR ended != snapshot_id")
                .select(*ROW_ID, F.col("old").alias(COMMIT), "snapshot_id", "ended")
            )
            found = (
                self._scan(sorted({unit for _, unit in single}))
                .select(*ROW_ID, COMMIT, value)
                .join(keys, [*ROW_ID, COMMIT])
                .groupBy("snapshot_id", "ended")
                .agg(*sums)
            )
            changes = changes.unionByName(changes_of(found, "snapshot_id", -1))
        changes = changes.filter("snapshot_id IS NOT NULL")
        zero = self.snapshots().filter(F.col("snapshot_id").isin(chain))
        changes = changes.unionByName(zero.select("snapshot_id", F.lit(0).alias("n"), F.lit(0).alias("x")))
        so_far = Window.orderBy("snapshot_id").rowsBetween(Window.unboundedPreceding, 0)
        return (
            changes.groupBy("snapshot_id")
            .agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
            .select(
                "snapshot_id",
                F.sum("n").over(so_far).alias("row_count"),
                F.sum("x").over(so_far).alias("total"),
            )
        )

    # -- metadata as tables ----------------------------------------------------------------

    def snapshots(self) -> DataFrame:
        return (
            self._meta()
            .filter("kind = 'commit'")
            .select("snapshot_id", "parent_id", "committed_at", "operation", "ref", "summary")
        )

    def history(self, ref: str = MAIN) -> DataFrame:
        """When each snapshot of ``ref`` became the current one."""
        return (
            self.snapshots()
            .filter(F.col("snapshot_id").isin(self.lineage(ref)))
            .select(F.col("committed_at").alias("made_current_at"), "snapshot_id", "parent_id")
        )

    def refs(self) -> DataFrame:
        newest = F.max_by(F.struct("kind", "snapshot_id"), "event")
        return (
            self._meta()
            .filter("ref IS NOT NULL")
            .groupBy(F.col("ref").alias("name"))
            .agg(newest.alias("last"))
            .filter("last.kind != 'drop'")
            .select(
                "name",
                F.when(F.col("last.kind") == "tag", "TAG").otherwise("BRANCH").alias("type"),
                "last.snapshot_id",
            )
        )

    def files(self, ref: str = MAIN) -> DataFrame:
        """The data files a read of ``ref`` touches; ``record_count`` counts all rows a file holds,
        those that later updates replaced included."""
        plan = self.read_plan(self.head(ref))
        return (
            self._scan(sorted(plan.intact + plan.partial))
            .select(F.col("_metadata.file_path"), F.col("_metadata.file_size"))
            .groupBy("file_path")
            .agg(
                F.count("*").alias("record_count"),
                F.max("file_size").alias("file_size_in_bytes"),
            )
            .select(
                "file_path",
                F.lit("PARQUET").alias("file_format"),
                "record_count",
                "file_size_in_bytes",
            )
        )

    def partitions(self, ref: str = MAIN) -> DataFrame:
        """Live rows per partition; a table that is not partitioned is one partition."""
        names = [t.name for t in self.partition_by]
        if not names:
            return self._rows(self.head(ref)).agg(F.count("*").alias("record_count"))
        return (
            self._rows(self.head(ref)).groupBy(*names).agg(F.count("*").alias("record_count"))
        )

    def register_views(self, name: str) -> None:
        """Temporary views for plain SQL: the table and its metadata tables, as ``name$files``."""
        self.current().createOrReplaceTempView(f"`{name}`")
        for suffix in ("snapshots", "history", "refs", "files", "partitions"):
            getattr(self, suffix)().createOrReplaceTempView(f"`{name}${suffix}`")

    # -- internals -------------------------------------------------------------------------

    def _meta(self) -> DataFrame:
        return self.spark.read.schema(META_SCHEMA).parquet(f"{self.path}/meta")

    def _writable(self, ref: str) -> None:
        self.refresh().head(ref)
        if self._state.refs[ref][0] == "TAG":
            raise ValueError(f"{ref!r} is a tag; tags do not move")

    def _next_id(self) -> int:
        return max(self._state.commits) + 1

    def _log_schema(self) -> StructType:
        hidden = [StructField(name, kind) for name, kind in _HIDDEN.items()]
        parts = [StructField(t.name, DateType()) for t in self.partition_by]
        fields = [StructField(c.name, c.dataType) for c in self.schema]
        return StructType(fields + hidden + parts)

    def _part(self) -> Column:
        """The partition a row lies in, as its folder's name."""
        names = [t.name for t in self.partition_by]
        values = [F.coalesce(F.col(n).cast("string"), F.lit(NULL_PARTITION)) for n in names]
        return F.concat_ws("/", *(F.concat(F.lit(f"{n}="), v) for n, v in zip(names, values)))

    def _folder(self, seq: int) -> str:
        """Where a commit, or the attempt at one that is being made, has its rows."""
        commit = self._state.commits.get(seq)
        attempt = commit.attempt if commit else self._attempts[seq]
        return f"{self.path}/log/{COMMIT}={seq}/attempt={attempt}"

    def _scan(self, units: Sequence[Unit]) -> DataFrame:
        """Rows of the given folders; other folders are not even listed. Where all partitions
        of a commit are wanted, its own folder stands for them."""
        if not units:
            return self.spark.createDataFrame([], self._log_schema())
        wanted: dict[int, set[str]] = {}
        for seq, part in units:
            wanted.setdefault(seq, set()).add(part)
        paths = []
        for seq, parts in wanted.items():
            commit = self._state.commits.get(seq)
            whole = "" in parts or (commit and len(parts) == len(commit.written))
            folder = self._folder(seq)
            paths += [folder] if whole else [f"{folder}/{part}" for part in sorted(parts)]
        return (
            self.spark.read.schema(self._log_schema())
            .option("basePath", f"{self.path}/log")
            .parquet(*paths)
        )

    def _rows(self, snapshot_id: int) -> DataFrame:
        return self._read(self._state.plan(snapshot_id))

    def _read(self, plan: ReadPlan) -> DataFrame:
        parts = [self._scan(plan.intact)] if plan.intact or not plan.partial else []
        if plan.partial:
            commits = sorted({seq for seq, _ in plan.partial})
            gone = (
                self._scan([(seq, "") for seq in plan.replacing])
                .filter(F.col(REPLACES).isin(commits))
                .select(*ROW_ID, F.col(REPLACES).alias(COMMIT))
            )
            parts.append(self._scan(plan.partial).join(gone, [*ROW_ID, COMMIT], "left_anti"))
        names = [*self.schema.names, *ROW_ID, COMMIT, *(t.name for t in self.partition_by)]
        return reduce(DataFrame.unionByName, (p.select(*(f"`{n}`" for n in names)) for p in parts))

    def _rebalanced(self, rows: DataFrame) -> DataFrame:
        """Well-sized output: adaptive execution splits hot partitions and merges small ones."""
        if not self.partition_by:
            # Row identities are unique, so hashing them spreads changed rows evenly.
            return rows.hint("rebalance", *(n for n in ROW_ID if n in rows.columns))
        derived = rows.withColumns({t.name: t.derived(self.schema) for t in self.partition_by})
        names = [t.name for t in self.partition_by]
        return derived.hint("rebalance", *names).drop(*names)

    def _write_new(self, df: DataFrame, seq: int, rebalance: bool | None, fill_missing: bool) -> dict[str, int]:
        """Write rows under new identities; returns the rows per partition. Those of an unpartitioned
        table are counted while they are written, others in the footers of what was written."""
        if extra := set(df.columns) - set(self.schema.names):
            raise ValueError(f"columns not in the table: {sorted(extra)}")
        if (missing := set(self.schema.names) - set(df.columns)) and not fill_missing:
            raise ValueError(f"columns missing: {sorted(missing)}; fill_missing=True makes them NULL")
        rows = df.select(
            *(
                (F.col(f"`{c.name}`") if c.name in df.columns else F.lit(None))
                .cast(c.dataType)
                .alias(c.name)
                for c in self.schema
            )
        )
        if bool(self.partition_by) if rebalance is None else rebalance:
            rows = self._rebalanced(rows)
        rows = rows.select(
            "*",
            F.lit(seq).cast("long").alias(ROW_ID[0]),
            F.monotonically_increasing_id().alias(ROW_ID[1]),
            F.lit(None).cast("long").alias(REPLACES),
            F.lit(None).cast("string").alias(REPLACES_PART),
        )
        if not self.partition_by:
            counted = Observation()
            self._write(rows.observe(counted, F.count(F.lit(1)).alias("n")), seq)
            return {"": counted.get["n"]} if counted.get["n"] else {}
        self._write(rows, seq)
        counts = self._scan([(seq, "")]).groupBy(self._part().alias("part")).count()
        return {row["part"]: row["count"] for row in counts.collect()}

    def _write(self, rows: DataFrame, seq: int) -> None:
        transforms = self.partition_by
        self._attempts[seq] = uuid.uuid4().hex
        writer = rows.withColumns({t.name: t.derived(self.schema) for t in transforms}).write.options(
            **codec_options(self._state.compression)
        )
        if transforms:
            writer = writer.partitionBy(*(t.name for t in transforms))
        writer.parquet(self._folder(seq))

    def _commit(
        self,
        seq: int,
        ref: str,
        committed_at: str | datetime | None,
        operation: str,
        written: Mapping[str, int],
        replaced: Mapping[Unit, int],
        changed: int,
    ) -> int:
        parent = self.head(ref)
        if committed_at is not None:
            micros = self.spark.range(1).select(F.unix_micros(_timestamp(committed_at))).first()[0]
            if micros < self._state.commits[parent].micros:
                raise ValueError(f"commit time {committed_at} lies before that of snapshot {parent}")
        added = sum(written.values()) - sum(replaced.values())
        self._record(
            "commit",
            ref,
            snapshot_id=seq,
            parent_id=parent,
            committed_at=committed_at,
            operation=operation,
            summary={
                "added-records": added,
                "changed-records": changed,
                "total-records": self._state.commits[parent].total + added,
            },
            written=written,
            replaced={f"{old}/{part}": n for (old, part), n in replaced.items()},
        )
        return seq

    def _create_ref(self, kind: str, name: str, at: int | str) -> None:
        self.refresh()
        if name in self._state.refs:
            raise ValueError(f"reference exists: {name}")
        snapshot_id = at if isinstance(at, int) else self.head(at)
        if snapshot_id not in self._state.commits:
            raise UnknownVersion(f"no snapshot {snapshot_id}")
        self._record(kind, name, snapshot_id=snapshot_id)

    def _drop_ref(self, kind: str, name: str) -> None:
        self.refresh()
        if name == MAIN:
            raise ValueError("the main branch cannot be dropped")
        if self._state.refs.get(name, ("",))[0] != kind:
            raise UnknownVersion(f"no {kind.lower()} named {name!r}")
        self._record("drop", name)

    def _record(
        self,
        kind: str,
        ref: str | None,
        snapshot_id: int | None = None,
        parent_id: int | None = None,
        committed_at: str | datetime | None = None,
        operation: str | None = None,
        summary: Mapping[str, object] | None = None,
        written: Mapping[str, int] | None = None,
        replaced: Mapping[str, int] | None = None,
    ) -> None:
        """Write one event as one small file, then read the events back."""
        schema = self.schema.json() if kind in ("commit", "schema") else None
        event = self.spark.range(1, numPartitions=1).select(
            F.lit(self._state.events + 1).cast("long").alias("event"),
            F.lit(kind).alias("kind"),
            F.lit(ref).cast("string").alias("ref"),
            F.lit(snapshot_id).cast("long").alias("snapshot_id"),
            F.lit(parent_id).cast("long").alias("parent_id"),
            _timestamp(committed_at).alias("committed_at"),
            F.lit(operation).cast("string").alias("operation"),
            F.lit(schema).cast("string").alias("table_schema"),
            _map(summary, "string").alias("summary"),
            _map(written, "bigint").alias("written"),
            _map(replaced, "bigint").alias("replaced"),
            F.lit(self._attempts.pop(snapshot_id, None) if kind == "commit" else None).cast("string").alias("attempt"),
        )
        event.write.mode("append").parquet(f"{self.path}/meta")
        self.refresh()


def _map(entries: Mapping[str, object] | None, kind: str) -> Column:
    keys, values = list(entries or {}), [str(v) for v in (entries or {}).values()]
    text = F.map_from_arrays(F.lit(keys).cast("array<string>"), F.lit(values).cast("array<string>"))
    return text.cast(f"map<string,{kind}>")


def _unit(key: str) -> Unit:
    seq, part = key.split("/", 1)
    return int(seq), part


def _timestamp(value: str | datetime | None) -> Column:
    """A point in time; text and naive datetimes are taken in the session's time zone."""
    if value is None:
        return F.current_timestamp()
    return F.lit(str(value)).cast("timestamp")


def _schema_of(text: str) -> StructType:
    return StructType.fromJson(json.loads(text))
