"""Row numbers, earlier rows, running totals and joined text over a whole table in one order.

A window without partitions sends every row to one task. Here the order is cut into ranges at sampled
keys. A range is a function of the row alone, so any pass over the table finds the same ones: one
pass adds up each range where the rows lie, the driver carries the sums of a few ranges over to the next,
and one exchange by range brings the rows of a range together for an ordinary window. Ranges are cut by
all columns of the order and, for ties, a hash of the whole row, so a value that holds a third of the rows
spreads over many ranges; only rows alike in every column share one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DateType,
    IntegralType,
    LongType,
    MapType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

#: Sampled keys for each range. The driver holds as many, and one row of sums for each range.
SAMPLES = 16
#: Ranges for each shuffle partition, so that tasks that get several are of like size.
RANGES = 4
#: Times with all their digits.
EXACT = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


@dataclass(frozen=True)
class Item:
    """One wanted column: what it is, over which column, and what stands where there is no earlier row."""

    kind: str
    column: str | None = None
    default: object = None


def number(descending: bool = False) -> Item:
    """The place of a row, from 1; ``descending`` counts from the end."""
    return Item("from_end" if descending else "from_start")


def previous(column: str, default: object = None) -> Item:
    """The column's value in the row before; ``default`` in the first row."""
    return Item("previous", column, default)


def running_sum(column: str) -> Item:
    """The sum of the column up to the row, NULLs left out; NULL before the first value."""
    return Item("running", column)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _free(name: str, taken: Sequence[str]) -> str:
    """The name, or a longer one that no column has."""
    used = {t.lower() for t in taken}
    while name in used:
        name += "_"
    return name


def row_hash(df: DataFrame) -> Column:
    """A hash of everything in a row that Spark hashes."""
    return F.xxhash64(*(_quoted(f.name) for f in df.schema if not isinstance(f.dataType, MapType)))


def order_key(df: DataFrame, order_by: Sequence[str]) -> Column:
    """The columns of the order, then a hash that settles ties between different rows; NULLs come first."""
    fields = [_quoted(name).alias(f"k{i}") for i, name in enumerate(order_by)]
    return F.struct(*fields, row_hash(df).alias("tie"))


def cut_points(keys: DataFrame, ranges: int, samples: int = SAMPLES) -> tuple[Column, int]:
    """At most ``ranges - 1`` rising values of the column ``key``, evenly among its rows: an array that is
    constant for the tasks, and its length.

    They are keys of rows, chosen by their hash, some ``samples`` for each range; this runs a count and a
    pass over the keys. Equal keys are chosen once, so a key that holds many rows adds one sample.
    """
    every = max(keys.count() // (samples * ranges), 1)
    sample = keys.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).distinct()
    chosen = sample.orderBy("key").select(F.to_json("key", EXACT).alias("key")).collect()
    places = sorted({i * len(chosen) // ranges for i in range(1, ranges)} - {0}) if chosen else []
    # Read once, when the plan is made.
    text = f"[{','.join(chosen[i]['key'] for i in places)}]"
    return F.from_json(F.lit(text), ArrayType(keys.schema["key"].dataType), EXACT), len(places)


def place_among(key: Column, cuts: Column, n: int) -> Column:
    """How many of the ``n`` rising cut points are not above the key, by halving steps."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(max(n, 1).bit_length()))))

    def place(given: Column) -> Column:
        def move(at: Column, by: Column) -> Column:
            return F.when((at + by <= n) & (F.get(given["c"], at + by - 1) <= given["k"]), at + by).otherwise(at)

        return F.aggregate(steps, F.lit(0), move)

    return _let(F.struct(cuts.alias("c"), key.alias("k")), place)


def range_of(df: DataFrame, order_by: Sequence[str], ranges: int | None = None) -> Column:
    """The number of the range a row of ``df`` falls in, rising with the order."""
    key = order_key(df, order_by)
    wanted = ranges or RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts, n = cut_points(df.select(key.alias("key")), wanted)
    return place_among(key, cuts, n) if n else F.lit(0)


def in_order(df: DataFrame, order_by: Sequence[str], ranges: int | None = None, **wanted: Item) -> DataFrame:
    """``df`` with a column for each item of ``wanted``, by the order of ``order_by``, NULLs first.

    Rows that tie go by a hash of the row, the same way on every run; rows alike in all columns are
    interchangeable. The driver gets ``SAMPLES`` keys and one row of sums for each range. An empty table
    stays empty. Hidden columns never clash with those of ``df``. The table is read four times (counted,
    sampled, added up, numbered), so write what is dear to work out first; its rows must be the same each time.
    """
    spark = df.sparkSession
    at, tie = (_free(n, [*df.columns, *wanted]) for n in ("range_of_rows", "tie_of_rows"))
    ranged = df.withColumn(at, range_of(df, order_by, ranges)).withColumn(tie, row_hash(df))
    key = F.struct(*(_quoted(c) for c in order_by), F.col(tie))
    names = {name: f"before_{i}" for i, name in enumerate(wanted)}
    sums = [F.count(F.lit(1)).alias("n")]
    for name, item in wanted.items():
        if item.kind == "running":
            sums.append(F.sum(_quoted(item.column)).alias(names[name]))
        elif item.kind == "previous":
            sums.append(F.max_by(F.struct(_quoted(item.column).alias("value")), key).alias(names[name]))
    per_range = ranged.groupBy(F.col(at).alias("range")).agg(*sums)
    sorts = {names[name]: item.kind for name, item in wanted.items() if item.kind in ("running", "previous")}
    carried, total = _carried(sorted(per_range.collect(), key=lambda r: r["range"]), sorts)
    types = {name: per_range.schema[names[name]].dataType for name in wanted if names[name] in sorts}
    of_range, offset = _free("of_range", df.columns), _free("rows_before", df.columns)
    columns = [StructField(of_range, per_range.schema["range"].dataType), StructField(offset, LongType())]
    columns += [StructField(_free(names[name], df.columns), kind) for name, kind in types.items()]
    edges = spark.createDataFrame(carried, StructType(columns))
    window = Window.partitionBy(at).orderBy(*(_quoted(c) for c in order_by), tie)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within, found = {}, {}
    here = [_free(f"within_{i}", df.columns) for i in range(len(wanted) + 1)]
    within[here[-1]] = F.row_number().over(window)
    place = F.col(here[-1]) + F.col(offset)
    for (name, item), own in zip(wanted.items(), here):
        before = F.col(_free(names[name], df.columns))
        if item.kind == "from_start":
            found[name] = place
        elif item.kind == "from_end":
            found[name] = F.lit(total) + 1 - place
        elif item.kind == "previous":
            within[own] = F.lag(F.struct(_quoted(item.column).alias("value"))).over(window)
            default = F.lit(item.default).cast(df.schema[item.column].dataType)
            found[name] = F.when(place == 1, default).otherwise(F.coalesce(F.col(own), before)["value"])
        else:
            within[own] = F.sum(_quoted(item.column)).over(upto)
            both = F.when(before.isNull(), F.col(own)).when(F.col(own).isNull(), before).otherwise(before + F.col(own))
            found[name] = both.cast(types[name])
    # A left join, though every range has its row: an inner one would work out each row's range once more.
    joined = ranged.withColumns(within).join(F.broadcast(edges), _quoted(at) == F.col(of_range), "left")
    return joined.select(*(_quoted(c) for c in df.columns), *(c.alias(n) for n, c in found.items()))


def _carried(rows: list, sorts: dict[str, str]) -> tuple[list[tuple], int]:
    """For each range what lies before it: number of rows, sums and last values; and the number of all."""
    carried, n = [], 0
    state: dict[str, object] = dict.fromkeys(sorts)
    for row in rows:
        carried.append((row["range"], n, *state.values()))
        n += row["n"]
        for name, kind in sorts.items():
            if kind == "previous":
                state[name] = row[name]
            elif row[name] is not None:
                state[name] = row[name] if state[name] is None else state[name] + row[name]
    return carried, n


def joined_text(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    order_by: Sequence[str],
    separator: str = ",",
    name: str = "joined",
    ranges: int | None = None,
) -> DataFrame:
    """Per group the texts of ``value`` in order, one string; NULL texts are left out.

    A group is cut into ranges of its order, each joined on its own, so that a task sorts one range of a
    huge group; only the finished pieces of a group meet, in its one result row.
    """
    at = _free("range_of_rows", df.columns)
    ranged = df.withColumn(at, range_of(df, [*by, *order_by], ranges))
    item = F.struct(*(_quoted(c).alias(f"k{i}") for i, c in enumerate(order_by)), _quoted(value).alias("v"))
    group = F.struct(*(_quoted(c).alias(c) for c in by)).alias("group")
    pieces = ranged.groupBy(group, _quoted(at).alias("range")).agg(
        F.sort_array(F.collect_list(F.when(_quoted(value).isNotNull(), item))).alias("items")
    )
    spelled = F.when(F.size("items") > 0, F.array_join(F.transform("items", lambda x: x["v"]), separator))
    chunks = pieces.select("group", F.struct("range", spelled.alias("chunk")).alias("piece"))
    ordered = F.sort_array(F.collect_list(F.when(F.col("piece.chunk").isNotNull(), F.col("piece"))))
    whole = chunks.groupBy("group").agg(ordered.alias("pieces"))
    text = F.when(F.size("pieces") > 0, F.array_join(F.transform("pieces", lambda p: p["chunk"]), separator))
    return whole.select("group.*", text.alias(name))


def first_and_last(
    df: DataFrame, by: Sequence[str], order_by: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Per group the earliest and latest row: ``first_<column>`` and ``last_<column>``.

    Partial aggregates; rows of a group are never sorted nor brought together. A time or integer and a whole
    number behind it are packed into one decimal, so that fixed-width columns aggregate by hash. Rows with a NULL in the
    first column of the order, or in either of two packed ones, are left out.
    """
    order = _packed(df, order_by)
    present = df.where(_quoted(order_by[0]).isNotNull())
    found = [
        f(_quoted(c), order).alias(f"{word}_{c}")
        for word, f in (("first", F.min_by), ("last", F.max_by))
        for c in columns
    ]
    return present.groupBy(*(_quoted(c) for c in by)).agg(*found)


def _packed(df: DataFrame, order_by: Sequence[str]) -> Column:
    """One or two whole numbers or times as one decimal of the same order, anything else as a struct."""
    whole = []
    for name in order_by:
        kind, value = df.schema[name].dataType, _quoted(name)
        if isinstance(kind, TimestampType):
            value = F.unix_micros(value)
        elif isinstance(kind, TimestampNTZType):
            value = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), value)
        elif isinstance(kind, DateType):
            value = F.unix_date(value)
        elif not isinstance(kind, IntegralType) or (isinstance(kind, LongType) and not whole and len(order_by) > 1):
            return F.struct(*(_quoted(c) for c in order_by))
        whole.append(value.cast("long"))
    if len(whole) == 1:
        return whole[0]
    if len(whole) > 2:
        return F.struct(*whole)
    # The second spans less than 2 * 10 ** 19; times and integers are below 10 ** 18, so 38 digits hold both.
    return whole[0].cast("decimal(18,0)") * F.lit(str(2 * 10**19)).cast("decimal(20,0)") + whole[1].cast("decimal(19,0)")
