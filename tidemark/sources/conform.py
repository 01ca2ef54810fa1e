"""Target schemas, and turning a DataFrame into one."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, MapType, StringType, StructField, StructType

from ..functions import array_from_text

NESTED = (ArrayType, MapType, StructType)
# Name under which ``conform`` observes the number of rows; no column is named so.
ROWS = "rows read"


def schema_from(spark: SparkSession, schema: StructType | str | None) -> StructType | None:
    """A schema given as StructType, DDL text, JSON text, or the path of a file holding either.

    A file that cannot be read as a schema is reported and ignored, so the load falls back to
    inference.
    """
    if schema is None or isinstance(schema, StructType):
        return schema
    text = schema.strip()
    if text.lower().endswith((".json", ".ddl", ".sql", ".txt")):
        try:
            return _parse(spark.read.text(text, wholetext=True).first()[0].strip())
        except (PySparkException, ValueError, KeyError, TypeError) as error:
            warnings.warn(f"schema file {text} not usable, types are inferred: {error}")
            return None
    return _parse(text)


def _parse(text: str) -> StructType:
    if text.startswith("{"):
        return StructType.fromJson(json.loads(text))
    return StructType.fromDDL(text)


def has_nested(schema: StructType) -> bool:
    return any(isinstance(field.dataType, NESTED) for field in schema)


def conform(
    df: DataFrame,
    schema: StructType,
    mode: str = "compat",
    lost: Observation | None = None,
    rescue: str | None = None,
) -> DataFrame:
    """One projection to the target's columns, order and types.

    Columns the file lacks become typed NULLs, extra ones are dropped, and a value that does not
    cast becomes NULL. ``mode`` says how array text is read: ``compat`` cuts at commas and leaves
    strings, whatever the element type; ``json`` parses it and casts the elements. Structs and
    maps are always parsed as JSON. ``lost`` observes how many values of each column did not cast.

    ``rescue`` names one more column, a map from the name of each column whose value did not cast, and of
    each extra column that has a value, to the text it had; NULL where nothing was lost.
    """
    if rescue is not None and rescue.lower() in {name.lower() for name in (*df.columns, *schema.names)}:
        raise ValueError(f"there is a column {rescue} already")
    if mode not in ("compat", "json"):
        raise ValueError(f"unknown mode: {mode}")
    present = {field.name: field for field in df.schema}
    targets = {field.name: _target(present.get(field.name), field, mode) for field in schema}
    if lost is not None:
        failed = {n: F.col(f"`{n}`").isNotNull() & targets[n].isNull() for n in targets if n in present}
        counts = [F.count_if(value).alias(name) for name, value in failed.items()]
        df = df.observe(lost, F.count(F.lit(1)).alias(ROWS), *counts)
    if rescue is None:
        return df.select(*(value.alias(name) for name, value in targets.items()))
    # Worked out once, in a projection of their own, for the result and for what it lacks.
    taken = {name.lower() for name in df.columns}
    own = {name: next(n for n in _names(f"conformed_{i}") if n not in taken) for i, name in enumerate(targets)}
    both = df.select("*", *(value.alias(own[name]) for name, value in targets.items()))
    kept = {name: F.col(hidden) for name, hidden in own.items()}
    return both.select(*(value.alias(name) for name, value in kept.items()), _rescued(df.schema, kept).alias(rescue))


def _names(name: str) -> Iterator[str]:
    while True:
        yield name
        name += "_"


def _rescued(given: StructType, targets: dict[str, Column]) -> Column:
    """The texts of the values that have no place in the target, by the name of their column."""
    entries, any_lost = [], F.lit(False)
    for field in given:
        value = F.col(f"`{field.name}`")
        nested = isinstance(field.dataType, NESTED)
        entry = F.struct(F.lit(field.name).alias("key"), (F.to_json(value) if nested else value.cast("string")).alias("value"))
        gone = value.isNotNull() & targets[field.name].isNull() if field.name in targets else value.isNotNull()
        entries.append(F.when(gone, entry))
        any_lost = any_lost | gone
    lost = F.filter(F.array(*entries), lambda entry: entry.isNotNull())
    return F.when(any_lost, F.map_from_entries(lost))


def quarantine(df: DataFrame, rescue: str) -> tuple[DataFrame, DataFrame]:
    """Conformed rows without the column of rescued texts, and the rows that lost something, with it.

    Both read the same input; write ``df`` first where reading it twice is dear.
    """
    whole = F.col(f"`{rescue}`").isNull()
    return df.where(whole).drop(rescue), df.where(~whole)


def _target(source: StructField | None, target: StructField, mode: str) -> Column:
    if source is None:
        return F.lit(None).cast(target.dataType)
    value = F.col(f"`{target.name}`")
    from_text = isinstance(source.dataType, StringType) and isinstance(target.dataType, NESTED)
    if not from_text:
        whole = value.try_cast(target.dataType)
        if not (isinstance(source.dataType, StringType) and isinstance(target.dataType, IntegralType)):
            return whole
        # 8.0 and 1e2 are whole numbers too.
        number = value.try_cast("decimal(38,18)")
        return F.coalesce(whole, F.when(number == F.floor(number), number).try_cast(target.dataType))
    if isinstance(target.dataType, ArrayType) and mode == "compat":
        return array_from_text(value)
    return F.from_json(value, target.dataType)
