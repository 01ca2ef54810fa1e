"""Partitioning by a transform of a column, kept in a derived column users never see."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType, TimestampType

MICROS_A_DAY = 86_400_000_000


@dataclass(frozen=True)
class Transform:
    unit: str  # "day" or "month"
    column: str

    @property
    def name(self) -> str:
        return f"{self.column}_{self.unit}"

    def apply(self, value: Column, kind: DataType) -> Column:
        """The date that names the partition ``value`` belongs to: of a point in time, its UTC day,
        whatever the session's zone."""
        if isinstance(kind, TimestampType):
            days = F.floor(F.unix_micros(value) / F.lit(MICROS_A_DAY)).cast("int")
            day = F.date_add(F.lit("1970-01-01").cast("date"), days)
        else:
            day = F.to_date(value)
        return day if self.unit == "day" else F.trunc(day, "MONTH")

    def derived(self, schema: StructType) -> Column:
        return self.apply(F.col(f"`{self.column}`"), schema[self.column].dataType).alias(self.name)

    def __str__(self) -> str:
        return f"{self.unit}s({self.column})"

    @classmethod
    def parse(cls, text: str) -> "Transform":
        unit, column = text[:-1].split("s(", 1)
        return cls(unit, column)


def days(column: str) -> Transform:
    return Transform("day", column)


def months(column: str) -> Transform:
    return Transform("month", column)
