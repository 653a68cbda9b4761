"""Rounding, guarded ratios and null handling shared by all jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_half_even(x: str | Column, digits: int = 0) -> Column:
    """Rounds halves to the even neighbour, on the scaled double."""
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def round_half_up(x: str | Column, digits: int = 0) -> Column:
    """Rounds halves away from zero, on the scaled double."""
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5).cast("double") / scale


def safe_ratio(above: Column, below: Column) -> Column:
    """above / below as a double; null where `below` is zero or null."""
    return F.when(below != 0, above.cast("double") / below.cast("double"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: it becomes null in every floating column."""
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*(F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns))


def count_where(condition: Column) -> Column:
    """How many rows satisfy the condition (null: not)."""
    return F.count(F.when(condition, 1))


def row_sum(*columns: str) -> Column:
    """Sum over columns of a row, nulls skipped."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return total


def any_present(*columns: str) -> Column:
    """Whether any of the columns is not null."""
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).isNotNull()
    return found
