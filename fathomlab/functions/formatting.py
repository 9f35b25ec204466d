"""Numbers as people read them, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What stands for an undefined and for an infinite value (fixed values).
UNDEFINED, INFINITE = "—", "∞"


def num(c: Column, digits: int = 2) -> Column:
    """A number with ``digits`` decimals."""
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x), UNDEFINED).when(F.abs(x) == float("inf"), F.when(x > 0, INFINITE).otherwise("-" + INFINITE)).otherwise(F.format_string(f"%.{digits}f", x))


def pct(c: Column, digits: int = 1) -> Column:
    """A share as a percentage."""
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x), UNDEFINED).otherwise(F.format_string(f"%.{digits}f%%", x * 100))


def integer(c: Column) -> Column:
    return F.when(c.isNull(), UNDEFINED).otherwise(F.format_number(c, 0))


def metrics_row(columns: dict[str, Column]) -> Column:
    """One line: label and value of each, parted by two blanks."""
    return F.concat_ws("  ", *(F.concat(F.lit(f"{label} "), value) for label, value in columns.items()))
