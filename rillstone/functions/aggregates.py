"""Aggregates whose results differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_true(condition: Column) -> Column:
    """Rows for which the condition is true."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def count_items(items: Column) -> Column:
    """Items of all lists that are not null."""
    return F.coalesce(F.sum(F.size(F.filter(items, lambda x: x.isNotNull())).cast("long")), F.lit(0).cast("long"))


def average(value: Column, scale: int = 0) -> Column:
    """Mean of numbers of so many decimal places, to 8 places, halves towards zero; what is no number is left out, none is null."""
    return rounded_mean(F.sum(value.try_cast(f"decimal(20,{scale})")), F.count(value.try_cast(f"decimal(20,{scale})")), scale)


def rounded_mean(total: Column, n: Column, scale: int = 0) -> Column:
    """``total / n`` to 8 places, halves towards zero, exactly; null if there is nothing to divide."""
    units = (F.abs(total).cast(f"decimal(28,{scale})") * F.lit(10**8).cast("decimal(9,0)")).cast("decimal(37,0)" if not scale else f"decimal(37,{min(scale, 8)})")
    rest = F.lit(10 ** max(0, scale - 8)).cast("decimal(12,0)")
    size = (n.cast("decimal(18,0)") * rest).cast("decimal(30,0)")
    whole = F.call_function("div", (2 * (units * rest) + size - 1).cast("decimal(38,0)"), 2 * size)
    return F.when(n > 0, F.signum(total).cast("int") * whole / 1e8)
