"""Rules over records: compiled to Column expressions in three-valued logic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def threshold(value: Column, at: float, greater: bool = True) -> Column:
    return value > at if greater else value < at


def within(value: Column, low: float, high: float) -> Column:
    return value.between(low, high)


def kleene(op: str, parts: list[Column]) -> Column:
    """and, or, not, implies, exactly_one; a null is unknown."""
    if op == "and":
        return reduce(lambda a, b: a & b, parts)
    if op == "or":
        return reduce(lambda a, b: a | b, parts)
    if op == "not":
        return ~parts[0]
    if op == "implies":
        return ~parts[0] | parts[1]
    true = reduce(lambda a, b: a + b, (F.when(p, 1).otherwise(0) for p in parts))
    unknown = reduce(lambda a, b: a + b, (F.when(p.isNull(), 1).otherwise(0) for p in parts))
    # two trues decide it, whatever is unknown
    return F.when(true >= 2, False).when(unknown > 0, F.lit(None).cast("boolean")).otherwise(true == 1)


def both(a: Column, b: Column) -> Column:
    return a * b


def either(a: Column, b: Column) -> Column:
    return a + b - a * b


def policy(rate: Column, outside: Column, alarm: Column) -> Column:
    """Ordered actions of a controller."""
    return F.when(alarm & (outside >= 3), "shutdown").when(outside >= 3, "throttle").when(F.abs(rate) > 20, "alert").when(alarm, "inspect").otherwise("run")


def blast(target: Column) -> Column:
    """How much a destructive target reaches."""
    return F.when(target.isin("/", "~", "*"), "all").when(F.endswith(target, F.lit("/*")), "folder").when(F.contains(target, F.lit("*")), "pattern").otherwise("file")
