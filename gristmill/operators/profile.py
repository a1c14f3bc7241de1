"""Column profiles of raw tables: text and label columns, dependencies, unanswerable tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


ID_LIKE = r"(^|_)(id|key|uuid|index|idx)$|key$"


def strings(rows: DataFrame) -> list[str]:
    return [f.name for f in rows.schema if f.dataType.simpleString() == "string"]


def columns(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row a column: name, n (not null), distinct, mean and longest length.  One pass over the table."""
    names = names or rows.columns
    c = lambda n: F.col(n).cast("string")
    made = rows.agg(*(x for n in names for x in (F.count(n).alias(f"n_{n}"), F.count_distinct(c(n)).alias(f"d_{n}"), F.avg(F.length(c(n))).alias(f"m_{n}"), F.max(F.length(c(n))).alias(f"l_{n}"))))
    stack = ", ".join(f"'{n}', n_{n}, d_{n}, m_{n}, cast(l_{n} as bigint)" for n in names)
    return made.select(F.expr(f"stack({len(names)}, {stack}) as (name, n, distinct, mean_length, longest)"))


def text_columns(profile: DataFrame) -> DataFrame:
    """Free-text columns: mostly distinct or long."""
    return profile.where((F.col("distinct") > 0.5 * F.col("n")) | (F.col("mean_length") >= 80))


def label_columns(profile: DataFrame) -> DataFrame:
    """2 to 255 values, at most half as many as rows, short, not named like an id."""
    return profile.where(F.col("distinct").between(2, 255) & (F.col("distinct") <= 0.5 * F.col("n")) & (F.col("longest") <= 80) & ~F.regexp_like("name", F.lit(ID_LIKE)))


def same_columns(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Whether two columns determine each other."""
    made = rows.agg(*(x for i, (a, b) in enumerate(pairs) for x in (F.count_distinct(a).alias(f"a{i}"), F.count_distinct(b).alias(f"b{i}"), F.count_distinct(a, b).alias(f"c{i}"))))
    stack = ", ".join(f"'{a}', '{b}', a{i} = c{i} and b{i} = c{i}" for i, (a, b) in enumerate(pairs))
    return made.select(F.expr(f"stack({len(pairs)}, {stack}) as (left, right, same)"))


def rejected_columns(rows: DataFrame, state: str, label: str) -> DataFrame:
    """Texts, texts with more than one label, and whether that is a fifth (and three) of them."""
    g = rows.groupBy(F.sha2(state, 256).alias("s")).agg(F.count_distinct(label).alias("labels"))
    out = g.agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("labels") > 1).alias("conflicting"))
    return out.withColumn("rejected", (F.col("conflicting") >= 3) & (F.col("conflicting") >= 0.2 * F.col("texts")))


def opaque(state: Column) -> Column:
    """Whether a state is only an address, a digest or a number."""
    return F.regexp_like(F.trim(state), F.lit(r"^(https?://\S+|[0-9a-fA-F]{16,}|[0-9.:]+)$"))


def unanswerable(rows: DataFrame, task: str, state: str, target: str) -> DataFrame:
    """Reason to drop a task: constant (eight rows or more), opaque, repeated, or null."""
    x = F.col(state)
    made = rows.select(task, F.col(target).alias("_target"), opaque(x).alias("_opaque"), F.sha2(x, 256).alias("_key"), F.length(x).alias("_length"))
    return unanswerable_by(made, task, "_target", "_opaque", "_key", "_length")


def unanswerable_by(rows: DataFrame, task: str, target: str, opaque: str, key: str, length: str) -> DataFrame:
    """As unanswerable, over each state's digest, length and whether it is opaque."""
    g = rows.groupBy(task).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(target).alias("labels"), F.avg(F.col(opaque).cast("double")).alias("opaque"), F.count_distinct(key).alias("states"), F.percentile(length, F.lit(0.5)).alias("median"))
    reason = F.when((F.col("n") >= 8) & (F.col("labels") <= 1), "constant").when(F.col("opaque") >= 0.8, "opaque").when((F.col("states") <= 0.5 * F.col("n")) & (F.col("median") < 20), "repeated")
    return g.select(task, "n", reason.alias("reason"))


def keep_answerable(rows: DataFrame, task: str, state: str, target: str) -> DataFrame:
    return rows.join(unanswerable(rows, task, state, target).where("reason is not null"), task, "left_anti")


def opaque_share(options: str) -> object:
    """Share of options that are numbers, hex of six digits or more, or addresses."""
    bad = F.filter(options, lambda o: F.regexp_like(o, F.lit(r"^([0-9]+(\.[0-9]+)?|[0-9a-f]{6,}|[0-9]{1,3}(\.[0-9]{1,3}){3})$")))
    return F.size(bad) / F.size(options)


__all__ = ["columns", "keep_answerable", "label_columns", "opaque", "opaque_share", "rejected_columns", "same_columns", "strings", "text_columns", "unanswerable", "unanswerable_by"]
