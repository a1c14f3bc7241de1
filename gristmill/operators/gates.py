"""Release gates over a dump: one row a gate, with its value, bar, verdict, and whether it blocks a release."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators import evaluate as E

BLOCKING = ("independence", "calibration", "calibration_two", "calibration_choice", "probability_recovery_mae", "probability_recovery_r")
INDEPENDENCE = r"max \|delta logit\| = ([0-9.eE+-]+)"


def _row(df: DataFrame, gate: str | Column, value: Column, bar: float | None, passed: Column) -> DataFrame:
    name = F.lit(gate) if isinstance(gate, str) else gate
    return df.select(name.alias("gate"), value.cast("double").alias("value"), F.lit(bar).cast("double").alias("bar"), passed.alias("pass"))


def independence(reports: DataFrame, bar: float = 1e-4) -> DataFrame:
    """The largest change that a report's text (column value) states; without one the gate fails."""
    found = F.regexp_extract("value", INDEPENDENCE, 1).try_cast("double")
    return _row(reports.agg(F.max(found).alias("v")), "independence", F.col("v"), bar, F.coalesce(F.col("v") < bar, F.lit(False)))


def calibration(dump: DataFrame, real: str = "real", bar: float = 0.05, kind_bar: float = 0.08) -> list[DataFrame]:
    """Calibration error of the real half, and of its questions of two options and of more."""
    own = dump.where(F.col(real))
    kinds = E.ece(own.withColumn("two", F.size("probs") == 2), ["two"])
    name = F.when(F.col("two"), "calibration_two").otherwise("calibration_choice")
    whole = E.ece(own, [])
    return [_row(whole, "calibration", F.col("ece"), bar, F.coalesce(F.col("ece") <= bar, F.lit(False))), _row(kinds, name, F.col("ece"), kind_bar, F.col("ece") <= kind_bar)]


def probability_recovery(dump: DataFrame, known: str = "p", source: str = "source", mae: float = 0.10, r: float = 0.80) -> list[DataFrame]:
    """Mean absolute error and correlation of the chance of yes with a known one; pooled, with verdicts, and by source, without."""
    own = dump.where(F.col(known).isNotNull() & (F.size("probs") == 2)).withColumn("yes", F.col("probs")[1])
    sx, sy = F.stddev_pop("yes"), F.stddev_pop(known)
    figures = [F.avg(F.abs(F.col("yes") - F.col(known))).alias("mae"), F.when((sx > 1e-12) & (sy > 1e-12), F.covar_pop("yes", known) / F.nullif(sx * sy, F.lit(0.0))).alias("r")]
    whole, parts = own.agg(*figures), own.groupBy(source).agg(*figures)
    none = F.lit(None).cast("boolean")
    return [
        _row(whole, "probability_recovery_mae", F.col("mae"), mae, F.coalesce(F.col("mae") <= mae, F.lit(False))), _row(whole, "probability_recovery_r", F.col("r"), r, F.coalesce(F.col("r") >= r, F.lit(False))),
        _row(parts, F.concat(F.lit("mae_of_"), F.col(source)), F.col("mae"), None, none), _row(parts, F.concat(F.lit("r_of_"), F.col(source)), F.col("r"), None, none),
    ]


def score_coherence(dump: DataFrame, answers: DataFrame, bar: float = 1e-9) -> DataFrame:
    """The wire's score against the sum of index times probability, added up over exploded options."""
    own = dump.select("id", F.posexplode("probs").alias("i", "p")).groupBy("id").agg(F.sum(F.col("i") * F.col("p")).alias("expected"))
    worst = own.join(answers, "id").agg(F.max(F.abs(F.col("score") - F.col("expected"))).alias("v"))
    return _row(worst, "score_coherence", F.round("v", 9), bar, F.coalesce(F.col("v") < bar, F.lit(False)))


def reserved_families(dump: DataFrame, reserved: Column) -> DataFrame:
    """Confidence on families held out of training; it must be under that on the others.  The bar is the latter."""
    means = dump.agg(F.avg(F.when(reserved, F.col("confidence"))).alias("r"), F.avg(F.when(~reserved, F.col("confidence"))).alias("t"))
    return means.select(F.lit("reserved_families").alias("gate"), F.col("r").alias("value"), F.col("t").alias("bar"), (F.col("r") < F.col("t")).alias("pass"))


def figures(dump: DataFrame, shipped: float | None, oracle: float | None, gap: float | None, ratio: float | None) -> DataFrame:
    """Gates on single figures of a training run; a missing one passes neither way."""
    apart = None if shipped is None or oracle is None else abs(shipped - oracle)
    rows = [("temperature_transfer", apart, 0.25, None if apart is None else apart <= 0.25), ("abstention", gap, 0.15, None if gap is None else gap > 0.15), ("confidence_beats_maxprob", ratio, 0.95, None if ratio is None else ratio <= 0.95)]
    return dump.sparkSession.createDataFrame(rows, "gate string, value double, bar double, pass boolean")


def report(parts: list[DataFrame]) -> DataFrame:
    """All gates with whether they block, and whether this one does now."""
    every = reduce(DataFrame.unionAll, parts)
    blocking = F.col("gate").isin(*BLOCKING)
    return every.withColumns({"blocking": blocking, "blocked": blocking & ~F.coalesce(F.col("pass"), F.lit(False))})
