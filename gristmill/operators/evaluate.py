"""Evaluation of probability dumps: losses, calibration, selective prediction, pairing, bootstrap, temperature, gates.

A dump has one row a question: id, task, probs, onehot (target), confidence, correct (0 or 1).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import arrays

BINS = 15


def bin_left(conf: Column, bins: int = BINS) -> Column:
    """Bins closed on the left; the last also on the right."""
    return F.least(F.floor(conf * bins), F.lit(bins - 1)).cast("long")


def bin_right(conf: Column, bins: int = BINS) -> Column:
    """Bins closed on the right; the first also on the left."""
    return F.greatest(F.ceil(conf * bins) - 1, F.lit(0)).cast("long")


def losses(dump: DataFrame) -> DataFrame:
    return dump.withColumns({"nll": arrays.nll(F.col("probs"), F.col("onehot")), "brier": arrays.brier(F.col("probs"), F.col("onehot"))})


def ece(dump: DataFrame, by: list[str], right: bool = False, bins: int = BINS) -> DataFrame:
    """Expected calibration error for each group of by (all rows where empty)."""
    b = (bin_right if right else bin_left)(F.col("confidence"), bins)
    binned = dump.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("conf"), F.avg("correct").alias("acc"))
    return binned.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def reliability(dump: DataFrame, bins: int = BINS) -> DataFrame:
    """Every bin with its bounds, count, confidence and accuracy; empty ones have nulls."""
    spark = dump.sparkSession
    full = dump.groupBy(bin_left(F.col("confidence"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("conf"), F.avg("correct").alias("acc"))
    return spark.range(bins).select(F.col("id").alias("bin")).join(full, "bin", "left").select("bin", (F.col("bin") / bins).alias("lo"), ((F.col("bin") + 1) / bins).alias("hi"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "conf", "acc")


def aurc(dump: DataFrame, by: str) -> DataFrame:
    """Area under the risk-coverage curve of each group: mean running error in order of falling confidence, ties by id."""
    w = Window.partitionBy(by).orderBy(F.desc("confidence"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return dump.select(by, F.avg(1 - F.col("correct")).over(w).alias("risk")).groupBy(by).agg(F.avg("risk").alias("aurc"))


def wrong_at(dump: DataFrame, floor: float = 0.9) -> DataFrame:
    """Share of errors among confident rows, their number and share; null share of errors without any."""
    sure = F.col("confidence") >= floor
    return dump.agg(F.avg(F.when(sure, 1 - F.col("correct"))).alias("p_wrong"), F.count_if(sure).alias("n"), (F.count_if(sure) / F.count(F.lit(1))).alias("share"))


def paired(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of two dumps by key; the i-th of a repeated key meets the i-th."""
    def numbered(x: DataFrame, side: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(key).orderBy(order))
        return x.withColumn("occurrence", n).select(key, "occurrence", *(F.col(c).alias(f"{c}_{side}") for c in x.columns if c != key))

    return numbered(a, "a").join(numbered(b, "b"), [key, "occurrence"])


def pearson(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation by group; null where a side is constant."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return rows.groupBy(*by).agg(F.when((sx > 1e-12) & (sy > 1e-12), F.covar_pop(x, y) / F.nullif(sx * sy, F.lit(0.0))).alias("r"))


def bootstrap(rows: DataFrame, value: str, cluster: str, draws: int = 400, seed: int = 0) -> DataFrame:
    """Mean, and 2.5 and 97.5 percent bounds over resampled clusters with Poisson weights drawn by hash.

    Only cluster sums are repeated for each draw; a draw is keyed by hash, so results don't depend on partitions.
    """
    sums = rows.groupBy(cluster).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("_draw"), F.col(cluster)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    weight = poisson(u)
    drawn = sums.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_w", weight)
    stats = drawn.groupBy("_draw").agg((F.sum(F.col("_w") * F.col("_sum")) / F.nullif(F.sum(F.col("_w") * F.col("_rows")), F.lit(0))).alias("stat"))
    bounds = stats.agg(F.percentile("stat", F.lit(0.025)).alias("low"), F.percentile("stat", F.lit(0.975)).alias("high"))
    return rows.agg(F.avg(value).alias("mean"), F.count_distinct(cluster).alias("clusters")).join(F.broadcast(bounds))  # one row each


def poisson(u: Column) -> Column:
    """The Poisson(1) weight of a number from 0 to 1."""
    weight, cumulative = F.lit(0), 0.0
    for k in range(12):
        cumulative += math.exp(-1) / math.factorial(k)
        weight = weight + F.when(u > cumulative, 1).otherwise(0)
    return weight


def digest_unit(seed: int, *keys: Column) -> Column:
    """A number from 0 to 1 by digest, the same in every engine."""
    return (F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)), 256), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def resampled(rows: DataFrame, value: str, task: str, key: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(draw, micro, macro): means over resampled questions, and over resampled tasks of means over their resampled questions.

    Rows are repeated for each draw before they are added up by task, so this is for one dump, not for a corpus.
    """
    drawn = rows.select(F.col(task).alias("t"), F.col(key).alias("k"), F.col(value).cast("double").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    w = poisson(digest_unit(seed, F.col("draw"), F.col("t"), F.col("k")))
    tasks = drawn.withColumn("w", w).groupBy("draw", "t").agg(F.sum(F.col("w") * F.col("x")).alias("s"), F.sum("w").alias("n"))
    wt = poisson(digest_unit(seed, F.col("draw"), F.col("t")))
    mean = F.col("s") / F.nullif(F.col("n"), F.lit(0))
    return tasks.withColumn("wt", F.when(F.col("n") > 0, wt).otherwise(0)).groupBy("draw").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("micro"), (F.sum(F.col("wt") * F.coalesce(mean, F.lit(0.0))) / F.nullif(F.sum("wt"), F.lit(0))).alias("macro"))


def question_interval(rows: DataFrame, value: str, by: str, key: str, draws: int = 400, least: int = 20, seed: int = 0) -> DataFrame:
    """by, n, mean, low, high: 2.5 and 97.5 percent over resampled questions of each group; null below `least` questions."""
    drawn = rows.select(F.col(by), F.col(key).alias("k"), F.col(value).cast("double").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    w = poisson(digest_unit(seed, F.col("draw"), F.col("k")))
    stats = drawn.withColumn("w", w).groupBy(by, "draw").agg((F.sum(F.col("w") * F.col("x")) / F.nullif(F.sum("w"), F.lit(0))).alias("stat"))
    bounds = stats.groupBy(by).agg(F.percentile("stat", F.lit(0.025)).alias("l"), F.percentile("stat", F.lit(0.975)).alias("h"))
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))
    enough = lambda c: F.when(F.col("n") >= least, F.col(c))
    return sizes.join(bounds, by).select(by, "n", "mean", enough("l").alias("low"), enough("h").alias("high"))


def paired_bootstrap(rows: DataFrame, diff: str, cluster: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """clusters, stat, low, high, p_a_better of a difference summed over resampled clusters, ties counting half; without two clusters no bounds."""
    sums = rows.groupBy(F.col(cluster).alias("c")).agg(F.sum(diff).alias("s"), F.count(F.lit(1)).alias("n"))
    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    w = poisson(digest_unit(seed, F.col("draw"), F.col("c")))
    stats = drawn.withColumn("w", w).groupBy("draw").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("stat"))
    better = F.avg(F.when(F.col("stat") > 0, 1.0).when(F.col("stat") == 0, 0.5).when(F.col("stat") < 0, 0.0))
    bounds = stats.agg(F.percentile("stat", F.lit(0.025)).alias("l"), F.percentile("stat", F.lit(0.975)).alias("h"), better.alias("p"))
    whole = sums.agg(F.count(F.lit(1)).alias("clusters"), (F.sum("s") / F.sum("n")).alias("stat"))
    two = lambda c: F.when(F.col("clusters") >= 2, F.col(c))
    return whole.join(F.broadcast(bounds)).select("clusters", "stat", two("l").alias("low"), two("h").alias("high"), two("p").alias("p_a_better"))  # one row each


def answers(dump: DataFrame) -> DataFrame:
    """id, score (expected index), noul (chance of yes, of two options) and choice (the first best) as the wire has them."""
    score = arrays.total(F.transform("probs", lambda p, i: p * i))
    return dump.select("id", score.alias("score"), F.when(F.size("probs") == 2, F.col("probs")[1]).alias("noul"), arrays.argmax(F.col("probs")).alias("choice"))


def ensemble_nll_at(dump: DataFrame, heads: list[str], grid: list[float]) -> DataFrame:
    """(temperature, nll): mean log loss of the mean of several heads' softmaxes at each temperature of a short grid, in one pass."""
    def loss(t: float) -> Column:
        each = [F.element_at(arrays.softmax(F.transform(h, lambda v: v / t)), F.col("target").cast("int") + 1) for h in heads]
        return -F.log(sum(each[1:], each[0]) / len(each))

    made = dump.agg(F.array(*(F.avg(loss(t)) for t in grid)).alias("nll")).select(F.posexplode("nll").alias("i", "nll"))
    return made.select(F.element_at(F.array(*map(F.lit, grid)), F.col("i") + 1).alias("temperature"), "nll")


def nll_at(dump: DataFrame, grid: list[float]) -> DataFrame:
    """Mean log loss at each temperature of a short grid, in one pass."""
    def loss(t: float) -> Column:
        z = F.transform("logits", lambda v: v / t)
        top = F.array_max(z)
        return top + F.log(arrays.total(F.transform(z, lambda v: F.exp(v - top)))) - F.element_at(z, F.col("target").cast("int") + 1)

    return dump.agg(F.array(*(F.avg(loss(t)) for t in grid)).alias("nll")).select(F.posexplode("nll").alias("i", "nll")).select(F.element_at(F.array(*map(F.lit, grid)), F.col("i") + 1).alias("temperature"), "nll")


def fit_temperature(dump: DataFrame, rounds: int = 4) -> float:
    """The temperature of least log loss: a grid over log T, narrowed around its best point in each round."""
    low, high = math.log(0.05), math.log(20.0)
    for _ in range(rounds):
        grid = [low + (high - low) * i / 16 for i in range(17)]
        found = {round(math.log(r.temperature), 9): r.nll for r in nll_at(dump, [math.exp(g) for g in grid]).collect()}  # 17 rows
        best = min(found, key=lambda g: (found[g], g))
        step = (high - low) / 16
        low, high = best - step, best + step
    return math.exp((low + high) / 2)


def fit_temperature_by_size(dump: DataFrame, rounds: int = 4) -> tuple[float, float]:
    """T and slope of T * (n / 2) ** slope of least log loss: a grid over both, narrowed around its best point in each round."""
    box = [(math.log(0.05), math.log(20.0)), (-1.0, 1.0)]
    for _ in range(rounds):
        axes = [[a + (b - a) * i / 8 for i in range(9)] for a, b in box]
        points = [(x, y) for x in axes[0] for y in axes[1]]

        def loss(x: float, y: float) -> Column:
            t = math.exp(x) * F.pow(F.col("n") / 2.0, F.lit(y))
            z = F.transform("logits", lambda v: v / t)
            top = F.array_max(z)
            return F.avg(top + F.log(arrays.total(F.transform(z, lambda v: F.exp(v - top)))) - F.element_at(z, F.col("target").cast("int") + 1))

        found = dump.agg(F.array(*(loss(x, y) for x, y in points)).alias("nll")).first().nll  # 81 numbers
        best = points[min(range(len(points)), key=lambda i: (found[i], i))]
        box = [(c - (b - a) / 8, c + (b - a) / 8) for c, (a, b) in zip(best, box, strict=True)]
    return math.exp(sum(box[0]) / 2), sum(box[1]) / 2
