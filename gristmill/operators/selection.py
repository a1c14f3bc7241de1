"""Selection beyond a plain sample: caps that relax, balance on two levels, turns, prefix boosts, fallback keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import hashing
from gristmill.operators import balance as B

STEP, LAST = 0.05, 0.90


def _kept(sizes: Column, q: Column) -> Column:
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + F.least(n, q))


def _largest(sizes: Column, share: Column) -> Column:
    """The largest cap up to the largest class whose majority is at most the share; 0 for none.  The majority grows with the cap, so it is bisected."""
    top = F.array_max(sizes)

    def fits(q: Column) -> Column:
        return F.least(top, q) <= (share + 1e-9) * _kept(sizes, q)

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2)
        ok = fits(mid)
        return F.struct(F.when(ok, mid).otherwise(s["lo"]).alias("lo"), F.when(ok, s["hi"]).otherwise(mid - 1).alias("hi"))

    start = F.struct(F.lit(0).cast("long").alias("lo"), top.alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(62)), start, lambda s, k: F.when(s["lo"] < s["hi"], halve(s, k)).otherwise(s))["lo"]


def relaxed_cap(sizes: Column, max_share: float, least: int) -> Column:
    """A cap a class that holds the majority to max_share, or to the first further step of 0.05 up to 0.90 that leaves `least` rows; else the largest class.

    sizes: rows of each class, as longs.
    """
    own = F.filter(sizes, lambda n: n > 0)
    steps, share = [], max_share
    while share <= LAST:
        steps.append((share, share > 0.85))
        share += STEP
    out = F.array_max(own)
    for share, last in reversed(steps):
        q = _largest(own, F.lit(share))
        enough = (q > 0) & ((_kept(own, q) >= least) | F.lit(last))
        out = F.when(enough, q).otherwise(out)
    return F.when(F.size(own) > 0, out).otherwise(F.lit(0).cast("long"))


def capped(rows: DataFrame, by: list[str], label: str, max_share: float, least: int, seed: int, key: str) -> DataFrame:
    """rows whose classes are held to their group's relaxed cap, those of least digest."""
    sizes = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    caps = sizes.groupBy(*by).agg(F.collect_list("n").alias("s")).select(*by, relaxed_cap(F.col("s"), max_share, least).alias("cap"))  # one number a class
    ranked = B.ranked(rows, [*by, label], [hashing.hash_order(seed, F.col(key).cast("string")), key])
    joined = ranked.join(caps, by) if by else ranked.join(F.broadcast(caps))  # one row
    return joined.where(F.col("r") <= F.col("cap")).select(*rows.columns)


def balanced_twice(rows: DataFrame, system: str, label: str, max_share: float, least: int, seed: int, key: str, system_least: int = 8, majority: float = 0.60) -> DataFrame:
    """Classes capped within each system, systems of one class or still over the majority dropped, then classes capped over all."""
    inner = capped(rows, [system], label, max_share, system_least, seed, key)
    kept = inner.groupBy(system, label).agg(F.count(F.lit(1)).alias("n")).groupBy(system).agg(F.sum("n").alias("all"), F.max("n").alias("top"), F.count(F.lit(1)).alias("classes"))
    good = kept.where((F.col("classes") > 1) & (F.col("top") <= majority * F.col("all")) & (F.col("all") >= system_least)).select(system)
    return capped(inner.join(good, system, "left_semi").select(*rows.columns), [], label, max_share, least, seed, key)


def interleaved(rows: DataFrame, theme: str, flag: str, order: str) -> DataFrame:
    """rows with turn: in each theme the k-th positive, then the k-th negative, as many of either as the rarer has."""
    r = B.ranked(rows, [theme, flag], [order])
    fewer = rows.groupBy(theme).agg(F.least(F.count_if(F.col(flag)), F.count_if(~F.col(flag))).alias("fewer"))
    return r.join(fewer, theme).where(F.col("r") <= F.col("fewer")).withColumn("turn", 2 * F.col("r") - F.col(flag).cast("int")).select(*rows.columns, "turn")


def spread(rows: DataFrame, cycle: str, point: str, order: str) -> DataFrame:
    """rows with turn: the first row of each point in a cycle, cycles taking turns."""
    first = B.ranked(rows, [cycle, point], [order]).where("r = 1").select(*rows.columns)
    return first.withColumn("turn", F.row_number().over(Window.partitionBy(cycle).orderBy(order)))


def hash_half(rows: DataFrame, key: str) -> DataFrame:
    """The half of the rows whose digest begins with an even byte, with the digest that orders them."""
    digest = F.sha1(F.col(key).cast("string"))
    return rows.withColumn("digest", digest).where(F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % 2 == 0)


def boosted(rows: DataFrame, task: str, key: str, per_task: int, boosts: list[tuple[str, int]], seed: int = 0) -> DataFrame:
    """At most per_task rows of a task, or as many as the first boost whose prefix its name has."""
    limit = F.lit(per_task)
    for prefix, n in reversed(boosts):
        limit = F.when(F.startswith(task, F.lit(prefix)), n).otherwise(limit)
    return B.ranked(rows, [task], [hashing.hash_order(seed, F.col(key).cast("string")), key]).where(F.col("r") <= limit).select(*rows.columns)


def val_group(group: Column, claim: Column, position: Column) -> Column:
    """The group that an example is carved out with: its declared group, its claim, or itself."""
    return F.coalesce(F.concat(F.lit("g:"), F.nullif(group, F.lit(""))), F.concat(F.lit("c:"), F.nullif(claim, F.lit(""))), F.concat(F.lit("i:"), position.cast("string")))


def top_groups(rows: DataFrame, group: str, least: int, most: int, left_out: tuple[str, ...] = (), alias: dict[str, str] | None = None) -> DataFrame:
    """(group, n): the most frequent groups of `least` rows or more, aliases merged and some left out; ties by name."""
    name = F.col(group)
    if alias:
        pairs = F.create_map(*(F.lit(x) for p in alias.items() for x in p))
        name = F.coalesce(F.try_element_at(pairs, name), name)
    counts = rows.groupBy(name.alias("group")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & ~F.col("group").isin(*left_out))
    return counts.orderBy(F.desc("n"), "group").limit(most)
