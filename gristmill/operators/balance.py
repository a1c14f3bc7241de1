"""Quotas, deterministic sampling and balancing, on ranks by digest instead of seeded shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import hashing


def ranked(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """rows with r, the rank from 1 within each group, and size, the group's rows."""
    w = Window.partitionBy(*by)
    return rows.withColumns({"r": F.row_number().over(w.orderBy(*order)), "size": F.count(F.lit(1)).over(w)})


def sample(rows: DataFrame, by: list[str], limit: int, seed: int, key: str) -> DataFrame:
    """At most `limit` rows of each group, the lowest by digest."""
    return ranked(rows, by, [hashing.hash_order(seed, F.col(key).cast("string")), key]).where(F.col("r") <= limit)


def task_quotas(tasks: DataFrame, target: int, per_task: int, floor: int = 50) -> DataFrame:
    """Quota of each (task, row): the row's share of the target (15 % for rows 1 to 3, else 10 %) over its tasks, within bounds."""
    share = F.when(F.col("row").between(1, 3), 0.15).otherwise(0.10)
    n = F.count(F.lit(1)).over(Window.partitionBy("row"))
    return tasks.withColumn("quota", F.least(F.lit(per_task), F.greatest(F.lit(floor), F.floor(target * share / n))).cast("long"))


def source_caps(counts: dict[str, int], cap: float, rounds: int = 8) -> dict[str, int]:
    """Fixed point of: no source over max(total * cap, total / sources) rows; one number a source."""
    now = dict(counts)
    for _ in range(rounds):
        total = sum(now.values())
        limit = max(int(total * cap), total // max(1, len(now)))
        after = {k: min(v, limit) for k, v in now.items()}
        if after == now:
            break
        now = after
    return now


def disjoint_slice(rows: DataFrame, by: list[str], order: str, parts: int) -> DataFrame:
    """rows with part: contiguous slices [n * i / parts, n * (i + 1) / parts) of each group in order."""
    x = ranked(rows, by, [order])
    i = F.floor(((F.col("r") - 1) * parts + parts - 1) / F.col("size"))
    bound = lambda k: F.floor(F.col("size") * k / parts)
    at = F.col("r") - 1
    part = F.when(bound(i + 1) <= at, i + 1).when(bound(i) > at, i - 1).otherwise(i)
    return x.withColumn("part", F.least(part, F.lit(parts - 1)).cast("long"))


def bit_reversed(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows with spread: the rank's bits reversed, an order whose every prefix is spread over the group."""
    x = ranked(rows, by, [order])
    width = F.greatest(F.lit(1), F.length(F.bin(F.col("size") - 1)))
    bits = F.reverse(F.lpad(F.bin(F.col("r") - 1), 40, "0"))
    return x.withColumn("spread", F.conv(F.substr(bits, F.lit(1), width), 2, 10).cast("long"))


def thin(rows: DataFrame, by: list[str], order: str, q: int) -> DataFrame:
    """q rows of each group at even steps: places floor(i * size / q)."""
    x = ranked(rows, by, [order])
    at = F.col("r") - 1
    i = F.ceil(at * q / F.col("size"))
    return x.where((F.col("size") <= q) | ((i < q) & (F.floor(i * F.col("size") / q) == at)))


def round_robin(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with turn: groups take turns, in group order."""
    return ranked(rows, [group], [order]).select(*rows.columns, F.col("r").cast("long").alias("turn"))


def water_level(sizes: DataFrame, n: int) -> Column:
    """Smallest c with sum of min(size, c) >= n, over a short table of sizes; the table's total if that is under n."""
    top = sizes.agg(F.sort_array(F.collect_list("size")).alias("s")).first().s  # one number a class
    left, k = n, len(top)
    for i, s in enumerate(top or []):
        if s * (k - i) >= left:
            return -(-left // (k - i))
        left -= s
    return max(top or [0])


def majority_cap(rows: DataFrame, label: str, times: int, seed: int, key: str) -> DataFrame:
    """At most `times` the runner-up's rows of the largest label, the lowest by digest; all of the others."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    second = counts.orderBy(F.desc("n"), label).limit(2).agg(F.min("n").alias("second"))
    x = ranked(rows, [label], [hashing.hash_order(seed, F.col(key).cast("string")), key]).join(F.broadcast(second))  # one row
    return x.where(F.col("r") <= F.col("second") * times)


def paired(rows: DataFrame, table: str, label: str, seed: int, key: str) -> DataFrame:
    """Within each table, the k-th row of label 0 and the k-th of label 1 by digest."""
    x = ranked(rows, [table, label], [hashing.hash_order(seed, F.col(key).cast("string")), key])
    side = lambda v, name: x.where(F.col(label) == v).select(table, F.col("r").cast("long").alias("rank"), F.col(key).alias(name))
    return side(0, "negative").join(side(1, "positive"), [table, "rank"])


def class_fill(rows: DataFrame, label: str, n: int, cap: float, seed: int, key: str) -> DataFrame:
    """n rows in digest order with at most cap * n of a class, then filled up by the lowest of the rest."""
    h = hashing.hash_order(seed, F.col(key).cast("string"))
    x = ranked(rows, [label], [h, key]).withColumn("over", (F.col("r") > int(n * cap)).cast("int")).withColumn("h", h)
    best = x.orderBy("over", "h", key).limit(n)
    return best.select(*rows.columns)


def carve(rows: DataFrame, task: str, group: str, share: float = 0.05, least: int = 20, seed: int = 0) -> DataFrame:
    """(task, group) carved out for validation: groups in digest order while they fit the share, never a whole task.

    Greedy over group sizes, a small table of its own, task by task.
    """
    sizes = rows.groupBy(task, group).agg(F.count(F.lit(1)).alias("n")).withColumn("h", hashing.hash_order(seed, F.col(task), F.col(group).cast("string")))

    def pick(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["h", group])
        total = int(own["n"].sum())
        want, taken, keep = max(1, round(total * share)), 0, []
        for n in own["n"]:
            ok = total >= least and taken < want and taken + n <= total - 1
            keep.append(ok)
            taken += int(n) if ok else 0
        return own.loc[keep, [task, group]]

    kinds = {f.name: f.dataType.simpleString() for f in sizes.schema}
    return sizes.groupBy(task).applyInPandas(pick, f"{task} {kinds[task]}, {group} {kinds[group]}")


def positives_first(rows: DataFrame, key: str, flags: list[str], quota: int, share: float) -> DataFrame:
    """(key, task): tasks take turns, the rarest first, claiming their next unclaimed positive up to share * quota, then fill up in order.

    Each choice depends on all before, so the rows are reduced to key and flags, and only as many as can be chosen are looked at.
    """
    counts = rows.agg(*(F.sum(f).alias(f) for f in flags)).first()  # one number a task
    turn = sorted(flags, key=lambda f: (counts[f] or 0, f))
    want = int(quota * share)
    most = quota * len(flags)
    pools = [rows.where(F.col(f) == 1).orderBy(key).limit(most) for f in flags] + [rows.orderBy(key).limit(most)]
    pool = pools[0]
    for p in pools[1:]:
        pool = pool.unionAll(p)
    pool = pool.select(key, *flags).distinct().coalesce(1)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(parts)).sort_values(key)
        claimed: dict[object, str] = {}
        own = {f: [k for k, v in zip(held[key], held[f], strict=True) if v == 1] for f in flags}
        got = dict.fromkeys(flags, 0)
        while any(own[f] and got[f] < want for f in turn):
            for f in turn:
                while own[f] and own[f][0] in claimed:
                    own[f].pop(0)
                if own[f] and got[f] < want:
                    claimed[own[f].pop(0)] = f
                    got[f] += 1
        free = iter([k for k in held[key] if k not in claimed])
        for f in turn:
            while got[f] < quota and (k := next(free, None)) is not None:
                claimed[k] = f
                got[f] += 1
        yield pd.DataFrame({key: list(claimed), "task": list(claimed.values())})

    return pool.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, task string")
