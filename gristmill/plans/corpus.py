"""The corpus build: quota, sample, describe, quality, decontaminate, route, dedup, cap, carve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import hashing
from gristmill.operators import balance, contamination, dedup, profile
from gristmill.operators._side import cut, small


def facts(examples: DataFrame, state: str = "state") -> DataFrame:
    """examples with what the build needs of a state in its place: sha and key (digests), opaque and length."""
    x = F.col(state)
    made = {"sha": F.sha1(x), "key": F.unhex(F.sha2(x, 256)), "opaque": profile.opaque(x), "length": F.length(x)}
    return examples.withColumns(made).drop(state)


def build(examples: DataFrame, benchmark: DataFrame, target: int = 400_000, per_task: int = 2_000, cap: float = 0.15, describe: float = 0.5, seed: int = 0) -> DataFrame:
    """doc_id, task, split, described of what is kept of examples (doc_id, task, domain, state, target)."""
    return build_from(facts(examples), examples.select("doc_id", "state"), benchmark, target, per_task, cap, describe, seed)


def build_from(rows: DataFrame, states: DataFrame, benchmark: DataFrame, target: int = 400_000, per_task: int = 2_000, cap: float = 0.15, describe: float = 0.5, seed: int = 0) -> DataFrame:
    """As build, over facts (doc_id, task, domain, target, sha, key, opaque, length) and the states (doc_id, state) apart.

    The order matters: quality before decontamination, that before routing, dedup before the source cap, the cap before the carve.
    Ranks, windows and keys are of facts only; a state is read for the sampled rows, once they are known.
    """
    rows = cut(rows)
    tasks = rows.select("task", (F.conv(F.substring(F.sha1("task"), 1, 8), 16, 10).cast("long") % 51 + 1).alias("row")).distinct()
    quotas = balance.task_quotas(tasks, target, per_task)
    ranked = balance.ranked(rows, ["task"], [hashing.hash_order(seed, F.col("doc_id").cast("string")), "doc_id"])
    sampled = cut(ranked.join(quotas.select("task", "row", "quota"), "task").where(F.col("r") <= F.col("quota")).drop("r", "size", "quota"))
    w = Window.partitionBy("task")
    turn = F.row_number().over(w.orderBy(hashing.hash_order(seed, F.col("task"), F.col("sha")), "doc_id"))
    described = sampled.withColumn("described", turn <= F.floor(F.count(F.lit(1)).over(w) * describe))
    dropped = profile.unanswerable_by(sampled, "task", "target", "opaque", "key", "length").where("reason is not null")
    good = described.join(dropped, "task", "left_anti").withColumn("split", hashing.split_of(F.col("task"), F.col("row"), seed))
    good = cut(good.select("doc_id", "task", "domain", "key", "split", "described"))
    keyed = states.withColumn("key", F.unhex(F.sha2("state", 256)))
    texts = cut(keyed.join(small(good.select("doc_id", "key", "split").distinct()), ["doc_id", "key"]))
    blocked = cut(contamination.blocked(texts, benchmark, col="state"))
    routed = cut(good.join(small(blocked), "doc_id", "left_anti"))
    # a state once over the corpus, then held-out states that training holds are dropped
    first = cut(dedup.first_by(routed, ["key"], ["split", "doc_id"]))
    train = texts.where("split = 'train'").join(small(blocked), "doc_id", "left_anti")
    others = texts.where("split <> 'train'").join(small(first.where("split <> 'train'").select("doc_id", "key")), ["doc_id", "key"], "left_semi")
    held = dedup.against_train(train.select("doc_id", "state"), others.select("doc_id", "state"), "doc_id", "state")
    kept = cut(first.join(held.where("reason <> 'keep'"), "doc_id", "left_anti"))
    counts = {r.domain: r.n for r in kept.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a source
    if not counts:
        return kept.select("doc_id", "task", "split", "described")
    limit = F.create_map(*(F.lit(x) for kv in balance.source_caps(counts, cap).items() for x in kv))
    capped = balance.ranked(kept, ["domain"], [hashing.hash_order(seed, F.col("doc_id").cast("string")), "doc_id"]).where(F.col("r") <= F.element_at(limit, F.col("domain"))).drop("r", "size")
    carved = balance.carve(capped.where("split = 'train'"), "task", "doc_id", seed=seed).withColumn("val", F.lit(True))
    return capped.join(carved, ["task", "doc_id"], "left").select("doc_id", "task", F.when(F.col("val"), "val").otherwise(F.col("split")).alias("split"), "described")
