"""Joins that a corpus build needs besides equality on a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators._side import cut, small

#: Words of an anchor by which an excerpt finds texts.
ANCHOR = 3


def state_json(columns: list[str], limit: int = 4000) -> Column:
    """One column as it is; several as a JSON object, indented, in the given order, each cut to the limit and empty ones left out."""
    trimmed = [F.substring(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), 1, limit) for c in columns]
    if len(columns) == 1:
        return F.trim(F.coalesce(F.col(columns[0]).cast("string"), F.lit("")))
    quoted = lambda v: F.regexp_replace(F.to_json(F.array(v)), r"^\[|\]$", "")
    fields = F.filter(F.array(*(F.when(v != "", F.concat(F.lit(f'  "{c}": '), quoted(v))) for c, v in zip(columns, trimmed, strict=True))), lambda x: x.isNotNull())
    return F.when(F.size(fields) > 0, F.concat(F.lit("{\n"), F.array_join(fields, ",\n"), F.lit("\n}"))).otherwise("")


def class_name(value: Column, names: Column) -> Column:
    """The published name of an index in range; anything else as it is."""
    at = F.when(F.regexp_like(value, F.lit("^[0-9]+$")), value.try_cast("int"))
    return F.when(at < F.size(names), F.get(names, at)).otherwise(value)


def verify_positions(raw: DataFrame, enriched: DataFrame, pos: str, task: str, protected: Column) -> DataFrame:
    """(problem, n): rows of two files of the same order that differ by position: missing, extra, of another task, or changed though protected."""
    r = raw.select(F.col(pos).alias("p"), F.col(task).alias("raw_task"), F.struct(*(F.col(c) for c in raw.columns if c != pos)).alias("a"), protected.alias("keep"))
    e = enriched.select(F.col(pos).alias("p"), F.col(task).alias("new_task"), F.struct(*(F.col(c) for c in raw.columns if c != pos)).alias("b"))
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("raw_task") != F.col("new_task"), "order").when(F.col("keep") & (F.to_json("a") != F.to_json("b")), "changed")
    return r.join(e, "p", "full").groupBy(problem.alias("problem")).agg(F.count(F.lit(1)).alias("n")).where("problem is not null")


def verifying(forecasts: DataFrame, observed: DataFrame, cycle: str, lead: str, day: str) -> DataFrame:
    """Forecasts with what was observed on the day that they speak of: the cycle's day and lead - 1 further ones."""
    return forecasts.withColumn(day, F.date_add(F.col(cycle), F.col(lead) - 1)).join(observed, day)


def excluded(rows: DataFrame, positions: DataFrame, key: Column) -> DataFrame:
    """rows whose key isn't among the positions (column key)."""
    return rows.withColumn("_key", key).join(positions.select(F.col("key").alias("_key")).distinct(), "_key", "left_anti").select(*rows.columns)


def rematch(docs: DataFrame, items: DataFrame, doc: str, item: str, col: str, k: int = 8, least: int = 3) -> DataFrame:
    """(doc, item, shared): documents that are an item's whole text, or share `least` runs of k words with one item."""
    def runs(x: DataFrame, key: str) -> DataFrame:
        made = x.select(key, text.word_hashes(text.tokens(F.coalesce(F.col(col), F.lit("")))).alias("w")).select(key, F.explode_outer(text.shingle_hashes(F.col("w"), k)).alias("h"))
        return made.where("h is not null")

    shared = runs(docs, doc).join(runs(items, item), "h").groupBy(doc, item).agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    whole = lambda x, key: x.select(key, F.sha2(F.array_join(text.tokens(F.coalesce(F.col(col), F.lit(""))), " "), 256).alias("s")).where(F.col("s") != F.sha2(F.lit(""), 256))
    same = whole(docs, doc).join(whole(items, item), "s").select(doc, item)
    return shared.join(same.withColumn("whole", F.lit(True)), [doc, item], "full").select(doc, item, F.coalesce("shared", F.lit(0).cast("long")).alias("shared"), F.coalesce("whole", F.lit(False)).alias("whole"))


def found_elsewhere(excerpts: DataFrame, texts: DataFrame, key: str, owner: str, col: str, mask: str = "[REDACTED]") -> DataFrame:
    """(key, other): the least other text that holds every unredacted span of an excerpt, in whole words; the owner itself if nothing is left of it.

    excerpts: key, owner, col; texts: owner, col.  An excerpt finds texts by the first words of its longest span, ANCHOR of them or
    as many as it has, and is compared in full with those alone.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    spans = F.filter(F.transform(F.split(F.col(col), "\\Q" + mask + "\\E"), norm), lambda s: s != "")
    longest = F.array_max(F.transform(spans, lambda s: F.struct(F.size(F.split(s, " ")).alias("n"), s.alias("s"))))["s"]
    own = excerpts.select(key, F.col(owner).alias("own"), spans.alias("spans"), F.slice(F.split(longest, " "), 1, ANCHOR).alias("a"))
    own = cut(own.withColumn("anchor", F.xxhash64(text.word_hashes(F.col("a")))))
    sizes = [n for n in range(1, ANCHOR + 1) if own.where(F.size("a") == n).limit(1).count()]
    none = own.where(F.size("spans") == 0).select(key, F.col("own").alias("other"))
    if not sizes:
        return none
    bodies = texts.select(F.col(owner).alias("other"), norm(F.coalesce(F.col(col), F.lit(""))).alias("body"))
    known = cut(bodies.select("other", "body", text.word_hashes(F.split("body", " ")).alias("w")))  # words are split once

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, n)))

    every = reduce(F.concat, map(runs, sizes))
    wanted = own.select("anchor").distinct()
    places = known.select("other", F.explode(F.array_distinct(every)).alias("anchor")).join(small(wanted), "anchor")
    pairs = own.join(places, "anchor").where(F.col("other") != F.col("own")).join(known.select("other", "body"), "other")
    holds = F.forall("spans", lambda s: F.contains(F.concat(F.lit(" "), "body", F.lit(" ")), F.concat(F.lit(" "), s, F.lit(" "))))
    return pairs.where(holds).groupBy(key).agg(F.min("other").alias("other")).unionAll(none)


def document_meta(docs: DataFrame, blocked: DataFrame, doc: str, col: str) -> DataFrame:
    """(digest, tokens, blocked) of each distinct text, for reuse by content."""
    made = docs.join(blocked.select(doc).distinct().withColumn("b", F.lit(True)), doc, "left")
    return made.select(F.sha1(F.coalesce(F.col(col), F.lit(""))).alias("digest"), F.size(text.tokens(F.coalesce(F.col(col), F.lit("")))).cast("long").alias("tokens"), F.coalesce("b", F.lit(False)).alias("b")).groupBy("digest").agg(F.max("tokens").alias("tokens"), F.bool_or("b").alias("blocked"))


def dependent_pairs(rows: DataFrame, names: list[str]) -> DataFrame:
    """(left, right) of columns that determine each other, found among all: only columns of equally many values are compared."""
    counts = rows.agg(*(F.count_distinct(c).alias(c) for c in names)).first()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if counts[a] == counts[b] and counts[a] > 1]
    if not pairs:
        return rows.sparkSession.createDataFrame([], "left string, right string")
    made = rows.agg(*(F.count_distinct(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    stack = ", ".join(f"'{a}', '{b}', c{i} = {counts[a]}" for i, (a, b) in enumerate(pairs))
    return made.select(F.expr(f"stack({len(pairs)}, {stack}) as (left, right, same)")).where("same").drop("same")


def about_text(name: Column) -> Column:
    """Whether a column's name speaks of the text, and not of who labelled it or where it came from."""
    who = r"annotator|worker|rater|coder|labell?er|author|user|judge|confidence|agreement|(^|_)(time|date|duration|timestamp|split|fold|version|batch|hit)(_|$)"
    origin = r"(^|_)(url|uri|link|source|domain|website|file|path|filename|dataset|corpus|license|licence|doi|isbn)(_|$)"
    return ~F.regexp_like(F.lower(name), F.lit(f"{who}|{origin}"))


def ancestors(rows: DataFrame, doc: str, pos: str, level: str, most: int = 32) -> DataFrame:
    """(doc, pos, chain): positions of the entries that enclose each entry, the innermost first.

    The last earlier entry of each lower level encloses an entry unless a later one of a lower level stands between.
    """
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    levels = [r[0] for r in rows.select(level).distinct().orderBy(level).limit(most + 1).collect()]  # outline levels
    if len(levels) > most:
        raise ValueError(f"over {most} outline levels")
    last = F.array(*(F.struct(F.lit(v).alias("level"), F.max(F.when(F.col(level) == v, F.col(pos))).over(w).alias("pos")) for v in levels))
    seen = rows.withColumn("_last", last)
    open_ = F.filter("_last", lambda x: x["pos"].isNotNull() & (x["level"] < F.col(level)))
    chain = F.filter(open_, lambda x: ~F.exists(open_, lambda y: (y["level"] < x["level"]) & (y["pos"] > x["pos"])))
    return seen.select(doc, pos, F.transform(F.reverse(F.array_sort(F.transform(chain, lambda x: x["pos"]))), lambda p: p).alias("chain"))
