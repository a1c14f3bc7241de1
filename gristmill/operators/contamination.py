"""Benchmark contamination: shingle cover of protected items, and exact matches of short ones.

An item of 12 tokens or more is known by its distinct eight-token shingles, a shorter one (3 to 11) by its tokens in a row.
A text is blocked if it holds at least 3 shingles and half of the shingles of ONE item, or if it or a line of six tokens or more
is a short item.  Shingles join by 64-bit hash; the protected side is small and is broadcast only if it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators._side import small
from gristmill.operators.dedup import runs_of

K, LONG, SHORT, LINE = 8, 12, 3, 6
MIN_HITS, MIN_COVER = 3, 0.5


def blocklist(items: DataFrame, item: str = "item_id", col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item, size, h) of long items and (item, h) of short ones.  Null texts have neither."""
    words = items.select(F.col(item).alias("item"), text.tokens(F.col(col)).alias("w"))
    long = words.where(F.size("w") >= LONG).select("item", text.word_hashes(F.col("w")).alias("w")).select("item", text.shingle_hashes(F.col("w"), K).alias("hs"))
    long = long.select("item", F.size("hs").cast("long").alias("size"), F.explode("hs").alias("h"))
    short = words.where(F.size("w").between(SHORT, LONG - 1)).select("item", F.xxhash64(F.array_join("w", " ")).alias("h"))
    return long, short


def cover(docs: DataFrame, long: DataFrame, doc: str = "doc_id", col: str = "text") -> DataFrame:
    """doc, item, hits, size, cover of each document and item that share a shingle."""
    own = runs_of(docs, doc, col, K).select(doc, "h")
    hits = own.join(small(long), "h").groupBy(doc, "item", "size").agg(F.count(F.lit(1)).alias("hits"))
    return hits.select(doc, "item", "hits", "size", (F.col("hits") / F.col("size")).alias("cover"))


def short_matches(docs: DataFrame, short: DataFrame, doc: str = "doc_id", col: str = "text") -> DataFrame:
    """doc, item where the whole text or a line of it is a short item."""
    lines = F.filter(F.transform(F.split(F.col(col), "\n"), lambda x: text.tokens(x)), lambda w: F.size(w) >= LINE)
    parts = F.array_union(F.array(text.tokens(F.col(col))), lines)
    own = docs.select(doc, F.explode_outer(F.transform(parts, lambda w: F.xxhash64(F.array_join(w, " ")))).alias("h")).where("h is not null")
    return own.join(small(short), "h").select(doc, "item").distinct()


def short_groups(docs: DataFrame, doc: str = "doc_id", col: str = "text") -> DataFrame:
    """doc, h, item, items of each whole text of 3 to 11 tokens and each line of 6 to 11: the least document that holds it, and how many do.

    Every document's short texts are items here.  What a document holds and what it lends as items is then the same set, so
    the matches are the pairs within each h; their number grows with the square of a common line's documents, the rows here don't.
    """
    lines = F.filter(F.transform(F.split(F.col(col), "\n"), lambda x: text.tokens(x)), lambda w: F.size(w) >= LINE)
    whole = F.filter(F.array(text.tokens(F.col(col))), lambda w: F.size(w) >= SHORT)
    kept = F.filter(F.array_union(whole, lines), lambda w: F.size(w) < LONG)
    own = docs.select(doc, F.explode_outer(F.transform(kept, lambda w: F.md5(F.array_join(w, " ")))).alias("h")).where("h is not null").distinct()
    groups = own.groupBy("h").agg(F.min(doc).alias("item"), F.count(F.lit(1)).alias("items"))
    return own.join(groups, "h").select(doc, "h", "item", "items")


def blocked(docs: DataFrame, items: DataFrame, doc: str = "doc_id", col: str = "text", item: str = "item_id") -> DataFrame:
    """Ids of blocked documents."""
    long, short = blocklist(items, item)
    by_cover = cover(docs, long, doc, col).where((F.col("hits") >= MIN_HITS) & (F.col("cover") >= MIN_COVER)).select(doc)
    return by_cover.unionAll(short_matches(docs, short, doc, col).select(doc)).distinct()


def keep(docs: DataFrame, items: DataFrame, doc: str = "doc_id", col: str = "text", item: str = "item_id") -> DataFrame:
    """docs without the blocked ones."""
    return docs.join(blocked(docs, items, doc, col, item), doc, "left_anti")
