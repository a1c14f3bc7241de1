"""Caps that relax, balance on two levels, turns, boosts, fallback keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import balance as B
from gristmill.operators import selection as S
from gristmill.queries._base import query, table


def _caps(sizes: str, by: str, share: float, least: int) -> str:
    """(by, cap) by trying every cap: sizes is a table (by, label, n)."""
    k = by or "one"
    src = sizes if by else f"(SELECT 1 AS one, * FROM {sizes})"
    return f"""(WITH sz AS (SELECT {k}, n FROM {src}), mx AS (SELECT {k}, max(n) AS m FROM sz GROUP BY {k}), q AS (SELECT {k}, unnest(range(1, m + 1)) AS q FROM mx), c AS (SELECT q.{k}, q, sum(least(n, q)) AS pool, max(least(n, q)) / sum(least(n, q)) AS top FROM q JOIN sz USING ({k}) GROUP BY q.{k}, q),
t AS (SELECT unnest(range(0, 20)) AS s), f AS (SELECT {k}, s, max(q) AS q, max(pool) AS pool FROM c, t WHERE {share} + 0.05 * s <= 0.90 + 1e-12 AND top <= {share} + 0.05 * s + 1e-9 GROUP BY ALL), g AS (SELECT {k}, arg_min(q, s) AS q FROM f WHERE pool >= {least} OR {share} + 0.05 * s > 0.85 GROUP BY {k}) SELECT mx.{k}, coalesce(g.q, m)::BIGINT AS cap FROM mx LEFT JOIN g USING ({k}))"""


@query(f"""WITH s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, cap FROM {_caps('s', 'lang', 0.12, 60)}""")
def relaxed_class_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap of a class of each language, its share relaxed in steps until enough rows are left."""
    s = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.collect_list("n").alias("s"))
    return s.select("lang", S.relaxed_cap(F.col("s"), 0.12, 60).alias("cap"))


_RANK = "row_number() OVER (PARTITION BY {0} ORDER BY sha1('{1}:' || doc_id), doc_id)"


@query(f"""WITH d AS (SELECT doc_id, source AS system, lang AS label FROM documents), s AS (SELECT system, label, count(*) AS n FROM d GROUP BY ALL), c AS (SELECT * FROM {_caps('s', 'system', 0.4, 8)}), r AS (SELECT *, {_RANK.format('system, label', 5)} AS r FROM d), i AS (SELECT doc_id, system, label FROM r JOIN c USING (system) WHERE r <= cap),
k AS (SELECT system, sum(n) AS whole, max(n) AS top, count(*) AS classes FROM (SELECT system, label, count(*) AS n FROM i GROUP BY ALL) GROUP BY system), j AS (SELECT i.* FROM i JOIN k USING (system) WHERE classes > 1 AND top <= 0.60 * whole AND whole >= 8), p AS (SELECT label, count(*) AS n FROM j GROUP BY label), z AS (SELECT cap FROM {_caps('p', '', 0.4, 60)}),
o AS (SELECT *, {_RANK.format('label', 5)} AS r FROM j) SELECT doc_id, system, label FROM o, z WHERE r <= cap""")
def balance_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes balanced within each system, then over those systems that are left."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("system"), F.col("lang").alias("label"))
    return S.balanced_twice(d, "system", "label", 0.4, 60, 5, "doc_id")


@query("""WITH b AS (SELECT regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS k FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1), d AS (SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') NOT IN (SELECT k FROM b)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha1('3:' || doc_id), doc_id) <= 36 AS under FROM d), o AS (SELECT doc_id, lang, row_number() OVER (ORDER BY NOT under, sha1('3:' || doc_id), doc_id) AS place FROM r) SELECT doc_id, lang FROM o WHERE place <= 120""")
def class_fill_unblocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120 rows in digest order with at most 30 % of a class, blocked texts left out first."""
    d = table(spark, sf_dir, "documents").where("text is not null").withColumn("k", text.norm(F.col("text")))
    blocked = d.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    return B.class_fill(d.join(blocked, "k", "left_anti").select("doc_id", "lang"), "lang", 120, 0.3, 3, "doc_id").select("doc_id", "lang")


@query("""WITH l AS (SELECT p_partkey, p_brand AS theme, p_size > 30 AS flag FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY theme, flag ORDER BY p_partkey) AS r FROM l), f AS (SELECT theme, least(count(*) FILTER (flag), count(*) FILTER (NOT flag)) AS fewer FROM l GROUP BY theme) SELECT p_partkey, theme, flag, 2 * r - flag::INT AS turn FROM r JOIN f USING (theme) WHERE r <= fewer""")
def theme_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("theme"), (F.col("p_size") > 30).alias("flag"))  # noqa: E741
    return S.interleaved(l, "theme", "flag", "p_partkey").withColumn("turn", F.col("turn").cast("long"))


@query("""WITH f AS (SELECT event_id, event_type AS cycle, user_id AS point, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS r FROM events) SELECT event_id, cycle, point, row_number() OVER (PARTITION BY cycle ORDER BY event_id) AS turn FROM f WHERE r = 1""")
def cycle_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles take turns over their points, each point once."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("cycle"), F.col("user_id").alias("point"))
    return S.spread(e, "cycle", "point", "event_id").withColumn("turn", F.col("turn").cast("long"))


@query("""SELECT o_orderkey, sha1(o_orderkey::VARCHAR) AS digest FROM orders WHERE ('0x' || substr(sha1(o_orderkey::VARCHAR), 1, 2))::INT % 2 = 0""")
def digest_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hash_half(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("""WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha1('0:' || p_partkey), p_partkey) AS r FROM part) SELECT p_partkey, p_brand FROM r WHERE r <= CASE WHEN starts_with(p_brand, 'Brand#11') THEN 1 WHEN starts_with(p_brand, 'Brand#1') THEN 5 ELSE 2 END""")
def devsel_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a task, more or fewer by the first prefix that fits."""
    return S.boosted(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey", 2, [("Brand#11", 1), ("Brand#1", 5)])


@query("""SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'g:' || source WHEN doc_id % 3 > 0 THEN 'c:' || md5(coalesce(text, '')) ELSE 'i:' || doc_id END AS val_group FROM documents""")
def val_group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an example is carved out with: its group, else its claim, else itself."""
    group = F.when(F.col("source").isin("src1", "src2"), F.col("source"))
    claim = F.when(F.col("doc_id") % 3 > 0, F.md5(F.coalesce("text", F.lit("")))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", S.val_group(group, claim, F.col("doc_id")).alias("val_group"))


@query("""WITH g AS (SELECT CASE source WHEN 'src1' THEN 'src0' WHEN 'src3' THEN 'src2' ELSE source END AS "group", count(*) AS n FROM documents GROUP BY 1) SELECT "group", n FROM g WHERE n >= 5 AND "group" NOT IN ('src2') ORDER BY n DESC, "group" LIMIT 14""")
def top_aliased_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 14 most frequent groups of enough rows, aliases merged, some left out."""
    return S.top_groups(table(spark, sf_dir, "documents"), "source", 5, 14, ("src2",), {"src1": "src0", "src3": "src2"})


@query("""WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS tokens FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha1('0:' || doc_id), doc_id) AS r FROM t WHERE tokens BETWEEN 1 AND 1024) SELECT doc_id, source, tokens FROM r WHERE r <= 2""")
def probe_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two examples a task, of those that fit the token limit."""
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))).cast("long")
    t = table(spark, sf_dir, "documents").select("doc_id", "source", n.alias("tokens")).where("tokens between 1 and 1024")
    return S.boosted(t, "source", "doc_id", 2, [])
