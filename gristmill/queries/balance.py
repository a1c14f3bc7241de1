"""Quotas, sampling and balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import hashing
from gristmill.operators import balance as B
from gristmill.queries._base import EXAMPLES, examples, query, table


@query("""WITH t AS (SELECT DISTINCT source AS task, substr(source, 4)::BIGINT % 5 + 1 AS row FROM documents) SELECT task, row, least(2000, greatest(50, floor(20000 * CASE WHEN row BETWEEN 1 AND 3 THEN 0.15 ELSE 0.10 END / count(*) OVER (PARTITION BY row))))::BIGINT AS quota FROM t""")
def task_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "documents").select(F.col("source").alias("task"), (F.substring("source", 4, 9).cast("long") % 5 + 1).alias("row")).distinct()
    return B.task_quotas(tasks, 20_000, 2_000)


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha1('7:' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, source FROM r WHERE r <= 10""")
def devsel_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sample(table(spark, sf_dir, "documents"), ["source"], 10, 7, "doc_id").select("doc_id", "source")


@query("""WITH RECURSIVE c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), s(i, lang, n) AS (SELECT 0, lang, n FROM c UNION ALL SELECT i + 1, lang, least(n, greatest(floor(sum(n) OVER () * 0.3)::BIGINT, (sum(n) OVER ())::BIGINT // count(*) OVER ()))::BIGINT FROM s WHERE i < 8),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1('3:' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, r.lang FROM r JOIN s ON s.lang = r.lang AND s.i = 8 WHERE r.r <= s.n""")
def source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    caps = B.source_caps({r.lang: r.n for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}, 0.3)  # one row a source
    limit = F.create_map(*(F.lit(x) for kv in caps.items() for x in kv))
    x = B.ranked(docs, ["lang"], [hashing.hash_order(3, F.col("doc_id").cast("string")), "doc_id"])
    return x.where(F.col("r") <= F.element_at(limit, F.col("lang"))).select("doc_id", "lang")


@query("""WITH r AS (SELECT doc_id, row_number() OVER w AS r, count(*) OVER (PARTITION BY source) AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY sha1('0:' || source || ':' || doc_id), doc_id)) SELECT doc_id, r <= floor(n * 0.5) AS described FROM r""")
def describe_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = B.ranked(table(spark, sf_dir, "documents"), ["source"], [hashing.hash_order(0, F.col("source"), F.col("doc_id").cast("string")), "doc_id"])
    return x.select("doc_id", (F.col("r") <= F.floor(F.col("size") * 0.5)).alias("described"))


@query("""WITH t AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), d AS (SELECT lang, count(*) AS tasks FROM t GROUP BY lang), q AS (SELECT lang, tasks, (600 // (SELECT count(*) FROM d))::BIGINT AS want FROM d),
r AS (SELECT doc_id, d.lang, d.source, row_number() OVER (PARTITION BY d.lang, d.source ORDER BY sha1('5:' || doc_id), doc_id) AS r FROM documents d), k AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY sha1('5:' || source), source) AS k FROM t)
SELECT r.doc_id, r.lang FROM r JOIN q USING (lang) JOIN k ON k.lang = r.lang AND k.source = r.source WHERE r.r <= greatest(2, want // tasks) + CASE WHEN k.k <= want % tasks AND want // tasks >= 2 THEN 1 ELSE 0 END""")
def domain_matched_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal shares of 600 examples for the domains present; each is dealt over its tasks, the remainder by digest, two a task at least."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    tasks = docs.groupBy("lang", "source").count()
    tasks = tasks.withColumns({"tasks": F.count(F.lit(1)).over(Window.partitionBy("lang")), "k": F.row_number().over(Window.partitionBy("lang").orderBy(hashing.hash_order(5, F.col("source")), "source"))})
    want = 600 // max(1, docs.select("lang").distinct().count())
    limit = F.greatest(F.lit(2), F.floor(want / F.col("tasks"))) + F.when((F.col("k") <= want % F.col("tasks")) & (F.floor(want / F.col("tasks")) >= 2), 1).otherwise(0)
    x = B.ranked(docs, ["lang", "source"], [hashing.hash_order(5, F.col("doc_id").cast("string")), "doc_id"])
    return x.join(tasks.select("lang", "source", limit.alias("limit")), ["lang", "source"]).where("r <= limit").select("doc_id", "lang")


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority AS g, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderkey, (SELECT max(i) FROM range(7) t(i) WHERE n * i // 7 <= p)::BIGINT AS part FROM r""")
def disjoint_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.disjoint_slice(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey", 7).select("o_orderkey", "part")


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS p, count(*) OVER (PARTITION BY p_brand) AS n FROM part), b AS (SELECT *, greatest(1, length(bin(n - 1))) AS w FROM r)
SELECT p_partkey, list_sum(list_transform(range(w), lambda i: ((p >> i) & 1) * (1 << (w - 1 - i))))::BIGINT AS spread FROM b""")
def van_der_corput_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bit_reversed(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey").select("p_partkey", "spread")


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS p, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, c_mktsegment FROM r WHERE n <= 40 OR p IN (SELECT i * n // 40 FROM range(40) t(i))""")
def thin_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.thin(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_custkey", 40).select("c_custkey", "c_mktsegment")


@query("""SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS turn FROM supplier""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.round_robin(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "s_suppkey")


@query("""WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), c AS (SELECT min(c) AS c FROM range(1, 1000001) t(c) WHERE (SELECT sum(least(size, c)) FROM s) >= least(500, (SELECT sum(size) FROM s))),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1('1:' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, lang FROM r, c WHERE r <= c ORDER BY sha1('1:' || doc_id), doc_id LIMIT 500""")
def waterfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    level = B.water_level(docs.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), 500)
    held = B.sample(docs, ["lang"], level, 1, "doc_id").select("doc_id", "lang")
    return held.orderBy(hashing.hash_order(1, F.col("doc_id").cast("string")), "doc_id").limit(500)  # the excess goes back by digest


@query(f"""WITH {EXAMPLES}, c AS (SELECT target, count(*) AS n FROM examples GROUP BY 1), s AS (SELECT min(n) AS second FROM (SELECT n FROM c ORDER BY n DESC, target LIMIT 2)), r AS (SELECT doc_id, target, row_number() OVER (PARTITION BY target ORDER BY sha1('2:' || doc_id), doc_id) AS r FROM examples) SELECT doc_id, target FROM r, s WHERE r <= second * 2""")
def majority_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.majority_cap(examples(spark, sf_dir), "target", 2, 2, "doc_id").select("doc_id", "target")


@query(f"""WITH {EXAMPLES}, r AS (SELECT domain, doc_id, toxic, row_number() OVER (PARTITION BY domain, toxic ORDER BY sha1('4:' || doc_id), doc_id) AS rank FROM examples) SELECT a.domain, a.rank, a.doc_id AS negative, b.doc_id AS positive FROM r a JOIN r b ON a.domain = b.domain AND a.rank = b.rank AND a.toxic = 0 AND b.toxic = 1""")
def paired_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.paired(examples(spark, sf_dir), "domain", "toxic", 4, "doc_id")


@query("""WITH r AS (SELECT doc_id, lang, sha1('6:' || doc_id) AS h, row_number() OVER (PARTITION BY lang ORDER BY sha1('6:' || doc_id), doc_id) > 120 AS over FROM documents) SELECT doc_id, lang FROM r ORDER BY over, h, doc_id LIMIT 400""")
def class_cap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.class_fill(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 400, 0.3, 6, "doc_id")


@query()
def val_carve_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy by group; a test repeats it in plain Python."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.concat(F.lit("t"), (F.col("conv_id") % 4).cast("string")).alias("task"))
    return B.carve(rows, "task", "conv_id")


@query()
def positives_first_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy turns; a test checks shares and disjointness."""
    rows = table(spark, sf_dir, "part").select("p_partkey", *((F.col("p_size") % m == 0).cast("int").alias(f"m{m}") for m in (3, 5, 7)))
    return B.positives_first(rows, "p_partkey", ["m3", "m5", "m7"], 60, 0.5)


@query("""SELECT doc_id % 51 + 1 AS row, count(*) AS docs FROM documents WHERE doc_id % 51 + 1 IN (11, 25) GROUP BY 1""")
def reserved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = (F.col("doc_id") % 51 + 1).alias("row")
    return table(spark, sf_dir, "documents").select(row).where(F.col("row").isin(*hashing.RESERVED_ROWS)).groupBy("row").agg(F.count(F.lit(1)).alias("docs"))
