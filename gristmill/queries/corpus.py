"""Aggregation of annotators and records, and corpus accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import arrays
from gristmill.queries._base import EXAMPLES, examples, query, table


@query("""WITH v AS (SELECT event_id % 200 AS item, user_id, event_type FROM events), n AS (SELECT item, count(DISTINCT user_id) AS raters FROM v GROUP BY item), c AS (SELECT item, event_type, count(DISTINCT user_id) AS votes FROM v GROUP BY ALL)
SELECT item, event_type, votes, raters, round(votes / raters, 6) AS share FROM c JOIN n USING (item) WHERE raters >= 3""")
def crowd_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of distinct raters for each item and answer, over the raters who answered anything."""
    v = table(spark, sf_dir, "events").select((F.col("event_id") % 200).alias("item"), "user_id", "event_type")
    n = v.groupBy("item").agg(F.count_distinct("user_id").alias("raters")).where("raters >= 3")
    c = v.groupBy("item", "event_type").agg(F.count_distinct("user_id").alias("votes"))
    return c.join(n, "item").select("item", "event_type", "votes", "raters", F.round(F.col("votes") / F.col("raters"), 6).alias("share"))


@query("""WITH h AS (SELECT event_id % 100 AS item, least(4, floor(value / 20))::BIGINT AS level FROM events WHERE value IS NOT NULL), c AS (SELECT item, level, count(*) AS n FROM h GROUP BY ALL)
SELECT item, sum(n)::BIGINT AS answers, round(sum(n * [0.0, 0.0, 0.5, 1.0, 1.0][level + 1])::DOUBLE / sum(n), 6) AS share FROM c GROUP BY item HAVING sum(n) >= 3""")
def survey_credit_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of yes from a histogram of levels, each with its credit."""
    credit = F.array(*map(F.lit, (0.0, 0.0, 0.5, 1.0, 1.0)))
    h = table(spark, sf_dir, "events").where("value is not null").select((F.col("event_id") % 100).alias("item"), F.least(F.lit(4), F.floor(F.col("value") / 20)).cast("int").alias("level"))
    c = h.groupBy("item", "level").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("item").agg(F.sum("n").alias("answers"), F.round(F.sum(F.col("n") * F.element_at(credit, F.col("level") + 1)) / F.sum("n"), 6).alias("share")).where("answers >= 3")


@query("""WITH r AS (SELECT event_id % 150 AS item, user_id, value, row_number() OVER (PARTITION BY event_id % 150, user_id ORDER BY event_id) AS n FROM events) SELECT item, count(*) AS rows, count(value) AS answers, round(CASE WHEN count(value) >= 3 THEN avg(value) END, 6) AS mean FROM r WHERE n = 1 GROUP BY item HAVING count(*) >= 3""")
def rater_dedup_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first answer of each rater; a mean needs three."""
    w = Window.partitionBy("item", "user_id").orderBy("event_id")
    r = table(spark, sf_dir, "events").select((F.col("event_id") % 150).alias("item"), "user_id", "event_id", "value").withColumn("n", F.row_number().over(w)).where("n = 1")
    return r.groupBy("item").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("answers"), F.round(F.when(F.count("value") >= 3, F.avg("value")), 6).alias("mean")).where("rows >= 3")


@query("""WITH c AS (SELECT c_mktsegment AS seg, c_nationkey, count(*) AS n FROM customer GROUP BY ALL), t AS (SELECT c_mktsegment AS seg, count(*) AS total FROM customer GROUP BY 1), d AS (SELECT seg, c_nationkey, n, total, n / total AS p, round(n / total, 2) AS published FROM c JOIN t USING (seg))
SELECT seg, bool_and(abs(p - published) <= 0.005) AS agrees, sum(n)::BIGINT AS total, count(*) AS options FROM d GROUP BY seg""")
def distribution_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted shares against published ones, within half a percent."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("seg"), "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    d = c.withColumn("total", F.sum("n").over(Window.partitionBy("seg"))).withColumn("p", F.col("n") / F.col("total")).withColumn("published", F.round("p", 2))
    return d.groupBy("seg").agg(F.bool_and(F.abs(F.col("p") - F.col("published")) <= 0.005).alias("agrees"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("options"))


@query("""SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10""")
def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_brand").limit(10)


@query("""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS users, count(*) FILTER (n >= 50) AS over_50, count(*) FILTER (n >= 70) AS over_70, count(*) FILTER (n >= 100) AS over_100 FROM c""")
def issue_count_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("users"), *(F.count_if(F.col("n") >= k).alias(f"over_{k}") for k in (50, 70, 100)))


@query("""WITH c AS (SELECT c_nationkey AS system, c_mktsegment AS component, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY n DESC, component) AS r FROM c WHERE n >= 8), k AS (SELECT *, count(*) OVER (PARTITION BY system) AS kept FROM r WHERE r <= 3) SELECT system::BIGINT AS system, component, n FROM k WHERE kept >= 2""")
def components_by_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("system"), F.col("c_mktsegment").alias("component")).agg(F.count(F.lit(1)).alias("n")).where("n >= 8")
    r = c.withColumn("r", F.row_number().over(Window.partitionBy("system").orderBy(F.desc("n"), "component"))).where("r <= 3")
    return r.withColumn("kept", F.count(F.lit(1)).over(Window.partitionBy("system"))).where("kept >= 2").select("system", "component", "n")


@query("""SELECT least(floor(l_discount * 100), 9)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1""")
def probability_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.least(F.floor(F.col("l_discount") * 100), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EXAMPLES}, q AS (SELECT task, domain, target, toxic, substr(task, 4)::BIGINT % 6 AS row FROM examples), t AS (SELECT count(*) AS total FROM q)
SELECT row, count(*) AS questions, count(DISTINCT task) AS schemas, round(count(*) / any_value(total), 6) AS share, count(*) / any_value(total) <= CASE WHEN row <= 3 THEN 0.15 ELSE 0.10 END AS within_cap, round(avg(toxic), 6) AS soft_share FROM q, t GROUP BY row""")
def corpus_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = examples(spark, sf_dir).withColumn("row", F.substring("task", 4, 9).cast("long") % 6)
    x = q.groupBy("row").agg(F.count(F.lit(1)).alias("questions"), F.count_distinct("task").alias("schemas"), F.avg("toxic").alias("soft"))
    x = x.withColumn("share", F.col("questions") / F.sum("questions").over(Window.partitionBy()))  # one row a source row
    return x.select("row", "questions", "schemas", F.round("share", 6).alias("share"), (F.col("share") <= F.when(F.col("row") <= 3, 0.15).otherwise(0.10)).alias("within_cap"), F.round("soft", 6).alias("soft_share"))


@query(f"""WITH {EXAMPLES}, q AS (SELECT domain, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'devreal' ELSE 'testreal' END AS split, task FROM (SELECT *, ('0x' || substr(sha256('0:' || task), 1, 16))::UBIGINT % 100 AS h FROM examples))
SELECT CASE WHEN grouping(domain) = 1 THEN 'all' ELSE domain END AS domain, CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, count(*) AS questions, count(DISTINCT task) AS tasks FROM q GROUP BY CUBE (domain, split)""")
def domain_split_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gristmill.functions import hashing

    q = examples(spark, sf_dir).withColumn("split", hashing.split_of(F.col("task")))
    c = q.cube("domain", "split").agg(F.grouping("domain").alias("gd"), F.grouping("split").alias("gs"), F.count(F.lit(1)).alias("questions"), F.count_distinct("task").alias("tasks"))
    return c.select(F.when(F.col("gd") == 1, "all").otherwise(F.col("domain")).alias("domain"), F.when(F.col("gs") == 1, "all").otherwise(F.col("split")).alias("split"), "questions", "tasks")


@query("""WITH s AS (SELECT p_brand AS task, p_type AS options, p_partkey AS pos FROM part), n AS (SELECT task, count(DISTINCT options) AS sets, count(DISTINCT options) > 6 AS unstable, arg_min(options, pos) AS first_options FROM s GROUP BY task) SELECT * FROM n""")
def schema_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option sets of each task; more than six make it unstable; the first seen represents it."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("task")).agg(F.count_distinct("p_type").alias("sets"), (F.count_distinct("p_type") > 6).alias("unstable"), F.min_by("p_type", "p_partkey").alias("first_options"))


@query("""WITH x AS (SELECT p_brand, p_type, p_size % 3 AS axis FROM part) SELECT 'brand' AS axis, p_brand AS value, count(DISTINCT p_type) AS generators FROM x GROUP BY p_brand UNION ALL SELECT 'size', axis::VARCHAR, count(DISTINCT p_type) FROM x GROUP BY axis""")
def coverage_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").select("p_type", F.expr("stack(2, 'brand', p_brand, 'size', cast(p_size % 3 as string)) as (axis, value)"))
    return x.groupBy("axis", "value").agg(F.count_distinct("p_type").alias("generators"))


@query("""WITH m AS (SELECT count(*) AS n, count(*) FILTER (l_discount > 0) AS soft, count(*) FILTER (l_tax > 0.04) AS ordinal FROM lineitem) SELECT 'soft' AS rule, round(soft / n, 6) AS share, soft / n >= 0.10 AS met FROM m UNION ALL SELECT 'ordinal', round(ordinal / n, 6), ordinal / n >= 0.10 FROM m""")
def mixing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").agg(F.avg((F.col("l_discount") > 0).cast("double")).alias("soft"), F.avg((F.col("l_tax") > 0.04).cast("double")).alias("ordinal"))
    long = m.select(F.expr("stack(2, 'soft', soft, 'ordinal', ordinal) as (rule, share)"))
    return long.select("rule", F.round("share", 6).alias("share"), (F.col("share") >= 0.10).alias("met"))


@query("""WITH i AS (SELECT o_custkey AS input, o_orderpriority AS target FROM orders), a AS (SELECT input, count(DISTINCT target) AS n FROM i GROUP BY input) SELECT count(*) AS inputs, round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0.0 END), 6) AS ambiguous FROM a""")
def ambiguous_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n"))
    return a.agg(F.count(F.lit(1)).alias("inputs"), F.round(F.avg((F.col("n") > 1).cast("double")), 6).alias("ambiguous"))


@query("""WITH c AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS labels, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, labels FROM c WHERE n = 1""")
def single_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("s"))
    return c.where(F.size("s") == 1).select("l_orderkey", F.array_join("s", ",").alias("labels"))


@query("""WITH g AS (SELECT s_nationkey, count(DISTINCT s_suppkey % 3) AS revisions, count(DISTINCT s_suppkey % 2) AS claims, count(DISTINCT (s_suppkey % 3) * 2 + s_suppkey % 2) AS cells FROM supplier GROUP BY 1) SELECT s_nationkey, revisions, claims, revisions = 3 AND claims >= 2 AND revisions * claims = cells AS complete FROM g""")
def contrast_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational division: cases with every revision and claim combined."""
    g = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count_distinct(F.col("s_suppkey") % 3).alias("revisions"), F.count_distinct(F.col("s_suppkey") % 2).alias("claims"), F.count_distinct(F.col("s_suppkey") % 3, F.col("s_suppkey") % 2).alias("cells"))
    return g.select("s_nationkey", "revisions", "claims", ((F.col("revisions") == 3) & (F.col("claims") >= 2) & (F.col("revisions") * F.col("claims") == F.col("cells"))).alias("complete"))


@query("""SELECT n.n_nationkey, c.n AS customers, coalesce(s.n, 0) AS suppliers FROM nation n LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c.c_nationkey = n.n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s.s_nationkey = n.n_nationkey""")
def coverage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension with counts of two facts, each aggregated before the join."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", "customers", F.coalesce("suppliers", F.lit(0).cast("long")).alias("suppliers"))
