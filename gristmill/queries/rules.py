"""Rules, rankings, linkage and posteriors over records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import arrays
from gristmill.operators import rules as R
from gristmill.queries._base import query, table


@query("""SELECT p_partkey, p_size > 20 AS threshold, p_retailprice BETWEEN 950 AND 1200 AS within, p_brand = 'Brand#11' AS equals, p_size IN (1, 5, 9) AS member, round(0.5 * (1 + tanh(2.5 * (p_retailprice - 1000) / (0.03 * 1000))), 6) AS soft FROM part""")
def rule_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", R.threshold(F.col("p_size"), 20).alias("threshold"), R.within(price, 950, 1200).alias("within"), (F.col("p_brand") == "Brand#11").alias("equals"), F.col("p_size").isin(1, 5, 9).alias("member"), F.round(arrays.soft(price, F.lit(1000.0), F.lit(1000.0)), 6).alias("soft"))


_KLEENE = "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal > 0 END AS a, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey < 12 END AS b, c_mktsegment = 'BUILDING' AS c"


@query(f"""WITH k AS (SELECT c_custkey, {_KLEENE} FROM customer) SELECT c_custkey, a AND b AS both, a OR b AS any_of, NOT a AS negated, NOT a OR b AS implies, CASE WHEN coalesce(a, false)::INT + coalesce(b, false)::INT + c::INT >= 2 THEN false WHEN a IS NULL OR b IS NULL THEN NULL ELSE a::INT + b::INT + c::INT = 1 END AS one FROM k""")
def kleene_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer").selectExpr("c_custkey", *_KLEENE.split(", "))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return k.select("c_custkey", R.kleene("and", [a, b]).alias("both"), R.kleene("or", [a, b]).alias("any_of"), R.kleene("not", [a]).alias("negated"), R.kleene("implies", [a, b]).alias("implies"), R.kleene("one", [a, b, c]).alias("one"))


@query("""WITH w AS (SELECT s_suppkey, s_nationkey, s_acctbal, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS top, avg(s_acctbal) OVER (PARTITION BY s_nationkey) AS mean FROM supplier), t AS (SELECT *, count(*) FILTER (s_acctbal = top) OVER (PARTITION BY s_nationkey) AS ties FROM w) SELECT s_suppkey, CASE WHEN ties > 1 THEN NULL ELSE s_acctbal = top END AS extreme, s_acctbal > mean AS above_mean FROM t""")
def across_extreme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a record holds its group's extreme, unknown on ties, and is above the mean."""
    w = Window.partitionBy("s_nationkey")
    t = table(spark, sf_dir, "supplier").withColumns({"top": F.max("s_acctbal").over(w), "mean": F.avg("s_acctbal").over(w)}).withColumn("ties", F.count_if(F.col("s_acctbal") == F.col("top")).over(w))
    return t.select("s_suppkey", F.when(F.col("ties") > 1, F.lit(None).cast("boolean")).otherwise(F.col("s_acctbal") == F.col("top")).alias("extreme"), (F.col("s_acctbal") > F.col("mean")).alias("above_mean"))


@query("""WITH o AS (SELECT user_id, event_id, value - lag(value, 2) OVER w AS rate, sum(CASE WHEN value NOT BETWEEN 10 AND 60 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 3 PRECEDING) AS outside, event_type = 'error' AS alarm FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN alarm AND outside >= 3 THEN 'shutdown' WHEN outside >= 3 THEN 'throttle' WHEN abs(rate) > 20 THEN 'alert' WHEN alarm THEN 'inspect' ELSE 'run' END AS action FROM o""")
def controller_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    outside = F.sum(F.when(~F.col("value").between(10, 60), 1).otherwise(0)).over(w.rowsBetween(-3, 0))
    o = table(spark, sf_dir, "events").select("event_id", (F.col("value") - F.lag("value", 2).over(w)).alias("rate"), outside.alias("outside"), (F.col("event_type") == "error").alias("alarm"))
    return o.select("event_id", R.policy(F.col("rate"), F.col("outside"), F.col("alarm")).alias("action"))


@query("""SELECT page_id, CASE WHEN t IN ('/', '~', '*') THEN 'all' WHEN ends_with(t, '/*') THEN 'folder' WHEN contains(t, '*') THEN 'pattern' ELSE 'file' END AS reach FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '/tmp/' || page_id || '/*' WHEN 2 THEN 'log*.txt' ELSE url END AS t FROM pages)""")
def blast_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    t = F.when(k == 0, "/").when(k == 1, F.concat(F.lit("/tmp/"), F.col("page_id").cast("string"), F.lit("/*"))).when(k == 2, "log*.txt").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", R.blast(t).alias("reach"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS following FROM orders) SELECT o_custkey, count(*) AS shifts, count(*) FILTER (date_diff('day', o_orderdate::DATE, following::DATE) < 7) AS short_rests, count(*) > 20 AS overload FROM s GROUP BY o_custkey""")
def roster_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").withColumn("following", F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return s.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("shifts"), F.count_if(F.datediff(F.col("following").cast("date"), F.col("o_orderdate").cast("date")) < 7).alias("short_rests"), (F.count(F.lit(1)) > 20).alias("overload"))


@query("""WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey // 2 AS b FROM supplier), r(start, node, hops) AS (SELECT a, a, 0 FROM e UNION ALL SELECT r.start, e.b, r.hops + 1 FROM r JOIN e ON e.a = r.node WHERE r.hops < 3 AND e.b > 0) SELECT start, node, hops::BIGINT AS hops FROM r WHERE hops > 0""")
def k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References followed up to three times; each hop is one equi-join."""
    e = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.floor(F.col("s_suppkey") / 2).alias("b")).where("b > 0")
    now = e.select(F.col("a").alias("start"), F.col("b").alias("node"), F.lit(1).cast("long").alias("hops"))
    out = now
    for k in (2, 3):
        now = now.join(e, F.col("node") == F.col("a")).select("start", F.col("b").alias("node"), F.lit(k).cast("long").alias("hops"))
        out = out.unionAll(now)
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("start"))
    return out.join(known, "start", "left_semi")


@query("""SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice / p_size DESC, p_partkey) AS by_ratio, rank() OVER (PARTITION BY p_brand ORDER BY abs(p_size - 25), p_partkey) AS by_deviation FROM part""")
def ranking_comparators(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.rank().over(w.orderBy(F.desc(F.col("p_retailprice") / F.col("p_size")), "p_partkey")).cast("long").alias("by_ratio"), F.rank().over(w.orderBy(F.abs(F.col("p_size") - 25), "p_partkey")).cast("long").alias("by_deviation"))


@query("""WITH r AS (SELECT c_custkey, c_nationkey, lower(regexp_replace(c_mktsegment, '[^A-Za-z]', '', 'g')) AS name, c_custkey % 97 AS strong, round(c_acctbal / 1000) AS day FROM customer), p AS (SELECT a.c_custkey AS x, b.c_custkey AS y, a.strong = b.strong AS s, a.name = b.name AND a.day = b.day AS n FROM r a JOIN r b ON a.c_nationkey = b.c_nationkey AND a.day = b.day AND a.c_custkey < b.c_custkey)
SELECT x, y, CASE WHEN s THEN 'id' WHEN n THEN 'name_and_date' ELSE 'unresolved' END AS verdict FROM p""")
def linkage_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records paired within blocks of nation and day: by strong id, else by name and date."""
    r = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.lower(F.regexp_replace("c_mktsegment", "[^A-Za-z]", "")).alias("name"), (F.col("c_custkey") % 97).alias("strong"), F.round(F.col("c_acctbal") / 1000).alias("day"))
    a, b = r.alias("a"), r.alias("b")
    p = a.join(b, (F.col("a.c_nationkey") == F.col("b.c_nationkey")) & (F.col("a.day") == F.col("b.day")) & (F.col("a.c_custkey") < F.col("b.c_custkey")))
    return p.select(F.col("a.c_custkey").alias("x"), F.col("b.c_custkey").alias("y"), F.when(F.col("a.strong") == F.col("b.strong"), "id").when(F.col("a.name") == F.col("b.name"), "name_and_date").otherwise("unresolved").alias("verdict"))


@query("""WITH f AS (SELECT s.s_suppkey, n.n_nationkey AS slot, abs(s.s_suppkey - n.n_nationkey) % 4 AS cost FROM (SELECT * FROM supplier WHERE s_suppkey <= 6) s JOIN nation n ON n.n_nationkey <= 4) SELECT a.slot AS s1, b.slot AS s2, c.slot AS s3, (a.cost + b.cost + c.cost)::BIGINT AS cost FROM f a JOIN f b ON b.s_suppkey = 2 AND a.slot <> b.slot JOIN f c ON c.s_suppkey = 3 AND c.slot NOT IN (a.slot, b.slot) WHERE a.s_suppkey = 1 AND a.cost + b.cost + c.cost <= 4""")
def feasible_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All assignments of three workers to five slots of a fixed-size instance, pruned as they grow."""
    slots = table(spark, sf_dir, "nation").where("n_nationkey <= 4").select(F.col("n_nationkey").alias("slot"))
    people = table(spark, sf_dir, "supplier").where("s_suppkey <= 3").select("s_suppkey", F.lit(1).alias("one"))
    f = people.join(F.broadcast(slots.withColumn("one", F.lit(1))), "one").withColumn("cost", F.abs(F.col("s_suppkey") - F.col("slot")) % 4)  # 15 rows
    own = lambda k: f.where(F.col("s_suppkey") == k).select("one", F.col("slot").alias(f"s{k}"), F.col("cost").alias(f"c{k}"))
    ab = own(1).join(own(2), "one").where("s1 <> s2 and c1 + c2 <= 4")
    abc = ab.join(own(3), "one").where("s3 <> s1 and s3 <> s2 and c1 + c2 + c3 <= 4")
    return abc.select("s1", "s2", "s3", (F.col("c1") + F.col("c2") + F.col("c3")).cast("long").alias("cost"))


_POST = """h AS (SELECT p_partkey, [0.5::DOUBLE, 0.3, 0.2] AS prior, [p_size / 51.0, 0.5, 1 - p_size / 51.0]::DOUBLE[] AS l1, [0.2::DOUBLE, 0.5, 0.3 + (p_partkey % 7) / 20.0] AS l2 FROM part), m AS (SELECT p_partkey, list_transform(range(1, 4), lambda i: prior[i] * l1[i] * l2[i]) AS m, prior FROM h),
post AS (SELECT p_partkey, prior, list_transform(m, lambda x: x / list_sum(m)) AS p FROM m)"""


def _posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") / 51.0
    prior = F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))
    l1 = F.array(size, F.lit(0.5), 1 - size)
    l2 = F.array(F.lit(0.2), F.lit(0.5), 0.3 + (F.col("p_partkey") % 7) / 20.0)
    return table(spark, sf_dir, "part").select("p_partkey", prior.alias("prior"), F.array(l1, l2).alias("l")).select("p_partkey", "prior", arrays.posterior(F.col("prior"), F.col("l")).alias("p"))


@query(f"WITH {_POST} SELECT p_partkey, round(p[1], 6) AS p1, round(p[2], 6) AS p2, round(p[3], 6) AS p3 FROM post")
def posterior_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posterior(spark, sf_dir).select("p_partkey", *(F.round(F.col("p")[i], 6).alias(f"p{i + 1}") for i in range(3)))


@query(f"WITH {_POST} SELECT p_partkey, list_position(p, list_max(p)) = list_position(prior, list_max(prior)) AS agrees, least(floor((list_max(p) - 1 / 3) / (2 / 3) * 5), 4)::BIGINT AS conf_bin FROM post")
def posterior_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the posterior's best with the prior's, and the bin of its normalised height."""
    top = F.array_max("p")
    return _posterior(spark, sf_dir).select("p_partkey", (arrays.argmax(F.col("p")) == arrays.argmax(F.col("prior"))).alias("agrees"), F.least(F.floor((top - 1 / 3) / (2 / 3) * 5), F.lit(4)).cast("long").alias("conf_bin"))


@query("""SELECT l_orderkey, l_linenumber, round(0.1 * pow(0.9, k) * pow(0.1, n - k) / (0.1 * pow(0.9, k) * pow(0.1, n - k) + 0.9 * pow(0.2, k) * pow(0.8, n - k)), 6) AS fault FROM (SELECT l_orderkey, l_linenumber, (l_quantity % 5)::INT AS k, 5 AS n FROM lineitem)""")
def sensor_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fault probability from k of five alarms, with false positives and negatives."""
    k = F.floor(F.col("l_quantity") % 5)
    yes = 0.1 * F.pow(F.lit(0.9), k) * F.pow(F.lit(0.1), 5 - k)
    no = 0.9 * F.pow(F.lit(0.2), k) * F.pow(F.lit(0.8), 5 - k)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(yes / (yes + no), 6).alias("fault"))


@query("""SELECT conv_id, turn, CASE WHEN role NOT IN ('user', 'assistant', 'system') THEN 'role' WHEN text IS NULL OR trim(text) = '' THEN 'text' WHEN length(text) > 1500 THEN 'length' ELSE 'ok' END AS problem FROM conversations""")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first field of a request that is wrong."""
    problem = F.when(~F.col("role").isin("user", "assistant", "system"), "role").when(F.col("text").isNull() | (F.trim("text") == ""), "text").when(F.length("text") > 1500, "length").otherwise("ok")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", problem.alias("problem"))
