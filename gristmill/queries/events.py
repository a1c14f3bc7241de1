"""Ordered operators: runs, islands, latches, as-of, vintages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.queries._base import query, table

LEVELS = ("click", "view", "signup", "purchase", "error")
_RANK = "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 END"
_BURST = f"""o AS (SELECT user_id, event_id, {_RANK} AS lvl, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events), b AS (SELECT *, pos // 6 AS burst, count(*) OVER (PARTITION BY user_id, pos // 6) AS n FROM o)"""


def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of six events of a user, in order, not overlapping; shorter ones are left out."""
    level = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("event_type")) - 1
    o = table(spark, sf_dir, "events").select("user_id", "event_id", level.alias("lvl"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("pos"))
    b = o.withColumn("burst", F.floor(F.col("pos") / 6))
    return b.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id", "burst"))).where("n = 6")


@query(f"WITH {_BURST} SELECT user_id, burst, min(event_id) AS first_event, max(lvl)::BIGINT AS top FROM b WHERE n = 6 GROUP BY ALL")
def bursts_of_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts(spark, sf_dir).groupBy("user_id", "burst").agg(F.min("event_id").alias("first_event"), F.max("lvl").alias("top"))


@query(f"WITH {_BURST}, e AS (SELECT user_id, burst, arg_min(lvl, pos) AS head, max(lvl) FILTER (pos % 6 > 0) AS later, count(DISTINCT lvl) AS kinds FROM b WHERE n = 6 GROUP BY ALL) SELECT user_id, burst, CASE WHEN kinds = 1 THEN 'dropped' WHEN later > head THEN 'escalates' WHEN later = head THEN 'stays' ELSE 'falls' END AS label FROM e")
def escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first level of a run against the highest later one; runs of one level are dropped."""
    e = bursts(spark, sf_dir).groupBy("user_id", "burst").agg(F.min_by("lvl", "pos").alias("head"), F.max(F.when(F.col("pos") % 6 > 0, F.col("lvl"))).alias("later"), F.count_distinct("lvl").alias("kinds"))
    return e.select("user_id", "burst", F.when(F.col("kinds") == 1, "dropped").when(F.col("later") > F.col("head"), "escalates").when(F.col("later") == F.col("head"), "stays").otherwise("falls").alias("label"))


@query(f"WITH {_BURST}, s AS (SELECT user_id, burst, count(DISTINCT lvl) = 1 AS same FROM b WHERE n = 6 GROUP BY ALL) SELECT count(*) AS bursts, count(*) FILTER (same) AS identical FROM s")
def burst_identical_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bursts(spark, sf_dir).groupBy("user_id", "burst").agg((F.count_distinct("lvl") == 1).alias("same"))
    return s.agg(F.count(F.lit(1)).alias("bursts"), F.count_if("same").alias("identical"))


@query("""WITH o AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events) SELECT event_id, ['level', 'component', 'burst', 'burst'][pos // 30 % 4 + 1] AS task FROM o""")
def task_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of thirty events dealt to four slots in turn."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    slots = F.array(*map(F.lit, ("level", "component", "burst", "burst")))
    return table(spark, sf_dir, "events").select("event_id", pos.alias("pos")).select("event_id", F.element_at(slots, (F.floor(F.col("pos") / 30) % 4 + 1).cast("int")).alias("task"))


@query("""WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n, value NOT BETWEEN 10 AND 60 AS outside FROM events) SELECT user_id, (any_value(n) - coalesce(max(pos) FILTER (NOT outside), 0))::BIGINT AS run FROM o GROUP BY user_id""")
def islands_outside_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive readings outside a band up to the last one."""
    o = table(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"), (~F.col("value").between(10, 60)).alias("outside"))
    return o.groupBy("user_id").agg((F.max("pos") - F.coalesce(F.max(F.when(~F.col("outside"), F.col("pos"))), F.lit(0))).cast("long").alias("run"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) = 'error' AS latched FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id""")
def latched_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the last raise or clear is a raise."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    return e.groupBy("user_id").agg((F.max_by("event_type", F.struct("ts", "event_id")) == "error").alias("latched"))


@query("""WITH o AS (SELECT user_id, value, row_number() OVER w AS r, lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l2, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, round(CASE WHEN n >= 3 THEN (value - l2) / 2 ELSE value - f END, 6) AS rate FROM o WHERE r = n""")
def rate_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean change over the last three readings; with fewer, last less first."""
    last = F.slice(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")), False), 1, 3)
    # a user's readings are reduced to the last three by rank before they are gathered
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    top = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("user_id").agg(last.alias("v"))
    first, end = F.col("v")[0]["value"], F.element_at("v", -1)["value"]
    return top.select("user_id", F.round(F.when(F.size("v") == 3, (first - end) / 2).otherwise(first - end), 6).alias("rate"))


@query("""WITH h AS (SELECT p_brand AS doc, p_partkey AS page, CASE WHEN p_size <= 8 THEN p_name END AS heading FROM part) SELECT doc, page, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner FROM h""")
def page_owner_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of backward: the last heading strictly before each page."""
    h = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("page"), F.when(F.col("p_size") <= 8, F.col("p_name")).alias("heading"))
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return h.select("doc", "page", F.last("heading", ignorenulls=True).over(w).alias("owner"))


@query("""WITH q AS (SELECT year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS quarter, sum(o_totalprice) AS level FROM orders GROUP BY 1), v AS (SELECT a.quarter + 1 AS vintage, b.quarter, b.level FROM q a JOIN q b ON b.quarter <= a.quarter AND b.quarter > a.quarter - 6)
SELECT c.vintage::BIGINT AS vintage, c.quarter::BIGINT AS quarter, round(c.level / p.level - 1, 6) AS growth FROM v c JOIN v p ON p.vintage = c.vintage AND p.quarter = c.quarter - 1""")
def vintage_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of a quarter on the one before, within one vintage, which knows the six quarters before it."""
    i = F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1
    q = table(spark, sf_dir, "orders").groupBy(i.cast("long").alias("quarter")).agg(F.sum("o_totalprice").alias("level"))
    v = q.withColumn("vintage", F.explode(F.sequence(F.col("quarter") + 1, F.col("quarter") + 6)))
    known = q.select((F.col("quarter") + 1).alias("vintage"))
    v = v.join(known, "vintage")
    before = v.select("vintage", (F.col("quarter") + 1).alias("quarter"), F.col("level").alias("past"))
    return v.join(before, ["vintage", "quarter"]).select("vintage", "quarter", F.round(F.col("level") / F.col("past") - 1, 6).alias("growth"))


@query("""SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations""")
def outline_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("previous"), F.lead("role").over(w).alias("next"))


@query("""WITH e AS (SELECT o_custkey, o_orderkey, o_orderdate AS closed, o_totalprice FROM orders) SELECT CASE WHEN o_totalprice < 1000 THEN 'group' WHEN o_custkey % 50 = 0 THEN 'benchmark' WHEN closed < TIMESTAMP '1992-06-01' THEN 'untimed' ELSE 'kept' END AS reason, count(*) AS n FROM e GROUP BY 1""")
def usable_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason that fits a row, counted."""
    reason = F.when(F.col("o_totalprice") < 1000, "group").when(F.col("o_custkey") % 50 == 0, "benchmark").when(F.col("o_orderdate") < F.lit("1992-06-01").cast("timestamp"), "untimed").otherwise("kept")
    return table(spark, sf_dir, "orders").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
