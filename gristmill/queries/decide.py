"""Controller policies, tool gates, constraints, rosters, posteriors and wire requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from gristmill.operators import decide as X
from gristmill.queries._base import query, table
from gristmill.queries.rules import _POST, _posterior

_SOFT = "0.5 * (1 + tanh(2.5 * ({0} - {1}) / (0.03 * 100.0)))"
_HI, _LO, _CRIT = 60.0, 10.0, 85.0


@query(f"""WITH o AS (SELECT user_id, value, ts, event_id, event_type, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)), i AS (SELECT user_id, min(r) AS inside FROM o WHERE value BETWEEN {_LO} AND {_HI} GROUP BY user_id), n AS (SELECT user_id, count(*) AS n FROM o GROUP BY user_id),
l AS (SELECT n.user_id, max(value) FILTER (r = 1) AS last, (max(value) FILTER (r = 1) - max(value) FILTER (r = least(3, n.n))) / 2.0 AS rate, any_value(coalesce(i.inside, n.n + 1)) - 1 AS runs, bool_or(r = 1 AND event_type = 'error') AS alarm FROM o JOIN n USING (user_id) LEFT JOIN i USING (user_id) GROUP BY n.user_id),
p AS (SELECT *, 1 - (1 - {_SOFT.format('last', _CRIT)}) * (1 - {_SOFT.format('(last + rate * 4)', _CRIT)}) AS shut, 1 - (1 - {_SOFT.format('last', _HI)}) * {_SOFT.format('last', _LO)} AS outside, CASE WHEN rate > 0 THEN {_SOFT.format('(last + rate * 4)', _HI)} WHEN rate < 0 THEN 1 - {_SOFT.format('(last + rate * 4)', _LO)} ELSE 0 END AS leaving, CASE WHEN last > {(_HI + _LO) / 2} THEN rate < 0 ELSE rate > 0 END AS improving FROM l)
SELECT user_id, round(shut, 6) AS shut_down_the_loop, round(CASE WHEN NOT improving AND (runs >= 3 OR alarm) THEN (1 - shut) * outside ELSE 0 END, 6) AS escalate_to_duty_engineer, round(CASE WHEN NOT improving AND NOT (runs >= 3 OR alarm) THEN (1 - shut) * outside ELSE 0 END, 6) AS correct_the_setpoint,
round(CASE WHEN improving THEN (1 - shut) * outside ELSE 0 END + (1 - shut) * (1 - outside) * leaving, 6) AS hold_and_watch, round((1 - shut) * (1 - outside) * (1 - leaving), 6) AS leave_the_loop_alone FROM p""")
def controller_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The controller's policy for each sensor, as chances of its five actions."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    o = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w))
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("value")))
    inside = F.min(F.when(F.col("value").between(_LO, _HI), F.col("r")))
    g = o.groupBy("user_id").agg(at(1).alias("v1"), at(2).alias("v2"), at(3).alias("v3"), F.count(F.lit(1)).alias("n"), inside.alias("inside"), F.bool_or((F.col("r") == 1) & (F.col("event_type") == "error")).alias("alarm"))
    rate = (F.col("v1") - F.coalesce("v3", "v2", "v1")) / 2.0
    runs = F.coalesce("inside", F.col("n") + 1) - 1
    chances = X.policy(F.col("v1"), rate, runs, F.col("alarm"), low=F.lit(_LO), high=F.lit(_HI), critical=F.lit(_CRIT), span=F.lit(100.0), horizon=4, runs_most=3)
    return g.select("user_id", *(F.round(c, 6).alias(a) for c, a in zip(chances, X.ACTIONS, strict=True)))


@query("""WITH c AS (SELECT p_partkey, (['read', 'overwrite', 'delete', 'create'])[(p_partkey % 4 + 1)::INT] AS effect, p_size % 7 = 0 AS dry, CASE WHEN p_size % 3 = 0 THEN 'git revert x' WHEN p_size % 3 = 1 THEN 'rm y' ELSE NULL END AS reverse, '/data/' || p_size || '/f' AS target, CASE WHEN p_partkey % 5 = 0 THEN '/data/' || p_size WHEN p_partkey % 5 = 1 THEN '/other' END AS backup FROM part)
SELECT p_partkey, effect = 'read' OR dry OR coalesce(string_split(reverse, ' ')[1] IN ('git', 'mv'), false) OR (effect IN ('overwrite', 'delete') AND coalesce(starts_with(target, backup), false)) AS undoable FROM c""")
def undoable_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls that can be taken back."""
    k, s = F.col("p_partkey"), F.col("p_size")
    effect = F.element_at(F.array(*map(F.lit, ("read", "overwrite", "delete", "create"))), (k % 4 + 1).cast("int"))
    size = s.cast("string")
    backup = F.when(k % 5 == 0, F.concat(F.lit("/data/"), size)).when(k % 5 == 1, "/other")
    reverse = F.when(s % 3 == 0, "git revert x").when(s % 3 == 1, "rm y")
    return table(spark, sf_dir, "part").select(k, X.undoable(effect, s % 7 == 0, reverse, F.array(F.lit("git"), F.lit("mv")), backup, F.concat(F.lit("/data/"), size, F.lit("/f"))).alias("undoable"))


_CONS = (("flag", "need", "", "", ()), ("enum", "ne", "Brand#11", "", ()), ("enum", "in", "", "", ("Brand#12", "Brand#23", "Brand#34")), ("num", ">=", "20", "", ()), ("num", "<", "20", "", ()), ("num", "eq", "25", "", ()), ("num", "range", "10", "30", ()))


@query("""WITH c AS (SELECT p_partkey, p_brand, p_size, p_partkey % 2 = 0 AS f, unnest(range(7)) AS i FROM part) SELECT p_partkey, i AS con, CASE i WHEN 0 THEN f WHEN 1 THEN p_brand <> 'Brand#11' WHEN 2 THEN p_brand IN ('Brand#12', 'Brand#23', 'Brand#34') WHEN 3 THEN p_size >= 20 WHEN 4 THEN p_size < 20 WHEN 5 THEN p_size = 25 ELSE p_size BETWEEN 10 AND 30 END AS ok FROM c""")
def catalog_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each catalog entry against each typed constraint."""
    cons = F.array(*(F.struct(F.lit(i).cast("long").alias("con"), F.lit(k).alias("kind"), F.lit(o).alias("op"), F.lit(t).alias("target"), F.lit(u).alias("upper"), F.array(*map(F.lit, v)).cast("array<string>").alias("options")) for i, (k, o, t, u, v) in enumerate(_CONS)))
    x = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.explode(cons).alias("c"))
    value = F.when(F.col("c.kind") == "flag", (F.col("p_partkey") % 2 == 0).cast("string")).when(F.col("c.kind") == "enum", F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    return x.select("p_partkey", "c.con", X.satisfied(F.col("c.kind"), F.col("c.op"), value, F.col("c.target"), F.col("c.upper"), F.col("c.options")).alias("ok"))


_RULES = (("max_shifts", 0, 0, 0, 2), ("min_shifts", 1, 0, 0, 1), ("rest", 0, 0, 0, 0), ("one_per_day", 0, 0, 0, 0), ("pair_conflict", 0, 0, 1, 0), ("handover", 0, 1, 2, 0), ("buddy", 0, 2, 0, 0))

def _rules() -> object:
    return F.array(*(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(k).alias("k")) for t, p, a, b, k in _RULES))


_BROKEN = """[0 + (len(list_filter(people, lambda w: w = 0)) > 2)::INT, 0 + (len(list_filter(people, lambda w: w = 1)) < 1)::INT, 0 + (len(list_filter(range(1, len(people)), lambda s: people[s] = people[s + 1])) > 0)::INT,
0 + (len(list_filter([0, 1, 2], lambda w: len(list_filter(range(1, len(people) + 1), lambda s: people[s] = w)) > len(list_distinct(list_transform(list_filter(range(1, len(people) + 1), lambda s: people[s] = w), lambda s: (s - 1) // 2))))) > 0)::INT,
0 + (len(list_intersect(list_transform(list_filter(range(1, len(people) + 1), lambda s: people[s] = 0), lambda s: (s - 1) // 2), list_transform(list_filter(range(1, len(people) + 1), lambda s: people[s] = 1), lambda s: (s - 1) // 2))) > 0)::INT,
0 + coalesce(list_max(list_filter(range(1, len(people) + 1), lambda s: people[s] = 1)) > list_min(list_filter(range(1, len(people) + 1), lambda s: people[s] = 2)), false)::INT,
0 + (len(list_filter(list_transform(list_filter(range(1, len(people) + 1), lambda s: people[s] = 2), lambda s: (s - 1) // 2), lambda d: NOT list_contains(list_transform(list_filter(range(1, len(people) + 1), lambda s: people[s] = 0), lambda s: (s - 1) // 2), d))) > 0)::INT]"""


@query(f"""WITH a AS (SELECT o_custkey, list((o_orderkey % 3)::INT ORDER BY o_orderdate, o_orderkey) AS people FROM orders GROUP BY o_custkey), b AS (SELECT o_custkey, {_BROKEN} AS x FROM a) SELECT o_custkey, array_to_string(list_filter(range(7), lambda i: x[i + 1] = 1), ',') AS broken FROM b""")
def roster_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coupling rules that each roster breaks, of seven kinds."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda s: (s["o_orderkey"] % 3).cast("int"))
    a = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(own.alias("people"))  # a customer's orders are one roster
    return a.select("o_custkey", F.array_join(F.transform(X.violations(F.col("people"), _rules(), 2), lambda i: i.cast("string")), ",").alias("broken"))


@query(f"""WITH i AS (SELECT s_suppkey, s_nationkey % 3 AS out FROM supplier), p AS (SELECT unnest([0, 1, 2]) AS w), g AS (SELECT s_suppkey, [a.w, b.w, c.w, d.w]::INT[] AS people FROM i, p a, p b, p c, p d WHERE a.w <> out AND d.w <> (out + 1) % 3), x AS (SELECT s_suppkey, people, {_BROKEN} AS x FROM g) SELECT s_suppkey, count(*) AS assignments, sum((list_sum(x) = 0)::INT)::BIGINT AS feasible, min(list_sum(x))::BIGINT AS fewest FROM x GROUP BY s_suppkey""")
def feasible_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All allowed assignments of each instance, and how many break no rule."""
    out = F.col("s_nationkey") % 3
    everyone = F.array(*map(F.lit, range(3)))
    allowed = F.array(F.filter(everyone, lambda w: w != out), everyone, everyone, F.filter(everyone, lambda w: w != (out + 1) % 3))
    i = table(spark, sf_dir, "supplier").select("s_suppkey", allowed.alias("allowed"))
    broken = F.size(X.violations(F.col("people"), _rules(), 2))
    g = X.assignments(i, "allowed", 4).select("s_suppkey", broken.alias("b"))
    return g.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("assignments"), F.count_if(F.col("b") == 0).alias("feasible"), F.min("b").cast("long").alias("fewest"))


_PRED = "([[0.9, 0.1, 0.0], [0.2, 0.8, 0.0], [0.5, 0.5, 0.0]]::DOUBLE[][])"


@query(f"""WITH {_POST}, t AS (SELECT p_partkey, list_transform(range(1, 4), lambda o: p[1] * {_PRED}[1][o] + p[2] * {_PRED}[2][o] + p[3] * {_PRED}[3][o]) AS t FROM post) SELECT p_partkey, round(t[2], 6) AS second, round(t[1], 6) AS first, t[1] <> 0 AS loses FROM t""")
def posterior_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors as chances of outcomes; the offered ones in order, and whether leaving out the first would lose mass."""
    pred = F.array(*(F.array(*map(F.lit, row)) for row in ((0.9, 0.1, 0.0), (0.2, 0.8, 0.0), (0.5, 0.5, 0.0))))
    t = _posterior(spark, sf_dir).select("p_partkey", X.to_outcomes(F.col("p"), pred).alias("t"))
    kept = X.offered(F.col("t"), F.array(F.lit(1), F.lit(0)))
    return t.select("p_partkey", F.round(kept[0], 6).alias("second"), F.round(kept[1], 6).alias("first"), X.offered(F.col("t"), F.array(F.lit(1), F.lit(2))).isNull().alias("loses"))


_VOTE = "list_transform(range(1, 4), lambda i: ({0}[i] >= list_max({0}) - 1e-12)::INT / len(list_filter({0}, lambda x: x >= list_max({0}) - 1e-12)))"


@query(f"""WITH {_POST}, h AS (SELECT p_partkey, [p_size / 51.0, 0.5, 1 - p_size / 51.0]::DOUBLE[] AS l1, [0.2::DOUBLE, 0.5, 0.3 + (p_partkey % 7) / 20.0] AS l2 FROM part), v AS (SELECT p_partkey, l1, l2, list_transform(range(1, 4), lambda i: l1[i] * l2[i]) AS e, list_transform(range(1, 4), lambda i: {_VOTE.format('l1')}[i] + {_VOTE.format('l2')}[i]) AS m FROM h)
SELECT p_partkey, 0.5 AS prior, round(e[1] / list_sum(e), 6) AS likelihood, round(l2[1] / list_sum(l2), 6) AS last, round(m[1] / list_sum(m), 6) AS majority FROM v""".replace(_POST + ", h AS", "h AS"))
def shallow_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hypothesis as each shallow reading sees it."""
    size = F.col("p_size") / 51.0
    prior, l1, l2 = F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)), F.array(size, F.lit(0.5), 1 - size), F.array(F.lit(0.2), F.lit(0.5), 0.3 + (F.col("p_partkey") % 7) / 20.0)
    x = table(spark, sf_dir, "part").select("p_partkey", prior.alias("weights"), F.array(l1, l2).alias("l"))
    return x.select("p_partkey", *(F.round(c[0], 6).alias(n) for n, c in X.heuristics(F.col("weights"), F.col("l")).items()))


@query(f"""WITH {_POST}, b AS (SELECT p_partkey, least(floor((list_max(p) - 1 / 3) / (2 / 3) * 5), 4)::BIGINT AS bin FROM post), r AS (SELECT b.p_partkey, p_brand, bin, row_number() OVER (PARTITION BY p_brand, bin ORDER BY b.p_partkey) AS r FROM b JOIN part USING (p_partkey)) SELECT p_partkey, p_brand, bin, r <= 3 AS kept FROM r""")
def balanced_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts kept in order while their bin has room in its group."""
    top = F.array_max("p")
    b = _posterior(spark, sf_dir).select("p_partkey", F.least(F.floor((top - 1 / 3) / (2 / 3) * 5), F.lit(4)).cast("long").alias("bin"))
    j = table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(b, "p_partkey")
    return X.balanced(j, "p_brand", "bin", "p_partkey", 3)


_LEAVES = (("all", 10.0), ("any", 45.0), ("none", 48.0), ("atleast", 25.0), ("count", None), ("sum", None), ("mean", None), ("min", None), ("max", None))


@query("""SELECT l_orderkey, min(l_quantity) > 10 AS "all", max(l_quantity) > 45 AS "any", max(l_quantity) <= 48 AS "none", count(*) FILTER (l_quantity > 25) >= 2 AS atleast, count(*)::DOUBLE AS count, round(sum(l_quantity), 6) AS sum, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem GROUP BY l_orderkey""")
def collection_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions and aggregates over a record's members."""
    m = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity")).alias("m"))  # the lines of one order
    made = [X.leaf(op, F.col("m"), "l_quantity", value, 2) for op, value in _LEAVES]
    return m.select("l_orderkey", *(F.round(c, 6).alias(op) if op in ("sum", "mean") else c.alias(op) for c, (op, _) in zip(made, _LEAVES, strict=True)))


@query("""WITH q AS (SELECT conv_id, turn, role, (['noul', 'choice', 'score', 'rank'])[(conv_id % 4 + 1)::INT] AS kind, list_transform(range((turn % 4)::INT), lambda i: CASE WHEN conv_id % 5 = 0 THEN 'same' ELSE 'o' || i END) AS options, CASE WHEN turn % 7 = 6 THEN ' ' ELSE text END AS text FROM conversations)
SELECT conv_id, turn, CASE WHEN kind NOT IN ('noul', 'choice', 'score') THEN '422 type' WHEN trim(coalesce(text, '')) = '' THEN '422 question' WHEN kind <> 'noul' AND len(options) < 2 THEN '422 options' WHEN len(options) > 64 OR len(list_distinct(options)) < len(options) THEN '422 options' WHEN coalesce(role NOT IN ('user', 'system'), true) THEN '422 role' END AS problem FROM q""")
def wire_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first wrong field of each wire request."""
    kind = F.element_at(F.array(*map(F.lit, ("noul", "choice", "score", "rank"))), (F.col("conv_id") % 4 + 1).cast("int"))
    n = (F.col("turn") % 4).cast("int")
    name = lambda i: F.when(F.col("conv_id") % 5 == 0, "same").otherwise(F.concat(F.lit("o"), i.cast("string")))
    options = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), name))
    text = F.when(F.col("turn") % 7 == 6, " ").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.wire_problem(F.col("role"), kind, options, text).alias("problem"))


def _packed_sql(mode: str) -> str:
    fits = "cum <= 900" if mode == "truncate" else "s + cum <= 900"
    base = f"WITH r AS (SELECT conv_id, turn, 200 + conv_id % 400 AS s, sum(least(length(coalesce(text, '')), 500)) OVER (PARTITION BY conv_id ORDER BY turn) AS cum FROM conversations), g AS (SELECT conv_id, max(s) AS s, count(*) AS n, count(*) FILTER ({fits}) AS kept, coalesce(max(cum) FILTER ({fits}), 0) AS q FROM r GROUP BY conv_id)"
    if mode == "refuse":
        return base + " SELECT conv_id, CASE WHEN kept = n THEN kept ELSE 0 END AS kept, CASE WHEN kept = n THEN 0 ELSE n END AS dropped, CASE WHEN kept = n THEN s + q ELSE 0 END::BIGINT AS tokens, CASE WHEN kept = n THEN 'ok' ELSE 'refused' END AS verdict FROM g"
    if mode == "truncate":
        return base + " SELECT conv_id, kept, n - kept AS dropped, (least(s, 900 - q) + q)::BIGINT AS tokens, CASE WHEN kept = 0 THEN 'refused' WHEN 900 - q < s THEN 'truncated' WHEN kept = n THEN 'ok' ELSE 'dropped' END AS verdict FROM g"
    return base + " SELECT conv_id, kept, n - kept AS dropped, CASE WHEN kept > 0 THEN s + q ELSE 0 END::BIGINT AS tokens, CASE WHEN kept = 0 THEN 'refused' WHEN kept = n THEN 'ok' ELSE 'dropped' END AS verdict FROM g"


def _pack(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    size = F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(500))
    return X.packed(table(spark, sf_dir, "conversations"), "conv_id", "turn", 200 + F.col("conv_id") % 400, size, 900, mode)


@query(_packed_sql("drop"))
def budget_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing questions that don't fit the budget go."""
    return _pack(spark, sf_dir, "drop")


@query(_packed_sql("truncate"))
def budget_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state gives way to the questions."""
    return _pack(spark, sf_dir, "truncate")


@query(_packed_sql("refuse"))
def budget_refuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An example that doesn't fit is refused whole."""
    return _pack(spark, sf_dir, "refuse")
