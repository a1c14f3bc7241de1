"""Schema inference over raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import profile as P
from gristmill.queries._base import EXAMPLES, examples, query, table

_PROFILE = "p AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, count(DISTINCT {c}::VARCHAR) AS d, avg(length({c}::VARCHAR)) AS m, max(length({c}::VARCHAR))::BIGINT AS longest FROM customer" for c in ("c_name", "c_nationkey", "c_mktsegment")) + ")"


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.columns(table(spark, sf_dir, "customer"), ["c_name", "c_nationkey", "c_mktsegment"])


@query(f"WITH {_PROFILE} SELECT name, n, d AS distinct_values, round(m, 6) AS mean_length FROM p WHERE d > 0.5 * n OR m >= 80")
def text_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.text_columns(_customer(spark, sf_dir)).select("name", "n", F.col("distinct").alias("distinct_values"), F.round("mean_length", 6).alias("mean_length"))


@query(f"WITH {_PROFILE} SELECT name, n, d AS distinct_values, longest FROM p WHERE d BETWEEN 2 AND 255 AND d <= 0.5 * n AND longest <= 80 AND NOT regexp_matches(name, '(^|_)(id|key|uuid|index|idx)$|key$')")
def label_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.label_columns(_customer(spark, sf_dir)).select("name", "n", F.col("distinct").alias("distinct_values"), "longest")


@query("""WITH u AS (SELECT l_orderkey, unnest(list_distinct(list(l_returnflag))) AS label FROM lineitem GROUP BY 1), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem)
SELECT label, count(*) AS yes, round(count(*) / any_value(n), 6) AS share, count(*) / any_value(n) BETWEEN 0.05 AND 0.95 AS balanced FROM u, n GROUP BY label""")
def multilabel_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list-valued column as one yes-or-no task a label, with its balance."""
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("labels"))
    n = lists.count()
    u = lists.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("yes"))
    return u.select("label", "yes", F.round(F.col("yes") / n, 6).alias("share"), (F.col("yes") / n).between(0.05, 0.95).alias("balanced"))


@query("""SELECT 'n_nationkey' AS "left", 'n_name' AS "right", count(DISTINCT n_nationkey) = count(DISTINCT (n_nationkey, n_name)) AND count(DISTINCT n_name) = count(DISTINCT (n_nationkey, n_name)) AS same FROM nation
UNION ALL SELECT 'n_name', 'n_regionkey', count(DISTINCT n_name) = count(DISTINCT (n_name, n_regionkey)) AND count(DISTINCT n_regionkey) = count(DISTINCT (n_name, n_regionkey)) FROM nation""")
def fd_duplicate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.same_columns(table(spark, sf_dir, "nation"), [("n_nationkey", "n_name"), ("n_name", "n_regionkey")])


@query("""WITH o AS (SELECT p_brand, list_sort(list_distinct(list(p_size))) AS s FROM part GROUP BY 1) SELECT p_brand, len(s) >= 3 AND list_max(s) - list_min(s) = len(s) - 1 AS ordinal FROM o""")
def ordinal_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("string")).alias("s"))
    return o.select("p_brand", text.is_ordinal(F.col("s")).alias("ordinal"))


@query("""WITH g AS (SELECT p_type AS s, count(DISTINCT p_brand) AS labels FROM part GROUP BY 1) SELECT count(*) AS texts, count(*) FILTER (labels > 1) AS conflicting, count(*) FILTER (labels > 1) >= 3 AND count(*) FILTER (labels > 1) >= 0.2 * count(*) AS rejected FROM g""")
def column_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rejected_columns(table(spark, sf_dir, "part"), "p_type", "p_brand")


@query("""WITH o AS (SELECT p_brand, unnest(list_distinct(list(p_type))) AS o FROM part WHERE p_size <= 20 GROUP BY 1 UNION ALL SELECT p_brand || 'n', unnest(list_distinct(list(p_size::VARCHAR))) FROM part GROUP BY 1)
SELECT p_brand AS task, count(*) AS options, round(avg(CASE WHEN regexp_matches(o, '^([0-9]+(\\.[0-9]+)?|[0-9a-f]{6,}|[0-9]{1,3}(\\.[0-9]{1,3}){3})$') THEN 1.0 ELSE 0.0 END), 6) AS opaque FROM o GROUP BY 1""")
def opaque_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    named = part.where("p_size <= 20").groupBy(F.col("p_brand").alias("task")).agg(F.collect_set("p_type").alias("o"))
    numbers = part.groupBy(F.concat("p_brand", F.lit("n")).alias("task")).agg(F.collect_set(F.col("p_size").cast("string")).alias("o"))
    return named.unionAll(numbers).select("task", F.size("o").cast("long").alias("options"), F.round(P.opaque_share("o"), 6).alias("opaque"))


@query(f"""WITH {EXAMPLES} SELECT task, count(*) AS n, CASE WHEN count(*) >= 8 AND count(DISTINCT target) <= 1 THEN 'constant' WHEN avg(CASE WHEN regexp_matches(trim(state), '^(https?://\\S+|[0-9a-fA-F]{{16,}}|[0-9.:]+)$') THEN 1.0 ELSE 0.0 END) >= 0.8 THEN 'opaque' WHEN count(DISTINCT state) <= 0.5 * count(*) AND median(length(state)) < 20 THEN 'repeated' END AS reason FROM examples GROUP BY task""")
def answerability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.unanswerable(examples(spark, sf_dir), "task", "state", "target")


@query("""SELECT event_id, CASE WHEN n = 2 THEN 'bool' WHEN n <= 5 THEN 'enum3-5' WHEN n <= 20 THEN 'enum6-20' ELSE 'enum>20' END AS shape FROM (SELECT event_id, event_id % 30 + 2 AS n FROM events)""")
def question_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 30 + 2
    return table(spark, sf_dir, "events").select("event_id", F.when(n == 2, "bool").when(n <= 5, "enum3-5").when(n <= 20, "enum6-20").otherwise("enum>20").alias("shape"))


@query(f"""WITH {EXAMPLES}, b AS (SELECT task FROM examples GROUP BY task HAVING count(*) >= 8 AND count(DISTINCT target) <= 1) SELECT doc_id, task FROM examples WHERE task NOT IN (SELECT task FROM b)""")
def keep_answerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.keep_answerable(examples(spark, sf_dir), "task", "state", "target").select("doc_id", "task")


@query("""SELECT event_id, event_type <> 'view' AND event_type NOT IN ('', 'nan', 'null') AND value = value AS keep FROM events""")
def keep_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing tokens, NaN and a drop pattern."""
    v = F.lower(F.trim("event_type"))
    return table(spark, sf_dir, "events").select("event_id", (~v.isin("", "nan", "null") & ~F.regexp_like("event_type", F.lit("^view$")) & ~F.isnan("value")).alias("keep"))
