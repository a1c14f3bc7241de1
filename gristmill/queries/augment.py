"""Sentinel options, augmentation and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import arrays, hashing
from gristmill.operators import audit, sentinel
from gristmill.operators import augment as A
from gristmill.queries._base import EXAMPLES, dump, dump_sql, examples, query, table


def _slot(words: tuple[str, ...], name: str) -> str:
    return f"(SELECT unnest([{', '.join(repr(w) for w in words)}]) AS {name})"


def _frame(i: int, frame: tuple) -> str:
    parts, slots = [], []
    for k, p in enumerate(frame):
        if isinstance(p, str):
            parts.append(repr(p))
        else:
            parts.append(f"s{k}")
            slots.append(_slot(p, f"s{k}"))
    return f"SELECT {' || '.join(parts)} AS description FROM {', '.join(slots)}"


_GRAMMAR = "g AS (" + " UNION ".join(_frame(i, f) for i, f in enumerate(sentinel.FRAMES)) + "), w AS (SELECT description, CASE WHEN ('0x' || substr(sha256(trim(description)), 1, 16))::UBIGINT % 1000 < 200 THEN 'eval' ELSE 'train' END AS split FROM g)"


@query(f"WITH {_GRAMMAR} SELECT description, split FROM w")
def sentinel_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentinel.wordings(spark)


@query(f"WITH {_GRAMMAR} SELECT split, count(*) AS wordings FROM w GROUP BY split")
def sentinel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentinel.wordings(spark).groupBy("split").agg(F.count(F.lit(1)).alias("wordings"))


_OPTIONS = "list_transform(range(n), lambda i: 'o' || i)"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.concat(F.lit("o"), i.cast("string")))
    return dump(spark, sf_dir).withColumn("options", options)


@query(f"WITH {dump_sql()}, q AS (SELECT *, {_OPTIONS} AS options FROM dump) SELECT id, array_to_string(list_transform(range(n), lambda i: 'opt_' || i), ',') AS keys FROM q")
def opaque_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("id", F.array_join(sentinel.opaque_keys(F.col("options")), ",").alias("keys"))


@query(f"WITH {dump_sql()}, q AS (SELECT *, {_OPTIONS} AS options, list_position(probs, list_max(probs)) - 1 AS best FROM dump) SELECT id, len(options) >= 3 AND list_max(probs) >= 0.9 AS eligible, array_to_string(list_concat(list_filter(options, lambda o: o <> 'o' || best), ['none']), ',') AS options FROM q")
def withhold(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir)
    return q.select("id", sentinel.eligible(F.col("probs"), F.col("options")).alias("eligible"), F.array_join(sentinel.withhold(F.col("options"), F.col("probs"), F.lit("none")), ",").alias("options"))


@query(f"""WITH {dump_sql()}, q AS (SELECT *, {_OPTIONS} AS options, (list_position(probs, list_max(probs)) - 1 + 1 + id % (n - 1)) % n AS dropped FROM dump), k AS (SELECT id, options, dropped, list_filter(list_zip(options, probs), lambda x: x[1] <> 'o' || dropped) AS z FROM q)
SELECT id, array_to_string(list_concat(list_transform(z, lambda x: x[1]), ['none']), ',') AS options, round(list_max(list_transform(z, lambda x: x[2])) / list_sum(list_transform(z, lambda x: x[2])), 6) AS top FROM k""")
def decoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir)
    drop = (arrays.argmax(F.col("probs")) + 1 + F.col("id") % (F.col("n") - 1)) % F.col("n")
    options, probs = sentinel.decoy(F.col("options"), F.col("probs"), F.col("dropped"), F.lit("none"))
    return q.withColumn("dropped", drop).select("id", F.array_join(options, ",").alias("options"), F.round(F.array_max(probs), 6).alias("top"))


@query("""WITH q AS (SELECT doc_id, ['yes', 'no', 'maybe', 'other'] AS o FROM documents), x AS (SELECT doc_id, unnest(o) AS o FROM q), r AS (SELECT doc_id, o, row_number() OVER (PARTITION BY doc_id ORDER BY sha1('9:' || doc_id || ':' || o), o) AS r FROM x) SELECT doc_id, string_agg(o, ',' ORDER BY r) AS options, (max(r) FILTER (o = 'yes') - 1)::BIGINT AS target FROM r GROUP BY doc_id""")
def shuffle_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options in digest order, the target following them; no rows are moved."""
    options = F.array(*map(F.lit, ("yes", "no", "maybe", "other")))
    dealt = F.array_sort(F.transform(options, lambda o: F.struct(hashing.hash_order(9, F.col("doc_id").cast("string"), o).alias("h"), o.alias("o"))))
    order = F.transform(dealt, lambda s: s["o"])
    return table(spark, sf_dir, "documents").select("doc_id", order.alias("o")).select("doc_id", F.array_join("o", ",").alias("options"), (F.array_position("o", F.lit("yes")) - 1).cast("long").alias("target"))


_CHECK = "CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE state END AS state, CASE WHEN doc_id % 13 = 0 THEN 'Is {slot} good?' ELSE 'Good?' END AS question, CASE WHEN doc_id % 17 = 0 THEN ['no', ' No'] ELSE ['no', 'yes'] END AS options, CASE WHEN doc_id % 19 = 0 THEN 5 ELSE target END AS target, CASE WHEN doc_id % 23 = 0 THEN [0.5, 0.4] ELSE [0.25, 0.75] END AS probs"


@query(f"""WITH {EXAMPLES}, c AS (SELECT {_CHECK} FROM examples) SELECT 'empty_state' AS rule, count(*) FILTER (trim(state) = '') AS n FROM c UNION ALL SELECT 'empty_question', count(*) FILTER (trim(question) = '') FROM c UNION ALL SELECT 'duplicate_options', count(*) FILTER (lower(trim(options[1])) = lower(trim(options[2]))) FROM c
UNION ALL SELECT 'target_range', count(*) FILTER (target NOT BETWEEN 0 AND 1) FROM c UNION ALL SELECT 'soft_length', count(*) FILTER (len(probs) <> 2) FROM c UNION ALL SELECT 'soft_sum', count(*) FILTER (abs(probs[1] + probs[2] - 1) > 1e-3) FROM c UNION ALL SELECT 'unfilled_slot', count(*) FILTER (regexp_matches(question, '\\{{[a-z_]+\\}}')) FROM c""")
def integrity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of broken rules over examples with planted faults."""
    d = F.col("doc_id")
    rows = examples(spark, sf_dir).select(
        F.when(d % 11 == 0, " ").otherwise(F.col("state")).alias("state"), F.when(d % 13 == 0, "Is {slot} good?").otherwise("Good?").alias("question"),
        F.when(d % 17 == 0, F.array(F.lit("no"), F.lit(" No"))).otherwise(F.array(F.lit("no"), F.lit("yes"))).alias("options"),
        F.when(d % 19 == 0, 5).otherwise(F.col("target")).alias("target"), F.when(d % 23 == 0, F.array(F.lit(0.5), F.lit(0.4))).otherwise(F.array(F.lit(0.25), F.lit(0.75))).alias("probs"),
    )
    return audit.counts(rows, audit.violations(*(F.col(c) for c in ("state", "question", "options", "target", "probs"))))


@query("""WITH s AS (SELECT sha256(text) AS state, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM documents) SELECT state, count(DISTINCT split) AS splits FROM s GROUP BY state HAVING count(DISTINCT split) > 1""")
def cross_split_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("split"))
    return audit.cross_split(docs, "split", "text")


@query(f"""WITH {dump_sql()}, s AS (SELECT id, n, id % 3 = 0 AS present, target = n - 1 AS last, correct FROM dump), a AS (SELECT n, count(*) AS questions, round(avg(CASE WHEN present THEN 1.0 ELSE 0.0 END), 6) AS share, round(avg(CASE WHEN present THEN correct END), 6) AS p_correct, round(avg(CASE WHEN last THEN 1.0 ELSE 0.0 END), 6) AS last_share FROM s GROUP BY n) SELECT n AS arity, questions, share, p_correct, last_share, share <= 0.34 AND p_correct <= 0.20 AND last_share <= 0.35 AS accepted FROM a""")
def sentinel_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dump(spark, sf_dir).select("n", (F.col("id") % 3 == 0).alias("present"), (F.col("target") == F.col("n") - 1).alias("last"), "correct")
    a = s.groupBy(F.col("n").alias("arity")).agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.col("present").cast("double")), 6).alias("share"), F.round(F.avg(F.when(F.col("present"), F.col("correct"))), 6).alias("p_correct"), F.round(F.avg(F.col("last").cast("double")), 6).alias("last_share"))
    return a.withColumn("accepted", (F.col("share") <= 0.34) & (F.col("p_correct") <= 0.20) & (F.col("last_share") <= 0.35))


@query()
def wording_predicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled nulls; a test plants a wording that predicts and one that doesn't."""
    rows = table(spark, sf_dir, "orders").select(F.lit("orders").alias("task"), F.col("o_orderpriority").alias("wording"), F.col("o_orderstatus").alias("target"), "o_orderkey")
    return audit.wording_gain(rows, "task", "wording", "target").select("task", "n", F.round("gain", 6).alias("gain"), F.round("null", 6).alias("null"))


@query("""SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS paths FROM events""")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.flatten_json(table(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "paths")


_DRAW = "('0x' || substr(sha256('0:0:' || id || ':{0}'), 1, 16))::UBIGINT % 1000000 / 1000000.0"


@query(f"""WITH {dump_sql()}, q AS (SELECT id, n >= 3 AND list_max(probs) >= 0.9 AND id % 9 <> 0 AS fits, id % 9 = 0 AS ordered, id % 2 = 0 AS described, {_DRAW.format("change")} AS u, {_DRAW.format("churn")} AS c, {_DRAW.format("decoy")} AS d FROM dump),
x AS (SELECT *, CASE WHEN u < 0.06 THEN CASE WHEN fits THEN 'withheld' ELSE 'none' END WHEN u < 0.36 THEN CASE WHEN described THEN 'opaque' ELSE 'none' END WHEN u < 0.46 THEN CASE WHEN described AND NOT ordered THEN 'strip' ELSE 'none' END ELSE 'none' END AS change FROM q)
SELECT id, c < 0.45 AND NOT ordered AS churn, change, fits AND change <> 'withheld' AND d < 0.36 AS decoy FROM x""")
def augment_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir).withColumns({"ordered": F.col("id") % 9 == 0, "described": F.col("id") % 2 == 0})
    return A.policy(q, "id").select("id", "churn", "change", "decoy")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = audit.flatten_json(table(spark, sf_dir, "events").select("event_id", "props"), "props")
    return audit.unflatten_json(flat, "paths").select("event_id", F.get_json_object("json", "$.k").alias("k"))
