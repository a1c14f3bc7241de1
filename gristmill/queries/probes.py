"""Probes of a scorer: insertions, look-ups, options of other tasks, shards and shortlists, criteria and rendered states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import probes
from gristmill.queries._base import dump, dump_sql, query, table


def _mod(key: str, n: str) -> str:
    return f"(('0x' || substr(sha256({key}), 1, 16))::UBIGINT % ({n}))::BIGINT"


_UUID = f"substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || (['8', '9', 'a', 'b'])[1 + {_mod("k || ':v'", '4')}] || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(f"""WITH r AS (SELECT doc_id, text, '0:' || doc_id AS k, sha256('0:' || doc_id) AS h, string_split(text, chr(10) || chr(10)) AS ps FROM documents WHERE NOT regexp_matches(text, '^\\s*[{{\\[]')),
p AS (SELECT *, {_mod("k || ':place'", "len(ps) + 1")} AS place, (['id', 'ref', 'request-id', 'trace id', 'msg-id'])[1 + {_mod("k || ':label'", "5")}] AS label FROM r)
SELECT doc_id, 'text_line' AS kind, sha256(array_to_string(list_concat(ps[1:place], [label || ': ' || {_UUID}], ps[place + 1:]), chr(10) || chr(10))) AS digest FROM p""")
def nonce_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identifier's line in every prose text, under a question that it can't change."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("Is this text kind?").alias("question"))
    return probes.nonce_variants(docs, "doc_id", "text", "question").select("doc_id", "kind", F.sha2("state", 256).alias("digest"))


@query("SELECT event_id, 'json_key' AS kind, json_extract_string(props, '$.k') AS k, len(json_keys(props)) + 1 AS n_keys FROM events")
def nonce_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new identifier in every JSON record: its own values stay, one key is new."""
    rows = table(spark, sf_dir, "events").select("event_id", "props", F.lit("Is this event urgent?").alias("question"))
    made = probes.nonce_variants(rows, "event_id", "props", "question")
    return made.select("event_id", "kind", F.get_json_object("state", "$.k").alias("k"), F.size(F.json_object_keys("state")).cast("long").alias("n_keys"))


@query(f"""WITH {dump_sql()}, {dump_sql(17, "other")}, j AS (SELECT a.id, a.task, list_transform(a.probs, lambda x: ln(x)) AS b, list_transform(o.probs, lambda x: ln(x)) AS c FROM dump a JOIN other o USING (id)),
e AS (SELECT id, task, unnest(b) AS x, unnest(c) AS y, list_position(b, list_max(b)) <> list_position(c, list_max(c)) AS flip FROM j), q AS (SELECT task, avg(abs(x - y)) AS m, max(abs(x - y)) AS w, sum(abs(exp(x) - exp(y))) / 2 AS tv, any_value(flip)::INT AS f FROM e GROUP BY id, task)
SELECT task AS kind, count(*) AS n, round(avg(m), 6) AS mean_abs_dlogp, round(max(w), 6) AS max_abs_dlogp, round(avg(tv), 6) AS mean_tv, round(avg(f), 6) AS flip_rate FROM q GROUP BY ROLLUP (task)""")
def nonce_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = lambda df, name: df.select("id", "task", F.transform("probs", lambda p: F.log(p)).alias(name))
    rows = logs(dump(spark, sf_dir), "base").join(logs(dump(spark, sf_dir, 17), "other").drop("task"), "id")
    out = probes.nonce_summary(rows, "task", "base", "other")
    return out.select("kind", "n", *(F.round(c, 6).alias(c) for c in ("mean_abs_dlogp", "max_abs_dlogp", "mean_tv", "flip_rate")))


_DEALT = "(SELECT list(i ORDER BY sha1(k || ':{0}:' || i), i) FROM (SELECT unnest(range(1, {1})) AS i))[1:n]"


@query(f"""WITH s AS (SELECT n, rep, '0:' || n || ':' || rep AS k FROM (SELECT unnest([2, 4, 8, 16, 32, 64, 128, 256]) AS n) CROSS JOIN (SELECT unnest(range(10)) AS rep)),
d AS (SELECT n, rep, 1 + {_mod("k || ':asked'", "n")} AS asked, {_DEALT.format("name", "1001")} AS names, {_DEALT.format("bin", "greatest(10 * n, 100)")} AS bins, {_DEALT.format("order", "n + 1")} AS o FROM s),
t AS (SELECT *, list_transform(names, lambda i: 'item-' || lpad(i::VARCHAR, 4, '0')) AS items FROM d)
SELECT n::INT AS n, rep, (list_position(o, asked) - 1)::BIGINT AS target, 'Which item is in bin ' || bins[asked] || '?' AS question, array_to_string(list_transform(o, lambda i: items[i]), ',') AS options,
'Items and their bins' || chr(10) || array_to_string(list_transform(range(1, n + 1), lambda i: items[i] || ': bin ' || bins[i]), chr(10)) AS state FROM t""")
def lookup_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.lookups(spark).select("n", "rep", "target", "question", F.array_join("options", ",").alias("options"), "state")


@query(f"""WITH {dump_sql()}, f AS (SELECT * FROM dump WHERE id % 10 <> 0), m AS (SELECT n, count(*) AS n_fit, avg(correct) AS acc, avg(probs[target + 1]) AS pc, avg(confidence) AS mp FROM f GROUP BY n),
b AS (SELECT n, least(floor(confidence * 15), 14) AS bin, count(*) AS c, avg(confidence) AS conf, avg(correct) AS acc FROM f GROUP BY ALL), e AS (SELECT n, sum(c * abs(conf - acc)) / sum(c) AS ece FROM b GROUP BY n)
SELECT n, count(*) AS n_generated, round(1 / n, 6) AS chance, any_value(n_fit) AS n_fit, round(any_value(m.acc), 6) AS acc, round(any_value(ece), 6) AS ece, round(any_value(pc), 6) AS mean_p_correct, round(any_value(mp), 6) AS mean_maxp FROM dump JOIN m USING (n) JOIN e USING (n) GROUP BY n""")
def lookup_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = probes.lookup_summary(dump(spark, sf_dir).withColumn("fits", F.col("id") % 10 != 0))
    return out.select("n", "n_generated", "n_fit", *(F.round(c, 6).alias(c) for c in ("chance", "acc", "ece", "mean_p_correct", "mean_maxp")))


@query(f"""WITH {dump_sql()}, f AS (SELECT p_brand AS option FROM part UNION ALL SELECT unnest(['O0', 'o1', 'O2'])), g AS (SELECT lower(option) AS low, min(option) AS option FROM f GROUP BY low),
pool AS (SELECT *, row_number() OVER (ORDER BY {_mod("low", "1024")}, sha256(low), low) - 1 AS number, count(*) OVER () AS size FROM g WHERE option <> 'O0' AND option <> 'O2'),
q AS (SELECT id, n, target, id % 3 AS cut, (id // 3) % 4 AS extra, (SELECT max(size) FROM pool) AS size FROM dump),
w AS (SELECT id, n, target, greatest(least(cut, n - 2, n - 3), 0) AS cut, extra, size, {_mod("'0:' || id || ':fill'", "size")} AS start FROM q),
st AS (SELECT *, unnest(range(least(size, n + extra)::BIGINT)) AS step FROM w WHERE n >= 3 AND extra > 0),
met AS (SELECT st.id, option, row_number() OVER (PARTITION BY st.id ORDER BY step) AS r, count(*) OVER (PARTITION BY st.id) AS c, extra FROM st JOIN pool ON number = (start + step) % st.size WHERE NOT list_contains(list_transform(range(n), lambda i: 'o' || i), low)),
own AS (SELECT id, n, target, cut, unnest(range(n)) AS i FROM w), ranked AS (SELECT *, row_number() OVER (PARTITION BY id, i = target ORDER BY sha1('0:0:' || id || ':drop:' || i)) AS r FROM own),
al AS (SELECT id, 'o' || i AS option, i = target AS gold FROM ranked WHERE i = target OR n < 3 OR r > cut UNION ALL SELECT id, option, false FROM met WHERE r <= extra AND c >= extra),
ch AS (SELECT w.id, n >= 3 AND (cut > 0 OR coalesce(m.c, 0) > 0) AS changed FROM w LEFT JOIN (SELECT id, count(*) AS c FROM met WHERE c >= extra GROUP BY id) m ON m.id = w.id),
z AS (SELECT al.id, option, gold, row_number() OVER (PARTITION BY al.id ORDER BY CASE WHEN changed THEN sha1('0:0:' || al.id || ':order:' || option) ELSE option END) - 1 AS spot FROM al JOIN ch ON ch.id = al.id)
SELECT id, string_agg(option, ',' ORDER BY spot) AS options, max(spot) FILTER (gold) AS target FROM z GROUP BY id""")
def churn_with_fillers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two wrong options less and three others more; own ones under another case don't come back."""
    i = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    rows = dump(spark, sf_dir).select("id", F.transform(i, lambda x: F.concat(F.lit("o"), x.cast("string"))).alias("options"), F.col("onehot").alias("probs"), (F.col("id") % 3).alias("drop"), (F.floor(F.col("id") / 3) % 4).alias("add"))
    own = spark.createDataFrame([("O0",), ("o1",), ("O2",)], "option string")
    out = probes.churned(rows, "id", table(spark, sf_dir, "part").select(F.col("p_brand").alias("option")).union(own))
    return out.select("id", F.array_join("options", ",").alias("options"), (F.array_position("probs", F.lit(1.0)) - 1).cast("long").alias("target"))


@query(f"WITH {dump_sql()}, e AS (SELECT id, unnest(range(n)) AS spot, unnest(probs) AS p FROM dump) SELECT id, spot, round(p, 6) AS p FROM e")
def sharded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of options scored shard by shard are those of all at once."""
    lengths = F.transform("logits", lambda v, i: (5 + (F.col("id") + 7 * i) % 11).cast("int"))
    rows = dump(spark, sf_dir).select("id", "logits", probes.shards(lengths, F.lit(8), 30).alias("shards"))
    each = rows.select("id", F.posexplode(F.arrays_zip("logits", "shards")).alias("spot", "x")).select("id", F.col("spot").cast("long").alias("spot"), F.col("x.logits").alias("logit"), F.col("x.shards").alias("shard"))
    return probes.over_shards(each, "id", "shard", "logit").select("id", "spot", F.round("p", 6).alias("p"))


@query(f"""WITH {dump_sql()}, e AS (SELECT id, unnest(range(n)) AS spot, unnest(logits) AS s FROM dump), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, spot) <= 2 AS best, s + 0.5 * spot AS m FROM e),
h AS (SELECT id, ln(sum(exp(m)) FILTER (best)) - ln(sum(exp(s)) FILTER (best)) AS shift FROM r GROUP BY id) SELECT id, spot, round(CASE WHEN best THEN m - shift ELSE s END, 6) AS logit FROM r JOIN h USING (id)""")
def shortlist_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = F.transform("logits", lambda v, i: 0.5 * i)
    mixed = dump(spark, sf_dir).select("id", F.posexplode(probes.shortlist_mix(F.col("logits"), deltas, 2)).alias("spot", "logit"))
    return mixed.select("id", F.col("spot").cast("long").alias("spot"), F.round("logit", 6).alias("logit"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed ' || o_orderpriority || '|' ELSE 'any ' || o_orderpriority || '|' END AS criteria FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderstatus = 'P'""")
def criteria_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published texts of options: the longest prefix of a task that has any counts, options without one have null."""
    orders = table(spark, sf_dir, "orders")
    task = F.when(F.col("o_orderstatus") == "P", "other_task").otherwise(F.concat(F.lit("orders_"), F.col("o_orderstatus"), F.lit("_x")))
    rows = orders.select("o_orderkey", task.alias("task"), F.array("o_orderpriority", F.lit("none")).alias("options"))
    known = orders.select(F.col("o_orderpriority").alias("option")).distinct()
    criteria = known.select(F.lit("orders_").alias("task_prefix"), "option", F.concat(F.lit("any "), F.col("option")).alias("text")).union(known.select(F.lit("orders_F_"), "option", F.concat(F.lit("closed "), F.col("option"))))
    out = probes.criteria_for(rows, "o_orderkey", "task", "options", criteria)
    return out.select("o_orderkey", F.array_join("criteria", "|", "").alias("criteria"))


@query("""SELECT event_id, '{' || chr(10) || '  "k": ' || json_extract(props, '$.k')::VARCHAR || chr(10) || '}' AS state FROM events""")
def rendered_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", probes.render_state("props").alias("state"))
