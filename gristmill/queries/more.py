"""Parsing, outlines, enrichment, batching and further probability operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import arrays, hashing
from gristmill.queries._base import dump, dump_sql, query, table


@query("""WITH l AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || upper(event_type) || '] user_' || user_id || ': value ' || round(value, 2) AS line FROM events)
SELECT event_id, regexp_extract(line, '\\[([A-Z]+)\\]', 1) AS level, regexp_extract(line, '\\] ([a-z_0-9]+):', 1) AS component, strpos(line, '[')::BIGINT AS level_at FROM l""")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, component and place of the level in log lines."""
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.upper("event_type"), F.lit("] user_"), F.col("user_id").cast("string"), F.lit(": value "), F.round("value", 2).cast("string"))
    x = table(spark, sf_dir, "events").select("event_id", line.alias("line"))
    return x.select("event_id", F.regexp_extract("line", r"\[([A-Z]+)\]", 1).alias("level"), F.regexp_extract("line", r"\] ([a-z_0-9]+):", 1).alias("component"), F.instr("line", "[").cast("long").alias("level_at"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?]\\s+')) AS s, generate_subscripts(string_split_regex(text, '[.!?]\\s+'), 1) AS i FROM documents) SELECT d.doc_id, sha256(coalesce(string_agg(s, ' ' ORDER BY i) FILTER (NOT regexp_matches(s, '(?i)licen[cs]e|password|@')), '')) AS state FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id""")
def strip_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that match a leak pattern go."""
    kept = F.filter(F.split("text", r"[.!?]\s+"), lambda s: ~F.regexp_like(s, F.lit("(?i)licen[cs]e|password|@")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(kept, " "), 256).alias("state"))


@query("""WITH a AS (SELECT lower(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS alias, p_name, count(*) AS used FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY used DESC, p_name) AS r FROM a) SELECT alias, p_name AS spelling, used FROM r WHERE r = 1""")
def canonical_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most used spelling of each alias, then the first by name."""
    a = table(spark, sf_dir, "part").groupBy(F.lower(F.regexp_replace("p_name", "[^A-Za-z]", "")).alias("alias"), "p_name").agg(F.count(F.lit(1)).alias("used"))
    best = F.row_number().over(Window.partitionBy("alias").orderBy(F.desc("used"), "p_name"))
    return a.withColumn("r", best).where("r = 1").select("alias", F.col("p_name").alias("spelling"), "used")


@query("""WITH o AS (SELECT p_brand AS doc, p_partkey AS pos, p_size % 3 + 1 AS level FROM part), l AS (SELECT *, max(pos) FILTER (level = 1) OVER w AS last1, max(pos) FILTER (level = 2) OVER w AS last2 FROM o WINDOW w AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT doc, pos, CASE level WHEN 2 THEN last1 WHEN 3 THEN greatest(last1, last2) END AS parent FROM l""")
def outline_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last earlier entry of a smaller level."""
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    o = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("pos"), (F.col("p_size") % 3 + 1).alias("level"))
    last = lambda k: F.max(F.when(F.col("level") == k, F.col("pos"))).over(w)
    made = o.withColumns({"one": last(1), "two": last(2)})
    return made.select("doc", "pos", F.when(F.col("level") == 2, F.col("one")).when(F.col("level") == 3, F.greatest("one", "two")).alias("parent"))


@query("""WITH q AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'published ' || n_name END AS own FROM nation), c AS (SELECT n_nationkey, 'cached ' || n_name AS fresh FROM nation WHERE n_nationkey % 2 = 0) SELECT n_nationkey, coalesce(nullif(own, ''), fresh) AS description FROM q LEFT JOIN c USING (n_nationkey)""")
def enrichment_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published descriptions win over cached ones; empty counts as missing."""
    n = table(spark, sf_dir, "nation")
    own = n.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("published "), "n_name")).alias("own"))
    cache = n.where("n_nationkey % 2 = 0").select("n_nationkey", F.concat(F.lit("cached "), "n_name").alias("fresh"))
    return own.join(cache, "n_nationkey", "left").select("n_nationkey", F.coalesce(F.nullif("own", F.lit("")), "fresh").alias("description"))


@query("""SELECT p_partkey, round(CASE WHEN red < k THEN 0 ELSE pow(red / 20.0, k) END, 6) AS replaced, round(CASE WHEN red < k THEN 0 WHEN k = 0 THEN 1 WHEN k = 1 THEN red / 20.0 WHEN k = 2 THEN red / 20.0 * (red - 1) / 19.0 ELSE red / 20.0 * (red - 1) / 19.0 * (red - 2) / 18.0 END, 6) AS kept FROM (SELECT p_partkey, p_size % 20 AS red, p_partkey % 4 AS k FROM part)""")
def urn_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of k red draws in a row from an urn of twenty, with and without putting back."""
    x = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 20).alias("red"), (F.col("p_partkey") % 4).cast("int").alias("k"))
    draws = F.when(F.col("k") > 0, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.aggregate(draws, F.lit(1.0), lambda a, i: a * F.greatest(F.col("red") - i, F.lit(0)) / (20.0 - i))
    none = F.col("red") < F.col("k")
    return x.select("p_partkey", F.round(F.when(none, 0.0).otherwise(F.pow(F.col("red") / 20.0, "k")), 6).alias("replaced"), F.round(F.when(none, 0.0).otherwise(kept), 6).alias("kept"))


_D = f"{dump_sql()}, {dump_sql(17, 'other')}"


@query(f"""WITH {_D}, j AS (SELECT a.id, a.n, a.probs AS p, b.probs AS q FROM dump a JOIN other b USING (id)), c AS (SELECT id, n, list_sum(list_transform(range(1, n + 1), lambda i: list_sum(list_transform(range(1, n + 1), lambda k: CASE WHEN i < k AND (p[i] - p[k]) * (q[i] - q[k]) < 0 THEN 1 ELSE 0 END)))) AS d FROM j) SELECT id, d::BIGINT AS discordant FROM c""")
def order_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of options that two dumps order differently."""
    j = dump(spark, sf_dir).select("id", "n", F.col("probs").alias("p")).join(dump(spark, sf_dir, 17).select("id", F.col("probs").alias("q")), "id")
    at = lambda c, i: F.element_at(c, i.cast("int"))
    index = F.sequence(F.lit(1).cast("long"), F.col("n"))
    pairs = F.flatten(F.transform(index, lambda i: F.transform(index, lambda k: F.when((i < k) & ((at("p", i) - at("p", k)) * (at("q", i) - at("q", k)) < 0), 1).otherwise(0))))
    return j.select("id", F.aggregate(pairs, F.lit(0), lambda a, b: a + b).cast("long").alias("discordant"))


@query(f"""WITH {_D}, m AS (SELECT a.id, a.n, list_transform(range(1, a.n + 1), lambda i: (a.probs[i] + b.probs[i]) / 2) AS p FROM dump a JOIN other b USING (id)) SELECT id, round(ln(list_max(p)), 6) AS log_top, round(pow(n / 2, 0.3) * 1.5, 6) AS temperature FROM m""")
def ensemble_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of the mean probability over two heads, and the temperature that grows with the number of options."""
    j = dump(spark, sf_dir).select("id", "n", F.col("probs").alias("p")).join(dump(spark, sf_dir, 17).select("id", F.col("probs").alias("q")), "id")
    mean = F.zip_with("p", "q", lambda a, b: (a + b) / 2)
    return j.select("id", F.round(F.log(F.array_max(mean)), 6).alias("log_top"), F.round(1.5 * F.pow(F.col("n") / 2, F.lit(0.3)), 6).alias("temperature"))


@query(f"""WITH {_D}, j AS (SELECT unnest(a.probs) AS p, unnest(b.probs) AS q FROM dump a JOIN other b USING (id)), g AS (SELECT avg((list_position(a.probs, list_max(a.probs)) <> list_position(b.probs, list_max(b.probs)))::INT) AS d FROM dump a JOIN other b USING (id)) SELECT round(corr(p, q), 6) AS correlation, round(any_value(d), 6) AS disagreement FROM j, g""")
def head_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of two heads' probabilities and how often their best options differ; one row."""
    j = dump(spark, sf_dir).select("id", F.col("probs").alias("p")).join(dump(spark, sf_dir, 17).select("id", F.col("probs").alias("q")), "id")
    flat = j.select("id", (arrays.argmax(F.col("p")) != arrays.argmax(F.col("q"))).cast("double").alias("d"), F.posexplode(F.arrays_zip("p", "q")).alias("i", "x"))
    first = F.avg(F.when(F.col("i") == 0, F.col("d")))
    return flat.agg(F.round(F.corr("x.p", "x.q"), 6).alias("correlation"), F.round(first, 6).alias("disagreement"))


@query("""SELECT o_orderkey, coalesce(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%d/%m/%Y'), try_strptime(t, '%d %b %Y'))::DATE AS day FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%d %b %Y') ELSE 'soon' END AS t FROM orders)""")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in several styles, day first; null where none fits."""
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    t = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "dd MMM yyyy")).otherwise("soon")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", t.alias("t"))
    return rows.select("o_orderkey", F.coalesce(*(F.try_to_timestamp("t", F.lit(f)) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd MMM yyyy"))).cast("date").alias("day"))


@query("""WITH b AS (SELECT date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS z FROM events), h AS (SELECT unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS h FROM b) SELECT strftime(h, '%Y-%m-%d-') || hour(h) AS key, count(e.event_id) AS events FROM h LEFT JOIN events e ON date_trunc('hour', e.ts) = h GROUP BY 1""")
def hourly_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly keys without a leading zero, from the first event's hour to the last one's, with the events of each."""
    n = table(spark, sf_dir, "events").where("ts is not null").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    h = n.agg(F.min("h").alias("a"), F.max("h").alias("z")).select(F.explode(F.expr("sequence(a, z, interval 1 hour)")).alias("h"))
    return h.join(n, "h", "left").select(F.concat(F.date_format("h", "yyyy-MM-dd-"), F.hour("h").cast("string")).alias("key"), F.coalesce("n", F.lit(0).cast("long")).alias("events"))


@query("""SELECT event_id, json_extract_string(nullif(regexp_extract(a, '\\{.*\\}'), ''), '$.k') AS k FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Sure: ```json' || chr(10) || props || '``` done' WHEN 1 THEN props ELSE 'no answer' END AS a FROM events)""")
def answer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object between the first and the last brace of an answer; null without one."""
    k = F.col("event_id") % 3
    a = F.when(k == 0, F.concat(F.lit("Sure: ```json\n"), "props", F.lit("``` done"))).when(k == 1, F.col("props")).otherwise("no answer")
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(F.regexp_extract(a, r"(?s)\{.*\}", 0), "$.k").alias("k"))


@query("""WITH p AS (SELECT p_partkey, 'opt' || (p_partkey + unnest([1, 2, 3, 5, 8])) % 12 AS o FROM part), r AS (SELECT p_partkey, o, row_number() OVER (PARTITION BY p_partkey ORDER BY sha1('8:' || p_partkey || ':' || o), o) AS r FROM p) SELECT p_partkey, string_agg(o, ',' ORDER BY r) FILTER (r <= 3) AS kept FROM r GROUP BY p_partkey""")
def churn_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong options thinned to three, the lowest by digest, in that order."""
    options = F.transform(F.array(*map(F.lit, (1, 2, 3, 5, 8))), lambda i: F.concat(F.lit("opt"), ((F.col("p_partkey") + i) % 12).cast("string")))
    dealt = F.array_sort(F.transform(options, lambda o: F.struct(hashing.hash_order(8, F.col("p_partkey").cast("string"), o).alias("h"), o.alias("o"))))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(F.slice(dealt, 1, 3), lambda s: s["o"]), ",").alias("kept"))


@query("""SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1998-12-31') >= 365 * 3 AS old, round(o_totalprice * 1.1, 2) > 100000 AS converted, o_totalprice > 2 * o_custkey AS relative, len(list_filter([o_orderstatus = 'F', o_orderpriority LIKE '1%', o_totalprice > 150000], lambda x: x)) >= 2 AS count_at_least FROM orders""")
def record_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age in days, converted units, field against field, and at least two of three."""
    parts = F.array(F.col("o_orderstatus") == "F", F.col("o_orderpriority").like("1%"), F.col("o_totalprice") > 150000)
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.datediff(F.lit("1998-12-31").cast("date"), F.col("o_orderdate").cast("date")) >= 365 * 3).alias("old"), (F.round(F.col("o_totalprice") * 1.1, 2) > 100000).alias("converted"), (F.col("o_totalprice") > 2 * F.col("o_custkey")).alias("relative"), (F.size(F.filter(parts, lambda x: x)) >= 2).alias("count_at_least"))


@query()
def epoch_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of documents in digest order, each sorted by length and cut into batches of a token budget.

    A window is a hash bucket of bounded expected size, so windows are formed without a global sort; a test checks the budget.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("tokens"))
    windows = max(1, docs.count() // 256)
    dealt = docs.withColumn("window", hashing.digest_mod(F.col("doc_id").cast("string"), windows))

    def batches(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["tokens", "doc_id"])
        batch, widest, n, out = 0, 0, 0, []
        for t in own["tokens"]:
            widest, n = max(widest, t), n + 1
            if n > 1 and widest * n > 98_304:
                batch, widest, n = batch + 1, t, 1
            out.append(batch)
        return own.assign(batch=out)[["window", "batch", "doc_id", "tokens"]]

    return dealt.groupBy("window").applyInPandas(batches, "window long, batch long, doc_id long, tokens long")


@query("""SELECT conv_id, count(*) AS rows, sum(CASE WHEN cum <= 2000 THEN 1 ELSE 0 END)::BIGINT AS packed FROM (SELECT conv_id, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS cum FROM conversations) GROUP BY conv_id""")
def budget_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing questions over a budget are dropped: a running sum by position."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", F.sum(F.length(F.coalesce("text", F.lit("")))).over(w).alias("cum"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("cum") <= 2000).alias("packed"))


@query(f"""WITH {dump_sql()} SELECT id, round(list_sum(list_transform(range(1, n + 1), lambda i: (i - 1) * probs[i])), 6) AS score, CASE WHEN n = 2 THEN round(probs[2], 6) END AS noul, (list_position(probs, list_max(probs)) - 1)::BIGINT AS choice FROM dump""")
def build_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by type: probability of yes, best option, expected score."""
    d = dump(spark, sf_dir)
    score = arrays.total(F.transform("probs", lambda p, i: p * i))
    return d.select("id", F.round(score, 6).alias("score"), F.when(F.col("n") == 2, F.round(F.col("probs")[1], 6)).alias("noul"), arrays.argmax(F.col("probs")).alias("choice"))
