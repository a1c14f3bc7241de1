"""Evaluation metrics and gates over dumps derived from the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import arrays
from gristmill.operators import evaluate as E
from gristmill.queries._base import dump, dump_sql, query

D = dump_sql()
_LOSS = """l AS (SELECT *, -list_sum(list_transform(range(1, n + 1), lambda i: onehot[i] * ln(greatest(probs[i], 1e-12)))) AS nll, list_sum(list_transform(range(1, n + 1), lambda i: (probs[i] - onehot[i]) ** 2)) AS brier FROM dump)"""


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {D}, {_LOSS} SELECT task, count(*) AS questions, round(avg(correct), 6) AS accuracy, round(avg(nll), 6) AS nll, round(avg(brier), 6) AS brier FROM l GROUP BY task")
def accuracy_nll_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = E.losses(dump(spark, sf_dir)).groupBy("task").agg(F.count(F.lit(1)).alias("questions"), F.avg("correct").alias("accuracy"), F.avg("nll").alias("nll"), F.avg("brier").alias("brier"))
    return r6(x, "accuracy", "nll", "brier")


@query(f"WITH {D}, b AS (SELECT task, least(floor(confidence * 15), 14) AS bin, count(*) AS c, avg(confidence) AS conf, avg(correct) AS acc FROM dump GROUP BY ALL) SELECT task, round(sum(c * abs(conf - acc)) / sum(c), 6) AS ece FROM b GROUP BY task")
def ece_left_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(E.ece(dump(spark, sf_dir), ["task"]), "ece")


@query(f"WITH {D}, b AS (SELECT task, greatest(ceil(confidence * 15) - 1, 0) AS bin, count(*) AS c, avg(confidence) AS conf, avg(correct) AS acc FROM dump GROUP BY ALL) SELECT task, round(sum(c * abs(conf - acc)) / sum(c), 6) AS ece FROM b GROUP BY task")
def ece_right_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(E.ece(dump(spark, sf_dir), ["task"], right=True), "ece")


@query(f"WITH {D}, b AS (SELECT least(floor(confidence * 15), 14)::BIGINT AS bin, count(*) AS n, avg(confidence) AS conf, avg(correct) AS acc FROM dump GROUP BY ALL) SELECT r.bin, round(r.bin / 15, 6) AS lo, round((r.bin + 1) / 15, 6) AS hi, coalesce(n, 0) AS n, round(conf, 6) AS conf, round(acc, 6) AS acc FROM (SELECT unnest(range(15)) AS bin) r LEFT JOIN b USING (bin)")
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(E.reliability(dump(spark, sf_dir)), "lo", "hi", "conf", "acc")


@query(f"WITH {D}, r AS (SELECT task, avg(1 - correct) OVER (PARTITION BY task ORDER BY confidence DESC, id ROWS UNBOUNDED PRECEDING) AS risk FROM dump) SELECT task, round(avg(risk), 6) AS aurc FROM r GROUP BY task")
def aurc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(E.aurc(dump(spark, sf_dir), "task"), "aurc")


@query(f"WITH {D} SELECT round(avg(1 - correct) FILTER (confidence >= 0.9), 6) AS p_wrong, count(*) FILTER (confidence >= 0.9) AS n, round(count(*) FILTER (confidence >= 0.9) / count(*), 6) AS share FROM dump")
def p_wrong_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(E.wrong_at(dump(spark, sf_dir)), "p_wrong", "share")


@query(f"WITH {D}, {_LOSS}, t AS (SELECT task, count(*) AS n, avg(correct) AS acc, avg(nll) AS nll FROM l GROUP BY task) SELECT round(sum(n * acc) / sum(n), 6) AS micro_acc, round(avg(acc), 6) AS macro_acc, round(sum(n * nll) / sum(n), 6) AS micro_nll, round(avg(nll), 6) AS macro_nll, count(*) AS tasks FROM t")
def per_task_micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = E.losses(dump(spark, sf_dir)).groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("acc"), F.avg("nll").alias("nll"))
    micro = lambda c: F.round(F.sum(F.col("n") * F.col(c)) / F.sum("n"), 6)
    return t.agg(micro("acc").alias("micro_acc"), F.round(F.avg("acc"), 6).alias("macro_acc"), micro("nll").alias("micro_nll"), F.round(F.avg("nll"), 6).alias("macro_nll"), F.count(F.lit(1)).alias("tasks"))


@query(f"WITH {D}, {_LOSS}, x AS (SELECT 'd' || id % 5 AS domain, id % 2 = 0 AS generated, correct, nll FROM l) SELECT CASE WHEN grouping(domain) = 1 THEN 'all' ELSE domain END AS domain, CASE WHEN grouping(generated) = 1 THEN 'all' WHEN generated THEN 'code' ELSE 'real' END AS kind, count(*) AS n, round(avg(correct), 6) AS acc, round(avg(nll), 6) AS nll FROM x GROUP BY GROUPING SETS ((domain), (generated), ())")
def by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = E.losses(dump(spark, sf_dir)).select(F.concat(F.lit("d"), (F.col("id") % 5).cast("string")).alias("domain"), (F.col("id") % 2 == 0).alias("generated"), "correct", "nll")
    g = x.groupingSets([[F.col("domain")], [F.col("generated")], []], "domain", "generated").agg(F.grouping("domain").alias("gd"), F.grouping("generated").alias("gg"), F.count(F.lit(1)).alias("n"), F.round(F.avg("correct"), 6).alias("acc"), F.round(F.avg("nll"), 6).alias("nll"))
    return g.select(F.when(F.col("gd") == 1, "all").otherwise(F.col("domain")).alias("domain"), F.when(F.col("gg") == 1, "all").when(F.col("generated"), "code").otherwise("real").alias("kind"), "n", "acc", "nll")


@query(f"WITH {D}, {_LOSS}, x AS (SELECT (id % 6 + 1) * 1000 AS length, id % 3 AS depth, n, correct, nll FROM l) SELECT CASE WHEN grouping(length) = 1 THEN -1 ELSE length END::BIGINT AS length, CASE WHEN grouping(depth) = 1 THEN -1 ELSE depth END::BIGINT AS depth, count(*) AS questions, round(avg(correct), 6) AS acc, round(avg(1 / n), 6) AS chance, round(avg(nll), 6) AS nll FROM x GROUP BY CUBE (length, depth)")
def length_depth_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = E.losses(dump(spark, sf_dir)).select(((F.col("id") % 6 + 1) * 1000).alias("length"), (F.col("id") % 3).alias("depth"), "n", "correct", "nll")
    g = x.cube("length", "depth").agg(F.grouping("length").alias("gl"), F.grouping("depth").alias("gd"), F.count(F.lit(1)).alias("questions"), F.round(F.avg("correct"), 6).alias("acc"), F.round(F.avg(1 / F.col("n")), 6).alias("chance"), F.round(F.avg("nll"), 6).alias("nll"))
    return g.select(F.when(F.col("gl") == 1, -1).otherwise(F.col("length")).cast("long").alias("length"), F.when(F.col("gd") == 1, -1).otherwise(F.col("depth")).cast("long").alias("depth"), "questions", "acc", "chance", "nll")


@query(f"WITH {D} SELECT CASE WHEN n = 2 THEN '2' WHEN n <= 4 THEN '3-4' ELSE '5+' END AS bucket, count(*) AS questions, round(avg(correct), 6) AS acc, round(avg(confidence), 6) AS conf FROM dump GROUP BY 1")
def option_count_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("n") == 2, "2").when(F.col("n") <= 4, "3-4").otherwise("5+")
    return r6(dump(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("questions"), F.avg("correct").alias("acc"), F.avg("confidence").alias("conf")), "acc", "conf")


_PAIR = f"""{D}, {dump_sql(17, "other")}, a AS (SELECT id // 2 AS key, row_number() OVER (PARTITION BY id // 2 ORDER BY id) AS occ, task, correct, confidence, n FROM dump),
b AS (SELECT id // 2 AS key, row_number() OVER (PARTITION BY id // 2 ORDER BY id) AS occ, task, correct, confidence FROM other WHERE id % 7 <> 0), p AS (SELECT a.key, a.occ, a.task, a.correct - b.correct AS diff, a.confidence AS ca, b.confidence AS cb FROM a JOIN b USING (key, occ))"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.floor(F.col("id") / 2).alias("key")
    a, b = (x.select("id", key, "task", "correct", "confidence") for x in (dump(spark, sf_dir), dump(spark, sf_dir, 17).where("id % 7 <> 0")))
    p = E.paired(a, b, "key", "id")
    return p.select("key", F.col("occurrence").cast("long").alias("occ"), F.col("task_a").alias("task"), (F.col("correct_a") - F.col("correct_b")).alias("diff"), F.col("confidence_a").alias("ca"), F.col("confidence_b").alias("cb"))


@query(f"WITH {_PAIR} SELECT key, occ, task, diff FROM p")
def paired_join_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("key", "occ", "task", "diff")


@query(f"WITH {_PAIR} SELECT task, count(*) AS n, round(avg(diff), 6) AS diff FROM p GROUP BY task")
def paired_diff_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("diff"), 6).alias("diff"))


@query(f"WITH {_PAIR} SELECT task, round(CASE WHEN stddev_pop(ca) > 1e-12 AND stddev_pop(cb) > 1e-12 THEN corr(ca, cb) END, 6) AS r FROM p GROUP BY task")
def pearson_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(E.pearson(_pairs(spark, sf_dir), "ca", "cb", ["task"]), "r")


@query()
def bootstrap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds depend on the hash draws; a test compares them with resampling."""
    return r6(E.bootstrap(_pairs(spark, sf_dir), "diff", "task"), "mean", "low", "high")


@query()
def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dump(spark, sf_dir)
    t = E.fit_temperature(d)
    return r6(E.nll_at(d, [1.0, t]), "temperature", "nll")


@query()
def temperature_by_size_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test recovers planted values."""
    t, slope = E.fit_temperature_by_size(dump(spark, sf_dir))
    return spark.range(1).select(F.round(F.lit(t), 4).alias("temperature"), F.round(F.lit(slope), 4).alias("slope"))


@query(f"WITH {D}, s AS (SELECT id, list_reverse_sort(probs) AS p, probs FROM dump) SELECT id, round(p[1] - p[2], 6) AS margin, round(-list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-12)))), 6) AS entropy FROM s")
def distribution_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.sort_array("probs", False)
    d = dump(spark, sf_dir).select("id", p.alias("p"))
    return d.select("id", F.round(F.col("p")[0] - F.col("p")[1], 6).alias("margin"), F.round(-arrays.total(F.transform("p", lambda x: x * F.log(F.greatest(x, F.lit(1e-12))))), 6).alias("entropy"))


@query(f"""WITH {D}, {dump_sql(17, "other")}, j AS (SELECT a.id, a.n, a.probs AS p, b.probs AS q FROM dump a JOIN other b USING (id)) SELECT id, round(list_sum(list_transform(range(1, n + 1), lambda i: p[i] * ln(p[i] / q[i]))), 6) AS kl, round(0.5 * list_sum(list_transform(range(1, n + 1), lambda i: abs(p[i] - q[i]))), 6) AS tv,
list_position(p, list_max(p)) <> list_position(q, list_max(q)) AS flip FROM j""")
def kl_tv_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = dump(spark, sf_dir).select("id", F.col("probs").alias("p")), dump(spark, sf_dir, 17).select("id", F.col("probs").alias("q"))
    j = a.join(b, "id")
    kl = arrays.total(F.zip_with("p", "q", lambda x, y: x * F.log(x / y)))
    tv = 0.5 * arrays.total(F.zip_with("p", "q", lambda x, y: F.abs(x - y)))
    return j.select("id", F.round(kl, 6).alias("kl"), F.round(tv, 6).alias("tv"), (arrays.argmax(F.col("p")) != arrays.argmax(F.col("q"))).alias("flip"))


@query(f"""WITH {D}, {dump_sql(17, "other")}, e AS (SELECT a.task, unnest(a.probs) AS p, unnest(b.probs) AS q FROM dump a JOIN other b USING (id)) SELECT task, round(regr_slope(p, q), 6) AS slope, round(regr_intercept(p, q), 6) AS intercept FROM e GROUP BY task""")
def kl_tv_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = dump(spark, sf_dir).select("id", "task", "probs"), dump(spark, sf_dir, 17).select("id", F.col("probs").alias("q"))
    e = a.join(b, "id").select("task", F.explode(F.arrays_zip("probs", "q")).alias("x")).select("task", F.col("x.probs").alias("p"), F.col("x.q").alias("q"))
    return e.groupBy("task").agg(F.round(F.regr_slope("p", "q"), 6).alias("slope"), F.round(F.regr_intercept("p", "q"), 6).alias("intercept"))


@query(f"WITH {D} SELECT id, unnest(range(n)) AS pos, unnest(list_transform(range(n), lambda i: round(probs[((i + id) % n) + 1], 6))) AS permuted, (list_position(list_transform(range(n), lambda i: (i + id) % n), target) - 1)::BIGINT AS new_target FROM dump")
def permute_unpermute(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: ((i + F.col("id")) % F.col("n")))
    d = dump(spark, sf_dir).select("id", "probs", "target", order.alias("o"))
    rounded = F.transform("o", lambda i: F.round(F.element_at("probs", (i + 1).cast("int")), 6))
    return d.select("id", F.posexplode(rounded).alias("pos", "permuted"), (F.array_position("o", F.col("target")) - 1).cast("long").alias("new_target")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {D}, {dump_sql(17, 'other')} SELECT a.id, unnest(range(a.n)) AS pos, unnest(list_transform(range(1, a.n + 1), lambda i: round(0.7 * a.onehot[i] + 0.3 * b.probs[i], 6))) AS mixed FROM dump a JOIN other b USING (id)")
def mix_teacher(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = dump(spark, sf_dir).select("id", "onehot"), dump(spark, sf_dir, 17).select("id", F.col("probs").alias("teacher"))
    mixed = F.zip_with("onehot", "teacher", lambda t, p: F.round(0.7 * t + 0.3 * p, 6))
    return a.join(b, "id").select("id", F.posexplode(mixed).alias("pos", "mixed")).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {D} SELECT id, unnest(range(n)) AS pos, unnest(CASE WHEN n = 2 THEN [round(1 - least(greatest(confidence, 0), 1), 6), round(least(greatest(confidence, 0), 1), 6)] ELSE onehot END) AS soft FROM dump")
def soften_meta_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    soft = F.when(F.col("n") == 2, F.array(F.round(1 - p, 6), F.round(p, 6))).otherwise(F.col("onehot"))
    return dump(spark, sf_dir).select("id", F.posexplode(soft).alias("pos", "soft")).withColumn("pos", F.col("pos").cast("long"))
