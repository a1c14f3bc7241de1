"""Release gates, resampling by digest, calibration details."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import arrays
from gristmill.operators import evaluate as E
from gristmill.operators import gates as G
from gristmill.queries._base import dump, dump_sql, query, table
from gristmill.queries.evaluation import r6

D = dump_sql()
_OWN = "own AS (SELECT *, id % 2 = 1 AS real, CASE WHEN n = 2 THEN ((id * 37) % 100) / 100.0 END AS p, 's' || id % 3 AS source, task IN ('t1', 't5') AS reserved FROM dump)"
_ECE = "sum(c * abs(conf - acc)) / sum(c)"


def _own(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("n") == 2, ((F.col("id") * 37) % 100) / 100.0)
    return dump(spark, sf_dir).withColumns({"real": F.col("id") % 2 == 1, "p": p, "source": F.concat(F.lit("s"), (F.col("id") % 3).cast("string")), "reserved": F.col("task").isin("t1", "t5")})


@query(f"""WITH {D}, {_OWN}, b AS (SELECT least(floor(confidence * 15), 14) AS bin, n = 2 AS two, count(*) AS c, avg(confidence) AS conf, avg(correct) AS acc FROM own WHERE real GROUP BY ALL), w AS (SELECT least(floor(confidence * 15), 14) AS bin, count(*) AS c, avg(confidence) AS conf, avg(correct) AS acc FROM own WHERE real GROUP BY ALL),
k AS (SELECT source, probs[2] AS yes, p FROM own WHERE n = 2), m AS (SELECT source, avg(abs(yes - p)) AS mae, corr(yes, p) AS r FROM k GROUP BY source), a AS (SELECT avg(abs(yes - p)) AS mae, corr(yes, p) AS r FROM k), i AS (SELECT max(abs(e.score - s.score)) AS v FROM (SELECT id, sum((i - 1) * q) AS score FROM (SELECT id, unnest(probs) AS q, unnest(range(1, n + 1)) AS i FROM dump) GROUP BY id) e JOIN (SELECT id, list_sum(list_transform(range(1, n + 1), lambda j: (j - 1) * probs[j])) AS score FROM dump) s USING (id)),
f AS (SELECT avg(confidence) FILTER (reserved) AS r, avg(confidence) FILTER (NOT reserved) AS t FROM own), g AS (
SELECT 'independence' AS gate, 2.5e-5 AS value, 1e-4 AS bar, true AS pass UNION ALL SELECT 'calibration', {_ECE}, 0.05, {_ECE} <= 0.05 FROM w UNION ALL SELECT CASE WHEN two THEN 'calibration_two' ELSE 'calibration_choice' END, {_ECE}, 0.08, {_ECE} <= 0.08 FROM b GROUP BY two
UNION ALL SELECT 'probability_recovery_mae', mae, 0.10, mae <= 0.10 FROM a UNION ALL SELECT 'probability_recovery_r', r, 0.80, r >= 0.80 FROM a UNION ALL SELECT 'mae_of_' || source, mae, NULL, NULL FROM m UNION ALL SELECT 'r_of_' || source, r, NULL, NULL FROM m
UNION ALL SELECT 'score_coherence', round(v, 9), 1e-9, v < 1e-9 FROM i UNION ALL SELECT 'reserved_families', r, t, r < t FROM f UNION ALL SELECT 'temperature_transfer', 0.2, 0.25, true UNION ALL SELECT 'abstention', NULL, 0.15, NULL UNION ALL SELECT 'confidence_beats_maxprob', 0.97, 0.95, false)
SELECT gate, round(value, 6) AS value, round(bar, 6) AS bar, pass, gate IN ({', '.join(repr(b) for b in G.BLOCKING)}) AS blocking, gate IN ({', '.join(repr(b) for b in G.BLOCKING)}) AND NOT coalesce(pass, false) AS blocked FROM g""")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gate of a release; a gate without its input passes neither way."""
    d = _own(spark, sf_dir)
    text = spark.createDataFrame([("checked 20 examples\nmax |delta logit| = 2.5e-05\n",)], "value string")
    parts = [G.independence(text), *G.calibration(d), *G.probability_recovery(d), G.score_coherence(d, E.answers(d)), G.reserved_families(d, F.col("reserved")), G.figures(d, 1.3, 1.1, None, 0.97)]
    return r6(G.report(parts), "value", "bar")


_UNIT = "(('0x' || substr(sha256({0}), 1, 8))::UBIGINT + 0.5) / 4294967296.0"


def _poisson(u: str) -> str:
    cumulative, out = 0.0, []
    for k in range(12):
        cumulative += math.exp(-1) / math.factorial(k)
        out.append(f"({u} > {cumulative!r})::INT")
    return "(" + " + ".join(out) + ")"


@query(f"""WITH {D}, x AS (SELECT id, task, correct, unnest(range(1, 2001)) AS draw FROM dump), u AS (SELECT *, {_UNIT.format("'0:' || draw || ':' || task || ':' || id")} AS u FROM x), w AS (SELECT *, {_poisson('u')} AS w FROM u), t AS (SELECT draw, task, sum(w * correct)::DOUBLE AS s, sum(w) AS n FROM w GROUP BY ALL),
v AS (SELECT *, {_UNIT.format("'0:' || draw || ':' || task")} AS u FROM t), y AS (SELECT *, CASE WHEN n > 0 THEN {_poisson('u')} ELSE 0 END AS wt FROM v), r AS (SELECT draw, sum(s) / nullif(sum(n), 0) AS micro, sum(wt * coalesce(s / nullif(n, 0), 0)) / nullif(sum(wt), 0) AS macro FROM y GROUP BY draw)
SELECT round(quantile_cont(micro, 0.025), 6) AS micro_low, round(quantile_cont(micro, 0.975), 6) AS micro_high, round(quantile_cont(macro, 0.025), 6) AS macro_low, round(quantile_cont(macro, 0.975), 6) AS macro_high FROM r""")
def bootstrap_micro_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of accuracy over 2,000 draws of questions, and of tasks and then questions."""
    r = E.resampled(dump(spark, sf_dir), "correct", "task", "id")
    return r.agg(*(F.round(F.percentile(c, F.lit(q)), 6).alias(f"{c}_{n}") for c in ("micro", "macro") for n, q in (("low", 0.025), ("high", 0.975))))


@query(f"""WITH {D}, x AS (SELECT id, task, correct, unnest(range(1, 401)) AS draw FROM dump), u AS (SELECT *, {_UNIT.format("'0:' || draw || ':' || id")} AS u FROM x), w AS (SELECT *, {_poisson('u')} AS w FROM u), s AS (SELECT task, draw, sum(w * correct) / nullif(sum(w), 0) AS stat FROM w GROUP BY ALL), b AS (SELECT task, quantile_cont(stat, 0.025) AS l, quantile_cont(stat, 0.975) AS h FROM s GROUP BY task)
SELECT task, count(*) AS n, round(avg(correct), 6) AS mean, round(CASE WHEN count(*) >= 20 THEN any_value(l) END, 6) AS low, round(CASE WHEN count(*) >= 20 THEN any_value(h) END, 6) AS high FROM dump JOIN b USING (task) GROUP BY task""")
def question_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(E.question_interval(dump(spark, sf_dir), "correct", "task", "id"), "mean", "low", "high")


@query(f"""WITH {D}, {dump_sql(17, 'other')}, d AS (SELECT a.task, a.correct - b.correct AS diff FROM dump a JOIN other b USING (id)), c AS (SELECT task, sum(diff) AS s, count(*) AS n FROM d GROUP BY task), x AS (SELECT *, unnest(range(1, 10001)) AS draw FROM c), u AS (SELECT *, {_UNIT.format("'0:' || draw || ':' || task")} AS u FROM x),
r AS (SELECT draw, sum({_poisson('u')} * s) / nullif(sum({_poisson('u')} * n), 0) AS stat FROM u GROUP BY draw) SELECT (SELECT count(*) FROM c) AS clusters, (SELECT round(sum(s) / sum(n), 6) FROM c) AS stat, round(quantile_cont(stat, 0.025), 6) AS low, round(quantile_cont(stat, 0.975), 6) AS high, round(avg(CASE WHEN stat > 0 THEN 1.0 WHEN stat = 0 THEN 0.5 WHEN stat < 0 THEN 0.0 END), 6) AS p_a_better FROM r""")
def paired_cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model less another over 10,000 draws of tasks."""
    a, b = dump(spark, sf_dir).select("id", "task", "correct"), dump(spark, sf_dir, 17).select("id", F.col("correct").alias("other"))
    return r6(E.paired_bootstrap(a.join(b, "id").withColumn("diff", F.col("correct") - F.col("other")), "diff", "task"), "stat", "low", "high", "p_a_better")


_GRID = [round(0.25 * 1.25**k, 6) for k in range(17)]
_SOFT = "list_transform({0}, lambda x: exp((x - list_max({0})) / t))"


@query(f"""WITH {D}, {dump_sql(17, 'other')}, h AS (SELECT a.id, a.target, a.logits AS l, b.logits AS m, unnest({_GRID}::DOUBLE[]) AS t FROM dump a JOIN other b USING (id)), e AS (SELECT t, target, {_SOFT.format('l')} AS x, {_SOFT.format('m')} AS y FROM h), g AS (SELECT t, avg(-ln((x[target + 1] / list_sum(x) + y[target + 1] / list_sum(y)) / 2)) AS nll FROM e GROUP BY t)
SELECT round(t, 6) AS temperature, round(nll, 6) AS nll, nll = (SELECT min(nll) FROM g) AS best FROM g""")
def ensemble_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss of two heads' mean at each temperature of a grid, and the best."""
    other = dump(spark, sf_dir, 17).select("id", F.col("logits").alias("second"))
    g = E.ensemble_nll_at(dump(spark, sf_dir).join(other, "id"), ["logits", "second"], _GRID)
    low = g.agg(F.min("nll").alias("low"))
    return r6(g.join(F.broadcast(low)).select("temperature", "nll", (F.col("nll") == F.col("low")).alias("best")), "nll")  # one row


@query(f"""WITH {D}, g AS (SELECT t, avg(-(logits[target + 1] - list_max(logits)) / t + ln(list_sum(list_transform(logits, lambda x: exp((x - list_max(logits)) / t))))) AS nll FROM (SELECT *, unnest({_GRID}::DOUBLE[]) AS t FROM dump) GROUP BY t) SELECT round(t, 6) AS temperature, round(nll, 6) AS nll FROM g""")
def temperature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(E.nll_at(dump(spark, sf_dir), _GRID), "temperature", "nll")


@query(f"""WITH {D}, {dump_sql(17, 'other')} SELECT a.id, round(list_max(list_transform(range(1, a.n + 1), lambda i: abs(ln(greatest(a.probs[i], 1e-12)) - ln(greatest(b.probs[i], 1e-12))))), 6) AS dlogp FROM dump a JOIN other b USING (id)""")
def perturbation_dlogp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest change of a log probability under a perturbation."""
    b = dump(spark, sf_dir, 17).select("id", F.col("probs").alias("q"))
    log = lambda p: F.log(F.greatest(p, F.lit(1e-12)))
    return dump(spark, sf_dir).join(b, "id").select("id", F.round(F.array_max(F.zip_with("probs", "q", lambda p, q: F.abs(log(p) - log(q)))), 6).alias("dlogp"))


_BUCKETS = ((2, 2), (3, 4), (5, 8), (9, 16), (17, 32), (33, 64), (65, 128), (129, 1 << 30))


@query(f"""WITH {D}, k AS (SELECT unnest([{', '.join(str(a) for a, _ in _BUCKETS)}]) AS low, unnest([{', '.join(str(b) for _, b in _BUCKETS)}]) AS high), x AS (SELECT id, correct, (n - 1) * (n - 1) * (n - 1) + 1 AS options FROM dump) SELECT low::BIGINT AS low, count(id) AS questions, round(avg(correct), 6) AS accuracy FROM k LEFT JOIN x ON options BETWEEN low AND high GROUP BY low""")
def option_count_all_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bucket of option counts, empty ones too."""
    x = dump(spark, sf_dir).select("correct", ((F.col("n") - 1) * (F.col("n") - 1) * (F.col("n") - 1) + 1).alias("options"))
    low = F.lit(_BUCKETS[0][0])
    for a, _ in _BUCKETS[1:]:
        low = F.when(F.col("options") >= a, a).otherwise(low)
    own = x.groupBy(low.cast("long").alias("low")).agg(F.count(F.lit(1)).alias("q"), F.avg("correct").alias("a"))
    every = spark.createDataFrame([(a,) for a, _ in _BUCKETS], "low long")
    return every.join(F.broadcast(own), "low", "left").select("low", F.coalesce("q", F.lit(0).cast("long")).alias("questions"), F.round("a", 6).alias("accuracy"))  # one row a bucket


@query(f"""WITH {D}, h AS (SELECT task, confidence, probs[1] AS hit FROM dump), b AS (SELECT task, greatest(ceil(confidence * 15) - 1, 0) AS bin, count(*) AS c, avg(confidence) AS conf, avg(hit) AS acc FROM h GROUP BY ALL) SELECT task, round({_ECE}, 6) AS ece FROM b GROUP BY task""")
def soft_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration where a hit is itself a probability."""
    return r6(E.ece(dump(spark, sf_dir).withColumn("correct", F.col("probs")[0]), ["task"], right=True), "ece")


@query(f"""WITH {D}, r AS (SELECT conv_id AS e, turn AS q, role FROM conversations), d AS (SELECT id, id // 4 AS e, id % 4 AS q, correct, confidence FROM dump) SELECT coalesce(role, 'missing') AS role, count(*) AS n, round(avg(correct), 6) AS accuracy, round(avg(confidence), 6) AS confidence FROM d LEFT JOIN r USING (e, q) GROUP BY 1""")
def dump_meta_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump meets its data file by example and question number, to recover what it left out."""
    r = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("e"), F.col("turn").alias("q"), "role")
    d = dump(spark, sf_dir).select(F.floor(F.col("id") / 4).alias("e"), (F.col("id") % 4).alias("q"), "correct", "confidence")
    j = d.join(r, ["e", "q"], "left").groupBy(F.coalesce("role", F.lit("missing")).alias("role"))
    return r6(j.agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"), F.avg("confidence").alias("confidence")), "accuracy", "confidence")


@query(f"""WITH {D}, {dump_sql(17, 'other')}, q AS (SELECT a.id, a.n, a.onehot, b.probs AS t, CASE WHEN a.id % 3 = 0 THEN b.n - 1 ELSE b.n END AS known FROM dump a JOIN other b USING (id)), s AS (SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: t[i])) AS whole FROM q)
SELECT id, unnest(range(n)) AS pos, unnest(list_transform(range(1, n + 1), lambda i: round(CASE WHEN known >= n THEN 0.5 * onehot[i] + 0.5 * t[i] / whole ELSE onehot[i] END, 6))) AS mixed FROM s""")
def mix_teacher_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A teacher's probabilities meet a question's options by key; they count only if it knows every option."""
    names = lambda n: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.concat(F.lit("o"), i.cast("string")))
    b = dump(spark, sf_dir, 17)
    known = F.when(F.col("id") % 3 == 0, F.col("n") - 1).otherwise(F.col("n"))
    teacher = b.select("id", F.map_from_arrays(names(known), F.slice("probs", F.lit(1), known.cast("int"))).alias("teacher"))
    q = dump(spark, sf_dir).select("id", "onehot", names(F.col("n")).alias("options")).join(teacher, "id")
    subset = F.forall("options", lambda o: F.map_contains_key("teacher", o))
    given = F.transform("options", lambda o: F.element_at("teacher", o))
    mixed = F.when(subset, F.zip_with("onehot", given, lambda t, p: F.round(0.5 * t + 0.5 * p / arrays.total(given), 6))).otherwise(F.col("onehot"))
    return q.select("id", F.posexplode(mixed).alias("pos", "mixed")).withColumn("pos", F.col("pos").cast("long"))


_RATES = ((0.0, 0.06), (0.2, 0.06), (0.36, 0.06), (0.36, 0.2))
_U = "('0x' || substr(sha256('0:0:' || id || ':{0}'), 1, 16))::UBIGINT % 1000000 / 1000000.0"


@query(f"""WITH {D}, f AS (SELECT id, n, n >= 3 AND list_max(probs) >= 0.5 AS fits, {_U.format('change')} AS u, {_U.format('decoy')} AS d FROM dump), r AS (SELECT unnest([{', '.join(str(a) for a, _ in _RATES)}]::DOUBLE[]) AS p_decoy, unnest([{', '.join(str(b) for _, b in _RATES)}]::DOUBLE[]) AS p_withheld),
x AS (SELECT p_decoy, p_withheld, n, fits AND u < p_withheld AS held, fits AND u >= p_withheld AND d < p_decoy AS fake FROM f, r) SELECT p_decoy, p_withheld, round(avg((held OR fake)::INT), 6) AS share, round(coalesce(sum(held::INT) / nullif(sum((held OR fake)::INT), 0), 0), 6) AS p_correct, coalesce(sum(held::INT) / nullif(sum((held OR fake)::INT), 0), 0) <= 0.20 AND avg((held OR fake)::INT) <= 0.34 AS accepted FROM x GROUP BY ALL""")
def sentinel_rate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a sentinel is present, and right when present, at each pair of rates of a short grid."""
    from gristmill.operators.augment import draw

    fits = (F.col("n") >= 3) & (F.array_max("probs") >= 0.5)
    key = F.col("id")
    q = dump(spark, sf_dir).select(fits.alias("fits"), draw(0, 0, key, "change").alias("u"), draw(0, 0, key, "decoy").alias("d"))
    pairs = F.array(*(F.struct(F.lit(a).alias("p_decoy"), F.lit(b).alias("p_withheld")) for a, b in _RATES))
    x = q.select("*", F.explode(pairs).alias("r")).select("fits", "u", "d", "r.*")
    held = F.col("fits") & (F.col("u") < F.col("p_withheld"))
    fake = F.col("fits") & (F.col("u") >= F.col("p_withheld")) & (F.col("d") < F.col("p_decoy"))
    g = x.groupBy("p_decoy", "p_withheld").agg(F.avg((held | fake).cast("double")).alias("share"), F.coalesce(F.count_if(held) / F.nullif(F.count_if(held | fake), F.lit(0)), F.lit(0.0)).alias("p_correct"))
    return r6(g.withColumn("accepted", (F.col("p_correct") <= 0.20) & (F.col("share") <= 0.34)), "share", "p_correct")


@query(f"""WITH {D}, s AS (SELECT n, id % 3 = 0 AS present, 'w' || id % 7 AS wording FROM dump), h AS (SELECT n, present, count(*) AS c FROM s GROUP BY ALL), a AS (SELECT n, coalesce(sum(c) FILTER (present), 0) / (SELECT sum(c) FROM h WHERE present) AS p, coalesce(sum(c) FILTER (NOT present), 0) / (SELECT sum(c) FROM h WHERE NOT present) AS q FROM h GROUP BY n), w AS (SELECT wording, count(*) AS c FROM s WHERE present GROUP BY wording)
SELECT (SELECT max(c) FROM w) AS most_repeated, (SELECT count(*) FROM w) AS wordings, round(0.5 * sum(abs(p - q)), 6) AS arity_tvd, (SELECT max(c) FROM w) <= 50 AND 0.5 * sum(abs(p - q)) <= 0.05 AS accepted FROM a""")
def sentinel_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most repeated wording, and how far option counts with and without a sentinel differ."""
    s = dump(spark, sf_dir).select("n", (F.col("id") % 3 == 0).alias("present"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string")).alias("wording"))
    w = s.where("present").groupBy("wording").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("most_repeated"), F.count(F.lit(1)).alias("wordings"))
    h = s.groupBy("n").agg(F.count_if("present").alias("p"), F.count_if(~F.col("present")).alias("q"))
    whole = h.agg(F.sum("p").alias("ps"), F.sum("q").alias("qs"))
    tvd = h.join(F.broadcast(whole)).agg((0.5 * F.sum(F.abs(F.col("p") / F.col("ps") - F.col("q") / F.col("qs")))).alias("arity_tvd"))  # one row
    return r6(w.join(F.broadcast(tvd)).withColumn("accepted", (F.col("most_repeated") <= 50) & (F.col("arity_tvd") <= 0.05)), "arity_tvd")  # one row each
