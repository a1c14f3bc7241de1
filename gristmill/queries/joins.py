"""State projection, and joins by position, day, containment and key sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import joins as J
from gristmill.queries._base import query, table


@query("""WITH c AS (SELECT conv_id, turn, trim(coalesce(role, '')) AS role, substr(trim(coalesce(text, '')), 1, 4000) AS text, CASE WHEN turn % 2 = 0 THEN 'é "q" \\ ' || turn ELSE '' END AS note FROM conversations), f AS (SELECT conv_id, turn, list_filter([CASE WHEN role <> '' THEN '  "role": ' || to_json(role)::VARCHAR END, CASE WHEN text <> '' THEN '  "text": ' || to_json(text)::VARCHAR END, CASE WHEN note <> '' THEN '  "note": ' || to_json(note)::VARCHAR END], lambda x: x IS NOT NULL) AS l FROM c)
SELECT conv_id, turn, CASE WHEN len(l) > 0 THEN '{' || chr(10) || array_to_string(l, ',' || chr(10)) || chr(10) || '}' ELSE '' END AS state FROM f""")
def state_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several columns as one indented JSON state, in declared order."""
    c = table(spark, sf_dir, "conversations").withColumn("note", F.when(F.col("turn") % 2 == 0, F.concat(F.lit('é "q" \\ '), F.col("turn").cast("string"))).otherwise(""))
    return c.select("conv_id", "turn", J.state_json(["role", "text", "note"]).alias("state"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CASE WHEN p_size // 10 < 4 THEN (['none', 'low', 'mid', 'high'])[(p_size // 10 + 1)::INT] ELSE (p_size // 10)::VARCHAR END WHEN 1 THEN 'true' WHEN 2 THEN '-1' ELSE p_brand END AS value FROM part""")
def class_index_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of published classes as names; everything else stays."""
    k = F.col("p_size") % 4
    raw = F.when(k == 0, F.floor(F.col("p_size") / 10).cast("string")).when(k == 1, "true").when(k == 2, "-1").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", J.class_name(raw, F.array(*map(F.lit, ("none", "low", "mid", "high")))).alias("value"))


_NAMES = ("text", "worker_id", "label", "source_url", "annotatorConfidence", "topic", "submit_date", "license", "premise", "file", "profile", "n_raters", "sentiment", "update", "hit_id")


@query(f"""SELECT name, NOT regexp_matches(lower(name), 'annotator|worker|rater|coder|labell?er|author|user|judge|confidence|agreement|(^|_)(time|date|duration|timestamp|split|fold|version|batch|hit)(_|$)|(^|_)(url|uri|link|source|domain|website|file|path|filename|dataset|corpus|license|licence|doi|isbn)(_|$)') AS about_text FROM (SELECT unnest([{', '.join(repr(n) for n in _NAMES)}]) AS name)""")
def columns_about_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in _NAMES], "name string").select("name", J.about_text(F.col("name")).alias("about_text"))


_COLS = ("s_suppkey", "s_name", "s_nationkey", "bucket", "parity")
_WIDE = "w AS (SELECT s_suppkey, s_name, s_nationkey, 'n' || s_nationkey AS bucket, s_suppkey % 2 AS parity FROM supplier)"


@query(f"WITH {_WIDE} " + " UNION ALL ".join(f"""SELECT '{a}' AS "left", '{b}' AS "right" FROM w HAVING count(DISTINCT {a}) = count(DISTINCT {b}) AND count(DISTINCT {a}) = count(DISTINCT ({a}, {b})) AND count(DISTINCT {a}) > 1""" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]))
def dependent_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of columns that hold the same thing, found among all pairs."""
    w = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("bucket"), (F.col("s_suppkey") % 2).alias("parity"))
    return J.dependent_pairs(w, list(_COLS))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) AS pos, source AS task, coalesce(text, '') AS state FROM documents), e AS (SELECT CASE WHEN pos % 101 = 0 THEN pos + 1000000 ELSE pos END AS pos, CASE WHEN pos % 37 = 0 THEN 'other' ELSE task END AS task, CASE WHEN pos % 10 = 0 THEN state || '!' ELSE state END AS state FROM r),
j AS (SELECT CASE WHEN e.pos IS NULL THEN 'missing' WHEN r.pos IS NULL THEN 'extra' WHEN r.task <> e.task THEN 'order' WHEN starts_with(r.task, 'src1') AND r.state <> e.state THEN 'changed' END AS problem FROM r FULL JOIN e USING (pos)) SELECT problem, count(*) AS n FROM j WHERE problem IS NOT NULL GROUP BY problem""")
def verify_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files line by line: lines missing, extra, of another task, or changed though protected."""
    # positions of this fixture come from the ids' order; files carry their own
    docs = table(spark, sf_dir, "documents")
    r = docs.select(F.row_number().over(Window.orderBy("doc_id")).cast("long").alias("pos"), F.col("source").alias("task"), F.coalesce("text", F.lit("")).alias("state"))
    p = F.col("pos")
    e = r.select(F.when(p % 101 == 0, p + 1_000_000).otherwise(p).alias("pos"), F.when(p % 37 == 0, "other").otherwise(F.col("task")).alias("task"), F.when(p % 10 == 0, F.concat("state", F.lit("!"))).otherwise(F.col("state")).alias("state"))
    return J.verify_positions(r, e, "pos", "task", F.startswith("task", F.lit("src1")))


@query("""WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS orders FROM orders GROUP BY 1) SELECT o_orderkey, day AS valid_day, orders FROM (SELECT o_orderkey, o_orderdate::DATE + (o_orderkey % 5)::INT AS day FROM orders) f JOIN d USING (day)""")
def forecast_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts by cycle and lead meet the day that they speak of."""
    o = table(spark, sf_dir, "orders").withColumn("cycle", F.col("o_orderdate").cast("date"))
    observed = o.groupBy(F.col("cycle").alias("valid_day")).agg(F.count(F.lit(1)).alias("orders"))
    leads = o.select("o_orderkey", "cycle", (F.col("o_orderkey") % 5 + 1).cast("int").alias("lead"))
    return J.verifying(leads, observed, "cycle", "lead", "valid_day").select("o_orderkey", "valid_day", "orders")


@query("""WITH b AS (SELECT DISTINCT regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS key FROM documents WHERE source = 'src0') SELECT doc_id FROM documents WHERE text IS NOT NULL AND regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') NOT IN (SELECT key FROM b)""")
def excluded_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose normalised text isn't among the excluded ones."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    held = docs.where("source = 'src0'").select(text.norm(F.col("text")).alias("key"))
    return J.excluded(docs, held, text.norm(F.col("text"))).select("doc_id")


_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{0E00}-\\x{0E7F}]|[\\p{L}\\p{N}]+')"


@query(f"""WITH i AS (SELECT item_id, {_TOKENS} AS w FROM benchmark), d AS (SELECT doc_id, {_TOKENS} AS w FROM documents), ir AS (SELECT DISTINCT item_id, array_to_string(w[p:p+7], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS p FROM i)), dr AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d)),
k AS (SELECT doc_id, item_id, count(*) AS shared FROM dr JOIN ir USING (s) GROUP BY ALL HAVING count(*) >= 3), m AS (SELECT doc_id, item_id FROM d JOIN i ON d.w = i.w AND len(d.w) > 0) SELECT doc_id, item_id, coalesce(shared, 0) AS shared, m.doc_id IS NOT NULL AS whole FROM k FULL JOIN m USING (doc_id, item_id)""")
def suite_rematch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are a benchmark item, or share three runs of eight words with one."""
    return J.rematch(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text")


_NORM = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"""WITH e AS (SELECT item_id, -item_id - 1 AS own, CASE WHEN item_id % 9 = 0 THEN '[REDACTED] ' ELSE array_to_string(list_concat(string_split(text, ' ')[1:6], ['[REDACTED]'], string_split(text, ' ')[9:16]), ' ') END AS text FROM benchmark), s AS (SELECT item_id, own, list_filter(list_transform(string_split(text, '[REDACTED]'), lambda x: {_NORM.format('x')}), lambda x: x <> '') AS spans FROM e),
t AS (SELECT doc_id, ' ' || {_NORM.format("coalesce(text, '')")} || ' ' AS body FROM documents) SELECT item_id, min(doc_id) AS other FROM s JOIN t ON len(spans) > 0 AND len(list_filter(spans, lambda x: NOT contains(body, ' ' || x || ' '))) = 0 GROUP BY item_id UNION ALL SELECT item_id, own FROM s WHERE len(spans) = 0""")
def excerpt_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted excerpts that another text holds in every part."""
    words = F.split("text", " ")
    cut = F.array_join(F.concat(F.slice(words, 1, 6), F.array(F.lit("[REDACTED]")), F.slice(words, 9, 8)), " ")
    e = table(spark, sf_dir, "benchmark").select("item_id", (-F.col("item_id") - 1).alias("owner"), F.when(F.col("item_id") % 9 == 0, "[REDACTED] ").otherwise(cut).alias("text"))
    return J.found_elsewhere(e, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("owner"), "text"), "item_id", "owner", "text")


_CONTAM = "b AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en')"


@query(f"""WITH {_CONTAM} SELECT sha1(coalesce(text, '')) AS digest, max(len({_TOKENS})) AS tokens, bool_or(b.doc_id IS NOT NULL) AS blocked FROM documents LEFT JOIN b USING (doc_id) GROUP BY 1""")
def document_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and flag of each distinct text."""
    docs = table(spark, sf_dir, "documents")
    return J.document_meta(docs, docs.where("lang = 'en'").select("doc_id"), "doc_id", "text")


@query("""WITH p AS (SELECT p_brand AS doc, p_partkey AS pos, p_size % 4 AS level FROM part) SELECT a.doc, a.pos, coalesce(string_agg(b.pos::VARCHAR, ',' ORDER BY b.pos DESC), '') AS chain FROM p a LEFT JOIN p b ON a.doc = b.doc AND b.pos < a.pos AND b.level < a.level AND NOT EXISTS (SELECT 1 FROM p c WHERE c.doc = a.doc AND c.pos > b.pos AND c.pos < a.pos AND c.level <= b.level) GROUP BY a.doc, a.pos""")
def outline_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that enclose each outline entry, innermost first."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("pos"), (F.col("p_size") % 4).alias("level"))
    return J.ancestors(p, "doc", "pos", "level").select("doc", "pos", F.array_join(F.transform("chain", lambda x: x.cast("string")), ",").alias("chain"))


@query("""WITH t AS (SELECT p_brand AS task, p_type AS target, p_partkey, p_name FROM part), i AS (SELECT task, count(*) AS examples, count(DISTINCT target) AS targets, arg_min(p_name, p_partkey) AS definition FROM t GROUP BY task) SELECT task, examples, targets, definition FROM i WHERE targets BETWEEN 2 AND 300 AND examples >= 5""")
def task_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of enough examples and few targets, with their first definition."""
    t = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("task")).agg(F.count(F.lit(1)).alias("examples"), F.count_distinct("p_type").alias("targets"), F.min_by("p_name", "p_partkey").alias("definition"))
    return t.where("targets between 2 and 300 and examples >= 5")


_ISSUE = """i AS (SELECT c_custkey AS id, 'r' || c_nationkey AS repo, CASE WHEN c_custkey % 23 = 0 THEN '🛑 api' || c_custkey || ' is down' WHEN c_custkey % 5 = 0 THEN 'Crash on start ' || c_custkey % 9 WHEN c_custkey % 7 = 0 THEN 'Deployment failed again' ELSE c_name END AS title, CASE WHEN c_custkey % 5 = 0 THEN 'same text' ELSE c_mktsegment || c_custkey // 3 || repeat('x', (c_custkey % 40)::INT) END AS body FROM customer),
k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(title), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS t, trim(regexp_replace(regexp_replace(lower(body), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g')) AS b FROM i)"""


@query(f"""WITH {_ISSUE}, c AS (SELECT *, count(*) OVER (PARTITION BY repo, t, b) AS n_full, count(*) OVER (PARTITION BY repo, t) AS n_title FROM k), a AS (SELECT t, b, count(DISTINCT repo) AS n_repos FROM k GROUP BY ALL)
SELECT id, CASE WHEN regexp_matches(title, '^\\s*(🛑|⚠️?|🟥|🟧|🟨|🟩|✅|❌)\\s*.+\\b(is down|has degraded performance|is up)\\s*$') THEN 'uptime' WHEN n_full >= 2 THEN 'same' WHEN n_title >= 5 AND len(string_split(t, ' ')) >= 2 THEN 'title' WHEN n_repos >= 2 THEN 'across' END AS reason FROM c JOIN a USING (t, b)""")
def automated_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues that a monitor wrote, that repeat in a repository, or that stand in two."""
    k = F.col("c_custkey")
    title = F.when(k % 23 == 0, F.concat(F.lit("🛑 api"), k.cast("string"), F.lit(" is down"))).when(k % 5 == 0, F.concat(F.lit("Crash on start "), (k % 9).cast("string"))).when(k % 7 == 0, "Deployment failed again").otherwise(F.col("c_name"))
    body = F.when(k % 5 == 0, "same text").otherwise(F.concat("c_mktsegment", F.floor(k / 3).cast("string"), F.repeat(F.lit("x"), (k % 40).cast("int"))))
    i = table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("repo"), title.alias("title"), body.alias("body"))
    mask = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9]+", "#"), r"\s+", " "))
    i = i.withColumns({"t": mask("title"), "b": mask("body")})
    # texts are counted by digest, combined before their shuffles, and joined back
    full = i.groupBy("repo", F.xxhash64("t", "b").alias("h")).agg(F.count(F.lit(1)).alias("n_full"))
    titles = i.groupBy("repo", F.xxhash64("t").alias("ht")).agg(F.count(F.lit(1)).alias("n_title"))
    across = full.groupBy("h").agg(F.count(F.lit(1)).alias("n_repos"))
    x = i.withColumns({"h": F.xxhash64("t", "b"), "ht": F.xxhash64("t")}).join(full, ["repo", "h"]).join(titles, ["repo", "ht"]).join(across, "h")
    uptime = F.regexp_like("title", F.lit(r"^\s*(🛑|⚠️?|🟥|🟧|🟨|🟩|✅|❌)\s*.+\b(is down|has degraded performance|is up)\s*$"))
    return x.select("id", F.when(uptime, "uptime").when(F.col("n_full") >= 2, "same").when((F.col("n_title") >= 5) & (F.size(F.split("t", " ")) >= 2), "title").when(F.col("n_repos") >= 2, "across").alias("reason"))


@query("""WITH t AS (SELECT DISTINCT p_brand || '/' || p_size AS family, CASE WHEN p_partkey % 10 < 2 THEN 'train' WHEN p_partkey % 10 < 6 THEN 'dev' ELSE 'test' END AS split FROM part), d AS (SELECT family FROM t WHERE split = 'dev' EXCEPT SELECT family FROM t WHERE split = 'train') SELECT family, family IN (SELECT family FROM t WHERE split = 'test') AS in_test FROM d""")
def family_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of the development split that training lacks, and whether the test split has them."""
    s = F.when(F.col("p_partkey") % 10 < 2, "train").when(F.col("p_partkey") % 10 < 6, "dev").otherwise("test")
    t = table(spark, sf_dir, "part").groupBy(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("family")).agg(F.collect_set(s).alias("splits"))
    has = lambda v: F.array_contains("splits", v)
    return t.where(has("dev") & ~has("train")).select("family", has("test").alias("in_test"))


@query("""WITH k AS (SELECT doc_id, sha256(coalesce(text, '') || chr(31) || lang || chr(31) || 'yes,no') AS key FROM documents), f AS (SELECT min(doc_id) AS doc_id, key FROM k GROUP BY key) SELECT doc_id, key, (('0x' || substr(sha256(key), 1, 16))::UBIGINT % 4)::BIGINT AS slice FROM f""")
def raw_pool_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each content once, by state, question and options, with its slice of four by digest."""
    from gristmill.functions import hashing

    key = F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("\x1f"), F.col("lang"), F.lit("\x1fyes,no")), 256)
    f = table(spark, sf_dir, "documents").select("doc_id", key.alias("key")).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return f.select("doc_id", "key", hashing.digest_mod(F.col("key"), 4).alias("slice"))


