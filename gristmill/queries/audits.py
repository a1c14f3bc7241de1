"""Keys, sentinel membership, criteria, reports and timing fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import hashing
from gristmill.operators import sentinel
from gristmill.operators._side import scratch, small
from gristmill.queries._base import query, table
from gristmill.queries.augment import _GRAMMAR
from gristmill.streaming import events as stream


@query("""WITH t AS (SELECT p_brand || '__' || p_type AS task, list_sort(list_distinct(list(p_size::VARCHAR))) AS o FROM part GROUP BY 1 UNION ALL SELECT p_brand, list_sort(list_distinct(list(p_size::VARCHAR))) FROM part GROUP BY 1) SELECT task, string_split(task, '__')[1] AS family, len(o) AS options, CASE WHEN len(o) > 40 THEN '>40' ELSE array_to_string(o, '|') END AS schema FROM t""")
def schema_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task's family by its old name, and its options as a key, which is one for all of over 40."""
    part = table(spark, sf_dir, "part")
    options = F.array_sort(F.collect_set(F.col("p_size").cast("string"))).alias("o")
    t = part.groupBy(F.concat("p_brand", F.lit("__"), "p_type").alias("task")).agg(options).unionAll(part.groupBy(F.col("p_brand").alias("task")).agg(options))
    return t.select("task", hashing.legacy_family(F.col("task")).alias("family"), F.size("o").cast("long").alias("options"), hashing.schema_tuple(F.col("o")).alias("schema"))


@query()
def blake_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit signed keys and shards by blake2b, which no engine has built in; a test holds them against hashlib."""
    docs = table(spark, sf_dir, "documents").select("doc_id", hashing.blake2b64(F.coalesce("text", F.lit(""))).alias("key"))
    return docs.select("doc_id", "key", F.pmod(F.col("key"), F.lit(8)).alias("shard"))


_LEGACY = ("none of the above", "Not on this list")


@query(f"""WITH {_GRAMMAR}, q AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'None of the options above applies' WHEN 1 THEN 'Not on this list' WHEN 2 THEN p_name ELSE 'Something else, not here' END AS option FROM part)
SELECT p_partkey, w.description IS NOT NULL OR option IN ('none of the above', 'Not on this list') AS sentinel, CASE WHEN option IN ('none of the above', 'Not on this list') THEN 'eval' ELSE w.split END AS split FROM q LEFT JOIN w ON w.description = option""")
def sentinel_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options that are wordings of the sentinel, old ones included, which are for evaluation."""
    k = F.col("p_partkey") % 4
    option = F.when(k == 0, "None of the options above applies").when(k == 1, "Not on this list").when(k == 2, F.col("p_name")).otherwise("Something else, not here")
    rows = table(spark, sf_dir, "part").select("p_partkey", option.alias("option"))
    return sentinel.marked(rows, "option", _LEGACY).select("p_partkey", "sentinel", "split")


@query(f"""WITH {_GRAMMAR}, n AS (SELECT description, row_number() OVER (ORDER BY description) - 1 AS i, count(*) OVER () AS n FROM w WHERE split = 'train') SELECT o_orderkey, description FROM orders JOIN n ON i = ('0x' || substr(sha256('0:' || o_orderkey), 1, 16))::UBIGINT % n""")
def sentinel_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wording of the training half for each question, every wording as likely."""
    return sentinel.picked(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "train").select("o_orderkey", "description")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '-|-|-' ELSE 'a|' || p_brand || '|c' END AS descriptions FROM part""")
def strip_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of some questions go, their number stays."""
    d = F.array(F.lit("a"), F.col("p_brand"), F.lit("c"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(sentinel.without_criteria(d, F.col("p_size") % 2 == 0), "|", "-").alias("descriptions"))


@query("""WITH d AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), g AS (SELECT lang, sum(n) AS n, count(*) AS tasks FROM d GROUP BY lang) SELECT '| ' || lang || ' | ' || n || ' | ' || tasks || ' |' AS line FROM g UNION ALL SELECT '| all | ' || sum(n) || ' | ' || sum(tasks) || ' |' FROM g""")
def domain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and tasks of each domain as Markdown lines."""
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("tasks"))
    whole = g.agg(F.lit("all").alias("lang"), F.sum("n").alias("n"), F.sum("tasks").alias("tasks"))
    return g.unionAll(whole).select(F.concat(F.lit("| "), "lang", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.col("tasks").cast("string"), F.lit(" |")).alias("line"))


@query("""WITH s AS (SELECT p_brand, ' ' || regexp_replace(lower(p_name || CASE WHEN p_partkey % 6 = 0 THEN ' by ' || p_brand || '!' ELSE '' END), '[^a-z0-9]+', ' ', 'g') || ' ' AS x FROM part) SELECT p_brand, count(*) AS n, round(avg(contains(x, ' ' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) || ' ')::INT), 6) AS leaked FROM s GROUP BY p_brand""")
def leakage_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of states that spell their answer out."""
    from gristmill.functions import text

    state = F.concat("p_name", F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit(" by "), "p_brand", F.lit("!"))).otherwise(""))
    leaked = text.spelled_out(F.col("p_brand"), state)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(leaked.cast("double")), 6).alias("leaked"))


@query("""WITH s AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN replace(props, ': ', ':') ELSE '{' || chr(10) || '    "k": 1,' || chr(10) || '    "l": 2' || chr(10) || '}' END AS x FROM events)
SELECT event_id, CASE WHEN regexp_matches(x, '^[{\\[]\\n') THEN length(regexp_extract(x, '^[{\\[]\\n( *)', 1)) END AS indent, regexp_extract(x, '"( *: *)', 1) AS colon, regexp_extract(x, '(,\\s*)', 1) AS comma FROM s""")
def json_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a state's JSON is laid out: indent, colon and comma, for edits that change nothing else."""
    k = F.col("event_id") % 3
    x = F.when(k == 0, F.col("props")).when(k == 1, F.replace("props", F.lit(": "), F.lit(":"))).otherwise('{\n    "k": 1,\n    "l": 2\n}')
    e = table(spark, sf_dir, "events").select("event_id", x.alias("x"))
    indent = F.when(F.regexp_like("x", F.lit(r"^[{\[]\n")), F.length(F.regexp_extract("x", r"^[{\[]\n( *)", 1)).cast("long"))
    return e.select("event_id", indent.alias("indent"), F.regexp_extract("x", '"( *: *)', 1).alias("colon"), F.regexp_extract("x", r"(,\s*)", 1).alias("comma"))


@query("""WITH t AS (SELECT p_brand AS task, p_type AS generator FROM part UNION ALL SELECT 'Brand#11', 'other') SELECT task, count(DISTINCT generator) AS generators FROM t GROUP BY task HAVING count(DISTINCT generator) > 1""")
def duplicate_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that more than one generator uses, which a build refuses."""
    t = table(spark, sf_dir, "part").select(F.col("p_brand").alias("task"), F.col("p_type").alias("generator"))
    both = t.unionAll(spark.createDataFrame([("Brand#11", "other")], t.schema))
    return both.groupBy("task").agg(F.count_distinct("generator").alias("generators")).where("generators > 1")


@query("""SELECT 'doc' AS probe, doc_id AS id, lang FROM documents UNION ALL SELECT 'bench', item_id, NULL FROM benchmark""")
def probe_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe sets as one, by column names."""
    a = table(spark, sf_dir, "documents").select(F.lit("doc").alias("probe"), F.col("doc_id").alias("id"), "lang")
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("bench").alias("probe")), allowMissingColumns=True)


@query("""SELECT o_orderkey, o_orderdate AS created, o_orderdate + to_days((o_orderkey % 9)::INT) AS closed, o_orderkey % 9 < 1 AS early FROM orders""")
def market_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Millisecond fields of a record as times, and whether it closed within a minute of its resolution."""
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    later = ms + (F.col("o_orderkey") % 9) * 86_400_000
    record = F.to_json(F.struct(ms.alias("createdTime"), later.alias("closeTime")))
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.from_json(record, "createdTime long, closeTime long").alias("r"))
    at = lambda c: F.timestamp_millis(F.col(f"r.{c}")).cast("timestamp_ntz")
    return r.select("o_orderkey", at("createdTime").alias("created"), at("closeTime").alias("closed"), (F.abs(F.col("r.closeTime") - F.col("r.createdTime")) <= 60_000).alias("early"))


@query("""WITH q AS (SELECT year(o_orderdate) * 4 + quarter(o_orderdate) AS quarter, month(o_orderdate) % 3 AS vintage, round(sum(o_totalprice), 2) AS level FROM orders GROUP BY ALL), f AS (SELECT quarter, arg_min(level, vintage) AS first, min(vintage) AS vintage FROM q GROUP BY quarter), g AS (SELECT a.quarter, a.first, b.level AS before FROM f a LEFT JOIN q b ON b.quarter = a.quarter - 1 AND b.vintage = a.vintage) SELECT quarter::BIGINT AS quarter, first < before AS declined FROM g""")
def first_published_decline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a quarter fell as first published: against the quarter before in the same vintage; null where that lacks it."""
    quarter = (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("long")
    q = table(spark, sf_dir, "orders").groupBy(quarter.alias("quarter"), (F.month("o_orderdate") % 3).alias("vintage")).agg(F.round(F.sum("o_totalprice"), 2).alias("level"))
    f = q.groupBy("quarter").agg(F.min_by("level", "vintage").alias("first"), F.min("vintage").alias("vintage"))
    before = q.select((F.col("quarter") + 1).alias("quarter"), "vintage", F.col("level").alias("before"))
    return f.join(before, ["quarter", "vintage"], "left").select("quarter", (F.col("first") < F.col("before")).alias("declined"))


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha1('4:' || doc_id), doc_id) AS r FROM documents) SELECT doc_id, source FROM r WHERE r <= 3""")
def class_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rows of each class by digest: a sampling operator."""
    from gristmill.operators import balance as B

    return B.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], 3, 4, "doc_id").select("doc_id", "source")


@query("""WITH m AS (SELECT 't' || n_nationkey AS task, CASE n_regionkey WHEN 0 THEN 'africa' WHEN 1 THEN 'america' END AS domain FROM nation), d AS (SELECT 't' || label AS task, count(*) AS n FROM embeddings GROUP BY 1) SELECT coalesce(domain, 'unmapped') AS domain, count(*) AS tasks, sum(n)::BIGINT AS questions FROM d LEFT JOIN m USING (task) GROUP BY 1""")
def dump_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dump's tasks meet the corpus's metadata; tasks that it lacks stand as unmapped."""
    m = table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("task"), F.when(F.col("n_regionkey") == 0, "africa").when(F.col("n_regionkey") == 1, "america").alias("domain"))
    d = table(spark, sf_dir, "embeddings").groupBy(F.concat(F.lit("t"), F.col("label").cast("string")).alias("task")).agg(F.count(F.lit(1)).alias("n"))
    return d.join(small(m), "task", "left").groupBy(F.coalesce("domain", F.lit("unmapped")).alias("domain")).agg(F.count(F.lit(1)).alias("tasks"), F.sum("n").alias("questions"))


@query("""SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY event_type""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events taken in without repeats, run to its end."""
    out = scratch(spark)
    source = spark.readStream.schema(stream.SCHEMA).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    rows = stream.ingest(source)
    rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))

