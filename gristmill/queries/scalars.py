"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import arrays, hashing, text
from gristmill.queries._base import query, table


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)
SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct, list_aggregate(w, 'max') AS last_token FROM t""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.array_max("w").alias("last_token"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
s AS (SELECT doc_id, w, list_distinct(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i+9], ' '))) AS g FROM t)
SELECT doc_id, (CASE WHEN len(w) >= 10 THEN len(g) WHEN len(w) > 0 THEN 1 ELSE 0 END)::BIGINT AS n_shingles FROM s""")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size(text.shingles(F.col("w"), 10, short=True)).cast("long").alias("n_shingles"))


@query("""SELECT p_partkey, replace(p_type, ' ', '') AS name,
trim(regexp_replace(lower(regexp_replace(regexp_replace(replace(p_type, ' ', 'X'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9]+', '_', 'g')) AS snake FROM part""")
def snake_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace("p_type", F.lit(" "), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), text.snake_case(F.replace("p_type", F.lit(" "), F.lit("X"))).alias("snake"))


@query("""SELECT event_id, substr(trim(regexp_replace(regexp_replace(lower(event_type || ' ' || props || ' ' || event_id), '\\b[0-9a-f]*[0-9][0-9a-f]*\\b', '#', 'g'), '\\s+', ' ', 'g')), 1, 40) AS skeleton FROM events""")
def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(" ", "event_type", "props", F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", text.skeleton(line, 40).alias("skeleton"))


@query("""WITH x AS (SELECT conv_id, turn, role || ': ' || coalesce(text, '') || chr(10) || 'Note: ' || role || chr(10) || 'end' AS t FROM conversations)
SELECT conv_id, turn, sha256(regexp_replace(t, '(?im)^(user|assistant|system|note)\\s*:.*\\n?', '', 'g')) AS rest FROM x""")
def strip_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\nNote: "), "role", F.lit("\nend"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(text.strip_headers(t, ("user", "assistant", "system", "note")), 256).alias("rest"))


@query("""WITH w AS (SELECT n_nationkey, n_name, list_transform(list_filter(string_split(lower(n_name), ' '), lambda w: length(w) >= 4), lambda w: coalesce(nullif(rtrim(w, 's'), ''), w)) AS stems FROM nation), l AS (SELECT *, 'we ship to ' || lower(n_name) || 's, ' || n_name || ' and region' AS line FROM w)
SELECT n_nationkey, CASE WHEN len(stems) > 0 THEN regexp_replace(line, '(?i)\\b(' || array_to_string(list_reverse(list_sort(list_distinct(stems))), '|') || ')s?\\b', '[REDACTED]', 'g') ELSE line END AS scrubbed FROM l""")
def scrub_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's own label goes from its line, words of four letters or more, with or without a plural s."""
    line = F.concat(F.lit("we ship to "), F.lower("n_name"), F.lit("s, "), "n_name", F.lit(" and region"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.scrub_by(line, F.col("n_name")).alias("scrubbed"))


@query("""SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL WHEN length(text) <= 60 THEN text WHEN instr(reverse(substr(text, 1, 60)), ' ') > 0 AND 60 - instr(reverse(substr(text, 1, 60)), ' ') > 30
THEN substr(text, 1, 60 - instr(reverse(substr(text, 1, 60)), ' ')) ELSE substr(text, 1, 60) END AS head FROM conversations""")
def cut_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.cut_words(F.col("text"), 60).alias("head"))


@query("""SELECT n_nationkey, r_regionkey, contains(' ' || regexp_replace(lower(n_name || ', ' || r_name || '!'), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || regexp_replace(lower(trim(r_name)), '[^a-z0-9]+', ' ', 'g') || ' ') AS own,
contains(' ' || regexp_replace(lower(n_name || 'x'), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || regexp_replace(lower(trim(n_name)), '[^a-z0-9]+', ' ', 'g') || ' ') AS inside FROM nation JOIN region ON n_regionkey = r_regionkey""")
def spelled_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_nationkey", "r_regionkey", text.spelled_out(F.col("r_name"), F.concat("n_name", F.lit(", "), "r_name", F.lit("!"))).alias("own"), text.spelled_out(F.col("n_name"), F.concat("n_name", F.lit("x"))).alias("inside"))


@query("""WITH v(i, t) AS (VALUES (0, 'Is {state} about {topic}?'), (1, 'Does {state} concern {topic}?'), (2, '{topic}: does {state} fit?'))
SELECT c.conv_id, c.turn, v.t AS phrasing FROM conversations c JOIN v ON v.i = ('0x' || substr(sha1('Is {state} about {topic}?' || '|' || c.conv_id || ':' || c.turn), 1, 16))::UBIGINT % 3""")
def phrasing_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the variants with the template's placeholders, the one that the digest of template and key picks."""
    bank = ["Is {state} about {topic}?", "Does {state} concern {topic}?", "{topic}: does {state} fit?", "What of {state}?"]
    template, key = F.lit(bank[0]), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    fits = F.filter(F.array(*map(F.lit, bank)), lambda v: F.size(F.array_except(text.placeholders(template), text.placeholders(v))) == 0)
    draw = F.conv(F.substring(F.sha1(F.concat(template, F.lit("|"), key)), 1, 16), 16, 10).cast("decimal(20,0)") % F.size(fits)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(fits, (draw + 1).cast("int")).alias("phrasing"))


@query("""SELECT doc_id, len(regexp_extract_all(text || CASE WHEN doc_id % 7 = 0 THEN ' {slot}' ELSE '' END, '\\{([a-z_]+)\\}', 1))::BIGINT AS n_unfilled FROM documents""")
def unfilled_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("text", F.when(F.col("doc_id") % 7 == 0, " {slot}").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all(t, F.lit(r"\{([a-z_]+)\}"), F.lit(1))).cast("long").alias("n_unfilled"))


@query("""SELECT o_orderkey, CASE WHEN regexp_matches(o, '^\\s*[-+]?[0-9]+(\\.[0-9]+)?\\s*$') THEN 'numeric' WHEN lower(trim(o)) IN ('yes','no','true','false') THEN 'boolean' WHEN upper(o) = o AND regexp_matches(o, '[A-Z]') THEN 'upper'
WHEN len(string_split_regex(trim(o), '\\s+')) = 1 THEN 'word' WHEN len(string_split_regex(trim(o), '\\s+')) <= 5 THEN 'phrase' ELSE 'sentence' END AS shape
FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus WHEN 2 THEN lower(o_orderpriority) ELSE o_orderkey::VARCHAR END AS o FROM orders)""")
def option_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    o = F.when(k == 0, F.col("o_orderpriority")).when(k == 1, F.col("o_orderstatus")).when(k == 2, F.lower("o_orderpriority")).otherwise(F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.surface(o).alias("shape"))


@query("""SELECT p_partkey, array_to_string(list_sort(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')), ' ') AS alias FROM part""")
def alias_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.alias_key(F.col("p_name")).alias("alias"))


@query("""SELECT event_id, CASE upper(trim(event_type)) WHEN 'ERROR' THEN 'error' END AS level, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def level_and_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", text.canonical_level(F.col("event_type")).alias("level"), k.alias("k"))


@query("""WITH b AS (SELECT doc_id, source, lang, ('0x' || substr(sha256('0:' || source || doc_id), 1, 16))::UBIGINT % 100 AS h FROM documents)
SELECT doc_id, CASE WHEN doc_id % 51 + 1 IN (11, 25) THEN 'testreal' WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'devreal' ELSE 'testreal' END AS split,
regexp_replace(source || CASE doc_id % 3 WHEN 0 THEN '_eval' WHEN 1 THEN '_x' ELSE '' END, '_(eval|dev|test|train|probe)$', '') AS family FROM b""")
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = F.concat("source", F.col("doc_id").cast("string"))
    suffix = F.when(F.col("doc_id") % 3 == 0, "_eval").when(F.col("doc_id") % 3 == 1, "_x").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", hashing.split_of(task, F.col("doc_id") % 51 + 1).alias("split"), hashing.family_of(F.concat("source", suffix)).alias("family"))


@query("""SELECT p_partkey, [0, 0, 1, 2][(('0x' || substr(sha256(p_name), 1, 16))::UBIGINT % 4)::BIGINT + 1]::BIGINT AS part, ('0x' || substr(sha256(p_name), 1, 2))::BIGINT % 2 AS parity, ('0x' || substr(sha256(p_name), 3, 2))::BIGINT % 5 AS fifth,
CASE WHEN ('0x' || substr(sha256(p_type), 1, 16))::UBIGINT % 1000 < 200 THEN 'eval' ELSE 'train' END AS wording,
CASE WHEN p_size % 5 <= 1 THEN 'train' WHEN p_size % 5 <= 3 THEN CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'dev' ELSE 'test' END WHEN h < 50 THEN 'dev' ELSE 'test' END AS sig_split
FROM (SELECT *, ('0x' || substr(sha256(p_brand || p_partkey), 1, 16))::UBIGINT % 100 AS h FROM part)""")
def hash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parity, fifth = hashing.parity_bucket(F.col("p_name"))
    signature = F.concat("p_brand", F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", hashing.weighted_part(F.col("p_name")).cast("long").alias("part"), parity.alias("parity"), fifth.alias("fifth"), hashing.wording_split(F.col("p_type")).alias("wording"), hashing.signature_split(signature, F.col("p_size") % 5).alias("sig_split"))


@query("""SELECT doc_id, sha256(source || chr(31) || text || chr(31) || doc_id || chr(31) || 'Good?' || chr(31) || '' || chr(31) || 'no' || chr(31) || 'yes') AS question_key,
substr(sha256('["' || source || '",["yes","no"]]'), 1, 20) AS schema_key FROM documents""")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.array(F.lit("yes"), F.lit("no"))
    key = hashing.question_key(F.col("source"), F.col("text"), F.col("doc_id").cast("string"), F.lit("Good?"), F.lit(None).cast("string"), options)
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("question_key"), hashing.schema_key(F.col("source"), options).alias("schema_key"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, 1.0), 50.0)::DOUBLE AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN v <= 10 THEN (10 - v) / 9 ELSE 0 END, 6) AS w1, round(CASE WHEN v <= 10 THEN (v - 1) / 9 WHEN v <= 30 THEN (30 - v) / 20 ELSE 0 END, 6) AS w2,
round(CASE WHEN v <= 10 THEN 0 WHEN v <= 30 THEN (v - 10) / 20 ELSE (50 - v) / 20 END, 6) AS w3, round(CASE WHEN v <= 30 THEN 0 ELSE (v - 30) / 20 END, 6) AS w4 FROM p""")
def interp_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = arrays.interp(F.col("l_quantity").cast("double"), F.array(*(F.lit(float(x)) for x in (1, 10, 30, 50))))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", w.alias("w"))
    return rows.select("l_orderkey", "l_linenumber", *(F.round(F.col("w")[i], 6).alias(f"w{i + 1}") for i in range(4)))


@query("""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 9 DAY, '%Y%m%d%H') AS valid_cycle, (year(o_orderdate) * 4 + quarter(o_orderdate) - 1 + 5)::BIGINT // 4 AS y5, (year(o_orderdate) * 4 + quarter(o_orderdate) - 1 + 5)::BIGINT % 4 + 1 AS q5,
date_diff('day', o_orderdate::DATE, DATE '1999-01-01')::BIGINT AS days_before FROM orders""")
def date_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid time of a forecast lead, a quarter five quarters on, days before a reference date."""
    i = F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1 + 5
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 9 DAYS"), "yyyyMMddHH").alias("valid_cycle"), F.floor(i / 4).cast("long").alias("y5"), (i % 4 + 1).cast("long").alias("q5"), F.datediff(F.lit("1999-01-01").cast("date"), F.col("o_orderdate").cast("date")).cast("long").alias("days_before"))
