"""Readers and writers: tables are written in a source's format to the shared folder and read back."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators._side import scratch
from gristmill.sources import archives, jsonl
from gristmill.queries._base import query, table


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as typed examples: hard and soft targets, and one without a question in seven."""
    k = F.col("doc_id")
    target = F.when(k % 3 == 0, F.lit("[0.25, 0.75]")).when(k % 3 == 1, (k % 2).cast("string"))
    q = F.struct(F.lit("q").alias("id"), F.lit("Good?").alias("question"), F.array(F.lit("no"), F.lit("yes")).alias("options"), target.alias("target"), F.to_json(F.struct(k.alias("doc"))).alias("meta"), F.lit(None).cast("string").alias("instructions"), F.lit(None).cast("array<string>").alias("descriptions"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("task"), F.coalesce("text", F.lit("")).alias("state"), F.when(k % 7 == 0, F.array().cast(f"array<{jsonl.QUESTION}>")).otherwise(F.array(q)).alias("questions"))


def _written(spark: SparkSession, rows: DataFrame) -> str:
    path = scratch(spark)
    jsonl.write_examples(rows, path)
    return path


@query("""WITH e AS (SELECT source AS task, coalesce(text, '') AS state, doc_id % 7 = 0 AS bare, CASE WHEN doc_id % 3 = 1 THEN doc_id % 2 END AS i, doc_id % 3 = 0 AS soft FROM documents) SELECT task, count(*) AS rows, sum((NOT bare)::INT)::BIGINT AS questions, round(coalesce(sum(CASE WHEN bare THEN 0 WHEN soft THEN 0.75 WHEN i = 1 THEN 1 ELSE 0 END), 0), 6) AS yes, sum((NOT bare AND NOT soft AND i IS NULL)::INT)::BIGINT AS unlabelled, sum(length(state))::BIGINT AS characters FROM e GROUP BY task""")
def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples written as JSON lines and read as typed ones: hard targets, soft targets, none."""
    q = jsonl.questions(jsonl.examples(spark, _written(spark, _examples(spark, sf_dir))))
    probs = jsonl.target_probs(F.col("target_index"), F.col("target_probs"), F.col("options"))
    x = q.select("task", "state", "id", probs.alias("p"))
    return x.groupBy("task").agg(F.count(F.lit(1)).alias("rows"), F.count("id").alias("questions"), F.round(F.coalesce(F.sum(F.coalesce(F.col("p")[1], F.lit(0.0))), F.lit(0.0)), 6).alias("yes"), F.count_if(F.col("id").isNotNull() & F.col("p").isNull()).alias("unlabelled"), F.sum(F.length("state")).alias("characters"))


@query("""SELECT md5('line ' || event_id || ' ' || props) AS digest, count(*) AS n FROM events GROUP BY 1""")
def verbatim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines pass through as they are, blank ones left out."""
    path = scratch(spark)
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("line "), F.col("event_id").cast("string"), F.lit(" "), "props").alias("value"))
    jsonl.write_lines(lines.unionAll(spark.createDataFrame([("",), ("  ",)], "value string")), path)
    return jsonl.lines(spark, path).groupBy(F.md5("value").alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE event_id % 9 > 0 GROUP BY event_type""")
def tolerant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed lines are skipped where a reader is told so."""
    path = scratch(spark)
    e = table(spark, sf_dir, "events")
    good = F.to_json(F.struct("event_id", "event_type", "value"))
    jsonl.write_lines(e.select(F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(good).alias("value")), path)
    rows = jsonl.records(spark, path, "event_id long, event_type string, value double", strict=False)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("""SELECT n_nationkey % 3 AS part, count(*) AS rows FROM nation GROUP BY 1 UNION ALL SELECT -1, count(*) FROM nation""")
def store_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each file of a store, by key, and all of them."""
    path = scratch(spark)
    n = table(spark, sf_dir, "nation")
    for k in range(3):
        jsonl.write_examples(n.where(F.col("n_nationkey") % 3 == k).coalesce(1), f"{path}/key={k}")
    files = jsonl.inventory(spark, f"{path}/key=*")
    whole = files.agg(F.lit(-1).alias("part"), F.sum("rows").alias("rows"))
    parts = spark.read.text(path).groupBy(F.col("key").alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    return parts.unionAll(whole)


@query("""SELECT r_name AS "column", (r_regionkey * 10 + i)::INT AS code, i::INT AS "index" FROM (SELECT r_name, r_regionkey, unnest(range(3)) AS i FROM region)""")
def class_name_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sidecar of class names, one row a name."""
    path = scratch(spark)
    r = table(spark, sf_dir, "region")
    names = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.col("r_regionkey") * 10 + i).cast("string"))
    r.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", names)))).alias("value")).coalesce(1).write.text(path)  # five regions
    return jsonl.class_names(spark, path).select("column", F.col("name").cast("int").alias("code"), "index")


_KINDS = ("parquet", "csv", "tsv", "json", "jsonl")


@query("""SELECT kind, count(*) AS rows, round(sum(s_acctbal), 2) AS balance, count(DISTINCT s_name) AS names FROM supplier, (SELECT unnest(['parquet', 'csv', 'tsv', 'json', 'jsonl']) AS kind) GROUP BY kind""")
def snapshot_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table in five formats, read by kind."""
    s = table(spark, sf_dir, "supplier")
    out = None
    for kind in _KINDS:
        path = scratch(spark)
        w = s.write
        if kind == "parquet":
            w.parquet(path)
        elif kind in ("csv", "tsv"):
            w.option("header", "true").option("sep", "," if kind == "csv" else "\t").csv(path)
        elif kind == "json":
            s.agg(F.to_json(F.collect_list(F.struct(*s.columns))).alias("value")).write.text(path)  # one document is one value
        else:
            w.option("compression", "gzip").json(path)
        own = jsonl.snapshot(spark, path, kind).select(F.lit(kind).alias("kind"), F.col("s_acctbal").cast("double").alias("b"), "s_name")
        out = own if out is None else out.unionAll(own)
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("b"), 2).alias("balance"), F.count_distinct("s_name").alias("names"))


@query("""SELECT unnest(['train', 'train_extra', 'test']) AS name, unnest([true, true, false]) AS legal""")
def legal_split_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["train", "train_extra", "test"]
    return spark.createDataFrame([(n, n in jsonl.legal_splits(names)) for n in names], "name string, legal boolean")


@query("""SELECT '| ' || s_name || ' | t' || s_nationkey || ' | ' || s_suppkey || ' |' AS line FROM supplier""")
def provenance_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance as Markdown lines."""
    s = table(spark, sf_dir, "supplier")
    return jsonl.manifest(s.select(F.col("s_name").alias("generator"), F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("task"), "s_suppkey"))


@query("""WITH v AS (SELECT p_partkey, p_size, p_brand FROM part WHERE p_size % 7 > 0) SELECT 'CVE-' || p_partkey AS id, 'part ' || p_brand AS description, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 3 = 0 THEN p_size / 10.0 ELSE p_size / 5.0 END AS score, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 3 = 0 THEN 'LOW' ELSE 'HIGH' END AS severity, CASE WHEN p_size % 4 > 0 THEN 'CWE-' || p_size END AS weakness FROM v""")
def vulnerability_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed's nested pages: rejected ones go, the primary score counts."""
    k, s = F.col("p_partkey"), F.col("p_size")
    metric = lambda kind, score, sev: F.struct(F.lit(kind).alias("type"), F.struct(score.alias("baseScore"), F.lit(sev).alias("baseSeverity"), F.lit("NETWORK").alias("attackVector")).alias("cvssData"))
    second, first = metric("Secondary", s / 100.0, "NONE"), metric("Primary", s / 5.0, "HIGH")
    v31 = F.when((s % 5 == 0) | (s % 3 == 0), F.array().cast(archives._METRIC)).otherwise(F.array(second, first))
    v30 = F.when(s % 5 == 0, F.array().cast(archives._METRIC)).otherwise(F.array(metric("Secondary", s / 10.0, "LOW")))
    words = F.array(F.struct(F.lit("fr").alias("lang"), F.lit("x").alias("value")), F.struct(F.lit("en").alias("lang"), F.concat(F.lit("part "), "p_brand").alias("value")))
    weak = F.array(F.struct(F.array(F.struct(F.lit("en").alias("lang"), F.when(s % 4 > 0, F.concat(F.lit("CWE-"), s.cast("string"))).otherwise("NVD-noinfo").alias("value"))).alias("description")))
    cve = F.struct(F.concat(F.lit("CVE-"), k.cast("string")).alias("id"), F.when(s % 7 == 0, "Rejected").otherwise("Analyzed").alias("vulnStatus"), words.alias("descriptions"), F.struct(v31.alias("cvssMetricV31"), v30.alias("cvssMetricV30")).alias("metrics"), weak.alias("weaknesses"))
    path = scratch(spark)
    pages = table(spark, sf_dir, "part").groupBy(F.floor(k / 50)).agg(F.collect_list(F.struct(cve.alias("cve"))).alias("vulnerabilities"))  # 50 a page
    pages.select("vulnerabilities").write.json(path)
    return archives.vulnerabilities(spark, path).select("id", "description", "score", "severity", "weakness")


@query("""SELECT s_suppkey AS "index", 'A ( b ) "' || s_name || '" .' AS sentence, (['train', 'dev', 'test'])[(s_suppkey % 3 + 1)::INT] AS split, s_nationkey / 25.0 AS score FROM supplier""")
def treebank_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four files of a treebank meet on normalised phrases."""
    s = table(spark, sf_dir, "supplier")
    i = F.col("s_suppkey")
    plain = F.concat(F.lit('A ( b ) "'), "s_name", F.lit('" .'))
    coded = F.concat(F.lit("a -LRB- b -RRB- ``"), F.upper("s_name"), F.lit("'' ."))
    split = F.element_at(F.array(*map(F.lit, ("train", "dev", "test"))), (i % 3 + 1).cast("int"))
    return archives.treebank(s.select(i.alias("index"), plain.alias("sentence")), s.select(i.alias("index"), split.alias("split")), s.select(coded.alias("phrase"), (i + 1000).alias("id")), s.select((i + 1000).alias("id"), (F.col("s_nationkey") / 25.0).alias("score")))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE ('0x' || substr(sha256('0:' || (l_orderkey * 10 + l_linenumber)), 1, 16))::UBIGINT % 10 = 0""")
def row_digest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the rows by digest, in place of every k-th row group: a sampling operator."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return archives.row_sample(rows, "k", 10).drop("k")


@query("""WITH c AS (SELECT c_custkey, c_mktsegment AS segment, 'n' || c_nationkey AS nation FROM customer) SELECT c_custkey, 'segment' AS "column", 'segment: [MASKED]' || chr(10) || 'nation: ' || nation AS state, segment AS answer FROM c WHERE segment IS NOT NULL UNION ALL SELECT c_custkey, 'nation', 'segment: ' || segment || chr(10) || 'nation: [MASKED]', nation FROM c""")
def masked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each categorical cell masked in turn."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("nation"))
    return archives.cloze(c, "c_custkey", ["segment", "nation"])


@query("""SELECT s_suppkey, 'kind' AS path, 'a,b' || s_nationkey AS options FROM supplier UNION ALL SELECT s_suppkey, 'inner.mode', 'x,y,z' FROM supplier WHERE s_nationkey % 2 = 0""")
def schema_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enumerated fields of nested schemas."""
    n = F.col("s_nationkey").cast("string")
    inner = F.when(F.col("s_nationkey") % 2 == 0, F.lit('{"properties":{"mode":{"enum":["x","y","z"]},"free":{"type":"string"}}}')).otherwise(F.lit('{"type":"object"}'))
    spec = F.concat(F.lit('{"properties":{"kind":{"enum":["a","b'), n, F.lit('"]},"size":{"type":"integer"},"inner":'), inner, F.lit("}}"))
    e = archives.enum_fields(table(spark, sf_dir, "supplier").select("s_suppkey", spec.alias("spec")), "spec", "s_suppkey")
    return e.select("s_suppkey", "path", F.array_join("options", ",").alias("options"))


@query("""SELECT n_nationkey, n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey""")
def zipped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a zip file's members, one member a region."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.to_json(F.struct("n_nationkey", "n_name")).alias("v"), "r_name").collect()  # 25 nations
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for region in sorted({r.r_name for r in n}):
            z.writestr(f"data/{region}.jsonl", "\n\n".join(r.v for r in n if r.r_name == region) + "\n")
        z.writestr("README.txt", "not data")
    path = scratch(spark)
    archives.write_bytes(spark, f"{path}/set.zip", buffer.getvalue())
    lines = archives.zipped_lines(spark, path)
    parsed = F.from_json("value", "n_nationkey int, n_name string")
    return lines.select(parsed.alias("x"), F.regexp_extract("member", r"data/(.*)\.jsonl", 1).alias("region")).select("x.n_nationkey", F.col("x.n_name").alias("name"), "region")


@query("""SELECT n_name AS name, n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'even' END AS note FROM nation""")
def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook's rows: shared strings, inline strings, numbers and empty cells."""
    from xml.sax.saxutils import escape

    n = sorted((r.n_nationkey, r.n_name) for r in table(spark, sf_dir, "nation").collect())  # 25 nations
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = f"<sst {space}>" + "".join(f"<si><t>{escape(name)}</t></si>" for _, name in n) + "</sst>"
    row = lambda i, k: f'<row r="{i + 2}"><c r="A{i + 2}" t="s"><v>{i}</v></c><c r="B{i + 2}"><v>{k}</v></c>' + (f'<c r="C{i + 2}" t="inlineStr"><is><t>even</t></is></c>' if k % 2 == 0 else f'<c r="C{i + 2}"/>') + "</row>"
    sheet = f'<worksheet {space}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>name</t></is></c></row>' + "".join(row(i, k) for i, (k, _) in enumerate(n)) + "</sheetData></worksheet>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", shared)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    path = scratch(spark)
    archives.write_bytes(spark, f"{path}/book.xlsx", buffer.getvalue())
    rows = archives.sheet_rows(spark, path).where("row > 1")
    return rows.select(F.col("cells")["A"].alias("name"), F.col("cells")["B"].alias("key"), F.try_element_at("cells", F.lit("C")).alias("note"))
