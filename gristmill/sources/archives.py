"""Zipped lines, spreadsheets, nested feeds and multi-file treebanks, with what the standard library reads."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def zipped_lines(spark: SparkSession, path: str, suffix: str = ".jsonl") -> DataFrame:
    """(file, member, value): lines of the members of zip files whose name ends in suffix; one task a file."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            for file, content in zip(own["path"], own["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(suffix)):
                        rows: list[str] = []
                        for line in io.TextIOWrapper(z.open(name), "utf-8", newline="\n"):
                            if line.strip():
                                rows.append(line.rstrip("\n"))
                            if len(rows) >= 10_000:
                                yield pd.DataFrame({"file": file, "member": name, "value": rows})
                                rows = []
                        yield pd.DataFrame({"file": file, "member": name, "value": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, member string, value string")


def sheet_rows(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(file, row, cells): cells of a workbook's sheet by column letters, as text; shared and inline strings resolved."""
    def text(node: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in node.iter(f"{_SHEET}t"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            for file, content in zip(own["path"], own["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    shared = [text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
                    rows = []
                    for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter(f"{_SHEET}row"):
                        cells = {}
                        for c in row.iter(f"{_SHEET}c"):
                            value = c.find(f"{_SHEET}v")
                            kind = c.get("t")
                            got = text(c) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
                            if got is not None:
                                cells[c.get("r").rstrip("0123456789")] = got
                        rows.append((file, int(row.get("r")), cells))
                yield pd.DataFrame(rows, columns=["file", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, row int, cells map<string,string>")


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file by the session's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


_METRIC = "array<struct<type:string,cvssData:struct<baseScore:double,baseSeverity:string,attackVector:string>>>"
FEED = f"vulnerabilities array<struct<cve:struct<id:string,vulnStatus:string,descriptions:array<struct<lang:string,value:string>>,metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC}>,weaknesses:array<struct<description:array<struct<lang:string,value:string>>>>>>>"


def vulnerabilities(spark: SparkSession, path: str) -> DataFrame:
    """id, description, score, severity, vector, weakness of each vulnerability of a feed's pages (one a line) that isn't rejected; the primary score, or else the first."""
    each = spark.read.schema(FEED).json(path).select(F.explode("vulnerabilities").alias("v")).select("v.cve.*")
    metrics = F.coalesce(F.when(F.size("metrics.cvssMetricV31") > 0, F.col("metrics.cvssMetricV31")), F.col("metrics.cvssMetricV30"))
    best = F.coalesce(F.get(F.filter(metrics, lambda m: m["type"] == "Primary"), F.lit(0)), F.get(metrics, F.lit(0)))["cvssData"]
    english = F.get(F.filter("descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"]
    weakness = F.get(F.filter(F.flatten(F.transform("weaknesses", lambda w: w["description"])), lambda d: F.startswith(d["value"], F.lit("CWE-"))), F.lit(0))["value"]
    kept = each.where(F.coalesce(F.col("vulnStatus"), F.lit("")) != "Rejected")
    return kept.select("id", english.alias("description"), best["baseScore"].alias("score"), best["baseSeverity"].alias("severity"), best["attackVector"].alias("vector"), weakness.alias("weakness"))


def treebank(sentences: DataFrame, splits: DataFrame, dictionary: DataFrame, scores: DataFrame) -> DataFrame:
    """sentence, split, score of a treebank's files: sentences (index, sentence), splits (index, split), dictionary (phrase, id), scores (id, score).

    A sentence meets its phrase after brackets, spaces and case are made the same.
    """
    from gristmill.functions import scrub

    norm = lambda c: F.lower(scrub.plain_brackets(F.col(c)))
    phrases = dictionary.select(norm("phrase").alias("key"), "id").groupBy("key").agg(F.min("id").alias("id"))
    return sentences.withColumn("key", norm("sentence")).join(splits, "index").join(phrases, "key").join(scores, "id").select("index", "sentence", "split", "score")


def row_sample(rows: DataFrame, key: str, every: int, seed: int = 0) -> DataFrame:
    """One in `every` rows by digest of a key: a sample that is the same wherever it is drawn."""
    from gristmill.functions import hashing

    return rows.where(hashing.digest_mod(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), every) == 0)


def cloze(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, state, answer): each categorical cell of a row masked in turn, the others as `name: value` lines."""
    cell = lambda c: F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("answer"))
    lines = F.array(*(F.struct(F.lit(c).alias("column"), F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("line")) for c in columns))
    made = rows.select(key, lines.alias("lines"), F.explode(F.array(*map(cell, columns))).alias("c")).where(F.col("c.answer").isNotNull())
    shown = F.transform("lines", lambda x: F.when(x["column"] == F.col("c.column"), F.concat(x["column"], F.lit(": [MASKED]"))).otherwise(x["line"]))
    return made.select(key, "c.column", F.array_join(shown, "\n").alias("state"), "c.answer")


def enum_fields(specs: DataFrame, column: str, key: str) -> DataFrame:
    """(key, path, options): fields of a JSON document that hold an array of strings under `enum`, wherever they stand."""
    tree = specs.select(key, F.expr(f"try_parse_json({column})").alias("v"))
    out = None
    level = tree.select(key, F.lit("").alias("path"), "v")
    for _ in range(4):  # properties nest four levels deep at most here
        level = level.select(key, "path", F.expr("try_variant_get(v, '$.properties', 'map<string,variant>')").alias("m")).where("m is not null").select(key, "path", F.explode("m").alias("name", "v"))
        level = level.select(key, F.concat(F.when(F.col("path") != "", F.concat("path", F.lit("."))).otherwise(""), "name").alias("path"), "v")
        found = level.select(key, "path", F.expr("try_variant_get(v, '$.enum', 'array<string>')").alias("options")).where("options is not null")
        out = found if out is None else out.unionAll(found)
    return out
