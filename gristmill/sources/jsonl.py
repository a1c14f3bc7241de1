"""JSON-lines corpora: typed examples, verbatim lines, tolerant raw rows, sidecars; and their writers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "struct<id:string,question:string,options:array<string>,target:string,meta:string,instructions:string,descriptions:array<string>>"
EXAMPLE = f"task string, state string, questions array<{QUESTION}>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they are, blank ones left out; column value."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0)


def records(spark: SparkSession, path: str, schema: str = EXAMPLE, strict: bool = True) -> DataFrame:
    """Typed rows.  strict fails on a malformed line; else such lines are skipped."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def examples(spark: SparkSession, path: str) -> DataFrame:
    """Examples with each target as an index (hard) or probabilities (soft), both null where unlabelled."""
    rows = records(spark, path)

    def typed(q: Column) -> Column:
        index = F.try_element_at(F.filter(F.array(q["target"].try_cast("int")), lambda x: x.isNotNull()), F.lit(1))
        return F.struct(q["id"].alias("id"), q["question"].alias("question"), q["options"].alias("options"), index.alias("target_index"), F.from_json(q["target"], "array<double>").alias("target_probs"), q["meta"].alias("meta"), q["instructions"].alias("instructions"), q["descriptions"].alias("descriptions"))

    return rows.select("task", "state", F.transform("questions", typed).alias("questions"))


def questions(examples: DataFrame) -> DataFrame:
    """One row a question, with its position; examples without any keep one row of nulls."""
    return examples.select("task", "state", F.posexplode_outer("questions").alias("position", "q")).select("task", "state", "position", "q.*")


def target_probs(index: Column, probs: Column, options: Column) -> Column:
    """The soft target, or the hard one as probabilities, or null; an index out of range raises."""
    n = F.size(options)
    hard = F.transform(options, lambda o, i: F.when(i == index, 1.0).otherwise(0.0))
    checked = F.when((index < 0) | (index >= n), F.raise_error(F.concat(F.lit("target out of range: "), index.cast("string"))).cast("array<double>")).otherwise(hard)
    return F.when(probs.isNotNull(), probs).when(index.isNotNull(), checked)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """file, rows and bytes of each file under a path."""
    files = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return files.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.max("bytes").alias("bytes"))


def snapshot(spark: SparkSession, path: str, kind: str, limit: int | None = None) -> DataFrame:
    """A local snapshot in Parquet, CSV, TSV, JSON or JSON lines, by kind; limit is the caller's sample size."""
    readers = {
        "parquet": lambda: spark.read.option("mergeSchema", "false").parquet(path), "csv": lambda: spark.read.csv(path, header=True),
        "tsv": lambda: spark.read.csv(path, header=True, sep="\t", quote=""), "json": lambda: spark.read.option("multiLine", "true").json(path), "jsonl": lambda: spark.read.json(path),
    }
    rows = readers[kind]()
    return rows.limit(limit) if limit is not None else rows


def legal_splits(names: list[str], allow_eval: bool = False) -> list[str]:
    """Training splits; a dataset with evaluation splits alone is refused unless allowed."""
    train = [n for n in names if re.match(r"train", n)]
    if not train and not allow_eval:
        raise ValueError(f"no training split among {names}")
    return train or names


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """A sidecar {column: [names]} as rows (column, index, name)."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("column", "names")).select("column", F.posexplode("names").alias("index", "name"))


def write_examples(rows: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """The column value as it is."""
    rows.select("value").write.mode("overwrite").text(path)


def manifest(rows: DataFrame) -> DataFrame:
    """Provenance rows as Markdown table lines, in order of generator and task."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), F.lit(" |"))
    return rows.orderBy("generator", "task").select(line.alias("line"))
