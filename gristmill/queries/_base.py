"""The registry, and tables that several queries derive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import arrays

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: doc_id, task (source), domain (lang), state, target (quality), toxic."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select("doc_id", F.col("source").alias("task"), F.col("lang").alias("domain"), F.col("text").alias("state"), F.col("quality").alias("target"), "toxic")


EXAMPLES = "examples AS (SELECT d.doc_id, d.source AS task, d.lang AS domain, d.text AS state, l.quality AS target, l.toxic FROM documents d JOIN labels l USING (doc_id))"


def dump(spark: SparkSession, sf_dir: str, start: int = 1) -> DataFrame:
    """A per-question evaluation dump from embeddings: id, task, n, probs, target (index), onehot, confidence, correct."""
    k = F.col("label") % 4 + 2
    raw = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("task"), k.cast("long").alias("n"), F.slice(F.transform("embedding", lambda x: x.cast("double") * 8), F.lit(start), k).alias("logits"))
    made = raw.select("id", "task", "n", "logits", arrays.softmax(F.col("logits")).alias("probs"), (F.col("id") % F.col("n")).alias("target"))
    return made.select("*", F.array_max("probs").alias("confidence"), (arrays.argmax(F.col("probs")) == F.col("target")).cast("long").alias("correct"), arrays.one_hot(F.col("target"), F.col("n")).alias("onehot"))


def dump_sql(start: int = 1, name: str = "dump") -> str:
    return f"""{name}_l AS (SELECT vec_id AS id, 't' || label AS task, (label % 4 + 2)::BIGINT AS n, list_transform(embedding[{start}:{start} + label % 4 + 1], lambda x: x::DOUBLE * 8) AS logits FROM embeddings),
{name}_e AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM {name}_l),
{name}_p AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS probs, id % n AS target FROM {name}_e),
{name} AS (SELECT id, task, n, logits, probs, target, list_max(probs) AS confidence, (list_position(probs, list_max(probs)) - 1 = target)::BIGINT AS correct,
  list_transform(range(n), lambda i: CASE WHEN i = target THEN 1.0 ELSE 0.0 END::DOUBLE) AS onehot FROM {name}_p)"""
