"""Composite plans and stream mirrors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.plans import corpus
from gristmill.operators._side import scratch
from gristmill.queries._base import query, table
from gristmill.streaming import events as stream


@query()
def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build; a test checks its invariants."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = corpus.facts(docs.select("doc_id", F.col("source").alias("task"), F.col("lang").alias("domain"), F.col("text").alias("state")))
    rows = rows.join(labels.select("doc_id", F.col("quality").alias("target")), "doc_id")
    return corpus.build_from(rows, docs.select("doc_id", F.col("text").alias("state")), table(spark, sf_dir, "benchmark"))


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT DISTINCT ON (event_id) * FROM events) WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of a stream over the events file, run to its end; days that the watermark has passed."""
    out = scratch(spark)
    source = spark.readStream.schema(stream.SCHEMA).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    counts = stream.counts(source)
    run = counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    run.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{out}/rows").select("start", "event_type", "n", F.round("total", 6).alias("total"))
