"""Shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many rows is hinted for broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and everything runs in this process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Rows of an Arrow batch while a table is written; whole texts make batches large.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_scratch: list[str] = []
_finished: list[str] = []


def cut(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there and a lost executor costs nothing.

    Within a pipeline stage, the next stage deletes it, unless it is to be kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gristmill/{tag}-{uuid.uuid4().hex}"
    rows = spark.conf.get(_BATCH, "10000")
    spark.conf.set(_BATCH, str(min(int(rows), BATCH_ROWS)))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, rows)
    if not keep:
        _scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that finished stages wrote; for callers that have written every result made from them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _finished:
        path = jvm.org.apache.hadoop.fs.Path(_finished.pop())
        path.getFileSystem(conf).delete(path, True)


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """f as a pipeline stage: it starts by deleting what the stage before wrote on the way, whose result is written by then."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        ship(spark)
        start = len(_scratch)
        out = f(spark, docs, sf_dir)
        _finished.extend(_scratch[start:])
        del _scratch[start:]
        return out

    return run


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is a materialised table of at most `rows` rows, else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key of more rows is hot; so many hot keys are broadcast, and beyond them salted.
HOT_ROWS, HOT_KEYS, SALTS = 5_000, 200_000, 16


def spread_join(left: DataFrame, right: DataFrame, key: str, most: int = HOT_ROWS, keys: int = HOT_KEYS) -> DataFrame:
    """left joined with right by key; both are written tables, and right has one row a key and, as n, left's rows of that key.

    Rows of keys with over `most` rows meet theirs by a broadcast, if such keys are at most `keys`, or else over SALTS salts; they
    take no part in the shuffle by key, so no task gets all rows of one.
    """
    hot, cold = right.where(F.col("n") > most), right.where(F.col("n") <= most)
    on = [key]
    if hot.count() <= keys:
        hot = F.broadcast(hot)
    else:
        on = [key, "salt_"]
        hot = hot.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = left.withColumn("salt_", F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int"))
    some, rest = left.join(hot, on), left.join(hot.select(*on), on, "left_anti").drop("salt_").join(cold, key)
    return some.drop("salt_", "n").unionByName(rest.drop("n"))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, in case their Python doesn't find it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = Path(__file__).resolve().parents[1]
        name = f"{tempfile.mkdtemp(prefix='gristmill-')}/{root.name}-{uuid.uuid4().hex[:8]}.zip"
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        context.addPyFile(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
