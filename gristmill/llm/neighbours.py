"""Approximate nearest neighbours: score-aware anisotropic quantisation, four-bit table scans, exact reranking.

 1. Coarse centroids and codebooks are fitted on at most SAMPLE rows, those of least hash.  Residuals are scaled by their
    centroid's spread, so that a dense group of near copies is told apart as finely as scattered rows.
    Codes minimise |e|^2 + (eta - 1) (e . x/|x|)^2: error parallel to the vector, which moves large inner products, costs more.
    eta = (dim - 1) T^2 / (1 - T^2) for inner products from T on, the cosine of a centroid with its rows.
 2. Every row is indexed: a centroid and one four-bit code for each PAIR-wide slice, two codes a byte.  Rows of a centroid form blocks
    of ROW_BLOCK, so a centroid may hold any share of the rows.
 3. A query goes to the blocks of the PROBES centroids that promise the largest inner products, and of more while these hold under
    LEAST rows.  A cell (block, query part) scans codes through tables of 256 partial scores a byte and keeps the RERANK best
    of each query, by approximate score.
 4. The RERANK best of each query over all its cells are joined with the original vectors and ranked exactly in double precision.

Only ids, codes and the queries' vectors are shuffled, once for each probe, and the original vectors once for reranking: bytes grow
with the rows, but for one more copy of the codes for every QUERY_BLOCK queries.  Scores grow with queries times rows in the
probed cells, at one table read for each byte of code.

Edge cases: vectors that are null, zero, hold null or non-finite components, or have not the most common length, and rows
with a null id take no part; equal scores go to the smaller id; rows of the query's own id are no candidates; repeated
ids count as repeated candidates, but as one query, of the least vector; an empty table gives no rows; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm._util import cut, ship

SAMPLE = 8_000
CENTROIDS = 192
PAIR = 1
CODES = 16
#: Least and most weight of parallel error.
ETA = (4.0, 1e4)
SWEEPS, ROUNDS = 2, 6
RERANK = 64
#: Deviations of a centroid's rows, along a query, that count toward its promise.
REACH = 2.5
PROBES, LEAST = 144, 1_024
QUERY_BLOCK, ROW_BLOCK = 65_536, 131_072
#: Scores that a cell holds at once.
SCORES = 1 << 21


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)


class Quantiser:
    """Centroids, their spreads, and one codebook for each slice; all fitted on unit vectors."""

    def __init__(self, sample: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        n, dim = sample.shape
        pad = -dim % (2 * PAIR)
        self.pad, self.dim = pad, dim
        x = self._padded(sample)
        k = min(CENTROIDS, n)
        centres = x[[int(rng.integers(n))]]
        far = ((x - centres[0]) ** 2).sum(1)
        while len(centres) < k and far.max() > 1e-12:
            centres = np.vstack([centres, x[rng.choice(n, p=far / far.sum())]])
            far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
        for _ in range(ROUNDS):
            at = _nearest(x, centres)
            count = np.bincount(at, minlength=len(centres))
            total = np.zeros_like(centres)
            np.add.at(total, at, x)
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        self.centres = centres
        at = _nearest(x, centres)
        residual = x - centres[at]
        square = (residual**2).sum(1)
        count = np.bincount(at, minlength=len(centres))
        own = np.sqrt(np.bincount(at, square, minlength=len(centres)) / np.maximum(count, 1))
        whole = max(np.sqrt(square.mean()), 1e-6)
        self.spread = np.where(count >= 4, np.maximum(own, 1e-4), whole)
        self.eta = np.clip((dim - 1) * (1 - self.spread**2) / self.spread**2, *ETA)
        scaled, eta = residual / self.spread[at][:, None], self.eta[at]
        parts = scaled.shape[1] // PAIR
        self.books = np.stack([scaled[rng.choice(n, CODES, replace=n < CODES)][:, m * PAIR : (m + 1) * PAIR] for m in range(parts)])
        for _ in range(ROUNDS):
            code = self._codes(scaled, x, eta)
            slices = scaled.reshape(n, parts, PAIR)
            side = x.reshape(n, parts, PAIR)
            error = slices - self.books[np.arange(parts), code]
            parallel = (error * side).sum(2)
            whole_parallel = parallel.sum(1)
            for m in range(parts):
                rest = whole_parallel - parallel[:, m]
                for c in range(CODES):
                    i = np.flatnonzero(code[:, m] == c)
                    if len(i):
                        s, r = side[i, m], slices[i, m]
                        more = s * (eta[i] - 1)[:, None]
                        a = len(i) * np.eye(PAIR) + more.T @ s
                        b = (r + more * (rest[i] + (r * s).sum(1))[:, None]).sum(0)
                        self.books[m, c] = np.linalg.solve(a, b)

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.pad))) if self.pad else x

    def _codes(self, scaled: np.ndarray, unit: np.ndarray, eta: np.ndarray) -> np.ndarray:
        """Four-bit codes by coordinate descent on the anisotropic loss."""
        n, parts = len(scaled), scaled.shape[1] // PAIR
        slices, side = scaled.reshape(n, parts, PAIR), unit.reshape(n, parts, PAIR)
        error = ((slices[:, :, None] - self.books[None]) ** 2).sum(3)
        along = ((slices[:, :, None] - self.books[None]) * side[:, :, None]).sum(3)
        code = error.argmin(2)
        rows = np.arange(n)
        total = np.take_along_axis(along, code[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(SWEEPS):
            for m in range(parts):
                rest = total - along[rows, m, code[:, m]]
                code[:, m] = (error[:, m] + (eta[:, None] - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
                total = rest + along[rows, m, code[:, m]]
        return code

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and packed codes of vectors of any length other than 0."""
        unit = self._padded(vectors / np.linalg.norm(vectors, axis=1)[:, None])
        at = _nearest(unit, self.centres)
        code = self._codes((unit - self.centres[at]) / self.spread[at][:, None], unit, self.eta[at])
        return at, (code[:, 0::2] | code[:, 1::2] << 4).astype(np.uint8)

    def scores(self, queries: np.ndarray, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate cosines of unit queries with coded rows."""
        q = self._padded(queries)
        parts = len(self.books)
        each = np.einsum("qmp,mcp->mqc", q.reshape(len(q), parts, PAIR), self.books)
        out = np.zeros((len(q), len(codes)), np.float32)
        for j in range(parts // 2):
            table = (each[2 * j + 1][:, :, None] + each[2 * j][:, None, :]).reshape(len(q), 256).astype(np.float32)
            out += np.take(table, codes[:, j], axis=1)
        out *= self.spread[at].astype(np.float32)
        out += np.take((q @ self.centres.T).astype(np.float32), at, axis=1)
        return out


    def promising(self, queries: np.ndarray) -> np.ndarray:
        """Centroids for each unit query, those first whose rows may have the largest inner products."""
        q = self._padded(queries)
        reach = q @ self.centres.T + REACH * self.spread / np.sqrt(self.dim)
        return np.argsort(-reach, axis=1, kind="stable")


def _vectors(column: pa.Array) -> np.ndarray:
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def best_rows(near: np.ndarray, ids: np.ndarray, m: int) -> np.ndarray:
    """The m rows of largest score; ids ascend, and equal scores at the edge go to the smaller ones."""
    if len(near) > m:
        rows = np.flatnonzero(near >= np.partition(near, len(near) - m)[len(near) - m])
    else:
        rows = np.arange(len(near))
    return rows[np.argsort(-near[rows], kind="stable")[:m]]


def valid(rows: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the rows that take part."""
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    return x.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            v, q = _vectors(batch.column("embedding")), _vectors(batch.column("asked"))
            dot = lambda a, b: np.einsum("ij,ij->i", a, b)
            score = dot(v, q) / (np.sqrt(dot(v, v)) * np.sqrt(dot(q, q)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(score)], names=["query_id", "vec_id", "score"])


def search(rows: DataFrame, every: int = 50, k: int = 5, sample: int = SAMPLE, probes: int = PROBES, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each row whose vec_id is divisible by `every`."""
    spark = rows.sparkSession
    ship(spark)
    good = valid(rows).withColumn("dim", F.size("embedding"))
    sizes = good.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.where(F.col("dim") == sizes[0].dim).drop("dim")
    picked = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()  # sample rows at most
    x = np.array([r.embedding for r in picked])
    model = spark.sparkContext.broadcast(Quantiser(x / np.linalg.norm(x, axis=1)[:, None]))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            if batch.num_rows:
                at, codes = model.value.encode(_vectors(batch.column("embedding")))
                turns = np.arange(turn, turn + batch.num_rows)
                turn += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(at, pa.int32()), pa.array(turns), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "centre", "turn", "code"])

    indexed = cut(good.mapInArrow(index, "id long, centre int, turn long, code binary"), "index")
    queries = cut(good.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("asked")).withColumnRenamed("vec_id", "query_id"), "queries")
    held = np.zeros(len(model.value.centres), np.int64)
    for r in indexed.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a centroid
        held[r.centre] = r.n
    blocks = -(-held // row_block)
    base = np.cumsum(blocks) - blocks
    parts = -(-queries.count() // query_block) or 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q = _vectors(batch.column("asked"))
                q = q / np.linalg.norm(q, axis=1)[:, None]
                order = model.value.promising(q)
                before = np.cumsum(held[order], axis=1) - held[order]
                who, turn = np.nonzero((np.arange(order.shape[1]) < probes) | (before < LEAST))
                centre = order[who, turn]
                each = blocks[centre]
                who, centre = np.repeat(who, each), np.repeat(centre, each)
                block = base[centre] + np.arange(len(who)) - np.repeat(np.cumsum(each) - each, each)
                raw = pa.array([v.tobytes() for v in q.astype(np.float32)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(block), batch.column("query_id").take(pa.array(who)), raw.take(pa.array(who))], names=["block", "id", "asked"])

    asked = queries.mapInArrow(ask, "block long, id long, asked binary").select("block", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), "id", F.lit(None).cast("int").alias("centre"), F.lit(None).cast("binary").alias("code"), "asked")
    listed = lambda v: F.array(*map(F.lit, v.tolist()))[F.col("centre")]
    block = listed(base) + F.pmod(F.xxhash64("turn", "id"), listed(np.maximum(blocks, 1)))
    there = indexed.select(block.cast("long").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "id", "centre", "code", F.lit(None).cast("binary").alias("asked"))

    def scan(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(list(batches)).combine_chunks()
        is_query = cell.column("code").is_null().to_numpy()
        mine, here = cell.filter(pa.array(is_query)), cell.filter(pa.array(~is_query))
        if not mine.num_rows or not here.num_rows:
            return
        here = here.sort_by("id")
        ids, at = here.column("id").to_numpy(), here.column("centre").to_numpy()
        codes = np.frombuffer(b"".join(here.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        q_ids = mine.column("id").to_numpy()
        q = np.frombuffer(b"".join(mine.column("asked").to_pylist()), np.float32).reshape(len(q_ids), -1)
        step = max(1, min(512, SCORES // len(ids)))
        for a in range(0, len(q), step):
            near = model.value.scores(q[a : a + step], at, codes)
            near[ids == q_ids[a : a + step, None]] = -np.inf
            found = [best_rows(x, ids, RERANK) for x in near]
            found = [r[np.isfinite(x[r])] for r, x in zip(found, near, strict=True)]
            rows = np.concatenate(found)
            who = np.repeat(np.arange(len(found)), [len(r) for r in found])
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[a + who]), pa.array(ids[rows]), pa.array(near[who, rows], pa.float32())], names=["query_id", "id", "near"])

    found = there.unionAll(asked).groupBy("block", "part").applyInArrow(scan, "query_id long, id long, near float")
    first = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    pairs = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= RERANK).select("query_id", "id").distinct()
    paired = cut(pairs, "pairs").join(good, F.col("id") == F.col("vec_id")).join(queries, "query_id").select("query_id", "vec_id", "embedding", "asked")
    exact = paired.mapInArrow(_exact, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
