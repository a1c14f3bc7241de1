"""Quality rules: base rules, then robust multivariate outliers for each language and source.

A text's statistics (length, word length, symbols, repeated lines, repeated words, capitals, digits) are transformed to
even out their spread.  For each (language, source), each language and all rows the minimum covariance determinant is sought
from three deterministic starts: medians and quartile spreads alone, and these with the correlations of the hyperbolic
tangents of the scores or of the scores' directions.  A concentration step takes the share ALPHA of the rows nearest in
Mahalanobis distance and re-estimates mean and covariance from them.  After FIRST steps the start of least determinant goes
on until no determinant falls by over DROP, or for STEPS steps.
A group's estimate is then pooled with its language's, and that with the one of all rows, as if the wider one brought
PRIOR rows.  Rows beyond the cutoff are rejected.

Scale: texts are read once; the steps run over the narrow statistics table.  A step bins distances on a fixed log grid and
sums moments by (group, bin), which Spark combines before its one small shuffle, so a group may hold any share of the
rows; the nearest whole bins that reach ALPHA are then added up.  Only group estimates (a few dozen numbers) are joined
back, broadcast when their counted rows are few.  No row is sampled.

Edge cases: a null text has no words and fails the base rules; null languages and sources are groups of their own; a group of
any size has an estimate, the smaller the nearer its language's; without any row that passes the base rules there is no estimate, and
none to judge; equal rows get equal verdicts; a text of any length is read whole; an empty table gives no rows; further columns are
ignored by judge() and kept by filter_documents(), whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm._util import cut, ship, small
from gristmill.llm.textkernel import SLICE, Words, grams, parts, slices, span_hash, utf8

ALPHA = 0.75
#: Steps from each start, steps of the best at most, and the fall of a determinant's logarithm that calls for another step.
FIRST, STEPS, DROP = 2, 20, 1e-3
#: Rows that a wider group's estimate counts for.
PRIOR = 200
#: Chance that a row of a normal cloud is rejected.
TAIL = 1e-7
#: Spread of each transformed statistic within which texts don't differ in quality; added to final estimates, and the scale of a start
#: whose quartiles are equal.
FLOOR = (0.25, 0.15, 0.03, 0.16, 0.16, 0.03, 0.06)
#: Keeps singular covariances invertible while steps go on, as a share of FLOOR.
GUARD = 1e-3
P = len(FLOOR)
BINS_PER_OCTAVE = 16

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The base statistics and the transformed vector of each text."""
    w = Words(texts)
    n = len(texts)

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[w.text_end] - total[w.text_start]

    words = w.last - w.first
    space = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum((w.buf & 0xC0) == 0x80, out=space[1:])
    chars = np.zeros(len(w.start) + 1, np.int64)
    np.cumsum(w.end - w.start - (space[w.end] - space[w.start]), out=chars[1:])
    word_chars = chars[w.last] - chars[w.first]

    # lines with a word, by hash
    breaks = np.append(np.flatnonzero(w.buf == 10), len(w.buf))
    line_start = np.concatenate([[0], breaks[:-1] + 1])
    at = np.searchsorted(w.start, line_start)
    full = at < np.searchsorted(w.start, breaks)
    line_start, line_end = line_start[full], breaks[full]
    lines = span_hash(w.prefix, line_start, line_end)
    line_text = np.searchsorted(w.text_end, line_start, side="left")
    n_lines = np.bincount(line_text, minlength=n)
    order = np.lexsort((lines, line_text))
    a, b = lines[order], line_text[order]
    again = np.bincount(b[1:][(a[1:] == a[:-1]) & (b[1:] == b[:-1])], minlength=n)

    # words in three-word windows that occur twice
    hashes = w.hashes()
    repeated = np.zeros(n, np.int64)
    for i, (f, t) in enumerate(zip(w.first.tolist(), w.last.tolist(), strict=True)):
        if t - f >= 4:
            g = grams(hashes[f:t], 3)
            s = np.sort(g)
            if (s[1:] == s[:-1]).any():
                order = np.argsort(g, kind="stable")
                s = g[order]
                same = s[1:] == s[:-1]
                hit = np.zeros(t - f, bool)
                hit[order[1:][same]] = True
                hit[order[:-1][same]] = True
                hit[1:] |= hit[:-1].copy()
                start = np.zeros(t - f, bool)
                start[order[1:][same]] = True
                start[order[:-1][same]] = True
                hit[2:] |= start[:-2]
                repeated[i] = hit.sum()
    symbols = count(_SYMBOL[w.buf])
    share = lambda x, of: np.arcsin(np.sqrt(np.clip(x / np.maximum(of, 1), 0, 1)))
    vector = np.stack([
        np.log1p(words), np.log(np.maximum(word_chars, 1) / np.maximum(words, 1)), share(symbols, word_chars), share(again, n_lines),
        share(repeated, words), share(count(_UPPER[w.buf]), word_chars), share(count(_DIGIT[w.buf]), word_chars),
    ], axis=1)
    return {"n_words": words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": again, "n_repeat_words": repeated, "vector": vector}


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        texts = utf8(batch.column("text"))
        for a, b in slices(texts, SLICE):
            x = text_statistics(texts[a:b])
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lang"), part.column("source"), *(pa.array(x[c], pa.int64()) for c in BASE), *(pa.array(x["vector"][:, i]) for i in range(P))],
                names=["doc_id", "lang", "source", *BASE, *(f"x{i}" for i in range(P))],
            )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base statistics and x0.. of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang string, source string, " + ", ".join([*(f"{c} long" for c in BASE), *(f"x{i} double" for i in range(P))])
    narrow = docs.select("doc_id", *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    return narrow.mapInArrow(_statistics, schema)


def chi2_cdf(x: float, k: float) -> float:
    """Regularised lower incomplete gamma function at (k/2, x/2), by its series or continued fraction."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def chi2_quantile(q: float, k: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return hi


#: Makes the covariance of the nearest ALPHA of a normal cloud that of the whole.
CONSISTENCY = ALPHA / chi2_cdf(chi2_quantile(ALPHA, P), P + 2)

_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_SUMS = [f"s{i}" for i in range(P)] + [f"q{i}_{j}" for i, j in _PAIRS]
_CENTRE, _WEIGHT, _COVARIANCE = [f"m{i}" for i in range(P)], [f"w{i}_{j}" for i, j in _PAIRS], [f"c{i}_{j}" for i, j in _PAIRS]
_ROW, _COLUMN = (np.array(x) for x in zip(*_PAIRS, strict=True))
_VECTOR = [f"x{i}" for i in range(P)]


def _square(lower: np.ndarray) -> np.ndarray:
    """The symmetric matrix of a lower triangle."""
    out = np.zeros((P, P))
    out[_ROW, _COLUMN] = out[_COLUMN, _ROW] = lower
    return out


def weights(cov: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, float]:
    """The lower triangle of the inverse Cholesky factor of cov with spread squared added, and the logarithm of its determinant."""
    factor = np.linalg.cholesky(cov + np.diag(np.square(spread)))
    return np.linalg.inv(factor)[_ROW, _COLUMN], 2 * float(np.log(np.diag(factor)).sum())


def moments(n: float, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from a count, sums and sums of products."""
    mean = sums[:P] / n
    return mean, _square(sums[P:] / n) - np.outer(mean, mean)


def starts(median: np.ndarray, scale: np.ndarray, n: float, tanh: np.ndarray, direction: np.ndarray) -> list[np.ndarray]:
    """Covariances to start from: spreads alone, and with either of the correlations that the sums and sums of products give."""

    def correlated(cov: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        return cov / np.outer(size, size) * np.outer(scale, scale)

    return [np.diag(scale**2), correlated(moments(n, tanh)[1]), correlated(_square(direction / n))]


_STATE = "g string, start int, logdet double, " + ", ".join(f"{c} double" for c in [*_CENTRE, *_WEIGHT, *_COVARIANCE])


def _state(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (g, start, mean, covariance) with weights and determinant."""
    made = [weights(cov, GUARD * np.array(FLOOR)) for _, _, _, cov in rows]
    numbers = np.array([[det, *mean, *w, *cov[_ROW, _COLUMN]] for (_, _, mean, cov), (w, det) in zip(rows, made, strict=True)]).reshape(len(rows), -1)
    names = ["logdet", *_CENTRE, *_WEIGHT, *_COVARIANCE]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array(numbers[:, k] if len(rows) else [], pa.float64()) for k in range(len(names)))], names=["g", "start", *names])


def _numbers(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)


def _begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        centre, scale, n = _numbers(batch, _CENTRE), _numbers(batch, [f"z{i}" for i in range(P)]), _numbers(batch, ["n"])
        tanh, direction = _numbers(batch, [f"t_{c}" for c in _SUMS]), _numbers(batch, [f"d_{c}" for c in _SUMS[P:]])
        out = []
        for k, g in enumerate(batch.column("g").to_pylist()):
            out += [(g, i, centre[k], cov) for i, cov in enumerate(starts(centre[k], scale[k], n[k, 0], tanh[k], direction[k]))]
        yield _state(out)


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = _numbers(batch, ["n", *_SUMS])
        keys = zip(batch.column("g").to_pylist(), batch.column("start").to_pylist(), strict=True)
        yield _state([(g, start, *moments(r[0], r[1:])) for (g, start), r in zip(keys, sums, strict=True)])


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. under w0_0.."""
    total = None
    for i in range(P):
        row = sum((F.col(f"w{i}_{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(1, i + 1)), F.col(f"w{i}_0") * (F.col("x0") - F.col("m0")))
        total = row * row if total is None else total + row * row
    return total


def _products(of: list[Column], prefix: str = "") -> list[Column]:
    return [*(F.sum(c).alias(f"{prefix}s{i}") for i, c in enumerate(of)), *(F.sum(of[i] * of[j]).alias(f"{prefix}q{i}_{j}") for i, j in _PAIRS)]


def _starts(rows: DataFrame) -> DataFrame:
    quartiles = rows.groupBy("g").agg(*(F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"p{i}") for i, c in enumerate(_VECTOR)))
    iqr = lambda i: (F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349
    robust = quartiles.select("g", *(F.col(f"p{i}")[1].alias(f"m{i}") for i in range(P)), *(F.when(iqr(i) > 0, iqr(i)).otherwise(F.lit(FLOOR[i])).alias(f"z{i}") for i in range(P)))
    robust = cut(robust, "quartiles")
    scored = rows.join(small(robust), "g").select("g", *_CENTRE, *(f"z{i}" for i in range(P)), *(((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"z{i}")).alias(f"x{i}") for i in range(P)))
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in _VECTOR[1:]), F.col("x0") * F.col("x0")))
    scored = scored.withColumn("size", F.when(size > 0, size).otherwise(F.lit(1.0)))
    direction = [F.col(c) / F.col("size") for c in _VECTOR]
    sums = scored.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in [*_CENTRE, *(f"z{i}" for i in range(P))]), *_products([F.tanh(c) for c in _VECTOR], "t_"), *_products(direction, "d_"),
    )
    return cut(sums.mapInArrow(_begin, _STATE), "starts")


def _step(rows: DataFrame, now: DataFrame, tag: str) -> DataFrame:
    """One concentration step of each (g, start)."""
    bin_ = F.floor(F.log2(F.col("d2") + 1e-9) * BINS_PER_OCTAVE).cast("int")
    near = rows.join(small(now.select("g", "start", *_CENTRE, *_WEIGHT)), "g").withColumn("d2", _distance())
    sums = near.groupBy("g", "start", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), *_products([F.col(c) for c in _VECTOR]))
    own = Window.partitionBy("g", "start")
    nearer = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    nearest = sums.withColumn("before", F.coalesce(F.sum("n").over(nearer), F.lit(0))).withColumn("all", F.sum("n").over(own)).where(F.col("before") < ALPHA * F.col("all"))
    added = nearest.groupBy("g", "start").agg(F.sum("n").cast("double").alias("n"), *(F.sum(c).alias(c) for c in _SUMS))
    return cut(added.mapInArrow(_estimates, _STATE), tag)


def minimum_covariance(rows: DataFrame, first: int = FIRST, steps: int = STEPS) -> DataFrame:
    """The state (g, start, logdet, m0.., w0_0.., c0_0..) of least determinant found for each g of rows (g, x0..)."""
    now = _starts(rows)
    for k in range(first):
        now = _step(rows, now, f"mcd{k}")
    every = [c for c in now.columns if c != "g"]
    best = cut(now.groupBy("g").agg(F.min_by(F.struct(*every), F.struct("logdet", "start")).alias("s")).select("g", "s.*"), "best")
    for k in range(steps):
        after = _step(rows, best, f"mcd{first + k}")
        both = best.join(after.select("g", *(F.col(c).alias(f"new_{c}") for c in every)), "g")
        falls = F.col("new_logdet") < F.col("logdet")
        left = both.where(F.col("new_logdet") < F.col("logdet") - DROP).limit(1).count()
        best = cut(both.select("g", *(F.when(falls, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in every)), "best")
        if not left:
            break
    return best


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _name(level: int) -> Column:
    """A group's name: its source and language, its language, or nothing; JSON tells null from any string."""
    return F.to_json(F.struct("lang", "source")) if level == 2 else F.to_json(F.struct("lang", F.lit(1).alias("any"))) if level else F.lit("all")


def pooled(n: float, mean: np.ndarray, cov: np.ndarray, wide_mean: np.ndarray, wide_cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moments of n rows of a group and PRIOR rows of a wider one."""
    share = n / (n + PRIOR)
    apart = mean - wide_mean
    return share * mean + (1 - share) * wide_mean, share * cov + (1 - share) * wide_cov + share * (1 - share) * np.outer(apart, apart)


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        levels = [(_numbers(batch, [f"{c}_{k}" for c in _CENTRE]), _numbers(batch, [f"{c}_{k}" for c in _COVARIANCE]) * CONSISTENCY) for k in range(3)]
        n = _numbers(batch, ["n1", "n2"])
        out = []
        for r in range(batch.num_rows):
            mean, cov = levels[0][0][r], _square(levels[0][1][r])
            for k in (1, 2):
                mean, cov = pooled(n[r, k - 1], levels[k][0][r], _square(levels[k][1][r]), mean, cov)
            out.append([*mean, *weights(cov, np.array(FLOOR))[0]])
        numbers = np.array(out).reshape(batch.num_rows, P + len(_PAIRS))
        yield pa.RecordBatch.from_arrays([batch.column("l"), batch.column("s"), *(pa.array(numbers[:, k]) for k in range(numbers.shape[1]))], names=["l", "s", *_CENTRE, *_WEIGHT])


def fit(stats: DataFrame, first: int = FIRST, steps: int = STEPS) -> DataFrame:
    """(l, s) of each language and source among the rows that pass the base rules, with their pooled estimate m0.., w0_0..

    Other languages and sources have none: all their rows fail the base rules.
    """
    good = stats.where(~_failed())
    named = cut(good.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n2")).withColumns({f"g{k}": _name(k) for k in range(3)}), "groups")
    named = named.join(named.groupBy("g1").agg(F.sum("n2").alias("n1")), "g1")
    rows = good.select(F.explode(F.array(_name(0), _name(1), _name(2))).alias("g"), *_VECTOR)
    found = minimum_covariance(rows, first, steps)
    for k in range(3):
        own = found.select(F.col("g").alias(f"g{k}"), *(F.col(c).alias(f"{c}_{k}") for c in [*_CENTRE, *_COVARIANCE]))
        named = named.join(small(own), f"g{k}")
    ready = named.withColumnsRenamed({"lang": "l", "source": "s"})
    return cut(ready.mapInArrow(_pool, "l string, s string, " + ", ".join(f"{c} double" for c in [*_CENTRE, *_WEIGHT])), "estimates")


def _verdicts(rows: DataFrame, found: DataFrame, tail: float) -> DataFrame:
    """rows with base_failed, distance (null where no row of the language and source passes the base rules) and kept."""
    out = rows.join(small(found), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").withColumn("d2", _distance())
    kept = ~_failed() & F.coalesce(F.col("d2") <= chi2_quantile(1 - tail, P), F.lit(True))
    return out.withColumns({"base_failed": _failed(), "distance": F.sqrt("d2"), "kept": kept})


def judge(docs: DataFrame, first: int = FIRST, steps: int = STEPS, tail: float = TAIL) -> DataFrame:
    """doc_id, lang, source, the base statistics, base_failed, distance and kept, of every row."""
    ship(docs.sparkSession)
    stats = cut(statistics(docs), "statistics")
    return _verdicts(stats, fit(stats, first, steps), tail).select("doc_id", "lang", "source", *BASE, "base_failed", "distance", "kept")


def filter_documents(docs: DataFrame, first: int = FIRST, steps: int = STEPS, tail: float = TAIL) -> DataFrame:
    """The rows of docs, all columns, that are kept.  Texts are read once more, not shuffled."""
    ship(docs.sparkSession)
    found = fit(cut(statistics(docs), "statistics"), first, steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            row = batch.column("row")
            texts = utf8(pc.struct_field(row, "text").cast(pa.string()))
            for a, b in slices(texts):
                x = text_statistics(texts[a:b])
                part = row.slice(a, b - a)
                keys = [pc.struct_field(part, c).cast(pa.string()) for c in ("lang", "source")]
                yield pa.RecordBatch.from_arrays([part, *keys, *(pa.array(x[c], pa.int64()) for c in BASE), *(pa.array(x["vector"][:, i]) for i in range(P))], names=["row", "lang", "source", *BASE, *(f"x{i}" for i in range(P))])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), *(T.StructField(c, T.LongType()) for c in BASE), *(T.StructField(f"x{i}", T.DoubleType()) for i in range(P))])
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).mapInArrow(run, schema)
    return _verdicts(rows, found, tail).where("kept").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
