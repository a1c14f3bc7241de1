"""Mixing to target weights by soft membership.

 1. A classifier is fitted on the labelled table: Gaussian naive Bayes over text statistics and over hits of a small
    lexicon of word beginnings, which is learnt by log-odds from at most LEXICON_ROWS labelled rows, those of least hash.
 2. Every document gets posteriors of its domain, on a grid of 1/GRID, and a token count.
 3. Rates: nonnegative, starting from 1, such that the sum over documents of rate * tokens * posterior nears each domain's
    target, in least squares.  Projected gradient steps with momentum; documents of equal posteriors have equal
    gradients, hence equal rates, so the sums run over the aggregated grid cells (exactly, not as an approximation).
    A step is one distributed aggregation that brings back one number a domain; a rate is a fold over these numbers, so
    no state is kept on executors and a lost one only repeats an aggregation.

DataFrame functions only.  Texts are read twice (lexicon rows, statistics); the statistics table is narrow.  Nothing grows with
the data on the driver: a lexicon of LEXICON words, one row a domain, STEPS vectors.

Edge cases: a null or empty text has no tokens and its prior's posteriors; without labels, posteriors are uniform; label
rows with a null or an unknown document count for nothing, several for one document count once each; a domain without
labelled rows has posterior 0 and its target is left out; equal rows get equal rates; texts of any length are read whole; an
empty table gives no rows; further columns are kept, whatever their names.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm._util import cut, small

DOMAINS = ("clean", "low", "toxic")
#: Wanted shares of the tokens.
TARGETS = {"clean": 0.90, "low": 0.05, "toxic": 0.05}
GRID = 64
STEPS, TOLERANCE = 40, 1e-5
LEXICON, LEXICON_ROWS, LEXICON_LEAST = 100, 4_000, 6
#: So many rows that don't come once are broadcast (about 10 MB); for more, rows are shuffled.
CHANGED = 250_000
#: Added to variances, so that a statistic that is constant in a domain doesn't decide alone.
VARIANCE_FLOOR = 0.01

_FEATURES = ("length", "word_length", "symbols", "hits")
_SPACES = "\t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "clean")


def _words(text: Column) -> Column:
    """Lower-cased words; one pass makes every space the same, so that the split needs no expression."""
    plain = F.translate(text, _UPPER + _SPACES, _LOWER + " " * len(_SPACES))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _beginnings(words: Column) -> Column:
    return F.transform(words, lambda w: F.substring(w, 1, 4))


def lexicon(docs: DataFrame, labelled: DataFrame) -> list[str]:
    """Word beginnings that mark toxic documents, by log-odds over the labelled rows of least hash."""
    rows = labelled.where("domain is not null").select("doc_id", (F.col("domain") == "toxic").cast("int").alias("t")).orderBy(F.xxhash64("doc_id"), "doc_id", "t").limit(LEXICON_ROWS)
    rows = cut(rows, "lexicon_rows")
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("t"), F.lit(0))).first()
    if not bad or bad == n:
        return []
    used = docs.join(F.broadcast(rows), "doc_id").select("t", F.explode(F.array_distinct(_beginnings(_words(F.col("text"))))).alias("w"))  # at most LEXICON_ROWS rows
    counts = used.groupBy("w").agg(F.sum("t").alias("yes"), F.count(F.lit(1)).alias("all"))
    odds = F.log((F.col("yes") + 0.5) / (bad + 1.0)) - F.log((F.col("all") - F.col("yes") + 0.5) / (n - bad + 1.0))
    best = counts.where(F.col("yes") >= LEXICON_LEAST).withColumn("odds", odds).where(F.col("odds") > 2.5).orderBy(F.desc("odds"), "w").limit(LEXICON)
    return [r.w for r in best.select("w").collect()]  # LEXICON rows at most


def features(docs: DataFrame, words: list[str]) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    n = F.length("text").cast("double")
    symbols = n - F.length(F.translate("text", "#*$%&|<>!", ""))
    made = base.select("doc_id", "th", n.alias("n"), F.asin(F.sqrt(symbols / F.greatest(n, F.lit(1.0)))).alias("symbols"), _words(F.col("text")).alias("words"))
    hits = F.size(F.array_intersect(_beginnings(F.col("words")), F.array(*map(F.lit, words)))) if words else F.lit(0)
    made = made.select("doc_id", "th", "n", "symbols", F.size("words").cast("long").alias("n_tokens"), hits.alias("n_hits"))
    return made.select("doc_id", "th", "n_tokens", F.log1p("n_tokens").alias("length"), F.log((F.col("n") + 1) / (F.col("n_tokens") + 1)).alias("word_length"), "symbols", F.log1p("n_hits").alias("hits"))


def posteriors(stats: DataFrame, labelled: DataFrame) -> list[Column]:
    """Each domain's posterior, on the grid; they add up to 1."""
    fit = stats.join(labelled.where("domain is not null").select("doc_id", "domain"), "doc_id").groupBy("domain")
    found = {r.domain: r for r in fit.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}_{c}") for c in _FEATURES for k, f in (("m", F.avg), ("v", F.var_pop)))).collect()}  # one row a domain
    if not found:
        return [F.lit(x / GRID) for x in (GRID - 2 * (GRID // 3), GRID // 3, GRID // 3)]
    total = sum(r.n for r in found.values())
    scores = {}
    for d, r in found.items():
        terms = [F.lit(math.log(r.n / total))]
        for c in _FEATURES:
            v = r[f"v_{c}"] + VARIANCE_FLOOR
            terms.append(-(F.col(c) - r[f"m_{c}"]) * (F.col(c) - r[f"m_{c}"]) / (2 * v) - 0.5 * math.log(v))
        scores[d] = sum(terms[1:], terms[0])
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    weights = {d: F.exp(s - top) for d, s in scores.items()}
    all_ = sum(list(weights.values())[1:], next(iter(weights.values())))
    rest = [F.floor(weights[d] / all_ * GRID) / GRID if d in weights else F.lit(0.0) for d in DOMAINS[1:]]
    if "clean" not in weights:
        return [F.lit(0.0), *rest[:-1], 1.0 - sum(rest[:-1], F.lit(0.0))]
    return [1.0 - sum(rest, F.lit(0.0)), *rest]


def _rate(p: list[Column], history: list[list[float]]) -> Column:
    """The rate after the steps of history: vectors (residual of each domain, momentum), folded."""
    if not history:
        return F.lit(1.0)
    state = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    steps = F.array(*(F.array(*map(F.lit, h)) for h in history))

    def step(s: Column, h: Column) -> Column:
        gradient = sum((p[k] * h[k] for k in range(1, len(p))), p[0] * h[0])
        r = F.greatest(F.lit(0.0), s["y"] - gradient)
        return F.struct(r.alias("r"), (r + h[len(p)] * (r - s["r"])).alias("y"))

    return F.aggregate(steps, state, step)


def fit_rates(stats: DataFrame, p: list[Column], targets: dict[str, float]) -> list[list[float]]:
    """Projected-gradient steps over grid cells; what _rate folds."""
    names = [f"p{k}" for k in range(len(p))]
    cells = cut(stats.select(*(c.alias(n) for c, n in zip(p, names, strict=True)), "n_tokens").groupBy(*names).agg(F.sum("n_tokens").cast("double").alias("t")), "cells")
    cols = [F.col(n) for n in names]

    def totals(weight: Column) -> list[float]:
        return [float(x or 0) for x in cells.agg(*(F.sum(F.col("t") * weight * c) for c in cols)).first()]

    now = totals(F.lit(1.0))
    whole = sum(now)
    if not whole:
        return []
    wanted = {k: targets[d] for k, d in enumerate(DOMAINS) if now[k] > 0}
    scale = sum(wanted.values())
    # The budget keeps the tokens of the domain with the largest target.
    lead = max(wanted, key=wanted.__getitem__)
    budget = now[lead] / (wanted[lead] / scale)
    goal = [wanted[k] / scale * budget if k in wanted else 0.0 for k in range(len(p))]
    history: list[list[float]] = []
    momentum, before = 1.0, None
    for _ in range(STEPS):
        point = totals(_rate(cols, history)["y"]) if history else now
        residual = [(point[k] - goal[k]) / whole for k in range(len(p))]
        following = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        history.append([*residual, (momentum - 1) / following])
        momentum = following
        size = max(map(abs, residual))
        if size < TOLERANCE or before is not None and max(abs(a - b) for a, b in zip(residual, before, strict=True)) < TOLERANCE / 10:
            break
        before = residual
    else:
        warnings.warn(f"mixing: residuals {residual} (shares of all tokens) still change after {STEPS} steps", stacklevel=2)
    return history


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, th, n_tokens, p_clean, p_low, p_toxic, rate and copies of every row.

    copies is rate rounded up or down by a number drawn from the row's hash, so that it is rate on average.
    """
    kind = docs.schema["doc_id"].dataType
    labelled = labels.select(F.col("doc_id").cast(kind).alias("doc_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    stats = cut(features(own, lexicon(own, labelled)), "mixing")
    p = posteriors(stats, labelled)
    history = fit_rates(stats, p, targets or TARGETS)
    given = stats.select("doc_id", "th", "n_tokens", *(c.alias(f"p_{d}") for c, d in zip(p, DOMAINS, strict=True)))
    rate = _rate([F.col(f"p_{d}") for d in DOMAINS], history)
    given = given.withColumn("rate", F.round(rate["r"] if history else rate, 6))
    draw = F.pmod(F.xxhash64("doc_id", "th", F.lit("mixing")), F.lit(1 << 20)) / float(1 << 20)
    return given.withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs, each row as often as its copies say."""
    given = cut(rates(docs, labels, targets).select("doc_id", "th", "copies"), "rates")  # each rate is folded once
    made = small(given.where("copies <> 1").select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "copies").distinct(), CHANGED)
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), th.alias("th"))
    often = rows.join(made, F.col("id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").withColumn("copies", F.coalesce("copies", F.lit(1))).where("copies > 0")
    return often.select("row", F.explode(F.expr("sequence(1, copies)"))).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
