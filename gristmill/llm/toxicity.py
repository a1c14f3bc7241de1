"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Kernel: two words share every subsequence of three characters that both hold within SPAN places; an occurrence weighs DECAY to the
power of its extent, so gaps and inserted characters weaken a match but don't lose it.  A word's norm is that of a word
of its length without repeats.  Case, punctuation within words, spaces between single letters, and usual look-alike digits are folded.

Training, on the labelled rows that aren't held out:
 1. Seeds: words of toxic documents by log-odds, counted by distinct preceding words, so that copies of one text count once.
 2. Sentences: of toxic documents those with a seed, of others any; each at most SENTENCES, those of least hash.  Labels are
    of documents, most of whose sentences are clean, so a sentence without a seed tells nothing; insults must be single words.
 3. Landmarks: seeds, and the words of clean sentences nearest to them and most frequent.  Words map to their Nystroem features.
 4. A squared-hinge linear machine on these features, by Newton steps; a toxic sentence counts by its highest word, which
    is chosen anew in each of PASSES passes, a clean one by all its words, of which the CLEAN_WORDS commonest count.
The machine is linear in the subsequences, so its landmarks fold into one weight a subsequence.  A text is scored whole, by
the highest of its words; a logistic curve over the training rows' scores turns that into a probability.

Scores: one pass over the texts, nothing shuffled but the training sentences, which are bounded, and a histogram.

Edge cases: a null or empty text, or one without words of three letters, has the lowest score; without labels of either kind
every score is the share of toxic training rows, or 0; texts of over PIECE characters are scored piece by piece, cut at a space if
one comes within PIECE characters; labels that are null or of unknown documents count for nothing; repeated
rows get equal scores; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm._util import cut, ship
from gristmill.llm.textkernel import parts

DECAY, SPAN = 0.75, 6
#: Labelled rows that seeds are drawn from, of each label; seeds; sentences of each label; landmarks of each kind.
ROWS, SEEDS, SENTENCES, LANDMARKS = 4_000, 400, 6_000, 160
#: Least contexts of a seed, also as a share of the most frequent seed's, and least log-odds.
SEED_CONTEXTS, SEED_SHARE, SEED_ODDS = 5, 0.03, 2.5
PASSES, REGULAR = 2, 1.0
#: Variants of each seed with an inserted character that count as toxic words, and their weight against a sentence's word.
VARIANTS, VARIANT_COST = 3, 0.1
#: Clean words that a first machine scores highest and that the second one also learns from, and their weight.
HARD, HARD_COST = 3_000, 10.0
THRESHOLD = 0.3
#: Characters of a text that are scored at once; longer texts go piece by piece.
PIECE = 1 << 20
#: Steps of 1/50 in the histogram that the logistic curve is fitted to; the last one holds all scores from there on.
BINS = 400
#: Commonest words of the clean sentences that a machine learns from, besides the hard ones.
CLEAN_WORDS = 60_000

_CLASSES = 64
# Look-alikes of letters.
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}
_SKIP, _SPACE = 255, 254
_CLASS = np.full(0x300, _SKIP, np.uint8)
for _c in range(0x300):
    _s = LOOKALIKE.get(chr(_c), chr(_c).lower())
    if _c == 0x20 or 0x09 <= _c <= 0x0D:
        _CLASS[_c] = _SPACE
    elif "a" <= _s[0] <= "z":
        _CLASS[_c] = ord(_s[0]) - 97
    elif chr(_c).isdigit() and _c < 128:
        _CLASS[_c] = 26 + _c - 48
    elif _c >= 0xC0:
        _CLASS[_c] = 36 + ord(_s[0]) % 28
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def _norms(most: int = 4096) -> np.ndarray:
    """Norm of a word of each length whose subsequences all differ."""
    out = np.ones(most)
    for n in range(3, most):
        out[n] = math.sqrt(sum(DECAY ** (2 * (b + 1)) * (n - b) for _, b in _OFFSETS if n > b))
    return out


NORMS = _norms()


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of a text without what is skipped, and each one's word number (increasing)."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(cps < 0x300, _CLASS[np.minimum(cps, 0x2FF)], 36 + (cps % 28).astype(np.uint8))
    c = c[c != _SKIP]
    space = c == _SPACE
    # spaces between single letters don't part words
    at = np.flatnonzero(space)
    if len(at):
        gap = np.diff(np.concatenate([[-1], at, [len(c)]]))
        single = (gap[:-1] == 2) & (gap[1:] == 2)
        parting = at[~single]
    else:
        parting = at
    word = np.zeros(len(c), np.int32)
    word[parting] = 1
    word = np.cumsum(word, dtype=np.int32)
    return c[~space], word[~space]


def subsequences(c: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of offsets: first places of the subsequences within a word, their numbers, and their weight."""
    c = c.astype(np.int32)
    n = len(c)
    for a, b in _OFFSETS:
        if n > b:
            ok = np.flatnonzero(word[b:] == word[: n - b])
            yield ok, c[ok] << 12 | c[ok + a] << 6 | c[ok + b], DECAY ** (b + 1)


def word_scores(text: str, weights: np.ndarray) -> float:
    """The highest of <weights, word> / norm over the text's words; -inf without words of three letters."""
    best = -np.inf
    a = 0
    while a < len(text):
        b = a + PIECE
        if b < len(text):  # to the end of a word, if one ends soon
            near = re.search(r"\s", text[b : b + PIECE])
            b += near.start() if near else 0
        c, word = fold(text[a:b])
        a = b
        if len(c) < 3:
            continue
        total = np.zeros(len(c))
        ids = c.astype(np.int32)
        first, second = ids << 12, ids << 6
        n = len(c)
        for i, j in _OFFSETS:
            if n > j:
                got = weights[first[: n - j] | second[i : n - j + i] | ids[j:]] * np.float32(DECAY ** (j + 1))
                got[word[j:] != word[: n - j]] = 0
                total[: n - j] += got
        start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        size = np.diff(np.append(start, n))
        sums = np.add.reduceat(total, start) / NORMS[np.minimum(size, len(NORMS) - 1)]
        if (size >= 3).any():
            best = max(best, float(sums[size >= 3].max()))
    return best


def entries(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, subsequence and weight of every occurrence in words without spaces, by word; weights are over the word's norm."""
    c, word = fold("\n\n".join(words))  # two spaces, so that single letters stay words of their own
    word = word // 2
    found = [np.zeros((2, 0), np.int64)]
    weight = [np.zeros(0, np.float32)]
    for at, ids, w in subsequences(c, word):
        found.append(np.stack([word[at], ids]).astype(np.int64))
        weight.append(np.full(len(at), w, np.float32))
    row, ids = np.concatenate(found, axis=1)
    order = np.argsort(row, kind="stable")
    norm = NORMS[np.minimum(np.bincount(word, minlength=len(words)), len(NORMS) - 1)]
    return row[order], ids[order], (np.concatenate(weight)[order] / norm[row[order]]).astype(np.float32)


def word_vector(word: str) -> dict[int, float]:
    out: dict[int, float] = {}
    for _, i, x in zip(*(v.tolist() for v in entries([word])), strict=True):
        out[i] = out.get(i, 0.0) + x
    return out


def projected(words: list[str], onto: np.ndarray) -> np.ndarray:
    """Each word's vector times `onto`, which has a row for each subsequence of `at`, and a last row of zeros for all others."""
    out = np.zeros((len(words), onto.shape[1]), np.float32)
    for a in range(0, len(words), 1000):
        row, ids, weight = entries(words[a : a + 1000])
        if len(row):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            out[a + row[first]] = np.add.reduceat(onto[ids] * weight[:, None], first, axis=0)
    return out


def _newton(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 12) -> np.ndarray:
    """Weights, the last one the bias, that minimise |w|^2 / 2 + sum of cost * max(0, 1 - y w.x)^2."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), REGULAR)
    ridge[-1] = 1e-3
    for _ in range(steps):
        gap = 1 - y * (x @ w)
        on = gap > 0
        a, c = x[on], cost[on]
        gradient = ridge * w - 2 * (c * y[on] * gap[on]) @ a
        move = np.linalg.solve(np.diag(ridge) + 2 * (a * c[:, None]).T @ a, gradient)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


def variants(word: str) -> list[str]:
    """The word with one inserted character, at each inner place of a few."""
    return [word[:k] + "xqzj"[k % 4] + word[k:] for k in range(1, len(word))][: 2 * VARIANTS : 2] if len(word) >= 4 else []


def train(seeds: list[str], toxic: list[str], clean: list[str], hard: list[str] = [], passes: int = PASSES) -> tuple[np.ndarray, float]:  # noqa: B006
    """Weight of each subsequence, and bias, from seed words, labelled sentences and further clean words."""
    split = lambda s: [w for w in re.split(r"[\x20\x09-\x0D]+", s.lower()) if w]
    counts = Counter(w for s in clean for w in split(s))
    words = sorted(counts, key=lambda w: (-counts[w], w))[:CLEAN_WORDS]
    words += sorted(set(hard) - set(words))
    _, ids, weight = entries(seeds)
    pull = np.bincount(ids, weight, 1 << 18).astype(np.float32)
    drawn = projected(words, pull[:, None])[:, 0]
    near = [words[i] for i in np.lexsort((words, -drawn))[: LANDMARKS // 2]]
    marks = list(dict.fromkeys([*seeds[:LANDMARKS], *near, *words[: LANDMARKS // 2]]))
    row, ids, weight = entries(marks)
    known_ids, column = np.unique(ids, return_inverse=True)
    z = np.zeros((len(marks), len(known_ids)))
    np.add.at(z, (row, column), weight)
    value, vector = np.linalg.eigh(z @ z.T)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    onto = np.zeros((1 << 18, root.shape[1]), np.float32)
    onto[known_ids] = z.T @ root

    def mapped(own: list[str]) -> np.ndarray:
        return projected(own, onto)

    negative = mapped(words)
    bags = [b for b in (split(s) for s in toxic) if b]
    known = sorted({w for b in bags for w in b})
    at = {w: i for i, w in enumerate(known)}
    positive = mapped(known)
    seed_set = set(seeds)
    witness = sorted({at[w] for b in bags for w in b if w in seed_set})
    changed = mapped([v for w in seeds for v in variants(w)])
    machine = np.zeros(root.shape[1] + 1)
    for turn in range(passes):
        if turn:
            score = positive @ machine[:-1]
            witness = sorted({max((at[w] for w in b), key=lambda i: (score[i], -i)) for b in bags})
        x = np.vstack([positive[witness], changed, negative])
        y = np.append(np.ones(len(witness) + len(changed)), -np.ones(len(negative)))
        weight = 20.0 * max(1.0, len(negative) / max(1, len(witness)) / 50)
        cost = np.concatenate([np.full(len(witness), weight), np.full(len(changed), weight * VARIANT_COST), np.where(np.isin(words, hard), HARD_COST, 1.0)])
        machine = _newton(x, y, cost)
    weights = np.zeros(1 << 18, np.float32)
    weights[known_ids] = (root @ machine[:-1]) @ z
    return weights, float(machine[-1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, t, text) of at most ROWS rows of either label, by least hash."""
    kind = docs.schema["doc_id"].dataType
    own = labels.select(F.col("doc_id").cast(kind).alias("doc_id"), (F.col("toxic") == 1).alias("t")).where("t is not null and doc_id is not null")
    own = own.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    ends = [own.where(F.col("t") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(ROWS) for x in (True, False)]
    some = cut(ends[0].unionAll(ends[1]), "labelled")
    return cut(docs.join(F.broadcast(some), "doc_id").where("text is not null").select("doc_id", "t", "text"), "training")  # 2 * ROWS rows at most


def _learn(rows: DataFrame) -> tuple[np.ndarray, float] | None:
    words = F.filter(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    pairs = rows.select("t", F.transform(words, lambda w: F.regexp_replace(w, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")).alias("w"))
    each = pairs.select("t", F.posexplode("w").alias("i", "w"), F.col("w").alias("all")).select("t", "w", F.when(F.col("i") > 0, F.try_element_at("all", F.col("i"))).otherwise("").alias("before"))
    counts = each.where(F.length("w") >= 3).distinct().groupBy("w").agg(F.count_if("t").alias("yes"), F.count_if(~F.col("t")).alias("no"))
    counts = cut(counts, "contexts")
    n_yes, n_no = counts.agg(F.sum("yes"), F.sum("no")).first()
    odds = F.log((F.col("yes") + 0.5) / float((n_yes or 0) + 1)) - F.log((F.col("no") + 0.5) / float((n_no or 0) + 1))
    best = counts.where((F.col("yes") >= SEED_CONTEXTS) & (odds >= SEED_ODDS)).orderBy(F.desc("yes"), "w").limit(SEEDS).collect()  # SEEDS rows at most
    if not best:
        return None
    seeds = [r.w for r in best if r.yes >= SEED_SHARE * best[0].yes]
    sentences = rows.select("t", F.explode(F.split("text", "[.!?\n]+")).alias("s")).where(F.length("s") >= 3).distinct()
    plain = F.transform(F.split(F.lower("s"), "[\\x20\\x09-\\x0D]+"), lambda w: F.regexp_replace(w, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", ""))
    hit = F.arrays_overlap(plain, F.array(*map(F.lit, seeds)))
    take = lambda c: [r.s for r in sentences.where(c).orderBy(F.xxhash64("s"), "s").limit(SENTENCES).select("s").collect()]  # SENTENCES rows at most
    toxic, clean = take(F.col("t") & hit), take(~F.col("t"))
    if not toxic or not clean:
        return None
    first = counts.sparkSession.sparkContext.broadcast(train(seeds, toxic, clean, passes=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [word_scores(x.as_py(), first.value[0]) for x in batch.column("w")]
            yield pa.RecordBatch.from_arrays([batch.column("w"), pa.array(got, pa.float64())], names=["w", "f"])

    rated = counts.where("no > 0").where(odds < 0).select("w").mapInArrow(run, "w string, f double")
    hard = [r.w for r in rated.orderBy(F.desc("f"), "w").limit(HARD).collect()]  # HARD rows at most
    return train(seeds, toxic, clean, hard)


def _raw(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in parts(batches):
            got = [word_scores(x.as_py() or "", weights) + bias for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.maximum(got, -3.0))], names=["doc_id", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, f double")


def logistic(f: np.ndarray, yes: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0) and intercept of a logistic curve, by damped Newton steps with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -35, 35)))
        w = n * p * (1 - p)
        gradient = np.array([((n * p - yes) * f).sum() + 1e-2 * a, (n * p - yes).sum() + 1e-2 * b])
        hessian = np.array([[(w * f * f).sum() + 1e-2, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-2]])
        move = np.linalg.solve(hessian, gradient)
        move *= min(1.0, 2.0 / max(1e-9, np.abs(move).max()))
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return max(a, 0.0), b


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    ship(docs.sparkSession)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = _training(own, labels)
    model = _learn(rows)
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    if model is None:
        n, yes = rows.agg(F.count(F.lit(1)), F.count_if("t")).first()
        value = F.lit(float(yes / n) if n and yes < n else 0.0)
        return own.select("doc_id", out.alias("held_out"), value.alias("score"), (value >= THRESHOLD).cast("int").alias("predicted"))
    scored = cut(_raw(own, model), "scores")
    fit = _raw(rows.select("doc_id", "t", "text"), model).withColumnRenamed("doc_id", "d").join(rows.select(F.col("doc_id").alias("d"), "t"), "d")
    step = F.least(F.floor((F.col("f") + 3) * 50), F.lit(BINS)) / 50 - 3
    bins = fit.groupBy(step.alias("f")).agg(F.count(F.lit(1)).alias("n"), F.count_if("t").alias("yes")).orderBy("f").collect()  # BINS + 1 rows at most, as scores are at least -3
    a, b = logistic(*(np.array([float(r[c]) for r in bins]) for c in ("f", "yes", "n")))
    value = 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), a * F.col("f") + b))))
    return scored.select("doc_id", out.alias("held_out"), value.alias("score"), (value >= THRESHOLD).cast("int").alias("predicted"))
