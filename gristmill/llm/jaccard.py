"""Exact n-gram Jaccard join, with groups of linked documents.

A document's set holds its distinct five-word shingles, as 64-bit hashes.  Sets x and y link if 100|x & y| >= 80|x | y|.

Plan (D: documents, S: distinct sets):
 1. Shingles in the lowest SHARE of the hash range are counted over all distinct sets, combined before one shuffle; so are
    the others of those sets that hold too few rare ones of these.  The most frequent form a list of at most HOT_MOST; all
    that occur twice mark a bitmap of bounded size.
    Both only steer the order of shingles and the skipping of singletons: results are the same whatever they hold.
 2. Shingles of a set are ordered: counted and rare, uncounted, frequent.  Linked sets share a shingle of their first
    n - ceil(0.8 n) + 1; those of them that occur once are left out, and a set with none left has no links.
 3. Index lists, one for each prefix shingle, are formed by bucket and ordered by set size and position.
    Star rounds: each member is compared with one hub of its list, the smallest or largest of fitting size, or one drawn.  Before the
    shuffle each block of sets does this for itself and passes on only its members of a list's extreme sizes.
    Members that link to a hub take its answer, its component; pairs within a component are never compared.
 4. Last round: members of lists that still hold several components are compared across these.  A list's entries form blocks
    of BLOCK; two blocks are skipped as wholes beyond the fitting sizes, where their positions leave too few shingles for
    the overlap needed, and where both hold one and the same component.
 5. Each candidate pair is checked on its whole texts.  Components come from alternating stars.

Every link between different sets is found or implied by a path of found links, so components are exact.  Equal sets
count once.  A set is identified by a 64-bit hash of its sorted hashes and its size.

Edge cases: null texts and texts without words have no set, no links and themselves as component; fewer than five words
form one shingle; a text of any length is hashed whole; repeated rows fall together; an empty table gives no rows; further
columns are ignored by groups() and kept by one_each(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import bitmap
from gristmill.llm._util import cut, ship, small, spread_join
from gristmill.llm.components import components
from gristmill.llm.textkernel import SALT, U, Words, grams, mix, parts, slices, tidy, utf8

N = 5
#: Shingles with a hash below this are counted.
SHARE = 0.25
LIMIT = U(int(SHARE * 2**64))
#: A shingle of so many sets is frequent; at most HOT_MOST, the most frequent, are listed (8 MB).
HOT_LEAST, HOT_MOST = 24, 1_000_000
#: Star rounds by kind of hub, then the exact one.
ROUNDS = ("smallest", "drawn1", "drawn2", "across")
#: Hubs that a drawn round compares each member with.
DRAWN = 6
#: So many sets whose texts are compared are broadcast to find the texts (at most about 20 MB); for more, texts are shuffled.
WANTED = 250_000
#: Cells of a set's count vector, which bounds overlaps from above.
CELLS, COARSE = 256, 64
#: Entries of a list that one task of the last round takes at most; longer lists are dealt into parts.
LIST_MOST = 20_000
#: Entries of a block of a list, which is skipped as a whole.
BLOCK = 32
#: Prefix shingles of one bucket of lists, about.
BUCKET = 750_000


def _mix_sum(values: np.ndarray) -> int:
    return int(mix(np.array([np.add.reduce(mix(values ^ SALT[7])) ^ U(len(values))], U))[0])


def shingle_sets(texts: list[bytes], n: int = N) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b in slices(texts):
        w = Words(texts[a:b], lower=True)
        hashes = w.hashes()
        for f, t in zip(w.first.tolist(), w.last.tolist(), strict=True):
            g = grams(hashes[f:t], min(n, t - f)) if t > f else np.zeros(0, U)
            g.sort()
            if len(g) > 1 and (again := g[1:] == g[:-1]).any():
                g = g[np.append(True, ~again)]
            yield g


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """ceil(0.8 n): the least overlap that a set of n shingles can have with a linked set."""
    return (80 * n + 99) // 100


def _signed(sig: int) -> int:
    return sig if sig < 1 << 63 else sig - (1 << 64)


class Order:
    """The order of shingles: counted and rare, uncounted, frequent; within these by count and hash."""

    def __init__(self, frequent: list[tuple[int, int]]):
        """frequent: shingles (signed) and counts, the most frequent first."""
        tokens = np.array([t for t, _ in frequent], np.int64).view(U)
        order = np.argsort(tokens)
        self.tokens, self.rank = tokens[order], (len(frequent) - order).astype(np.uint32)

    def ranks(self, s: np.ndarray) -> np.ndarray:
        """0 for counted and rare shingles of a set, 1 for uncounted, more for frequent."""
        rank = np.zeros(len(s), U)
        rank[np.searchsorted(s, LIMIT) :] = 1
        if len(self.tokens):
            at = np.searchsorted(self.tokens, s)
            at[at == len(self.tokens)] = 0
            found = np.flatnonzero(self.tokens[at] == s)
            rank[found] = U(2) + self.rank[at[found]]
        return rank


def _count(texts: DataFrame, order: Order | None) -> DataFrame:
    """Shingles that occur in two distinct sets of a task each, with counts: counted ones, or, given an order by these, the
    uncounted ones of sets whose prefix reaches them."""
    known = order and texts.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in parts(batches):
            found = []
            for s in shingle_sets(utf8(batch.column(0))):
                if not len(s) or (sig := _mix_sum(s)) in seen:
                    continue
                seen.add(sig)
                if known is None:
                    found.append(s[: np.searchsorted(s, LIMIT)])
                elif int((known.value.ranks(s) == 0).sum()) < len(s) - needed(len(s)) + 1:
                    found.append(s[np.searchsorted(s, LIMIT) :])
            if found:
                tokens, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], names=["token", "n"])

    counted = texts.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
    return cut(counted, "counts")


def _frequent(counts: DataFrame) -> list[tuple[int, int]]:
    rows = counts.where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "token").limit(HOT_MOST).collect()  # HOT_MOST rows at most
    return [(r.token, r.n) for r in rows]


def _sets(texts_of: DataFrame) -> DataFrame:
    """doc_id, th, n, sig of every row; tokens, places and cells for the first of each distinct set in a task that may link."""
    counts = _count(texts_of, None)
    order = Order(_frequent(counts))
    more = _count(texts_of, order)
    every = counts.unionAll(more)
    shared = texts_of.sparkSession.sparkContext.broadcast((Order(_frequent(every)), bitmap.of_hashes(every, "token", every.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, repeated = shared.value
        seen: set[int] = set()
        for batch in parts(batches):
            texts = utf8(batch.column("text"))
            size, sigs, cells, tokens, places = [], [], [], [], []
            for s in shingle_sets(texts):
                n = len(s)
                sig = _mix_sum(s) if n else None
                size.append(n)
                sigs.append(None if sig is None else _signed(sig))
                cells.append(None)
                tokens.append(None)
                places.append(None)
                if not n or sig in seen:
                    continue
                seen.add(sig)
                first = np.argsort(order.ranks(s), kind="stable")[: n - needed(n) + 1]
                t = s[first]
                twice = repeated.has(t)
                if twice.any():
                    c = np.bincount((s & U(CELLS - 1)).astype(np.int64), minlength=CELLS)
                    cells[-1] = c.astype(np.uint8 if c.max() < 256 else np.uint32).tobytes()
                    tokens[-1] = t[twice].tobytes()
                    places[-1] = np.flatnonzero(twice).astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(size, pa.int64()), pa.array(sigs, pa.int64()), pa.array(cells, pa.binary()), pa.array(tokens, pa.binary()), pa.array(places, pa.binary())], names=["doc_id", "th", "n", "sig", "cells", "tokens", "places"])

    kind = texts_of.schema["doc_id"].dataType.simpleString()
    return cut(texts_of.mapInArrow(run, f"doc_id {kind}, th long, n long, sig long, cells binary, tokens binary, places binary"), "sets")


#: Columns of an index list: shingle, set, size, position, component.
_LIST = ("token", "sig", "n", "place", "label")


def _unpack(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Rows (sig, n, tokens, places, label) of sets as columns of list entries."""
    raw = batch.column("tokens").to_pylist()
    each = np.fromiter((len(x) // 8 for x in raw), np.int64, len(raw))
    spread = lambda c: np.repeat(batch.column(c).to_numpy(zero_copy_only=False), each)
    return {"token": np.frombuffer(b"".join(raw), U), "sig": spread("sig"), "n": spread("n"), "place": np.frombuffer(b"".join(batch.column("places").to_pylist()), np.uint32).astype(np.int64), "label": spread("label")}


def _ordered(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """By shingle, size, position, set; each set once a list."""
    order = np.lexsort((x["sig"], x["place"], x["n"], x["token"]))
    x = {c: v[order] for c, v in x.items()}
    if len(order):
        fresh = np.append(True, (x["token"][1:] != x["token"][:-1]) | (x["sig"][1:] != x["sig"][:-1]))
        x = {c: v[fresh] for c, v in x.items()}
    return x


def _runs(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each entry's list, and the lists' first and last entries."""
    new = np.append(True, tokens[1:] != tokens[:-1])
    first = np.flatnonzero(new)
    return np.cumsum(new) - 1, first, np.append(first[1:], len(tokens)) - 1


def star_pairs(x: dict[str, np.ndarray], kind: str) -> np.ndarray:
    """Pairs of each entry with its list's hub, if of another component: the smallest or largest set of fitting size, or some drawn by hash."""
    if not len(x["token"]):
        return np.zeros((0, 2), np.int64)
    run, first, _ = _runs(x["token"])
    key = run.astype(np.int64) << 32
    if kind == "smallest":
        hubs = [np.searchsorted(key | x["n"], key | needed(x["n"]))]
    elif kind == "largest":
        hubs = [np.searchsorted(key | x["n"], key | (x["n"] * 100 // 80), side="right") - 1]
    else:
        draws = [mix(x["sig"].view(U) ^ SALT[DRAWN * int(kind[5:]) + k]) for k in range(DRAWN)]
        hubs = [np.lexsort((d, run))[first][run] for d in draws]
    found = []
    for hub in hubs:
        n, m = x["n"], x["n"][hub]
        room = np.minimum(n - x["place"], m - x["place"][hub])  # what the sets can still share from here on
        other = (x["label"][hub] != x["label"]) & (room >= -(-80 * (n + m) // 180))
        found.append(np.sort(np.stack([x["sig"][hub][other], x["sig"][other]], axis=1), axis=1))
    return np.unique(np.concatenate(found), axis=0)


def coarse(cells: bytes) -> bytes:
    """A count vector folded to COARSE cells of a byte, or nothing if a count is too large."""
    c = np.frombuffer(cells, np.uint8 if len(cells) == CELLS else np.uint32).astype(np.int64).reshape(COARSE, -1).sum(1)
    return c.astype(np.uint8).tobytes() if c.max() < 256 else b""


def _blocks(x: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """First entry, end, list, least and largest size, most room, least and largest component of each block of at most BLOCK entries of a list."""
    run, first, _ = _runs(x["token"])
    at = np.flatnonzero((np.arange(len(run)) - first[run]) % BLOCK == 0)
    over = lambda f, v: f.reduceat(v, at)
    room = x["n"] - x["place"]
    return at, np.append(at[1:], len(run)), run[at], x["n"][at], over(np.maximum, x["n"]), over(np.maximum, room), over(np.minimum, x["label"]), over(np.maximum, x["label"])


def block_pairs(x: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First entries and ends of blocks of a list, two and two, that sizes, positions and components don't rule out.

    Entries ascend by size, then position.  What two sets still share from an entry on is at most the rest of the shorter one, so two
    blocks are skipped as wholes where the most room of either is below the least overlap that their sizes need.
    """
    at, end, run, small_, large, room, low, high = _blocks(x)
    i = np.arange(len(at))
    for step in range(len(at)):
        i = i[i + step < len(at)]
        i = i[run[i] == run[i + step]]
        i = i[80 * small_[i + step] <= 100 * large[i]]  # sizes ascend: all further blocks are beyond reach
        if not len(i):
            return
        j = i + step
        need = -(-80 * (small_[i] + small_[j]) // 180)
        one = (low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j])
        ok = (np.minimum(room[i], room[j]) >= need) & ~one
        if ok.any():
            yield at[i[ok]], end[i[ok]], at[j[ok]], end[j[ok]]


def across_pairs(x: dict[str, np.ndarray], counts: np.ndarray) -> np.ndarray:
    """All pairs of a list's entries of different components that sizes, positions and counts allow to link.

    counts: each entry's folded count vector; no bound where it has none.
    """
    found = [np.zeros((0, 2), np.int64)]
    if len(x["token"]):
        n, label, sig = x["n"], x["label"], x["sig"]
        room = n - x["place"]
        for a, a_end, b, b_end in block_pairs(x):
            for k in np.array_split(np.arange(len(a)), len(a) * BLOCK * BLOCK // 250_000 + 1):
                i = (a[k][:, None] + np.arange(BLOCK))[:, :, None]
                j = (b[k][:, None] + np.arange(BLOCK))[:, None, :]
                i, j = (v[(i < a_end[k][:, None, None]) & (j < b_end[k][:, None, None]) & (i < j)] for v in np.broadcast_arrays(i, j))
                ok = (label[i] != label[j]) & (80 * n[j] <= 100 * n[i])
                i, j = i[ok], j[ok]
                need = -(-80 * (n[i] + n[j]) // 180)
                ok = np.minimum(room[i], room[j]) >= need
                i, j, need = i[ok], j[ok], np.minimum(need[ok], 4_000_000)
                for part in np.array_split(np.arange(len(i)), len(i) // 100_000 + 1):
                    ok = part[np.minimum(counts[i[part]], counts[j[part]]).sum(1, dtype=np.int64) >= need[part]]
                    if len(ok):
                        found.append(np.sort(np.stack([sig[i[ok]], sig[j[ok]]], axis=1), axis=1))
                if sum(map(len, found)) > 2 * max(1_000_000, len(found[0])):
                    found = [np.unique(np.concatenate(found), axis=0)]
    pairs = np.concatenate(found)
    return np.unique(pairs, axis=0) if len(pairs) else pairs


def _candidates(sets: DataFrame, mode: str, buckets: int) -> DataFrame:
    """Pairs (a, b) of sets to compare with hubs, from index lists; mode: smallest, largest or drawn with a number."""
    packed = [(c, np.int64 if c != "token" else U) for c in _LIST]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _ordered(_unpack(batch))
            pairs = np.zeros((0, 2), np.int64)
            if len(x["token"]):
                pairs = star_pairs(x, mode)
                # A list's members here are tied to hubs; only the smallest and largest and one in each size step go on.
                run, first, last = _runs(x["token"])
                stride = (np.log(np.maximum(x["n"], 1)) / np.log(1.25) * 2).astype(np.int64)
                on = np.append(True, (run[1:] != run[:-1]) | (stride[1:] != stride[:-1]))
                on[last] = True
                x = {c: v[on] for c, v in x.items()}
            rows: dict[str, list] = {"bucket": [], **{c: [] for c in _LIST}, "pairs": []}
            of = (mix(x["token"] ^ SALT[3]) % U(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            bounds = np.searchsorted(of[order], np.arange(buckets + 1))
            for k in range(buckets):
                own = order[bounds[k] : bounds[k + 1]]
                if len(own) or (k == 0 and len(pairs)):
                    rows["bucket"].append(k)
                    for c, t in packed:
                        rows[c].append(x[c][own].astype(t).tobytes())
                    rows["pairs"].append(pairs.tobytes() if k == 0 else b"")
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(rows["bucket"], pa.int64()), **{c: pa.array(rows[c], pa.binary()) for c in (*_LIST, "pairs")}})

    def lists(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list[bytes]] = {c: [] for c in (*_LIST, "pairs")}
        for part in parts:
            for c in columns:
                columns[c] += part.column(c).to_pylist()
        x = _ordered({c: np.frombuffer(b"".join(columns[c]), t) for c, t in packed})
        own = star_pairs(x, mode)
        pairs = np.concatenate([own, np.frombuffer(b"".join(columns["pairs"]), np.int64).reshape(-1, 2)])
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        tidy()

    binary = ", ".join(f"{c} binary" for c in (*_LIST, "pairs"))
    dealt = sets.select("sig", "n", "tokens", "places", "label").mapInArrow(deal, f"bucket long, {binary}")
    return dealt.groupBy("bucket").applyInArrow(lists, "a long, b long").distinct()


def _across(sets: DataFrame, buckets: int, most: int = LIST_MOST) -> DataFrame:
    """Pairs (a, b) of sets of different components, from the lists that hold several.

    A list of more than `most` entries is dealt into parts, and every two parts meet in a cell, so no task gets it whole.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpack(batch)
            each = np.repeat(np.arange(batch.num_rows), [len(t) // 8 for t in batch.column("tokens").to_pylist()])
            cells = pa.array([coarse(c) for c in batch.column("cells").to_pylist()], pa.binary()).take(pa.array(each))
            yield pa.RecordBatch.from_arrays([pa.array(x["token"].view(np.int64)), *(pa.array(x[c].astype(np.int64)) for c in _LIST[1:]), cells], names=[*_LIST, "cells"])

    def lists(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(parts))
        columns = {c: held.column(c).to_numpy() for c in _LIST}
        x = _ordered(columns | {"row": np.arange(held.num_rows)})
        raw = held.column("cells").to_pylist()
        counts = np.frombuffer(b"".join(raw[r] or b"\xff" * COARSE for r in x["row"].tolist()), np.uint8).reshape(-1, COARSE).astype(np.uint16)
        counts[[not raw[r] for r in x["row"].tolist()]] = 65_535
        del raw, columns, held
        pairs = across_pairs(x, counts)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        tidy()

    entries = sets.select("sig", "n", "tokens", "places", "label", "cells").mapInArrow(spread, "token long, sig long, n long, place long, label long, cells binary")
    mixed = entries.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    mixed = mixed.select(F.col("token").alias("t"), F.ceil(F.col("size") / most).cast("long").alias("parts"))
    some = entries.join(mixed, F.col("token") == F.col("t")).withColumn("own", F.expr("pmod(xxhash64(sig), parts)"))
    cells = some.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    cells = cells.withColumn("token", F.when(F.col("parts") == 1, F.col("token")).otherwise(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))))
    return cells.withColumn("bucket", F.expr(f"pmod(xxhash64(token), {buckets})")).select("bucket", *_LIST, "cells").groupBy("bucket").applyInArrow(lists, "a long, b long").distinct()


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text_a, text_b) whose sets link, as (a, b)."""
    hub: tuple[int | None, np.ndarray] = (None, np.zeros(0, U))
    for batch in parts(batches):
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep = []
        members = shingle_sets(utf8(batch.column("text_b")))
        hub_texts = batch.column("text_a")
        for i, y in enumerate(members):
            if hub[0] != a[i]:
                hub = (a[i], next(shingle_sets([hub_texts[i].as_py().encode()])))
            x = hub[1]
            both = len(x) + len(y) - len(np.union1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, cells_a, cells_b, ..) whose count vectors allow the overlap needed."""

    def counts(x: bytes) -> np.ndarray:
        return np.frombuffer(x, np.uint8 if len(x) == CELLS else np.uint32)

    for batch in batches:
        keep = []
        for x, y in zip(batch.column("cells_a").to_pylist(), batch.column("cells_b").to_pylist(), strict=True):
            x, y = counts(x), counts(y)
            both = int(np.minimum(x, y).sum())
            keep.append(100 * both >= 80 * (int(x.sum()) + int(y.sum()) - both))
        names = ["a", "doc_a", "th_a", "b", "doc_b", "th_b"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in names], names=names).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame, texts: DataFrame, tag: str) -> DataFrame:
    """Those of pairs that link: count vectors first, then whole texts of what is left."""
    one = sets.dropDuplicates(["sig"])
    of = lambda x: one.select(F.col("sig").alias(x), F.col("doc_id").alias(f"doc_{x}"), F.col("th").alias(f"th_{x}"), F.col("cells").alias(f"cells_{x}"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    left = pairs.join(of("b"), "b").join(of("a"), "a").mapInArrow(_possible, f"a long, doc_a {kind}, th_a long, b long, doc_b {kind}, th_b long")
    left = cut(left, f"possible_{tag}")
    wanted = left.select(F.col("a").alias("sig"), F.col("doc_a").alias("d"), F.col("th_a").alias("t")).unionAll(left.select("b", "doc_b", "th_b")).distinct()
    wanted = small(cut(wanted, f"wanted_{tag}"), WANTED)
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["d"]) & (texts["th"] == wanted["t"])).select("sig", "text").dropDuplicates(["sig"])
    both = left.select("a", "b").join(found.select(F.col("sig").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(found.select(F.col("sig").alias("a"), F.col("text").alias("text_a")), "a")
    return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long"), f"links_{tag}")


def _labelled(docs: DataFrame, list_most: int = LIST_MOST) -> DataFrame:
    """doc_id, th, n, label of every row; label: of its component, null without shingles."""
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    texts = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    rows = _sets(texts)
    sets = rows.where("tokens is not null")
    total = sets.agg(F.sum(F.length("tokens") / 8)).first()[0] or 0
    buckets = max(12, int(total) // BUCKET + 1)
    links = labels = None
    for tag in ROUNDS:
        if labels is None:
            labelled = sets.withColumn("label", F.col("sig"))
        else:
            labelled = sets.join(labels.select(F.col("u").alias("sig"), F.col("v").alias("label")), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        pairs = _across(labelled, buckets, list_most) if tag == "across" else _candidates(labelled, tag, buckets)
        new = _links(pairs, sets, texts, tag)
        links = new if links is None else links.unionAll(new)
        labels = components(links)
    named = rows.select("doc_id", "th", "n", "sig").join(labels.select(F.col("u").alias("sig"), F.col("v").alias("label")), "sig", "left")
    return named.select("doc_id", "th", "n", F.coalesce("label", "sig").alias("label"))


def groups(docs: DataFrame, list_most: int = LIST_MOST) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    named = cut(_labelled(docs, list_most), "labelled")
    least = cut(named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    some = spread_join(named.withColumnRenamed("n", "n_shingles").where("label is not null"), least, "label").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return some.unionAll(named.where("label is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def one_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, that of the smallest id, then of the least hash of its text; columns stay as they are.

    Rows with the same id and text fall to one; different texts under one id, or without an id, are judged each by itself.
    """
    found = cut(_labelled(docs), "groups")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))
    first = found.where("label is not null").groupBy("label").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    gone = spread_join(found.select("doc_id", "th", "label"), cut(first, "first"), "label").where(~own).select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct()
    gone = small(cut(gone, "gone"), WANTED)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    rest = rows.join(gone, F.col("id").eqNullSafe(F.col("d")) & F.xxhash64("text").eqNullSafe(F.col("t")), "left_anti")
    again = found.groupBy("doc_id", "th").count().where("count > 1").limit(1).count()
    rest = rest.dropDuplicates(["id", "text"]) if again else rest
    return rest.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
