"""Exact removal of repeated strings, by maximal repeats of a sparse enhanced suffix array.

A Scheme says what a string is: BYTES, 400 bytes; PASSAGES, 51 words, that is over 50, whatever spaces part them.

Anchors: a string of `gram` symbols is an anchor where its hash is the least of all that start in some length - gram + 1 places in a
row.  Equal strings of `length` symbols have an equal anchor at the same place, so every repeat shows at a repeated anchor.

 1. Anchors of all texts are counted by hash (combined before the shuffle); those that occur twice mark a bitmap of bounded size.
 2. Texts are read again, where they are; each anchor that the bitmap holds gets its context: length - gram symbols before and after
    it.  An anchor that it holds by chance meets no other; a bitmap that fills up costs shuffled contexts, not results.
 3. Contexts are dealt by anchor hash into buckets.  A bucket sorts its anchored suffixes (the sparse suffix array), takes
    the common prefix of neighbours, and a stack scan yields the tree of common-prefix intervals.  In an interval of
    common prefix r, members sorted by their reversed left contexts show their left-extension diversity: a member that
    shares l symbols to the left with another belongs to a maximal repeat of l + r.  Those of `length` or more cover it.
    All occurrences of each are output.
 4. Anchors that occur more than GROUP_MOST times (a passage in a third of all documents, say) are not gathered: their
    windows of `length` are hashed (64 bits), resolved within blocks, and each block passes on one entry a window to the window's
    bucket, so a bucket gets no more entries of a window than there are blocks.  At most HOT_MOST anchors, the most frequent, are
    listed for this; a further one has at most a HOT_MOST-th of all places.
 5. Covered spans are united by text.  Equal texts, known by size and 64-bit hash, have equal spans.

Rows: about two anchors each 200 bytes, or 25 words, are counted; contexts are shipped for repeated anchors only.  Symbols of a
context are compared one by one (words by 32 bits of their hash each), the anchor between by its 64-bit hash.

Edge cases: a null text is empty and keeps nothing; texts shorter than `length` keep all; repeated rows repeat each other and
are removed wholly if long enough; overlapping repeats within one text count; a text of any length is held whole by the one
task that cuts it, and hashed in one piece; an empty table gives no rows; further columns are ignored by the report and kept by
remove_repeats, whatever their names.  doc_id may be anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm import bitmap
from gristmill.llm._util import cut, ship, small
from gristmill.llm.textkernel import SALT, U, Words, grams, mix, parts, prefix_hash, slices, span_hash, tidy, utf8


@dataclass(frozen=True)
class Scheme:
    """What repeats are made of: symbols of `unit` bytes, the least length of a repeat, and the length of an anchor.

    A unit of 1 stands for bytes, one of 4 for words, each as 32 bits of its hash.  unit * (length - gram) is a multiple of 8.
    """

    length: int
    gram: int
    unit: int

    @property
    def side(self) -> int:
        return self.length - self.gram


BYTES = Scheme(400, 200, 1)
PASSAGES = Scheme(51, 27, 4)
#: Occurrences of an anchor that are compared in one task; more go another way.
GROUP_MOST = 5_000
#: Anchors that go the other way (8 MB), and contexts that a task hashes windows of at once.
HOT_MOST, HOT_SLICE = 1_000_000, 2_000
#: Contexts of a bucket, and window hashes of a bucket of frequent anchors, about.
BUCKET, HOT_BUCKET = 12_000, 1_000_000
#: So many texts and spans are broadcast to the texts (about 20 MB); for more, texts are shuffled.
BROADCAST = 400_000
_LOW32 = U(0xFFFFFFFF)


def _places(h: np.ndarray, sizes: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of every anchor; h: hashes of all strings of `gram` symbols, over the texts one after another."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    ends = np.cumsum(sizes)
    n = int(ends[-1]) - scheme.length + 1 if len(ends) else 0
    if n <= 0:
        return none
    # ordered by hash, then the last place first
    key = (h & ~_LOW32) | (_LOW32 - np.arange(len(h)).astype(U))
    w = scheme.side + 1
    rows = np.full(-(-len(key) // w) * w, ~U(0), U)
    rows[: len(key)] = key
    ahead = np.minimum.accumulate(rows.reshape(-1, w), axis=1).ravel()
    behind = np.minimum.accumulate(rows.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    inside = np.zeros(n + 1, np.int8)
    long = sizes >= scheme.length
    np.add.at(inside, (ends - sizes)[long], 1)
    np.add.at(inside, (ends - scheme.length + 1)[long], -1)
    least = least[np.cumsum(inside[:n]).astype(bool)]
    if not len(least):
        return none
    place = (_LOW32 - (least[np.append(True, least[1:] != least[:-1])] & _LOW32)).astype(np.int64)
    place = np.unique(place)
    text = np.searchsorted(ends, place, side="right")
    return text, place - (ends - sizes)[text], h[place]


def _read(texts: list[bytes], scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all texts, each text's first symbol and end, and the hashes of all strings of `gram` symbols."""
    if scheme.unit > 1:
        words = Words(texts)
        hashes = words.hashes()
        return hashes.astype(np.uint32), words.first, words.last, grams(hashes, scheme.gram)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    at = np.arange(max(0, len(buf) - scheme.gram + 1))
    return buf, np.append(0, ends[:-1]), ends, span_hash(prefix_hash(buf), at, at + scheme.gram)


def anchors(texts: list[bytes], scheme: Scheme = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of every anchor."""
    _, first, last, h = _read(texts, scheme)
    return _places(h, last - first, scheme)


def _counted(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """Anchors' hashes with their places' number in a batch."""
    for batch in parts(batches):
        texts = utf8(batch.column(0))
        found = [anchors(texts[a:b], scheme)[2] for a, b in slices(texts)]
        h, n = np.unique(np.concatenate([np.zeros(0, U), *found]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


@dataclass
class Contexts:
    """Anchors with the symbols before (reversed) and after each, as rows of bytes padded with zeros, and these symbols' numbers."""

    size: np.ndarray
    th: np.ndarray
    place: np.ndarray
    h: np.ndarray
    before: np.ndarray
    after: np.ndarray
    b_size: np.ndarray
    a_size: np.ndarray

    def take(self, rows: np.ndarray) -> Contexts:
        return Contexts(*(getattr(self, f)[rows] for f in self.__dataclass_fields__))


def _contexts(texts: list[bytes], size: np.ndarray, th: np.ndarray, scheme: Scheme, repeated: bitmap.Bitmap) -> Contexts:
    """The contexts of the texts' anchors that may occur twice."""
    symbols, first, last, h = _read(texts, scheme)
    text, place, h = _places(h, last - first, scheme)
    on = repeated.has(h)
    text, place, h = text[on], place[on], h[on]
    at, start, end = first[text] + place, first[text], last[text]
    step = np.arange(scheme.side)
    left, right = at[:, None] - 1 - step, at[:, None] + scheme.gram + step
    before = np.where(left >= start[:, None], symbols[np.maximum(left, 0)], 0) if len(at) else np.zeros((0, scheme.side), symbols.dtype)
    after = np.where(right < end[:, None], symbols[np.minimum(right, len(symbols) - 1)], 0) if len(at) else before
    raw = lambda m: np.ascontiguousarray(m.astype(symbols.dtype)).view(np.uint8)
    return Contexts(size[text], th[text], place, h.view(np.int64), raw(before), raw(after), np.minimum(scheme.side, at - start), np.minimum(scheme.side, end - at - scheme.gram))


def _matrix(column: pa.ChunkedArray, scheme: Scheme) -> np.ndarray:
    """Binary values of equal length as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), scheme.side * scheme.unit)


def _words(m: np.ndarray) -> np.ndarray:
    return m.view(">u8").astype(U)


def _common(m: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, unit: int) -> np.ndarray:
    """Symbols that rows i and rows j begin with in common."""
    differ = m[i] != m[j]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1]) // unit
    return np.minimum(first, np.minimum(size[i], size[j]))


def intervals(prefix: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """First row, last row and common prefix of each interval of the tree; prefix[i]: of rows i and i + 1, -1 for none."""
    stack: list[tuple[int, int]] = []
    for i, r in enumerate([*prefix.tolist(), -1]):
        first = i
        while stack and stack[-1][1] > r:
            first, top = stack.pop()
            yield first, i, top
        if r >= 0 and (not stack or stack[-1][1] < r):
            stack.append((first, r))


def maximal_extents(h: np.ndarray, before: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray], scheme: Scheme = BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Symbols before and after (from its start) that each anchor's repeats of `length` or more cover; -1 for none."""
    n = len(h)
    left, right = np.full(n, -1), np.full(n, -1)
    if n < 2:
        return left, right
    (b, b_size), (a, a_size) = before, after
    order = np.lexsort((*_words(a).T[::-1], h))
    turn = np.empty(n, np.int64)
    turn[np.lexsort((*_words(b).T[::-1], h))] = np.arange(n)
    i, j = order[:-1], order[1:]
    prefix = np.where(h[i] == h[j], _common(a, a_size, i, j, scheme.unit), -1)
    twos: list[tuple[int, int, int]] = []

    def cover(rows: np.ndarray, shared: np.ndarray, r: np.ndarray | int) -> None:
        ok = shared + scheme.gram + r >= scheme.length
        rows, shared, r = rows[ok], shared[ok], np.broadcast_to(r, shared.shape)[ok]
        np.maximum.at(left, rows, shared)
        np.maximum.at(right, rows, r + scheme.gram)

    for first, last, r in intervals(prefix):
        if last == first + 1:
            twos.append((first, last, r))
            continue
        rows = order[first : last + 1]
        rows = rows[np.argsort(turn[rows], kind="stable")]
        near = _common(b, b_size, rows[:-1], rows[1:], scheme.unit)
        shared = np.maximum(np.append(near, 0), np.append(0, near))
        cover(rows, shared, r)
    if twos:
        first, last, r = np.array(twos).T
        i, j = order[first], order[last]
        near = _common(b, b_size, i, j, scheme.unit)
        cover(i, near, r)
        cover(j, near, r)
    return left, right


_SPAN = "size long, th long, start long, stop long"


def _spans(size: np.ndarray, th: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (size, th, start, stop)], names=["size", "th", "start", "stop"])


def _bucket(held: pa.Table, scheme: Scheme) -> pa.RecordBatch:
    column = lambda c: held.column(c).to_numpy()
    left, right = maximal_extents(column("h"), (_matrix(held.column("before"), scheme), column("b_size")), (_matrix(held.column("after"), scheme), column("a_size")), scheme)
    ok = right >= 0
    place = column("place")[ok]
    return _spans(column("size")[ok], column("th")[ok], place - left[ok], place + right[ok])


def window_hashes(h: np.ndarray, before: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray], scheme: Scheme = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, anchor and symbols before the anchor of each window of `length` around the anchors."""
    (b, b_size), (a, a_size) = before, after
    side = scheme.side

    def ladder(m: np.ndarray) -> np.ndarray:
        power = np.multiply.accumulate(np.full(side, U(0x9E3779B97F4A7C15)))
        out = np.zeros((len(m), side + 1), U)
        np.cumsum((SALT[m] if scheme.unit == 1 else mix(m.view(np.uint32).astype(U) + U(1))) * power, axis=1, out=out[:, 1:])
        return out

    l = np.arange(side + 1)  # noqa: E741
    key = mix(mix(ladder(b) ^ SALT[1]) + mix(ladder(a)[:, ::-1] ^ SALT[2]) * U(3) + mix(h.view(U))[:, None] + l.astype(U))
    ok = (l <= b_size[:, None]) & (side - l <= a_size[:, None])
    who, lead = np.nonzero(ok)
    return key[ok], who, lead


#: Rows on their way to a bucket: a context, or the windows of many frequent ones.
_DEALT = "bucket long, size long, th long, place long, h long, b_size long, a_size long, before binary, after binary, keys binary, sizes binary, ths binary, starts binary, own binary"
_COLUMNS = {x.split()[0]: pa.binary() if x.endswith("binary") else pa.int64() for x in _DEALT.split(", ")}


def _row(columns: dict[str, object], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _COLUMNS.items()], names=list(_COLUMNS))


def _deal_windows(x: Contexts, buckets: int, base: int, scheme: Scheme) -> pa.RecordBatch:
    """Windows around frequent anchors by bucket: those that occur once in x with their place, the others resolved, as spans (`own`)."""
    none = np.uint32(0xFFFFFFFF)
    key, who, lead = window_hashes(x.h, (x.before, x.b_size), (x.after, x.a_size), scheme)
    key, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    again = n[back] > 1
    own = _merged(x.size[who[again]], x.th[who[again]], x.place[who[again]] - lead[again], scheme.length)
    owner = np.where(n > 1, none, who[first].astype(np.uint32))
    of = (key % U(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(buckets + 1))
    rows: dict[str, list] = {c: [] for c in ("bucket", "keys", "sizes", "ths", "starts", "own")}
    for k in range(buckets):
        mine = order[bounds[k] : bounds[k + 1]]
        if not len(mine) and k:
            continue
        o = owner[mine]
        known = np.where(o == none, 0, o)
        begin = np.where(o == none, -1, x.place[known] - lead[first[mine]]) if len(mine) else np.zeros(0, np.int64)
        rows["bucket"].append(base + k)
        rows["keys"].append(key[mine].tobytes())
        rows["sizes"].append(x.size[known].tobytes())
        rows["ths"].append(x.th[known].tobytes())
        rows["starts"].append(begin.astype(np.int64).tobytes())
        rows["own"].append(np.stack(own).astype(np.int64).tobytes() if k == 0 else b"")
    return _row(rows, len(rows["bucket"]))


def _meet(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """Spans of windows that occur twice, of all windows of a bucket."""
    got: dict[str, list[bytes]] = {c: [] for c in ("keys", "sizes", "ths", "starts")}
    for part in batches:
        for c in got:
            got[c] += part.column(c).to_pylist()
        for own in part.column("own").to_pylist():
            if own:
                yield _spans(*np.frombuffer(own, np.int64).reshape(4, -1))
    keys = np.frombuffer(b"".join(got["keys"]), U)
    size, th, start = (np.frombuffer(b"".join(got[c]), np.int64) for c in ("sizes", "ths", "starts"))
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    hit = (n[back] > 1) & (start >= 0)
    yield _spans(*_merged(size[hit], th[hit], start[hit], scheme.length))


def _merged(size: np.ndarray, th: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Windows' starts as spans, those that touch united."""
    order = np.lexsort((start, th, size))
    size, th, start = size[order], th[order], start[order]
    new = np.append(True, (size[1:] != size[:-1]) | (th[1:] != th[:-1]) | (start[1:] > start[:-1] + length))[: len(size)]
    last = np.append(new[1:], True)[: len(size)]
    return size[new], th[new], start[new], start[last] + length


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.octet_length(text).cast("long").alias("size"), F.xxhash64(text).alias("th"), text.alias("text"))


def _near(lists: DataFrame, column: str) -> DataFrame:
    """A written table of lists, with a broadcast hint if all their members are at most BROADCAST."""
    rows, members = lists.agg(F.count(F.lit(1)), F.sum(F.size(column))).first()
    return F.broadcast(lists) if rows + (members or 0) <= BROADCAST else lists


def repeated_spans(docs: DataFrame, group_most: int = GROUP_MOST, scheme: Scheme = BYTES) -> DataFrame:
    """(size, th, spans): the maximal runs of symbols, by start, that repeats cover in each text of that size and hash."""
    spark = docs.sparkSession
    ship(spark)
    least = scheme.length // 4 if scheme.unit == 1 else 2 * scheme.length - 1  # characters that a text with a repeat has at least
    texts = _keyed(docs).where(F.length("text") >= least)
    counted = texts.select("text").mapInArrow(lambda b: _counted(b, scheme), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = cut(counted.where("n > 1"), "anchors")
    hot = counts.where(F.col("n") > group_most).orderBy(F.desc("n"), "h").limit(HOT_MOST).collect()  # HOT_MOST rows at most
    n, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    many = sum(r.n for r in hot)
    cold, warm = max(12, ((total or 0) - many) // BUCKET + 1), max(12, many * (scheme.side + 1) // HOT_BUCKET + 1)
    shared = spark.sparkContext.broadcast((bitmap.of_hashes(counts, "h", n), np.sort(np.array([r.h for r in hot], np.int64))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, frequent = shared.value
        for batch in parts(batches):
            texts = utf8(batch.column("text"))
            size, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "th"))
            for a, b in slices(texts):
                x = _contexts(texts[a:b], size[a:b], th[a:b], scheme, repeated)
                is_hot = np.zeros(len(x.h), bool)
                if len(frequent):
                    is_hot = frequent[np.minimum(np.searchsorted(frequent, x.h), len(frequent) - 1)] == x.h
                own = x.take(np.flatnonzero(~is_hot))
                if len(own.h):
                    plain = {c: pa.array(getattr(own, c)) for c in ("size", "th", "place", "h", "b_size", "a_size")}
                    wide = {c: pa.array([r.tobytes() for r in getattr(own, c)], pa.binary()) for c in ("before", "after")}
                    yield _row({"bucket": pa.array((mix(own.h.view(U) ^ SALT[5]) % U(cold)).astype(np.int64)), **plain, **wide}, len(own.h))
                rows = np.flatnonzero(is_hot)
                for k in range(0, len(rows), HOT_SLICE):
                    yield _deal_windows(x.take(rows[k : k + HOT_SLICE]), warm, cold, scheme)

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key[0].as_py() < cold:
            yield _bucket(pa.Table.from_batches(list(batches)), scheme)
        else:
            yield from _meet(batches, scheme)
        tidy()

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [[{"start": a, "stop": b} for a, b in united(own)] for own in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("size"), batch.column("th"), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=["size", "th", "spans"])

    spans = texts.mapInArrow(deal, _DEALT).groupBy("bucket").applyInArrow(meet, _SPAN).distinct()
    lists = spans.groupBy("size", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # as many as a text has anchors
    return _near(cut(lists.mapInArrow(unite, "size long, th long, spans array<struct<start:long,stop:long>>"), "spans"), "spans")


def united(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["stop"]) for x in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def report(docs: DataFrame, group_most: int = GROUP_MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row by BYTES; n_passages and n_passage_words by PASSAGES.

    n_passages: maximal runs of words covered by passages of over 50 words that also occur elsewhere.
    """
    spans = repeated_spans(docs, group_most)
    passages = repeated_spans(docs, group_most, PASSAGES).withColumnRenamed("spans", "passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            left = (without(text, united(own)) for text, own in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("size"), batch.column("th"), pa.array([hashlib.sha256(x).hexdigest() for x in left])], names=["size", "th", "digest"])

    keyed = _keyed(docs)
    hit = keyed.join(spans, ["size", "th"]).select("size", "th", "text", "spans")
    digests = cut(hit.mapInArrow(run, "size long, th long, digest string").distinct(), "digests")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", F.octet_length(text).cast("long").alias("size"), F.xxhash64(text).alias("th"), F.sha2(text.cast("binary"), 256).alias("whole"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    count = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    of_text = spans.join(digests, ["size", "th"]).join(passages, ["size", "th"], "full")
    zero = F.lit(0).cast("long")
    figures = of_text.select("size", "th", F.coalesce(total("spans"), zero).alias("n_removed"), F.coalesce(count("spans"), zero).alias("n_spans"), "digest", F.coalesce(count("passages"), zero).alias("n_passages"), F.coalesce(total("passages"), zero).alias("n_passage_words"))
    out = base.join(small(cut(figures, "figures"), BROADCAST), ["size", "th"], "left")
    return out.select("doc_id", F.col("size").alias("n_bytes"), *(F.coalesce(c, zero).alias(c) for c in ("n_removed", "n_spans")), F.coalesce("digest", "whole").alias("kept_sha256"), *(F.coalesce(c, zero).alias(c) for c in ("n_passages", "n_passage_words")))


def _left(text: bytes, spans: list[dict], scheme: Scheme) -> str:
    """What stays of a text; a character that is cut in part goes wholly."""
    runs = united(spans)
    if scheme.unit > 1:
        words = Words([text])
        return without(text, [(int(words.start[a]), int(words.end[b - 1])) for a, b in runs]).decode()
    whole = []
    for a, b in runs:
        while a and text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        whole.append({"start": a, "stop": b})
    return without(text, united(whole)).decode()


def remove_repeats(docs: DataFrame, group_most: int = GROUP_MOST, scheme: Scheme = BYTES) -> DataFrame:
    """docs without their repeats, of which no occurrence stays; documents that lose all but spaces go.

    n_chars, if there, is brought up to date in rows whose text changes; all else stays as it is, null and empty texts included.
    """
    spans = repeated_spans(docs, group_most, scheme)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.octet_length(text).cast("long").alias("size"), F.xxhash64(text).alias("th"), text.alias("text"))
    joined = rows.join(spans, ["size", "th"], "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            pairs = zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True)
            left = [None if own is None else _left(x.as_py().encode(), own, scheme) for x, own in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(left, pa.string())], names=["row", "left"])

    out = joined.mapInArrow(run, T.StructType([T.StructField("row", docs.schema), T.StructField("left", T.StringType())]))
    out = out.where(F.col("left").isNull() | (F.trim(F.translate("left", "\t\n\x0b\x0c\r", "     ")) != ""))
    new = {"text": F.col("left"), "n_chars": F.length("left")}
    fresh = lambda f: F.when(F.col("left").isNotNull(), new[f.name].cast(f.dataType)).otherwise(F.col(f"row.`{f.name}`"))
    return out.select(*((fresh(f) if f.name in new else F.col(f"row.`{f.name}`")).alias(f.name) for f in docs.schema))
