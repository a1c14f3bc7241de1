"""Order-preserving packing into windows of at most 2048 tokens.

The documents of an input partition form one token stream, in order.  Windows are cut at document ends, sentence
ends or, at most every `stride` tokens of a longer sentence, inside one.  Dynamic programming picks the cuts that
minimise padding + truncation penalties + a small cost a window:

    best(i) = penalty(i) + cost + min over j of best(j) + pad(pos_i - pos_j)

pad(L) is window - L, and 0 where L is a power of two.  The first kind of transition is a sliding-window minimum of
best(j) + pos_j, kept in a monotone queue; the second has at most 12 candidates, found by binary search.

Nothing is shuffled: a partition is packed where it is read, in runs of about `run_tokens`, so memory is bounded by
that and the longest text, and a lost task is redone from its own split with the same result.

Edge cases: a null or empty text is the end-of-text id alone; an empty table gives no rows; repeated rows are packed
as often as they come; columns other than doc_id and text are ignored; ties take the earlier cut.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gristmill.llm._util import ship

WINDOW = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
#: Penalties in tokens of padding; see the module's formula.
SENTENCE_PENALTY, INNER_PENALTY, WINDOW_COST = 12, 48, 8
STRIDE = 128
RUN_TOKENS = 1 << 20


def choose_cuts(pos: np.ndarray, penalty: np.ndarray, window: int = WINDOW, cost: int = WINDOW_COST) -> list[int]:
    """Indices into pos, first and last included, of the cheapest cuts.  pos: increasing, gaps of at most window."""
    n = len(pos)
    jumps: dict[int, list[int]] = {}
    size = 1
    while size < window:
        at = np.searchsorted(pos, pos - size)
        for i in np.flatnonzero((pos >= size) & (pos[np.minimum(at, n - 1)] == pos - size)).tolist():
            jumps.setdefault(i, []).append(int(at[i]))
        size *= 2
    p, pen = pos.tolist(), penalty.tolist()
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(p[0], p[0], 0)])  # best + pos, pos, index
    none: list[int] = []
    for i in range(1, n):
        x = p[i]
        while queue[0][1] < x - window:
            queue.popleft()
        top = queue[0]
        c, b = top[0] + window - x, top[2]
        for j in jumps.get(i, none):
            if best[j] < c or best[j] == c and j < b:
                c, b = best[j], j
        best[i] = c = c + pen[i] + cost
        back[i] = b
        while queue and queue[-1][0] > c + x:
            queue.pop()
        queue.append((c + x, x, i))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions and their penalties.  ends: the documents' ends in the stream; sentence: by id, whether it ends one."""
    kind = np.full(len(ids) + 1, -1, np.int16)
    kind[1:][sentence[ids]] = SENTENCE_PENALTY
    kind[0] = 0
    kind[ends] = 0
    pos = np.flatnonzero(kind >= 0)
    gap = np.diff(pos)
    if (long := np.flatnonzero(gap > stride)).size:
        kind[np.concatenate([np.arange(pos[k] + stride, pos[k + 1], stride) for k in long])] = INNER_PENALTY
        pos = np.flatnonzero(kind >= 0)
    return pos, kind[pos].astype(np.int64)


class Encoder:
    """Ids of the public byte-level BPE.

    Its ranks file gives the same ids about five times as fast; the tokenizer file itself is used for texts with its
    special token or with characters beyond those whose classes every Unicode version shares.
    """

    OTHER = re.compile("[^\x00-ͷ΄-ҁҐ-ԧ‐-‧‰-›€]|<\\|endoftext\\|>")

    def __init__(self, name: str = TOKENIZER):
        import base64
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(name))
        self.special = np.array([self.slow.token_to_id("<|endoftext|>")])
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sentence = np.zeros(max(ranks.values()) + 2, bool)
        for token, i in ranks.items():
            self.sentence[i] = token.strip(b" ")[-1:] in (b".", b"!", b"?", b"\n")
        self.sentence[END_ID] = True

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.array([END_ID], np.uint32)
        if self.OTHER.search(text):
            own = np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            own = self.fast.encode_to_numpy(text)
        out = np.empty(len(own) + 1, np.uint32)
        out[:-1] = own
        out[-1] = END_ID
        return out


def pack_run(streams: list[np.ndarray], sentence: np.ndarray) -> dict[str, np.ndarray]:
    """Pieces of one run; `doc` is an index into streams, `sequence` counts from 0."""
    ids = np.concatenate(streams)
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    ends = np.cumsum(sizes)
    pos, penalty = candidates(ids, ends, sentence)
    cuts = pos[choose_cuts(pos, penalty)]
    edges = np.union1d(cuts, ends)
    start, stop = edges[:-1], edges[1:]
    doc = np.searchsorted(ends, start, side="right")
    sequence = np.searchsorted(cuts, start, side="right") - 1
    raw = ids.astype("<u4", copy=False)
    crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), np.int64, len(start))
    return {
        "doc": doc, "start": start - (ends - sizes)[doc], "length": stop - start, "ids_crc32": crc, "doc_tokens": sizes[doc],
        "sequence": sequence, "offset": start - cuts[sequence], "from": start, "ids": ids,
    }


def _packer(id_type: pa.DataType, with_ids: bool, run_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        base = TaskContext.get().partitionId() << 40
        keys: list = []
        streams: list[np.ndarray] = []
        held = done = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, done
            x = pack_run(streams, encoder.sentence)
            out = {"doc_id": pa.array(keys, id_type).take(pa.array(x["doc"])), **{k: pa.array(x[k], pa.int64()) for k in ("start", "length", "ids_crc32", "doc_tokens")}, "sequence_id": pa.array(x["sequence"] + (base + done)), "offset": pa.array(x["offset"])}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(x["from"], len(x["ids"])).astype(np.int32)), pa.array(x["ids"].astype(np.int32)))
            done += int(x["sequence"][-1]) + 1
            keys.clear()
            streams.clear()
            held = 0
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.ids(text.as_py())
                keys.append(key)
                streams.append(ids)
                held += len(ids)
                if held >= run_tokens:
                    yield flush()
        if streams:
            yield flush()

    return run


def pack_documents(docs: DataFrame, with_ids: bool = False, run_tokens: int = RUN_TOKENS) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the piece's ids if asked for."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_packer(to_arrow_type(kind), with_ids, run_tokens), schema)
