"""Deterministic hashing: splits, families, keys, ranks.  All on SHA digests, which every engine shares."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESERVED_ROWS = (11, 25)


def text(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def digest_mod(key: Column, n: int, algorithm: str = "sha256") -> Column:
    """The first eight digest bytes, big endian, modulo n."""
    hexed = F.sha2(key, 256) if algorithm == "sha256" else F.sha1(key)
    return (F.conv(F.substring(hexed, 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("long")


def split_of(task: Column, row: Column | None = None, seed: int = 0) -> Column:
    """Reserved rows to testreal; else 70 : 15 : 15 by the task's digest.  A null task has a null split."""
    bucket = digest_mod(F.concat(F.lit(f"{seed}:"), task), 100)
    split = F.when(bucket < 70, "train").when(bucket < 85, "devreal").when(bucket >= 85, "testreal")
    return split if row is None else F.when(row.isin(*RESERVED_ROWS), "testreal").otherwise(split)


def family_of(task: Column, declared: Column | None = None) -> Column:
    """The declared family, or the task without a split suffix."""
    plain = F.regexp_replace(task, "_(eval|dev|test|train|probe)$", "")
    return plain if declared is None else F.coalesce(F.nullif(declared, F.lit("")), plain)


def legacy_family(task: Column) -> Column:
    return F.split_part(task, F.lit("__"), F.lit(1))


def question_key(task: Column, state: Column, qid: Column, question: Column, instructions: Column, options: Column) -> Column:
    """Content key of a question; the order of options doesn't matter."""
    fields = [F.coalesce(c, F.lit("")) for c in (task, state, qid, question, instructions)]
    return F.sha2(F.concat_ws("\x1f", *fields, F.concat_ws("\x1f", F.array_sort(options))), 256)


def schema_key(task: Column, options: Column) -> Column:
    """Twenty hex digits of the task and its options in order."""
    quoted = F.transform(options, lambda o: F.concat(F.lit('"'), o, F.lit('"')))
    return F.substring(F.sha2(F.concat(F.lit('["'), task, F.lit('",['), F.concat_ws(",", quoted), F.lit("]]")), 256), 1, 20)


def schema_tuple(options: Column, most: int = 40) -> Column:
    """A question's options in order as one key; those of over `most` options are all the same."""
    return F.when(F.size(options) > most, f">{most}").otherwise(F.array_join(options, "|"))


@F.arrow_udf(T.LongType())
def blake2b64(values: pa.Array) -> pa.Array:
    """The signed 64-bit blake2b digest, big endian, of a string's UTF-8 bytes; for keys that other programs made."""
    made = (None if v is None else int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big", signed=True) for v in values.to_pylist())
    return pa.array(list(made), pa.int64())


def wording_split(description: Column, legacy: tuple[str, ...] = ()) -> Column:
    """A fifth of the wordings, and all legacy ones, are for evaluation."""
    draw = F.when(digest_mod(description, 1000) < 200, "eval").otherwise("train")
    return F.when(description.isin(*legacy), "eval").otherwise(draw) if legacy else draw


def weighted_part(group: Column) -> Column:
    """Parts 0, 1, 2 at weights 2 : 1 : 1."""
    return F.element_at(F.array(*map(F.lit, (0, 0, 1, 2))), (digest_mod(group, 4) + 1).cast("int"))


def parity_bucket(key: Column) -> tuple[Column, Column]:
    """Parity of the first digest byte, and the second modulo 5."""
    h = F.sha2(key, 256)
    byte = lambda i: F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("long")
    return byte(0) % 2, byte(1) % 5


def signature_split(signature: Column, depth: Column) -> Column:
    b = digest_mod(signature, 100)
    shallow = F.when(b < 80, "train").when(b < 90, "dev").otherwise("test")
    return F.when(depth <= 1, "train").when(depth <= 3, shallow).otherwise(F.when(b < 50, "dev").otherwise("test"))


def hash_order(seed: int, *keys: Column) -> Column:
    """A reproducible stand-in for a seeded shuffle: sort by this, then by a natural id."""
    return F.sha1(F.concat_ws(":", F.lit(str(seed)), *keys))
