"""The option for "not on this list": its wordings, membership, and what questions can take it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import hashing

# The slot vocabularies of the wordings, which decide which strings are members.
SUBJECTS = ("options", "choices", "answers", "labels", "categories", "alternatives", "entries", "candidates", "selections", "values")
SINGULAR = ("option", "choice", "answer", "label", "category", "alternative", "entry", "candidate", "value")
PLACE = ("listed", "above", "shown", "given", "provided", "offered", "on this list", "in this list", "here")
VERB = ("applies", "is correct", "fits", "matches", "is right", "is appropriate", "describes this", "is the answer")
CORRECT = ("correct", "right", "true", "actual", "appropriate")
AMONG = ("among", "one of", "included in", "present in", "covered by")
COVER = ("covered", "captured", "described", "represented", "matched")
SOMETHING = ("Something else", "Some other value", "Another answer", "A different option")
APPEAR = ("on this list", "above", "among these", "in the set given")
NONEWORD = ("None", "Not one")
#: Frames: literal text and slots in turn.
FRAMES: tuple[tuple[str | tuple[str, ...], ...], ...] = (
    (NONEWORD, " of the ", SUBJECTS, " ", PLACE, " ", VERB),
    ("The ", CORRECT, " ", SINGULAR, " is not ", AMONG, " the ", SUBJECTS, " ", PLACE),
    ("Not ", COVER, " by any of the ", SUBJECTS, " ", PLACE),
    ("No ", SINGULAR, " ", PLACE, " ", VERB),
    ("The ", CORRECT, " ", SINGULAR, " does not appear ", APPEAR),
    (SOMETHING, ", not ", AMONG, " the ", SUBJECTS, " ", PLACE),
    (SOMETHING, ", not ", PLACE),
)


def wordings(spark: SparkSession) -> DataFrame:
    """(description, split): every wording of the grammar once; a table of fixed size, grown slot by slot in one row's arrays."""
    def grow(done: Column, slot: str | tuple[str, ...]) -> Column:
        words = F.array(*(F.lit(w) for w in ((slot,) if isinstance(slot, str) else slot)))
        return F.flatten(F.transform(done, lambda d: F.transform(words, lambda w: F.concat(d, w))))

    every = F.flatten(F.array(*(reduce(grow, frame, F.array(F.lit(""))) for frame in FRAMES)))
    rows = spark.range(1).select(F.explode(every).alias("description")).distinct()
    return rows.withColumn("split", hashing.wording_split(F.trim("description")))


def eligible(probs: Column, options: Column) -> Column:
    """Three options or more, and one of 0.9 or more."""
    return (F.size(options) >= 3) & (F.array_max(probs) >= 0.9)


def withhold(options: Column, probs: Column, sentinel: Column) -> Column:
    """The best option goes, the sentinel comes last; it is then correct."""
    best = F.array_position(probs, F.array_max(probs)) - 1
    return F.concat(F.filter(options, lambda o, i: i != best), F.array(sentinel))


def decoy(options: Column, probs: Column, drop: Column, sentinel: Column) -> tuple[Column, Column]:
    """One wrong option goes and the sentinel comes last, wrong; probabilities are renormalised."""
    kept = F.filter(probs, lambda p, i: i != drop)
    total = F.aggregate(kept, F.lit(0.0), lambda a, b: a + b)
    return F.concat(F.filter(options, lambda o, i: i != drop), F.array(sentinel)), F.concat(F.transform(kept, lambda p: p / total), F.array(F.lit(0.0)))


def opaque_keys(options: Column) -> Column:
    return F.transform(options, lambda o, i: F.concat(F.lit("opt_"), i.cast("string")))


def marked(rows: DataFrame, option: str, legacy: tuple[str, ...] = ()) -> DataFrame:
    """rows with sentinel, whether an option is one of the wordings or an old one, and its split; old ones are for evaluation."""
    known = wordings(rows.sparkSession).withColumnsRenamed({"description": "_known", "split": "_split"})
    found = rows.join(F.broadcast(known), F.col(option) == F.col("_known"), "left")  # a table of fixed size
    old = F.col(option).isin(*legacy) if legacy else F.lit(False)
    return found.select(*rows.columns, F.coalesce(F.col("_known").isNotNull() | old, F.lit(False)).alias("sentinel"), F.when(old, "eval").otherwise(F.col("_split")).alias("split"))


def picked(rows: DataFrame, key: str, split: str, seed: int = 0) -> DataFrame:
    """rows with a wording of a split, drawn by digest; every wording is as likely."""
    known = [r.description for r in wordings(rows.sparkSession).where(F.col("split") == split).orderBy("description").collect()]  # at most 24,804 wordings
    table = rows.sparkSession.createDataFrame(list(enumerate(known)), "_i long, description string")
    drawn = rows.withColumn("_i", hashing.digest_mod(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), len(known)))
    return drawn.join(F.broadcast(table), "_i").drop("_i")  # a table of fixed size


def without_criteria(descriptions: Column, strip: Column) -> Column:
    """Descriptions, or as many nulls where they are to go."""
    return F.when(strip, F.transform(descriptions, lambda d: F.lit(None).cast("string"))).otherwise(descriptions)
