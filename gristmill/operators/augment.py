"""The augmentation policy of a question, its draws taken from digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import hashing
from gristmill.operators import sentinel

#: Chance of each change; withheld, opaque and stripped share one draw.
CHURN, WITHHELD, OPAQUE, STRIP, DECOY = 0.45, 0.06, 0.30, 0.10, 0.36


def draw(seed: int, epoch: int, key: Column, stage: str) -> Column:
    """A number from 0 to 1 for each question and stage, the same wherever it is made."""
    return hashing.digest_mod(F.concat_ws(":", F.lit(f"{seed}:{epoch}"), key, F.lit(stage)), 1_000_000) / 1_000_000


def policy(rows: DataFrame, key: str, seed: int = 0, epoch: int = 0, decoy_chance: float = DECOY, withheld_chance: float = WITHHELD) -> DataFrame:
    """rows with churn, change (withheld, opaque, strip or none) and decoy.

    rows need options, probs, ordered (rules in order: keys may be hidden, nothing else) and described.  A decoy is only for a
    question that isn't withheld; both need an eligible one.
    """
    k = F.col(key).cast("string")
    once = draw(seed, epoch, k, "change")
    fits = sentinel.eligible(F.col("probs"), F.col("options")) & ~F.col("ordered")
    change = (
        F.when(once < withheld_chance, F.when(fits, "withheld").otherwise("none")).when(once < withheld_chance + OPAQUE, F.when(F.col("described"), "opaque").otherwise("none"))
        .when(once < withheld_chance + OPAQUE + STRIP, F.when(F.col("described") & ~F.col("ordered"), "strip").otherwise("none")).otherwise("none")
    )
    made = rows.withColumns({"churn": (draw(seed, epoch, k, "churn") < CHURN) & ~F.col("ordered"), "change": change})
    return made.withColumn("decoy", fits & (F.col("change") != "withheld") & (draw(seed, epoch, k, "decoy") < decoy_chance))
