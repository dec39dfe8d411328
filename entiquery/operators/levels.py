"""Levels of a reference's forest, by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialise_and_measure


def levels(pairs: DataFrame) -> DataFrame:
    """(tail, level): how many steps lead from each tail to a root; tails on or below a cycle are left out.

    Each round doubles the steps that a pointer spans, so depth d takes about log2(d) rounds. While any tail with a
    level is open, a round settles at least one; when none settles, what is open leads into cycles.
    """
    tails = pairs.select(F.col("tail").alias("known"))
    state = pairs.join(tails, pairs["head"] == tails["known"], "left").select("tail", F.col("head").alias("at"), F.lit(1).cast("long").alias("level"), F.col("known").isNotNull().alias("open"))
    still_open = F.count(F.when(F.col("open"), 1))
    state, left = materialise_and_measure(state, still_open)
    while left:
        ahead = state.select(F.col("tail").alias("via"), F.col("at").alias("next"), F.col("level").alias("more"), F.col("open").alias("still"))
        going = state.where("open").join(ahead, F.col("at") == F.col("via"))
        going = going.select("tail", F.col("next").alias("at"), (F.col("level") + F.col("more")).alias("level"), F.col("still").alias("open"))
        state, now = materialise_and_measure(state.where("not open").union(going), still_open)
        if now == left:
            break
        left = now
    return state.where("not open").select("tail", "level")
