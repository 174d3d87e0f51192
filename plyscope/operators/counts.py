"""Counts and evaluations of positions: aggregation, merging, overlay.

Counts are exact sums; the capped counters of the storage format are a
projection of them.  Below the cap both agree whatever the order of merging;
at the cap only the exact sums don't depend on it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import capped, has_eval, saturated, share

COUNTERS = ("wins", "draws", "losses")
EVAL = ("cp", "has_cp", "dtm", "dtz", "proven_depth")


def _sums() -> list[Column]:
    return [F.sum(c).cast("long").alias(c) for c in COUNTERS]


def count_positions(plies: DataFrame) -> DataFrame:
    """(pos_key, wins, draws, losses): a position with only undecided games is there with zeros."""
    return plies.groupBy("pos_key").agg(*_sums())


def merge_counts(*layers: DataFrame) -> DataFrame:
    """Add up layers of counts; merging merged layers gives the same."""
    cols = ["pos_key", *COUNTERS]
    return reduce(DataFrame.unionByName, (x.select(*cols) for x in layers)).groupBy("pos_key").agg(*_sums())


def count_column() -> Column:
    return (F.col("wins") + F.col("draws") + F.col("losses")).cast("long")


def described(counts: DataFrame) -> DataFrame:
    """``counts`` with count, win_pct, draw_pct, the capped counters and whether one is at the cap."""
    n = count_column()
    return counts.select("*", n.alias("count"), share(F.col("wins"), n).alias("win_pct"), share(F.col("draws"), n).alias("draw_pct"), *(capped(F.col(c)).alias(f"{c}_capped") for c in COUNTERS), saturated(*map(F.col, COUNTERS)).alias("wdl_saturated"))


def latest_evaluations(*layers: DataFrame) -> DataFrame:
    """Per position the whole evaluation with the highest ``seq`` among those that say anything.

    Of several with the same ``seq`` the greatest counts, column by column.  A mate without centipawns says something too.
    """
    cols = ["pos_key", *EVAL, "seq"]
    rows = reduce(DataFrame.unionByName, (x.select(*cols) for x in layers)).where(has_eval(F.col("has_cp"), F.col("dtm")))
    return rows.groupBy("pos_key").agg(F.max(F.struct("seq", *EVAL)).alias("e")).select("pos_key", *(f"e.{c}" for c in (*EVAL, "seq")))


def overlay(counts: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Counts with evaluations; either side may be missing.

    A position without games has zero counts, one without an evaluation nulls.
    """
    both = counts.join(evaluations.select("pos_key", *EVAL), "pos_key", "full_outer")
    return both.select("pos_key", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS), *EVAL, has_eval(F.col("has_cp"), F.col("dtm")).alias("has_eval"))
