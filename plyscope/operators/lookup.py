"""Lookups by key and by range of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .counts import COUNTERS, EVAL

#: Levels of large dyadic blocks, which most ranges ask for: 2 ** LARGE blocks at most in the lowest of them.
LARGE = 10


def lookup(keys: DataFrame, positions: DataFrame) -> DataFrame:
    """A batch of point lookups: every key, with zeros and nulls where nothing is stored, and whether it is."""
    found = positions.select("pos_key", *COUNTERS, *EVAL, F.lit(True).alias("found"))
    rows = keys.select("pos_key").distinct().join(found, "pos_key", "left")
    return rows.select("pos_key", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS), *EVAL, F.coalesce("found", F.lit(False)).alias("found"))


def between(positions: DataFrame, low: str | None, high: str | None) -> DataFrame:
    """Positions with low <= pos_key <= high; None leaves an end open.  Files written in ranges of keys are skipped by their statistics."""
    k = F.col("pos_key")
    rows = positions if low is None else positions.where(k >= low)
    return rows if high is None else rows.where(k <= high)


def _numbered(keys: DataFrame, key: str) -> DataFrame:
    """Distinct keys with their place n in the order of all: ranges of keys are numbered apart and moved on by what lies before."""
    parts = written(keys.select(key).distinct().repartitionByRange(key).withColumn("part", F.spark_partition_id()), "keys")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))  # one row per partition
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return parts.withColumn("place", place).join(F.broadcast(before), "part").select(key, (F.col("before") + F.col("place")).alias("n"))


def _cover(low: Column, high: Column, levels: int) -> Column:
    """The fewest dyadic blocks "level:number" that make up the numbers from low to high; none, if low is past high."""
    # bottom-up, as in a segment tree over half-open [low, high): an odd low's own block, the block before an odd high
    def step(state: Column, level: Column) -> Column:
        lo, hi = state["lo"], state["hi"]
        name = lambda n: F.array(F.concat_ws(":", level, n))
        none = F.array().cast("array<string>")
        out = F.concat(state["out"], F.when((lo < hi) & (lo % 2 == 1), name(lo)).otherwise(none), F.when((lo < hi) & (hi % 2 == 1), name(hi - 1)).otherwise(none))
        return F.struct(F.floor((lo + 1) / 2).cast("long").alias("lo"), F.floor(hi / 2).cast("long").alias("hi"), out.alias("out"))

    start = F.struct(low.cast("long").alias("lo"), (high + 1).cast("long").alias("hi"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda s: s["out"])


def _blocks(n: Column, levels: int) -> Column:
    """All dyadic blocks that hold n."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: F.concat_ws(":", level, F.call_function("shiftright", n.cast("long"), level)))


def _placed(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Ranges (id, low, high) with their ends numbered in one order (id, low_n, high_n), and the levels of dyadic blocks over these."""
    keys = a.select(F.col("low").alias("key")).unionByName(a.select(F.col("high").alias("key"))).unionByName(b.select(F.col("low").alias("key"))).unionByName(b.select(F.col("high").alias("key")))
    place = written(_numbered(keys, "key"), "places")

    def by_place(t: DataFrame) -> DataFrame:
        for end in ("low", "high"):
            t = t.join(place.select(F.col("key").alias(end), F.col("n").alias(f"{end}_n")), end)
        return written(t.where("low_n <= high_n").select("id", "low_n", "high_n"), "ranges")

    return by_place(a), by_place(b), place.count().bit_length()


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a_id, b_id) of key ranges (id, low, high) that share a key, each once.

    As overlaps(), whose joins on equal blocks give the pairs themselves.  A
    range with a null end or low above high shares nothing.
    """
    x, y, levels = _placed(a, b)
    low, high = F.col("low_n"), F.col("high_n")

    def met(asks: Column, told: Column) -> DataFrame:
        return x.select(F.col("id").alias("a_id"), F.explode(asks).alias("block")).join(y.select(F.col("id").alias("b_id"), F.explode(told).alias("block")), "block").select("a_id", "b_id")

    return met(_cover(low, high, levels), _blocks(low, levels)).unionByName(met(_blocks(low, levels), _cover(low + 1, high, levels)))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each range of ``a`` (id, low, high) that shares a key with any of ``b``: a_id, how many (files), the smallest of their ids (first).

    A range of b does so if its low lies in a's range, or if it begins before
    a's low and holds it.  Ends are numbered by their order and ranges cut
    into dyadic blocks, so either is a join on a few dozen equal blocks of
    counts and minima; ranges are never paired.  The few large blocks, which
    most ranges ask for, are broadcast.
    """
    x, y, levels = _placed(a, b)
    low, high = F.col("low_n"), F.col("high_n")

    def held(asks: Column, told: Column) -> DataFrame:
        sums = y.select("id", F.explode(told).alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("files"), F.min("id").alias("first"))
        large = F.substring_index("block", ":", 1).cast("int") >= levels - LARGE
        rows = x.select(F.col("id").alias("a_id"), F.explode(asks).alias("block"))
        both = rows.where(~large).join(sums.where(~large), "block").unionByName(rows.where(large).join(F.broadcast(sums.where(large)), "block"))
        return both.select("a_id", "files", "first")

    found = held(_cover(low, high, levels), _blocks(low, levels)).unionByName(held(_blocks(low, levels), _cover(low + 1, high, levels)))
    return found.groupBy("a_id").agg(F.sum("files").alias("files"), F.min("first").alias("first"))


def rightmost(keys: DataFrame, ranges: DataFrame, by: str) -> DataFrame:
    """For each key the range (id, low) with the greatest low that isn't above it, among those with the same ``by``; of equal lows the greatest id.

    An as-of join without comparing pairs.  Keys and lows are dealt to tasks
    in ranges of one order by ``by``, place and id, so a group may span many.  The
    last low is carried forward within a task, and for each group from task
    to task: of these there is one row per group and task.  Repeated keys are
    kept; null keys and lows come first in a group.
    """
    both = keys.select(by, F.col("pos_key").alias("at"), F.lit(1).alias("is_key"), F.lit(None).cast(ranges.schema["id"].dataType).alias("id"))
    both = both.unionByName(ranges.select(by, F.col("low").alias("at"), F.lit(0).alias("is_key"), "id"))
    both = both.withColumn("at_random", F.xxhash64(F.monotonically_increasing_id()))  # splits one key that very many rows ask for
    parts = both.repartitionByRange(by, "at", "is_key", "id", "at_random").drop("at_random")
    parts = written(parts.withColumn("part", F.spark_partition_id()), "in-order")
    within = Window.partitionBy("part", by).orderBy("at", "is_key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = parts.groupBy(by, "part").agg(F.max(F.when(F.col("is_key") == 0, F.struct("at", "id")))["id"].alias("last"))
    last = last.select(F.col(by).alias("of"), F.col("part").alias("task"), F.last("last", ignorenulls=True).over(earlier).alias("before"))
    found = parts.withColumn("id", F.last("id", ignorenulls=True).over(within)).where("is_key = 1")
    found = found.join(last, F.col("of").eqNullSafe(F.col(by)) & (F.col("task") == F.col("part")), "left")
    return found.select(by, F.col("at").alias("pos_key"), F.coalesce("id", "before").alias("id"))
