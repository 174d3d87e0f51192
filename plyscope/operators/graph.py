"""Searches over the graph of positions.

A step of a search is one join with the moves.  They are dealt to partitions
by the key that is joined on once, and kept, so a step moves only what is new.
What a search has found is written, so that lineage doesn't grow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

MOST_DEPTH, MOST_PLIES = 20, 50
#: Levels of a search that one job goes on before what it found is written and compared with what was known.
LEVELS = 8
KINDS = ("win", "draw", "loss")


def fewest(moves: DataFrame, roots: DataFrame, depths: DataFrame) -> bool:
    """Whether ``depths`` (pos_key, depth) are all that ``moves`` (pos_key, child_key) reach, with the fewest moves: one join tells.

    They are if roots have 0, and every other position exactly one more than
    the least of those that lead to it: so no way is shorter, and one is as
    long.
    """
    told = moves.join(depths, "pos_key").groupBy(F.col("child_key").alias("pos_key")).agg((F.min("depth") + 1).alias("least"))
    both = told.join(depths, "pos_key", "full_outer").join(roots.select("pos_key", F.lit(True).alias("root")), "pos_key", "full_outer")
    right = F.when(F.col("root"), F.col("depth") == 0).otherwise(F.col("depth") == F.col("least"))
    return not both.where(~F.coalesce(right, F.lit(False))).limit(1).count()


def reachable(edges: DataFrame, roots: DataFrame, stored: DataFrame | None = None, depth: int | None = MOST_DEPTH, expected: DataFrame | None = None) -> DataFrame:
    """(pos_key, depth): positions that moves reach from ``roots``, with the fewest moves.

    With ``stored`` only positions found there count and are expanded.  With
    None for ``depth`` the search goes on until nothing is new; it isn't
    needed if ``expected`` (pos_key, depth), such as the plies at which games
    have a position, prove to be what it would find.
    """
    moves = edges.select(F.col("parent_key").alias("pos_key"), "child_key").distinct()
    rows = roots.select("pos_key").distinct()
    if stored is not None:
        stored = written(stored.select("pos_key").distinct(), "stored")
        rows = rows.join(stored, "pos_key", "left_semi")
        moves = moves.join(stored.withColumnRenamed("pos_key", "child_key"), "child_key", "left_semi")
    moves = written(moves.select("pos_key", "child_key", F.lit(1).alias("far")), "moves")
    if expected is not None and depth is None:
        found = expected.groupBy("pos_key").agg(F.min("depth").cast("int").alias("depth"))
        found = written(found if stored is None else found.join(stored, "pos_key", "left_semi"), "expected")
        if fewest(moves, rows, found):
            return found
    # every position also stays where it is, so that a level needs no second way for what came before it
    ends = moves.select("pos_key").unionByName(moves.select(F.col("child_key").alias("pos_key"))).unionByName(rows).distinct()
    moves = moves.unionByName(ends.select("pos_key", F.col("pos_key").alias("child_key"), F.lit(0).alias("far"))).repartition("pos_key").persist()
    seen = front = written(rows.withColumn("depth", F.lit(0)), "level")
    at = 0
    while depth is None or at < depth:
        steps = LEVELS if depth is None else min(LEVELS, depth - at)
        found = front
        for d in range(at, at + steps):
            on = found.join(moves, "pos_key").where((F.col("far") == 0) | (F.col("depth") == d))
            found = on.groupBy(F.col("child_key").alias("pos_key")).agg(F.min(F.col("depth") + F.col("far")).alias("depth"))
        new = written(found.where(F.col("depth") > at).join(seen.select("pos_key"), "pos_key", "left_anti"), "level")
        seen = seen.unionByName(new)
        at += steps
        front = new.where(F.col("depth") == at)
        if not front.limit(1).count():
            break
        if at % (LEVELS * LEVELS) == 0:
            seen = written(seen, "level")
    moves.unpersist()
    return seen


def beam(edges: DataFrame, roots: DataFrame, scores: DataFrame, white: Column, depth: int = 6, width: int = 5) -> DataFrame:
    """(pos_key, depth): as reachable(), but only each position's ``width`` best moves are followed.

    Scores are White's; ``white`` says of an edge whether White moves, so each
    side follows what is best for it.  Ties go by token.
    """
    mine = F.when(white, F.col("score")).otherwise(-F.col("score"))
    best = Window.partitionBy("parent_key").orderBy(mine.desc_nulls_last(), "token")
    kept = edges.join(scores.select(F.col("pos_key").alias("child_key"), "score"), "child_key", "left").withColumn("r", F.row_number().over(best)).where(F.col("r") <= width)
    return reachable(written(kept.select("parent_key", "child_key"), "beam"), roots, depth=depth)


def prove(edges: DataFrame, terminals: DataFrame, most: int | None = MOST_PLIES) -> DataFrame:
    """(pos_key, kind, distance) of all positions whose outcome moves alone decide.

    ``terminals`` (pos_key, kind, distance) are known; kinds are for the side
    to move.  A move to a lost position wins, one ply later than the quickest
    of them; with all moves proven and none winning, a draw if one draws
    (distance 0), else a loss, one ply later than the slowest.  Round n fixes
    outcomes up to distance n, so wins are minimal; cycles stay unproven.  With
    None for ``most`` rounds go on until nothing is new.

    A round joins the moves to what the last one proved, and keeps of every
    open position how many of its moves are still unproven.
    """
    known = written(terminals.select("pos_key", "kind", F.col("distance").cast("int").alias("distance")), "proof")
    moves = written(edges.select("parent_key", F.col("child_key").alias("pos_key")).distinct(), "moves")
    number = lambda c: F.lit(None).cast("int").alias(c)
    open_ = moves.groupBy(F.col("parent_key").alias("pos_key")).agg(F.count(F.lit(1)).alias("unproven")).join(known, "pos_key", "left_anti")
    code = sum((F.when(F.col("kind") == k, F.lit(i)).otherwise(F.lit(0)) for i, k in enumerate(KINDS, 1)), F.lit(0))  # numbers are aggregated by hashing, texts aren't
    first = known.select("pos_key", F.lit(0).cast("long").alias("unproven"), number("quick"), number("slow"), F.lit(False).alias("drawn"), code.cast("int").alias("kind"), "distance", F.lit(0).alias("round"))
    nodes = written(first.unionByName(open_.select("pos_key", "unproven", number("quick"), number("slow"), F.lit(False).alias("drawn"), number("kind"), number("distance"), number("round"))), "proof")
    # a move of a position to itself carries what is known of it on to the next round
    own = nodes.select("pos_key", F.col("pos_key").alias("to"), F.lit(True).alias("own"))
    moves = moves.select("pos_key", F.col("parent_key").alias("to"), F.lit(False).alias("own")).unionByName(own).repartition("pos_key").persist()
    mine = lambda c: F.max(F.when(F.col("own"), F.col(c))).alias(c)
    told = lambda c: F.when(~F.col("own"), c)
    win, draw, loss = (F.lit(i) for i in range(1, 4))
    lost, kind, distance = F.col("kind") == loss, F.col("kind"), F.col("distance")
    decided = F.when(F.col("quick").isNotNull(), win).when((F.col("unproven") == 0) & F.col("drawn"), draw).when(F.col("unproven") == 0, loss)
    far = F.when(F.col("quick").isNotNull(), F.col("quick") + 1).when(F.col("drawn"), F.lit(0)).otherwise(F.col("slow") + 1)
    parts, at = [known], 0
    while most is None or at < most:
        steps = LEVELS if most is None else min(LEVELS, most - at)
        for n in range(at + 1, at + steps + 1):
            on = nodes.join(moves, "pos_key").where(F.col("own") | (F.col("round") == n - 1))
            nodes = on.groupBy(F.col("to").alias("pos_key")).agg(
                F.sum(F.when(F.col("own"), F.col("unproven")).otherwise(F.lit(-1))).alias("unproven"),
                F.min(F.coalesce(told(F.when(lost, distance)), F.when(F.col("own"), F.col("quick")))).alias("quick"),
                F.max(F.coalesce(told(distance), F.when(F.col("own"), F.col("slow")))).alias("slow"),
                F.max(F.when(F.col("own"), F.col("drawn")).otherwise(kind == draw)).alias("drawn"),
                mine("kind"), mine("distance"), mine("round"), F.max("own").alias("there"),
            ).where("there")
            now = kind.isNull() & decided.isNotNull() & (far <= n)
            nodes = nodes.select("pos_key", "unproven", "quick", "slow", "drawn", F.when(now, decided).otherwise(kind).alias("kind"), F.when(now, far).otherwise(distance).cast("int").alias("distance"), F.when(now, F.lit(n)).otherwise(F.col("round")).alias("round"))
        nodes = written(nodes, "proof")
        proven, later = nodes.agg(F.count_if(F.col("round") > at), F.count_if(kind.isNull() & decided.isNotNull())).first()
        if proven:
            parts.append(nodes.where(F.col("round") > at).select("pos_key", F.element_at(F.array(*map(F.lit, KINDS)), kind).alias("kind"), "distance"))
        elif not later:
            break
        at += steps
        nodes = nodes.where(kind.isNull() | (F.col("round") == at))
    moves.unpersist()
    return reduce(DataFrame.unionByName, parts)


def one_round(edges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes of the parents of ``outcomes`` (kind, distance) after one round of prove()."""
    return prove(edges, outcomes, 1)


def by_depth(results: DataFrame, key: str, score: Column, depth: Column) -> DataFrame:
    """Per key the score of the deepest search; of several equally deep ones the highest."""
    return results.groupBy(key).agg(F.max_by(score, F.struct(depth, score)).alias("score"), F.max(depth).alias("depth"))
