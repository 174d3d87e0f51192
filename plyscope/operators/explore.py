"""What can be asked of a position: its moves, ranked and paged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.records import dtm_distance, dtm_kind, dtm_shown, share
from .counts import count_column

#: Moves with full statistics, and the most that may be asked for.
TOP, MOST_TOP = 3, 20


def edges(plies: DataFrame) -> DataFrame:
    """(parent_key, token, child_key), once each."""
    return plies.select(F.col("pos_key").alias("parent_key"), "token", "child_key").distinct()


def white_to_move(key: Column) -> Column:
    """Whether White moves in a position given by counts of what was played."""
    return F.aggregate(F.transform(F.split(key, "[.]"), lambda x: x.cast("int")), F.lit(0), lambda a, x: a + x) % 2 == 0


def node_columns() -> list[Column]:
    """A position's shares and evaluation as they are shown; proven_depth never has the flag."""
    n = count_column()
    return [
        n.alias("count"), share(F.col("wins"), n).alias("win_pct"), share(F.col("draws"), n).alias("draw_pct"),
        F.when(F.col("has_cp"), F.col("cp")).alias("cp"), dtm_kind(F.col("dtm")).alias("mate_kind"), dtm_shown(F.col("dtm")).alias("dtm"),
    ]


def children(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Every move with what is known of its position: zeros and nulls where nothing is."""
    known = positions.withColumnRenamed("pos_key", "child_key")
    rows = edges.join(known, "child_key", "left")
    return rows.select("parent_key", "token", "child_key", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("wins", "draws", "losses")), F.coalesce("has_eval", F.lit(False)).alias("has_eval"), *(c for c in ("has_cp", "cp", "dtm")))


def server_order(white: Column) -> WindowSpec:
    """Evaluated moves first, by centipawns for the mover; the others by games; ties by token."""
    mine = F.when(white, F.coalesce("cp", F.lit(0))).otherwise(-F.coalesce("cp", F.lit(0)))
    return Window.partitionBy("parent_key").orderBy(F.col("has_eval").desc(), F.when(F.col("has_eval"), mine).desc(), F.when(~F.col("has_eval"), count_column()).desc(), "token")


def client_order(white: Column) -> WindowSpec:
    """Evaluated moves first, mates before centipawns, each for the mover; then games, then wins; ties by token."""
    sign = F.when(white, F.lit(1)).otherwise(F.lit(-1))
    mate = F.coalesce(F.col("dtm"), F.lit(0)) != 0
    n = count_column()
    return Window.partitionBy("parent_key").orderBy(
        F.col("has_eval").desc(), (F.col("has_eval") & mate).desc(), F.when(mate, F.col("dtm") * sign).desc(), F.when(F.col("has_eval") & ~mate, F.coalesce("cp", F.lit(0)) * sign).desc(),
        F.when(~F.col("has_eval"), n).desc(), F.when(~F.col("has_eval"), share(F.col("wins"), n)).desc(), "token",
    )


def ranked(moves: DataFrame, order: WindowSpec) -> DataFrame:
    return moves.withColumn("rank", F.row_number().over(order))


def top_moves(moves: DataFrame, order: WindowSpec, top: int = TOP) -> DataFrame:
    """The first ``top`` moves of each position with statistics, the rest as stubs.

    A number outside 1 to MOST_TOP is ignored.
    """
    top = top if 1 <= top <= MOST_TOP else TOP
    shown = ranked(moves, order).withColumn("is_top", F.col("rank") <= top)
    stats = [F.when(F.col("is_top"), F.col(c)).alias(c) for c in ("wins", "draws", "losses", "cp", "dtm")]
    return shown.select("parent_key", "token", "child_key", "rank", "is_top", *stats)


def page(moves: DataFrame, order: WindowSpec, offset: int, size: int) -> DataFrame:
    """``size`` ranked moves of each position from ``offset`` on, beginning anew past the end; all, if they are no more."""
    n = F.count(F.lit(1)).over(Window.partitionBy("parent_key"))
    rows = ranked(moves, order).withColumn("n", n)
    place = F.pmod(F.col("rank") - 1 - offset, F.col("n"))
    return rows.withColumn("place", F.when(F.col("n") > size, place).otherwise(F.col("rank") - 1)).where((F.col("n") <= size) | (F.col("place") < size)).drop("n")


def needing_evaluation(positions: DataFrame) -> DataFrame:
    """Positions without centipawns and without a distance to mate."""
    return positions.where(~F.coalesce("has_cp", F.lit(False)) & (F.coalesce("dtm", F.lit(0)) == 0))


def extreme(positions: DataFrame, bad: int = -300, good: int = 300) -> DataFrame:
    """Positions with centipawns at or past a bound and no distance to mate, and which bound."""
    rows = positions.where(F.col("has_cp") & (F.col("dtm") == 0) & ((F.col("cp") <= bad) | (F.col("cp") >= good)))
    return rows.withColumn("winning", F.col("cp") >= good)


def proof_order() -> WindowSpec:
    """Moves as a proof should try them: to lost positions first, the quickest before, then by what the opponent has least of."""
    lost = dtm_kind(F.coalesce("dtm", F.lit(0))) == "loss"
    return Window.partitionBy("parent_key").orderBy(lost.desc(), F.when(lost, dtm_distance(F.col("dtm"))), F.when(F.col("has_cp"), F.col("cp")).asc_nulls_last(), "token")


def first_moves(lines: DataFrame, by: str, token: str, score: Column, most: int = TOP) -> DataFrame:
    """Of an engine's lines (by, token) the ``most`` best different first moves, each with its best score."""
    best = lines.groupBy(by, token).agg(F.max(score).alias("score"))
    w = Window.partitionBy(by).orderBy(F.col("score").desc_nulls_last(), token)
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def with_stubs(top: DataFrame, stubs: DataFrame) -> DataFrame:
    """Top moves and stubs as one set; what stubs lack is null."""
    return top.unionByName(stubs, allowMissingColumns=True)


def evaluated(positions: DataFrame, depths: DataFrame, results: DataFrame, depth: int) -> DataFrame:
    """(pos_key, score, depth) for one level: results of the positions there that still need an evaluation."""
    level = depths.where(F.col("depth") == depth).select("pos_key", "depth")
    return needing_evaluation(positions).select("pos_key").join(level, "pos_key").join(results.select("pos_key", "score"), "pos_key").select("pos_key", "score", "depth")


def missing_children(expanded: DataFrame, stored: DataFrame) -> DataFrame:
    """Moves (parent_key, token, child_key) to positions that aren't stored, with empty records: what a level lacks."""
    rows = expanded.where("child_key is not null").join(stored.select(F.col("pos_key").alias("child_key")), "child_key", "left_anti")
    return rows.select(F.col("child_key").alias("pos_key"), *(F.lit(0).cast("long").alias(c) for c in ("wins", "draws", "losses"))).distinct()
