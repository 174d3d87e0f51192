"""Games, plies and evaluations from tables of events and orders.

A table of events is a set of games: one per user, a ply per event in order
of time and id, the event's type as the move.  A position is what has been played
before a ply: how often each type, and so whose turn it is.  Different
orders of the same types reach one position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Moves of games from events.
TOKENS = ("click", "error", "purchase", "signup", "view")


def result_of(last: Column) -> Column:
    """A game's result by its last event."""
    return F.when(last == "purchase", F.lit("1-0")).when(last == "error", F.lit("0-1")).when(last == "signup", F.lit("1/2-1/2")).otherwise(F.lit("*"))


def outcome(result: Column, ply: Column) -> list[Column]:
    """wins, draws and losses of one game for the side to move at a ply; all 0 without a result."""
    white = ply % 2 == 0
    won = ((result == "1-0") & white) | ((result == "0-1") & ~white)
    lost = ((result == "0-1") & white) | ((result == "1-0") & ~white)
    return [won.cast("int").alias("wins"), (result == "1/2-1/2").cast("int").alias("draws"), lost.cast("int").alias("losses")]


def plies(events: DataFrame) -> DataFrame:
    """(game_id, ply, token, pos_key, child_key, wins, draws, losses), one row per event.

    The position is the one before the ply, so a game's last position isn't
    counted; a position that recurs counts at each visit.
    """
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = [F.sum(F.when(F.col("event_type") == t, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(f"n{i}") for i, t in enumerate(TOKENS)]
    rows = events.select("user_id", "event_type", (F.row_number().over(w) - 1).alias("ply"), result_of(F.last("event_type").over(all_)).alias("result"), *ahead)
    after = [F.col(f"n{i}").cast("string") for i in range(len(TOKENS))]
    before = [(F.col(f"n{i}") - (F.col("event_type") == t).cast("int")).cast("string") for i, t in enumerate(TOKENS)]
    return rows.select(F.col("user_id").alias("game_id"), "ply", F.col("event_type").alias("token"), F.concat_ws(".", *before).alias("pos_key"), F.concat_ws(".", *after).alias("child_key"), *outcome(F.col("result"), F.col("ply")))


def order_plies(orders: DataFrame, lineitem: DataFrame, least: float | None = None) -> DataFrame:
    """(game_id, ply, token, wins, draws, losses) from orders and their lines.

    An order is a game with its status as the result (F won, O lost, P
    drawn); its price stands for the players' rating, of at least ``least``.
    """
    games = orders.where(F.col("o_totalprice") >= least) if least is not None else orders
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    lines = lineitem.select(F.col("l_orderkey").alias("game_id"), (F.row_number().over(w) - 1).alias("ply"), F.concat("l_returnflag", "l_linestatus").alias("token"))
    status = F.col("o_orderstatus")
    result = F.when(status == "F", "1-0").when(status == "O", "0-1").when(status == "P", "1/2-1/2").otherwise("*")
    return lines.join(games.select(F.col("o_orderkey").alias("game_id"), result.alias("result")), "game_id").select("game_id", "ply", "token", *outcome(F.col("result"), F.col("ply")))


def evaluations(counts: DataFrame, turn: int = 0) -> DataFrame:
    """Stand-in evaluations of counted positions: whole-number arithmetic on the counts.

    ``turn`` gives another layer, for every second position.
    """
    w, d, n = F.col("wins"), F.col("draws"), F.col("wins") + F.col("draws") + F.col("losses")
    losses = F.col("losses")
    plies_ = F.aggregate(F.transform(F.split("pos_key", "[.]"), lambda x: x.cast("int")), F.lit(0), lambda a, x: a + x)
    cp = (w * 37 - losses * 41 + d * 5 + plies_ * 7) % 1000 + turn * 10
    kind = (n + plies_) % 5
    dtm = F.when(kind == 0, w + 1).when(kind == 1, -(losses + 1)).when(kind == 2, d - 32768).otherwise(F.lit(0))
    rows = counts if not turn else counts.where(n % 2 == 0)
    return rows.select("pos_key", cp.cast("int").alias("cp"), (plies_ % 4 != 3).alias("has_cp"), dtm.cast("int").alias("dtm"), (n % 3).cast("int").alias("dtz"), (plies_ % 17).cast("int").alias("proven_depth"), F.lit(turn).cast("long").alias("seq"))
