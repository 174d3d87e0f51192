"""Queries on counts and evaluations of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import counts as C
from ..operators import explore as X
from ..operators.lookup import between
from ..sources.evaluations import changed, exported
from ..sources.tables import evaluations, order_plies
from .base import COUNTS, DISTANCE, EVALS, KIND, PLIES, POSITIONS, counts, evals, event_plies, positions, table


def prj_01_plies(spark: SparkSession, d: str) -> DataFrame:
    return event_plies(spark, d)


def position_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.described(counts(spark, d))


def agg_02_merge(spark: SparkSession, d: str) -> DataFrame:
    """Merged layers: games by parity, and one layer merged before."""
    p = event_plies(spark, d)
    a, b = (C.count_positions(p.where(F.col("game_id") % 2 == k)) for k in (0, 1))
    return C.merge_counts(C.merge_counts(a, b), a)


def agg_03_latest(spark: SparkSession, d: str) -> DataFrame:
    return evals(spark, d)


def agg_08_evaluation_counts(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    return evals(spark, d).agg(F.count(F.lit(1)).alias("total"), n(F.col("has_cp"), "with_cp"), n(F.col("dtm") != 0, "with_dtm"), n(F.col("dtz") != 0, "with_dtz"))


def jon_03_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every other game's positions with all evaluations, so that both sides have gaps."""
    some = C.count_positions(event_plies(spark, d).where(F.col("game_id") % 2 == 0))
    return C.overlay(some, evals(spark, d))


def agg_18_game_counters(spark: SparkSession, d: str) -> DataFrame:
    """Games, plies and decided games by the parity of the game."""
    p = event_plies(spark, d).groupBy("game_id").agg(F.count(F.lit(1)).alias("plies"), F.max(F.col("wins") + F.col("draws") + F.col("losses")).alias("decided"))
    return p.groupBy((F.col("game_id") % 2).alias("part")).agg(F.count(F.lit(1)).alias("games"), F.sum("plies").alias("plies"), F.count_if(F.col("decided") == 1).alias("decided"))


def flt_01_rated_orders(spark: SparkSession, d: str) -> DataFrame:
    """Counts by token over orders of a least price; the filter precedes the replay."""
    p = order_plies(table(spark, d, "orders"), table(spark, d, "lineitem"), 200_000.0)
    return p.groupBy("ply", "token").agg(*(F.sum(c).cast("long").alias(c) for c in C.COUNTERS))


def flt_03_needs_evaluation(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.explore import needing_evaluation

    return needing_evaluation(positions(spark, d)).select("pos_key", *C.COUNTERS)


def flt_04_extreme(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.explore import extreme

    return extreme(positions(spark, d)).select("pos_key", "cp", "winning")


def flt_05_any_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """What an export has: every position that says something about its value."""
    p = exported(positions(spark, d))
    return p.select("pos_key", F.coalesce("cp", F.lit(0)).alias("cp"), "dtm", "dtz", R.proven_depth(F.col("proven_depth")).alias("proven_depth"))


def flt_06_changed_evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Imported rows that differ from what is stored, where odd centipawns are one less; a missing position is left out."""
    stored = evals(spark, d).withColumn("cp", F.col("cp") - F.col("cp") % 2)
    rows = changed(evaluations(counts(spark, d), 1), stored)
    return rows.select("pos_key", *(F.col(c).alias(f"new_{c}") for c in ("cp", "dtm", "dtz")))


def jon_15_import(spark: SparkSession, d: str) -> DataFrame:
    """An upsert: every position of either side, the imported evaluation first."""
    incoming = evaluations(counts(spark, d).where("wins > losses")).withColumn("seq", F.lit(9).cast("long")).withColumn("has_cp", F.lit(True))
    return C.latest_evaluations(evals(spark, d), incoming)


def prj_02_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of orders as seen by the side to move, by ply."""
    p = order_plies(table(spark, d, "orders"), table(spark, d, "lineitem"))
    sums = p.groupBy("ply").agg(*(F.sum(c).cast("long").alias(c) for c in C.COUNTERS))
    return sums.select("ply", *C.COUNTERS, R.share(F.col("wins"), C.count_column()).alias("win_pct"), R.share(F.col("draws"), C.count_column()).alias("draw_pct"))


def prj_03_evaluations(spark: SparkSession, d: str) -> DataFrame:
    dtm = F.col("dtm")
    return positions(spark, d).select("pos_key", "has_eval", R.dtm_kind(dtm).alias("kind"), R.dtm_distance(dtm).alias("distance"), R.dtm_shown(dtm).alias("shown"))


def agg_10_level_totals(spark: SparkSession, d: str) -> DataFrame:
    """Keys, range and games by length of the position, and how many tokens its moves have."""
    p = event_plies(spark, d)
    return p.groupBy("ply").agg(F.count_distinct("pos_key").alias("keys"), F.min("pos_key").alias("low"), F.max("pos_key").alias("high"), F.count_distinct("token").alias("tokens"), F.count(F.lit(1)).alias("visits"))


def agg_12_store_stats(spark: SparkSession, d: str) -> DataFrame:
    """One row on the whole store; positions are distinct keys, layers are added up apart."""
    p = event_plies(spark, d)
    layers = p.groupBy(F.col("game_id") % 2).agg(F.count_distinct("pos_key").alias("n")).agg(F.sum("n").alias("layer_positions"))
    one = p.agg(F.count_distinct("game_id").alias("games"), F.count_distinct("pos_key").alias("positions"), F.count(F.lit(1)).alias("visits"))
    e = agg_08_evaluation_counts(spark, d).select(F.col("total").alias("evaluated"))
    bytes_ = (F.col("positions") * 40).alias("bytes")
    return one.crossJoin(layers).crossJoin(e).select("games", "positions", "layer_positions", "visits", "evaluated", bytes_, F.try_divide(F.col("visits") * 40, F.col("positions")).alias("bytes_per_position"))


def agg_17_deepest(spark: SparkSession, d: str) -> DataFrame:
    """Of a user's events as searches, the score of the deepest: value by event id."""
    from ..operators.graph import by_depth

    return by_depth(table(spark, d, "events"), "user_id", F.col("value"), F.col("event_id"))


def set_03_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Games and their numbers of positions, every third game replaced by one row for all of these."""
    p = event_plies(spark, d)
    files = p.groupBy(F.col("game_id").alias("file")).agg(F.count_distinct("pos_key").alias("n"))
    gone = files.where("file % 3 = 0").select("file")
    new = p.where("game_id % 3 = 0").agg(F.lit(-1).cast("long").alias("file"), F.count_distinct("pos_key").alias("n"))
    return files.join(gone, "file", "left_anti").unionByName(new)


def prj_08_responses(spark: SparkSession, d: str) -> DataFrame:
    """Every position as a client sees it, with its status."""
    return positions(spark, d).select("pos_key", *X.node_columns(), _status().alias("status"))


def flt_10_predicates(spark: SparkSession, d: str) -> DataFrame:
    """What a stored distance says, one yes or no each; some positions are mated now."""
    dtm = F.when(F.col("wins") == 3, R.encode_mated(F.col("draws") == 0)).otherwise(F.coalesce("dtm", F.lit(0)))
    p = positions(spark, d).select("pos_key", dtm.alias("dtm"))
    return p.select("pos_key", *(f(F.col("dtm")).alias(n) for n, f in (("proven", R.is_proven), ("win", R.is_win), ("loss", R.is_loss), ("draw", R.is_draw), ("mated", R.is_mated))))


def flt_11_range(spark: SparkSession, d: str) -> DataFrame:
    """Positions with a key in a range."""
    return between(positions(spark, d), "1", "2.3").select("pos_key", *C.COUNTERS)


def _status() -> Column:
    status = F.when(F.col("dtm") != 0, F.lit("proven")).when(F.col("has_cp"), F.lit("evaluated"))
    return F.coalesce(status, F.lit("pending"))


def prj_08_response(spark: SparkSession, d: str) -> DataFrame:
    """Positions as a client sees them, by status."""
    return positions(spark, d).groupBy(_status().alias("status")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).cast("long").alias(c) for c in C.COUNTERS))


QUERIES = {f.__name__: f for f in (
    position_counts, prj_01_plies, prj_02_results, prj_03_evaluations, prj_08_response, prj_08_responses, agg_02_merge, agg_03_latest, agg_08_evaluation_counts, agg_10_level_totals, agg_12_store_stats, agg_17_deepest, agg_18_game_counters,
    jon_03_overlay, jon_15_import, flt_01_rated_orders, flt_03_needs_evaluation, flt_04_extreme, flt_05_any_evaluation, flt_06_changed_evaluations, flt_10_predicates, flt_11_range, set_03_replaced,
)}

_ORDER_PLIES = """
    WITH g AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '1-0' WHEN 'O' THEN '0-1' WHEN 'P' THEN '1/2-1/2' ELSE '*' END AS result FROM orders WHERE o_totalprice >= {least}),
    l AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS ply, l_returnflag || l_linestatus AS token FROM lineitem),
    p AS (
        SELECT ply, token, CAST((result = '1-0' AND ply % 2 = 0) OR (result = '0-1' AND ply % 2 = 1) AS INTEGER) AS wins, CAST(result = '1/2-1/2' AS INTEGER) AS draws,
            CAST((result = '0-1' AND ply % 2 = 0) OR (result = '1-0' AND ply % 2 = 1) AS INTEGER) AS losses
        FROM l JOIN g ON l_orderkey = o_orderkey),"""
_SUMS = "CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(draws) AS BIGINT) AS draws, CAST(sum(losses) AS BIGINT) AS losses"
_PCT = "CASE WHEN wins + draws + losses > 0 THEN CAST({0} AS DOUBLE) / (wins + draws + losses) * 100 ELSE 0.0 END"

SQL = {
    "position_counts": COUNTS + f"""
        SELECT *, wins + draws + losses AS count, {_PCT.format("wins")} AS win_pct, {_PCT.format("draws")} AS draw_pct,
            least(wins, 65535) AS wins_capped, least(draws, 65535) AS draws_capped, least(losses, 65535) AS losses_capped, greatest(wins, draws, losses) >= 65535 AS wdl_saturated
        FROM counts""",
    "prj_01_plies": PLIES + " SELECT * FROM plies",
    "prj_02_results": _ORDER_PLIES.format(least=0) + f" s AS (SELECT ply, {_SUMS} FROM p GROUP BY ply) SELECT *, {_PCT.format('wins')} AS win_pct, {_PCT.format('draws')} AS draw_pct FROM s",
    "prj_03_evaluations": POSITIONS + f" SELECT pos_key, has_eval, {KIND.format('dtm')} AS kind, {DISTANCE.format('dtm')} AS distance, CAST(CASE {KIND.format('dtm')} WHEN 'win' THEN 1 WHEN 'loss' THEN -1 ELSE 0 END * {DISTANCE.format('dtm')} AS INTEGER) AS shown FROM positions",
    "prj_08_response": POSITIONS + f" SELECT CASE WHEN dtm <> 0 THEN 'proven' WHEN has_cp THEN 'evaluated' ELSE 'pending' END AS status, count(*) AS n, {_SUMS} FROM positions GROUP BY 1",
    "prj_08_responses": POSITIONS + f""" SELECT pos_key, wins + draws + losses AS count, {_PCT.format("wins")} AS win_pct, {_PCT.format("draws")} AS draw_pct, CASE WHEN has_cp THEN cp END AS cp, {KIND.format("dtm")} AS mate_kind,
        CAST(CASE {KIND.format("dtm")} WHEN 'win' THEN 1 WHEN 'loss' THEN -1 ELSE 0 END * {DISTANCE.format("dtm")} AS INTEGER) AS dtm, CASE WHEN dtm <> 0 THEN 'proven' WHEN has_cp THEN 'evaluated' ELSE 'pending' END AS status FROM positions""",
    "flt_10_predicates": POSITIONS + """
        , p AS (SELECT pos_key, CASE WHEN wins = 3 THEN CASE WHEN draws = 0 THEN 32767 ELSE 32766 END ELSE coalesce(dtm, 0) END AS x FROM positions)
        SELECT pos_key, x <> 0 AS proven, x BETWEEN 1 AND 16384 AS win, x BETWEEN -16384 AND -1 OR x >= 32766 AS loss, x BETWEEN -32768 AND -16385 AS draw, x >= 32766 AS mated FROM p""",
    "flt_11_range": POSITIONS + " SELECT pos_key, wins, draws, losses FROM positions WHERE pos_key BETWEEN '1' AND '2.3'",
    "agg_02_merge": PLIES + f" SELECT pos_key, CAST(sum(wins * k) AS BIGINT) AS wins, CAST(sum(draws * k) AS BIGINT) AS draws, CAST(sum(losses * k) AS BIGINT) AS losses FROM (SELECT *, CASE WHEN game_id % 2 = 0 THEN 2 ELSE 1 END AS k FROM plies) GROUP BY pos_key",
    "agg_03_latest": EVALS + " SELECT * FROM evals",
    "agg_08_evaluation_counts": EVALS + " SELECT count(*) AS total, count(*) FILTER (has_cp) AS with_cp, count(*) FILTER (dtm <> 0) AS with_dtm, count(*) FILTER (dtz <> 0) AS with_dtz FROM evals",
    "agg_10_level_totals": PLIES + " SELECT ply, count(DISTINCT pos_key) AS keys, min(pos_key) AS low, max(pos_key) AS high, count(DISTINCT token) AS tokens, count(*) AS visits FROM plies GROUP BY ply",
    "agg_12_store_stats": EVALS + """
        , s AS (SELECT count(DISTINCT game_id) AS games, count(DISTINCT pos_key) AS positions, count(*) AS visits FROM plies)
        SELECT games, positions, (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(DISTINCT pos_key) AS n FROM plies GROUP BY game_id % 2)) AS layer_positions, visits, (SELECT count(*) FROM evals) AS evaluated,
            positions * 40 AS bytes, CAST(visits * 40 AS DOUBLE) / positions AS bytes_per_position
        FROM s""",
    "agg_17_deepest": "SELECT user_id, max_by(value, event_id) AS score, max(event_id) AS depth FROM events GROUP BY user_id",
    "agg_18_game_counters": PLIES + " SELECT game_id % 2 AS part, count(*) AS games, CAST(sum(n) AS BIGINT) AS plies, count(*) FILTER (decided = 1) AS decided FROM (SELECT game_id, count(*) AS n, max(wins + draws + losses) AS decided FROM plies GROUP BY game_id) GROUP BY 1",
    "jon_03_overlay": EVALS + f"""
        , half AS (SELECT pos_key, {_SUMS} FROM plies WHERE game_id % 2 = 0 GROUP BY pos_key)
        SELECT pos_key, coalesce(wins, 0) AS wins, coalesce(draws, 0) AS draws, coalesce(losses, 0) AS losses, cp, has_cp, dtm, dtz, proven_depth, coalesce(has_cp, false) OR coalesce(dtm, 0) <> 0 AS has_eval
        FROM half FULL JOIN evals USING (pos_key)""",
    "jon_15_import": EVALS + """
        , a AS (SELECT * FROM evals UNION ALL SELECT pos_key, cp, true, dtm, dtz, proven_depth, 9 FROM layers WHERE turn = 0 AND wins > losses)
        SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY pos_key ORDER BY seq DESC) = 1""",
    "flt_01_rated_orders": _ORDER_PLIES.format(least=200000) + f" z AS (SELECT 1) SELECT ply, token, {_SUMS} FROM p GROUP BY ply, token",
    "flt_03_needs_evaluation": POSITIONS + " SELECT pos_key, wins, draws, losses FROM positions WHERE NOT coalesce(has_cp, false) AND coalesce(dtm, 0) = 0",
    "flt_04_extreme": POSITIONS + " SELECT pos_key, cp, cp >= 300 AS winning FROM positions WHERE has_cp AND dtm = 0 AND (cp <= -300 OR cp >= 300)",
    "flt_05_any_evaluation": POSITIONS + " SELECT pos_key, coalesce(cp, 0) AS cp, dtm, dtz, proven_depth FROM positions WHERE coalesce(has_cp, false) OR coalesce(dtm, 0) <> 0 OR coalesce(dtz, 0) <> 0",
    "flt_06_changed_evaluations": EVALS + """
        SELECT pos_key, l.cp AS new_cp, l.dtm AS new_dtm, l.dtz AS new_dtz FROM layers l JOIN evals e USING (pos_key)
        WHERE turn = 1 AND NOT (l.cp = e.cp - e.cp % 2 AND l.dtm = e.dtm AND l.dtz = e.dtz)""",
    "set_03_replaced": PLIES + """
        SELECT game_id AS file, count(DISTINCT pos_key) AS n FROM plies WHERE game_id % 3 <> 0 GROUP BY 1
        UNION ALL SELECT -1, count(DISTINCT pos_key) FROM plies WHERE game_id % 3 = 0""",
}
