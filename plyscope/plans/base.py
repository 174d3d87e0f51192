"""What the queries start from, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.counts import count_positions, latest_evaluations, overlay
from ..operators.explore import edges
from ..sources.tables import TOKENS, evaluations, plies
from ..storage import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_plies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plies(table(spark, sf_dir, "events"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_positions(event_plies(spark, sf_dir))


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = counts(spark, sf_dir)
    return latest_evaluations(evaluations(c), evaluations(c, 1))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay(counts(spark, sf_dir), evals(spark, sf_dir))


def positions_of(plies: DataFrame) -> DataFrame:
    """positions() of written plies, which are counted once."""
    c = written(count_positions(plies), "counts")
    return overlay(c, latest_evaluations(evaluations(c), evaluations(c, 1)))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(event_plies(spark, sf_dir))


ROOT = ".".join("0" for _ in TOKENS)
#: One common table expression after another; a query takes those up to what it needs.
_PLIES = f"""
last AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id),
r AS (
    SELECT user_id AS game_id, event_type AS token, row_number() OVER w - 1 AS ply,
        CASE last WHEN 'purchase' THEN '1-0' WHEN 'error' THEN '0-1' WHEN 'signup' THEN '1/2-1/2' ELSE '*' END AS result,
        {", ".join(f"count(*) FILTER (event_type = '{t}') OVER w AS n{i}" for i, t in enumerate(TOKENS))}
    FROM events JOIN last USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
plies AS (
    SELECT game_id, CAST(ply AS INTEGER) AS ply, token,
        concat_ws('.', {", ".join(f"n{i} - CAST(token = '{t}' AS INTEGER)" for i, t in enumerate(TOKENS))}) AS pos_key,
        concat_ws('.', {", ".join(f"n{i}" for i in range(len(TOKENS)))}) AS child_key,
        CAST((result = '1-0' AND ply % 2 = 0) OR (result = '0-1' AND ply % 2 = 1) AS INTEGER) AS wins,
        CAST(result = '1/2-1/2' AS INTEGER) AS draws,
        CAST((result = '0-1' AND ply % 2 = 0) OR (result = '1-0' AND ply % 2 = 1) AS INTEGER) AS losses
    FROM r)"""
_COUNTS = """
counts AS (SELECT pos_key, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(draws) AS BIGINT) AS draws, CAST(sum(losses) AS BIGINT) AS losses FROM plies GROUP BY pos_key)"""
_EVALS = """
sized AS (SELECT *, wins + draws + losses AS n, CAST(list_sum(list_transform(string_split(pos_key, '.'), lambda x: CAST(x AS INTEGER))) AS BIGINT) AS played FROM counts),
layers AS (
    SELECT *, turn AS seq,
        CAST((wins * 37 - losses * 41 + draws * 5 + played * 7) % 1000 + turn * 10 AS INTEGER) AS cp, played % 4 <> 3 AS has_cp,
        CAST(CASE (n + played) % 5 WHEN 0 THEN wins + 1 WHEN 1 THEN -(losses + 1) WHEN 2 THEN draws - 32768 ELSE 0 END AS INTEGER) AS dtm,
        CAST(n % 3 AS INTEGER) AS dtz, CAST(played % 17 AS INTEGER) AS proven_depth
    FROM sized, (VALUES (0), (1)) t(turn) WHERE turn = 0 OR n % 2 = 0),
evals AS (SELECT pos_key, cp, has_cp, dtm, dtz, proven_depth, CAST(seq AS BIGINT) AS seq FROM layers WHERE has_cp OR dtm <> 0 QUALIFY row_number() OVER (PARTITION BY pos_key ORDER BY seq DESC) = 1)"""
_POSITIONS = """
positions AS MATERIALIZED (
    SELECT pos_key, coalesce(wins, 0) AS wins, coalesce(draws, 0) AS draws, coalesce(losses, 0) AS losses, cp, has_cp, dtm, dtz, proven_depth,
        coalesce(has_cp, false) OR coalesce(dtm, 0) <> 0 AS has_eval
    FROM counts FULL JOIN evals USING (pos_key))"""
_GRAPH = """
edges AS MATERIALIZED (SELECT DISTINCT pos_key AS parent_key, token, child_key FROM plies),
moves AS (
    SELECT parent_key, token, child_key, coalesce(wins, 0) AS wins, coalesce(draws, 0) AS draws, coalesce(losses, 0) AS losses,
        coalesce(has_eval, false) AS has_eval, has_cp, cp, dtm, coalesce(wins, 0) + coalesce(draws, 0) + coalesce(losses, 0) AS count,
        CASE WHEN list_sum(list_transform(string_split(parent_key, '.'), lambda x: CAST(x AS INTEGER))) % 2 = 0 THEN 1 ELSE -1 END AS sign
    FROM edges LEFT JOIN positions ON pos_key = child_key)"""
PLIES = "WITH RECURSIVE" + _PLIES
COUNTS = PLIES + "," + _COUNTS
EVALS = COUNTS + "," + _EVALS
POSITIONS = EVALS + "," + _POSITIONS
GRAPH = POSITIONS + "," + _GRAPH
KIND = "CASE WHEN {0} BETWEEN 1 AND 16384 THEN 'win' WHEN {0} BETWEEN -16384 AND -1 OR {0} IN (32767, 32766) THEN 'loss' WHEN {0} BETWEEN -32768 AND -16385 THEN 'draw' ELSE 'unknown' END"
DISTANCE = "CAST(CASE WHEN {0} BETWEEN 1 AND 16384 THEN {0} WHEN {0} BETWEEN -16384 AND -1 THEN -{0} WHEN {0} BETWEEN -32768 AND -16385 THEN {0} + 32768 ELSE 0 END AS INTEGER)"
