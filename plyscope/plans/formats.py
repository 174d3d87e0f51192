"""Queries on the functions of records, moves and text, over numbers and strings made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import moves as M
from ..functions import records as R
from ..functions import text as S
from .base import DISTANCE, KIND, table


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    """Every part's key as a distance: all of its range in steps."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), ((F.col("p_partkey") * 331) % 65_536 - 32_768).cast("int").alias("x"))


def fn_01_decode_dtm(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return _numbers(spark, d).select("k", "x", R.dtm_kind(x).alias("kind"), R.dtm_distance(x).alias("distance"), R.dtm_shown(x).alias("shown"), R.is_proven(x).alias("proven"))


def fn_02_encode_dtm(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return _numbers(spark, d).select("k", R.encode_draw(x).alias("draw"), R.encode_mate(x).alias("mate"), R.encode_mated(x % 2 == 0).alias("mated"))


def fn_04_flags(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("x") + 32_768).cast("int")
    return _numbers(spark, d).select("k", R.has_cp(x).alias("has_cp"), R.proven_depth(x).alias("depth"), R.set_has_cp(x, F.col("k") % 2 == 0).alias("flagged"), R.set_proven_depth(x, (F.col("k") % 100).cast("int")).alias("deepened"), F.bit_count(x).alias("bits"))


def fn_05_saturating(spark: SparkSession, d: str) -> DataFrame:
    a = (F.col("x") + 32_768).cast("long")
    return _numbers(spark, d).select("k", R.add_capped(a, F.col("k")).alias("plus"), R.add_capped(a, -F.col("k") * 300).alias("minus"), R.capped(a * 2).alias("capped"), R.saturated(a, a * 2).alias("saturated"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("int")
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), M.pack(k % 64, (k * 7) % 64, k % 5).alias("m"))


def fn_08_moves(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("m")
    return _packed(spark, d).select("k", "m", M.source(m).alias("source"), M.target(m).alias("target"), M.promotion(m).alias("promotion"))


def fn_09_uci(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("k", M.to_uci(F.col("m")).alias("uci"))


def fn_10_from_uci(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh text is cut short and so isn't a move."""
    uci = F.when(F.col("k") % 7 == 0, F.substring(M.to_uci(F.col("m")), 1, 3)).otherwise(M.to_uci(F.col("m")))
    return _packed(spark, d).select("k", M.from_uci(uci).alias("m"))


def fn_13_movetext(spark: SparkSession, d: str) -> DataFrame:
    """Lines of play from the users' first events: numbers, a comment, a glyph and check marks come off."""
    w = F.array_sort(F.collect_list(F.struct("ts", "event_type")))
    t = table(spark, d, "events").groupBy("user_id").agg(F.slice(w, 1, 4).alias("e"))
    e = F.transform("e", lambda x: x["event_type"])
    line = F.concat(F.lit("1. "), e[0], F.lit("+ {note} "), F.coalesce(F.get(e, F.lit(1)), F.lit("x")), F.lit(" 2... $3 "), F.coalesce(F.get(e, F.lit(2)), F.lit("y")), F.lit("#"))
    return t.select("user_id", F.array_join(S.movetext_tokens(line), " ").alias("moves"))


def fn_14_ratings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.when(k % 5 == 0, "?").when(k % 5 == 1, "-").when(k % 5 == 2, "").when(k % 5 == 3, F.concat(F.lit("x"), k.cast("string"))).otherwise((k % 3000).cast("string"))
    return table(spark, d, "customer").select("c_custkey", S.rating(text).alias("rating"))


def fn_16_keys(spark: SparkSession, d: str) -> DataFrame:
    """26-byte keys from hex and from base 64 with and without padding, and text that isn't one."""
    k = F.col("p_partkey")
    hexed = F.substring(F.sha2(k.cast("string"), 256), 1, 52)
    sixty = F.base64(F.unhex(hexed))
    plain = F.regexp_replace(F.translate(sixty, "+/", "-_"), "=", "")
    text = F.when(k % 4 == 0, hexed).when(k % 4 == 1, sixty).when(k % 4 == 2, plain).otherwise(F.substring(hexed, 1, 51))
    return table(spark, d, "part").select("p_partkey", S.key_of(text).alias("pos_key"))


def fn_17_order(spark: SparkSession, d: str) -> DataFrame:
    """Keys compare as unsigned bytes: rank of each by its hash's bytes."""
    from pyspark.sql import Window

    h = F.unhex(F.md5(F.col("n_name")))
    return table(spark, d, "nation").select("n_nationkey", F.row_number().over(Window.orderBy(h)).alias("rank"))


def fn_21_side_to_move(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    fen = F.concat(F.lit("8/8/8/8/8/8/8/8"), F.when(k % 3 == 0, " b - -").when(k % 3 == 1, " w - -").otherwise(""))
    return table(spark, d, "nation").select("n_nationkey", S.white_to_move(fen).alias("white"), R.to_white(k, S.white_to_move(fen)).alias("score"))


def fn_23_labels(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey") * F.col("o_custkey") * 7
    return table(spark, d, "orders").select("o_orderkey", L.number(n).alias("short"), L.size(n).alias("size"), L.exact(n).alias("exact"), L.results(F.col("o_custkey") % 5 - 1).alias("results"))


def fn_24_evaluations(spark: SparkSession, d: str) -> DataFrame:
    cp = F.when(F.col("k") % 6 != 5, F.col("x").cast("int"))
    dtm = F.when(F.col("k") % 3 == 0, (F.col("k") % 21 - 10).cast("int"))
    return _numbers(spark, d).select("k", L.evaluation(cp, dtm).alias("label"), L.evaluation_class(cp, dtm, F.col("k") % 2 == 0).alias("white"), L.evaluation_class(cp, dtm, F.col("k") % 2 == 1).alias("black"))


def fn_26_move_rows(spark: SparkSession, d: str) -> DataFrame:
    """A game's moves in rows of two, as they are printed."""
    from .base import event_plies

    p = event_plies(spark, d)
    side = F.col("ply") % 2
    rows = p.groupBy("game_id", (F.floor(F.col("ply") / 2) + 1).cast("int").alias("number"))
    return rows.agg(F.max(F.when(side == 0, F.col("token"))).alias("white"), F.max(F.when(side == 1, F.col("token"))).alias("black"))


def fn_27_paths(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the pages' paths, the path without its last part, and its first two."""
    parts = S.path_parts(F.regexp_extract("url", "^https?://[^/]*([^?#]*)", 1))
    return table(spark, d, "pages").select("page_id", F.size(parts).alias("parts"), F.array_join(F.slice(parts, 1, 2), "/").alias("first"), F.array_join(F.when(F.size(parts) > 1, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<string>")), "/").alias("up"))


def fn_31_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Of the moves between two squares the one a drop stands for: no promotion, else the queen first."""
    m = _packed(spark, d).select(M.to_uci(F.col("m")).alias("uci")).distinct()
    return m.groupBy(F.substring("uci", 1, 4).alias("drop")).agg(F.min_by("uci", M.promotion_rank(F.col("uci"))).alias("uci"))


def fn_33_state(spark: SparkSession, d: str) -> DataFrame:
    """Display state from URLs and back."""
    k = F.col("n_nationkey")
    url = F.concat(F.lit("/"), F.when(k % 3 != 0, F.concat(F.lit("?moves="), k.cast("string"))).otherwise(F.lit("")), F.when(k % 2 == 0, F.lit("#e4//e5/")).otherwise(F.lit("")))
    s = S.state_of(url)
    return table(spark, d, "nation").select("n_nationkey", F.array_join(s["path"], ",").alias("path"), s["moves"].alias("moves"), S.url_of(s["path"], s["moves"], s["depth"]).alias("url"))


QUERIES = {f.__name__: f for f in (
    fn_01_decode_dtm, fn_02_encode_dtm, fn_04_flags, fn_05_saturating, fn_08_moves, fn_09_uci, fn_10_from_uci, fn_13_movetext, fn_14_ratings, fn_16_keys, fn_17_order, fn_21_side_to_move, fn_23_labels, fn_24_evaluations, fn_26_move_rows, fn_27_paths, fn_31_dropped, fn_33_state,
)}

_X = "WITH n AS (SELECT p_partkey AS k, CAST((p_partkey * 331) % 65536 - 32768 AS INTEGER) AS x FROM part)"
_M = """WITH q AS (SELECT p_partkey AS k, p_partkey % 64 AS s, (p_partkey * 7) % 64 AS t, p_partkey % 5 AS p FROM part),
    u AS (SELECT *, CAST(s + t * 64 + p * 4096 AS INTEGER) AS m, chr(CAST(97 + s % 8 AS INTEGER)) || (s // 8 + 1) || chr(CAST(97 + t % 8 AS INTEGER)) || (t // 8 + 1) || ['', 'q', 'r', 'b', 'n'][p + 1] AS uci FROM q)"""
_UNIT = "CASE WHEN n >= 1000000000 THEN printf('%.1f{2}G', round(n / 1e9, 1)) WHEN n >= 1000000 THEN printf('%.1f{0}', round(n / 1e6, 1)) WHEN n >= 1000 THEN printf('%.1f{1}', round(n / 1e3, 1)) ELSE n || '{3}' END"
_SIGN = "CASE WHEN {0} > 0 THEN '+' ELSE '' END"

SQL = {
    "fn_01_decode_dtm": _X + f" SELECT k, x, {KIND.format('x')} AS kind, {DISTANCE.format('x')} AS distance, CAST(CASE {KIND.format('x')} WHEN 'win' THEN 1 WHEN 'loss' THEN -1 ELSE 0 END * {DISTANCE.format('x')} AS INTEGER) AS shown, x <> 0 AS proven FROM n",
    "fn_02_encode_dtm": _X + " SELECT k, CAST(least(greatest(x, 0), 16383) - 32768 AS INTEGER) AS draw, CAST(least(greatest(x, -16384), 16384) AS INTEGER) AS mate, CASE WHEN x % 2 = 0 THEN 32767 ELSE 32766 END AS mated FROM n",
    "fn_04_flags": _X + """
        , y AS (SELECT k, x + 32768 AS y FROM n)
        SELECT k, y >= 32768 AS has_cp, y % 32768 AS depth, CASE WHEN k % 2 = 0 THEN y | 32768 ELSE y % 32768 END AS flagged, CAST((y // 32768) * 32768 + k % 100 AS INTEGER) AS deepened, CAST(bit_count(y) AS INTEGER) AS bits FROM y""",
    "fn_05_saturating": _X + """
        , y AS (SELECT k, CAST(x + 32768 AS BIGINT) AS y FROM n)
        SELECT k, least(y + k, 65535) AS plus, greatest(y - k * 300, 0) AS minus, least(y * 2, 65535) AS capped, greatest(y, y * 2) >= 65535 AS saturated FROM y""",
    "fn_08_moves": _M + " SELECT k, m, CAST(s AS INTEGER) AS source, CAST(t AS INTEGER) AS target, CAST(p AS INTEGER) AS promotion FROM u",
    "fn_09_uci": _M + " SELECT k, uci FROM u",
    "fn_10_from_uci": _M + " SELECT k, CASE WHEN k % 7 <> 0 THEN m END AS m FROM u",
    "fn_13_movetext": """
        WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS r FROM events)
        SELECT user_id, max(event_type) FILTER (r = 1) || ' ' || coalesce(max(event_type) FILTER (r = 2), 'x') || ' ' || coalesce(max(event_type) FILTER (r = 3), 'y') AS moves FROM e GROUP BY user_id""",
    "fn_14_ratings": "SELECT c_custkey, CAST(CASE WHEN c_custkey % 5 = 4 THEN c_custkey % 3000 ELSE 0 END AS INTEGER) AS rating FROM customer",
    "fn_16_keys": "SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN upper(substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 52)) END AS pos_key FROM part",
    "fn_17_order": "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY md5(n_name)) AS INTEGER) AS rank FROM nation",
    "fn_21_side_to_move": "SELECT n_nationkey, n_nationkey % 3 <> 0 AS white, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey ELSE -n_nationkey END AS score FROM nation",
    "fn_23_labels": f"""
        WITH q AS (SELECT o_orderkey, o_custkey, o_orderkey * o_custkey * 7 AS n FROM orders)
        SELECT o_orderkey, {_UNIT.format("M", "K", "", "").replace("%.1fG", "%.1fB")} AS short, {_UNIT.format(" MB", " KB", " ", " B").replace("%.1f G", "%.1f GB")} AS size, format('{{:,}}', n) AS exact,
            CASE o_custkey % 5 WHEN 0 THEN 'Loading...' WHEN 1 THEN 'No games' ELSE CAST(o_custkey % 5 - 1 AS VARCHAR) END AS results
        FROM q""",
    "fn_24_evaluations": _X + f"""
        , e AS (SELECT k, CASE WHEN k % 6 <> 5 THEN x END AS cp, CASE WHEN k % 3 = 0 THEN CAST(k % 21 - 10 AS INTEGER) END AS dtm FROM n),
        s AS (SELECT *, CASE WHEN coalesce(dtm, 0) <> 0 THEN dtm ELSE coalesce(cp, 0) END * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS mine FROM e)
        SELECT k, CASE WHEN coalesce(dtm, 0) <> 0 THEN 'M' || {_SIGN.format("dtm")} || dtm ELSE {_SIGN.format("cp")} || printf('%.2f', cp / 100) END AS label,
            CASE WHEN mine > 0 THEN 'win' WHEN mine < 0 THEN 'loss' ELSE 'draw' END AS white, CASE WHEN mine < 0 THEN 'win' WHEN mine > 0 THEN 'loss' ELSE 'draw' END AS black
        FROM s""",
    "fn_26_move_rows": """
        WITH p AS (SELECT user_id AS game_id, event_type AS token, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS ply FROM events)
        SELECT game_id, CAST(ply // 2 + 1 AS INTEGER) AS number, max(token) FILTER (ply % 2 = 0) AS white, max(token) FILTER (ply % 2 = 1) AS black FROM p GROUP BY 1, 2""",
    "fn_27_paths": """
        WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^https?://[^/]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages)
        SELECT page_id, CAST(len(parts) AS INTEGER) AS parts, array_to_string(parts[1:2], '/') AS first, array_to_string(parts[1:len(parts) - 1], '/') AS up FROM p""",
    "fn_31_dropped": _M + " SELECT substr(uci, 1, 4) AS drop, min_by(uci, CASE WHEN length(uci) < 5 THEN 0 ELSE strpos('qrbn', substr(uci, 5, 1)) END) AS uci FROM u GROUP BY 1",
    "fn_33_state": """
        SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'e4,e5' ELSE '' END AS path, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey END AS moves,
            '/' || CASE WHEN n_nationkey % 3 <> 0 THEN '?moves=' || n_nationkey ELSE '' END || CASE WHEN n_nationkey % 2 = 0 THEN '#e4/e5' ELSE '' END AS url
        FROM nation""",
}
