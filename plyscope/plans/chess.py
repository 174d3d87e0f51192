"""Queries on game, opening and evaluation files and on the rules of chess.

The files are written from the tables first.  A user's events are a game in
which only knights move: a click or view takes the queen's knight of the side
to move out or back, any other event the king's.  All moves are legal, and a
position is four bits and the side to move, which SQL can count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators import explore as X
from ..operators.lookup import lookup
from ..sources import evaluations as E
from ..sources import games as G
from ..sources import openings as O
from ..sources.tables import result_of
from ..storage import fresh_path, written
from .base import EVALS, POSITIONS, evals, positions, table

#: What a knight's move is called: by side, wing and whether it goes out.
SAN = {("w", "q"): ("Nc3", "Nb1"), ("w", "k"): ("Nf3", "Ng1"), ("b", "q"): ("Nc6", "Nb8"), ("b", "k"): ("Nf6", "Ng8")}


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """(game_id, moves, last): a user's events as a line of knight moves."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.when(F.col("event_type").isin("click", "view"), F.lit("q")).otherwise(F.lit("k")).alias("wing"), (F.row_number().over(order) - 1).alias("ply"))
    rows = rows.withColumn("white", F.col("ply") % 2 == 0)
    nth = F.row_number().over(Window.partitionBy("user_id", "white", "wing").orderBy("ply"))
    token: Column = F.lit(None)
    for (side, wing), (out, back) in SAN.items():
        token = F.when((F.col("white") == (side == "w")) & (F.col("wing") == wing), F.when(nth % 2 == 1, F.lit(out)).otherwise(F.lit(back))).otherwise(token)
    rows = rows.select("user_id", "ply", token.alias("token"), "event_type")
    moves = F.array_sort(F.collect_list(F.struct("ply", "token")))  # a game's moves
    return rows.groupBy(F.col("user_id").alias("game_id")).agg(F.transform(moves, lambda m: m["token"]).alias("moves"), F.max_by("event_type", "ply").alias("last"))


def _ratings() -> tuple[Column, Column]:
    k = F.col("game_id")
    return F.when(k % 5 == 0, F.lit("?")).otherwise((k * 37 % 400 + 1900).cast("string")), F.when(k % 7 == 0, F.lit("")).otherwise((k * 53 % 300 + 1950).cast("string"))


def game_files(spark: SparkSession, d: str, lines: DataFrame | None = None) -> str:
    """A folder of game files: tags, numbers, glyphs, comments and nested variations; every eleventh game ends in an illegal move."""
    path, (white, black) = fresh_path(spark, "games"), _ratings()
    rows = (lines or _lines(spark, d)).withColumn("result", result_of(F.col("last")))

    def ply(move: Column, i: Column) -> Column:
        number = F.when(i % 2 == 0, F.concat((F.floor(i / 2) + 1).cast("string"), F.lit(". "))).otherwise(F.lit(""))
        extra = F.when(i == 0, F.lit(" $1 {a (note)} (1. e4 (1. d4 (1. c4 (1. b3 (1. g3 e5)))) e5)")).when(i % 10 == 3, F.lit("!?")).otherwise(F.lit(""))
        return F.concat(number, move, extra)

    tag = lambda name, value: F.concat(F.lit(f'[{name} "'), value, F.lit('"]\n'))
    end = F.when(F.col("game_id") % 11 == 0, F.lit(" Ke2")).otherwise(F.lit(""))
    text = F.concat(tag("Event", F.col("game_id").cast("string")), tag("Result", F.col("result")), tag("WhiteElo", white), tag("BlackElo", black), F.lit("\n"), F.array_join(F.transform("moves", ply), " "), end, F.lit(" ; the end\n"), F.col("result"), F.lit("\n"))
    rows.select(text.alias("value")).write.text(path)
    return path


def games(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """Games as read from files, told by the number in their Event tag."""
    read = G.read(spark, game_files(spark, d, lines), "part-*")
    return read.withColumn("game_id", F.get(F.filter("tags", lambda t: t["name"] == "Event"), F.lit(0))["value"].cast("long"))


def src_01_games(spark: SparkSession, d: str) -> DataFrame:
    """Games of files: ratings, result and number of moves, variations and comments left out."""
    return games(spark, d).select("game_id", "white_elo", "black_elo", "result", F.size("moves").alias("moves"), F.size("tags").alias("tags"))


def grf_01_replayed(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the positions of all games whose players both have the default rating, replayed by the rules."""
    return C.count_positions(G.replay(G.rated(games(spark, d))))


def grf_01_plies(spark: SparkSession, d: str) -> DataFrame:
    """Every ply of every game: the position before and after, until a move isn't legal."""
    return G.replay(G.rated(games(spark, d), None)).select("game_id", "ply", "token", "pos_key", "child_key", "wins", "draws", "losses")


def _openings(spark: SparkSession, d: str, lines: DataFrame | None = None) -> DataFrame:
    """Openings from .tsv files: a header, a line without moves, and the first one to three plies of every game."""
    path = fresh_path(spark, "openings")
    k = F.col("game_id")
    rows = (lines or written(_lines(spark, d), "lines")).select(k, F.concat_ws("\t", F.format_string("A%02d", k % 100), F.concat(F.lit("Line "), k.cast("string")), F.concat(F.lit("1. "), F.array_join(F.slice("moves", F.lit(1), (k % 3 + 1).cast("int")), " "), F.lit("+"))).alias("value"))
    extra = spark.createDataFrame([(-2, "eco\tname\tpgn"), (-1, "A00\tno moves")], "game_id long, value string")
    # files in the order of games, as of lines that reach one position the last counts
    rows.unionByName(extra).repartitionByRange("game_id").sortWithinPartitions("game_id").select("value").write.text(path)
    return O.by_position(G.line_key(O.read(spark, path, "part-*")), F.col("pos_key"))


def src_04_openings(spark: SparkSession, d: str) -> DataFrame:
    return _openings(spark, d)


def jon_06_carried(spark: SparkSession, d: str) -> DataFrame:
    """The opening that each ply of a replayed game is in, by names from a file."""
    lines = written(_lines(spark, d), "lines")
    plies = G.replay(G.rated(games(spark, d, lines), None))
    return O.carried(plies, written(_openings(spark, d, lines), "names"))


def grf_02_paths(spark: SparkSession, d: str) -> DataFrame:
    """All positions on the way of each game's first moves, given as one text with commas."""
    lines = _lines(spark, d).select("game_id", F.array_join(F.slice("moves", 1, 6), ",").alias("moves"))
    return G.paths(lines.withColumn("moves", F.split("moves", ",")), "game_id")


def _reached(spark: SparkSession, d: str) -> DataFrame:
    return G.replay(G.rated(games(spark, d), None)).select("pos_key").distinct()


def grf_03_expanded(spark: SparkSession, d: str) -> DataFrame:
    """Every legal move of every position that games reach, in both notations, and where it leads."""
    return G.expand(_reached(spark, d))


def grf_10_missing(spark: SparkSession, d: str) -> DataFrame:
    """Empty records for the positions one move on that no game has reached."""
    known = written(_reached(spark, d), "reached")
    return X.missing_children(G.expand(known), known)


def fn_12_applied(spark: SparkSession, d: str) -> DataFrame:
    """A few moves in UCI notation tried on every position; null where one isn't legal there."""
    tries = F.explode(F.array(*map(F.lit, ("b1c3", "g8f6", "e2e4", "a1b1", "e7e8q", "nonsense"))))
    return G.applied(_reached(spark, d).select("pos_key", tries.alias("uci")))


def api_04_keys(spark: SparkSession, d: str) -> DataFrame:
    """Positions' keys from FEN texts with counters, and from texts that aren't positions."""
    k = F.col("pos_key")
    kinds = {"good": F.concat(k, F.lit(" 7 31")), "no king": F.concat(F.translate(k, "K", "P"), F.lit(" 0 1")), "short": F.substring_index(k, "/", 7), "castling": F.regexp_replace(k, "KQkq", "KX")}
    rows = _reached(spark, d).select(F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), v.alias("fen")) for n, v in kinds.items()))).alias("x")).select("x.*")
    return G.key_of_fen(rows).select("kind", "fen", "pos_key")


def api_01_paths(spark: SparkSession, d: str) -> DataFrame:
    """The tree of the position that each game's first moves lead to: its moves in order, the first three with statistics, the others as stubs."""
    lines = written(_lines(spark, d), "lines")
    counted = written(C.count_positions(G.replay(G.rated(games(spark, d, lines), None))), "counts")
    names = written(_openings(spark, d, lines), "names")
    way = written(G.paths(lines.select("game_id", F.slice("moves", 1, 3).alias("moves")), "game_id"), "paths")
    last = F.max(F.struct("ply", "pos_key")).alias("at")
    carried = O.carried(way, names).groupBy("game_id").agg(F.max_by(F.struct("eco", "name"), "ply").alias("o"))
    at = way.groupBy("game_id").agg(last).select("game_id", F.col("at.pos_key").alias("parent_key")).join(carried, "game_id")
    moves = G.expand(at.select(F.col("parent_key").alias("pos_key"))).where("uci is not null")
    none = {"has_cp": F.lit(False), "cp": F.lit(None).cast("int"), "dtm": F.lit(0), "has_eval": F.lit(False)}
    known = X.children(moves, counted.select("*", *(v.alias(n) for n, v in none.items())))
    top = X.top_moves(known, X.server_order(F.contains("parent_key", F.lit(" w "))))
    shown = top.join(moves.select("parent_key", "token", "uci"), ["parent_key", "token"])
    answer = F.to_json(F.struct("uci", F.col("token").alias("san"), "wins", "draws", "losses"))
    return at.join(shown, "parent_key").select("game_id", "parent_key", F.col("o.eco").alias("eco"), F.col("o.name").alias("name"), "rank", "uci", F.col("token").alias("san"), "child_key", "is_top", "wins", "draws", "losses", answer.alias("answer"))


def api_03_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every position and of as many unknown ones, as JSON: zeros for those, an evaluation only where there is one."""
    p = positions(spark, d)
    keys = p.select("pos_key").unionByName(p.select(F.concat(F.lit("x"), "pos_key").alias("pos_key")))
    n = C.count_column()
    shown = lookup(keys, p).select("pos_key", "wins", "draws", "losses", n.alias("count"), F.when(F.col("has_cp"), F.col("cp")).alias("cp"), "found")
    return shown.select("pos_key", "found", F.to_json(F.struct("pos_key", "wins", "draws", "losses", "count", "cp")).alias("answer"))


def _hexed(key: Column) -> Column:
    return F.upper(F.substring(F.sha2(key, 256), 1, 52))


def evaluation_files(spark: SparkSession, d: str) -> str:
    """Evaluation files with and without the column fen; some keys, and some numbers, aren't right."""
    path, e = fresh_path(spark, "evaluations"), evals(spark, d)
    hexed = _hexed(F.col("pos_key"))
    bad = F.col("dtz") + F.col("proven_depth") == 5
    key = F.when(bad, F.substring(hexed, 1, 50)).when(F.col("seq") == 1, F.base64(F.unhex(hexed))).otherwise(hexed)
    cp = F.when(F.col("proven_depth") == 3, F.lit("many")).when(F.col("proven_depth") == 4, F.lit("99999")).otherwise(F.col("cp").cast("string"))
    rest = [cp, *(F.col(c).cast("string") for c in ("dtm", "dtz", "proven_depth"))]
    for name, seq, first in (("new", 0, [F.lit("")]), ("old", 1, [])):
        lines = e.where(F.col("seq") == seq).select(F.concat_ws(",", *first, key, *rest).alias("value"))
        head = spark.createDataFrame([("fen," * (seq == 0) + "position,cp,dtm,dtz,proven_depth",)], "value string")
        head.unionByName(lines).write.option("compression", "gzip").text(f"{path}/kind={name}")
    return f"{path}/kind=*"


def src_06_evaluations(spark: SparkSession, d: str) -> DataFrame:
    """Rows of evaluation files of both kinds, as a log has them."""
    return E.read(spark, evaluation_files(spark, d), log=True).where("pos_key is not null").select("pos_key", "cp", "has_cp", "dtm", "dtz", "proven_depth")


def flt_08_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a valid key, by kind of file."""
    by_file = E.rejected(E.read(spark, evaluation_files(spark, d)))
    return by_file.groupBy(F.regexp_extract("file", "kind=(new|old)", 1).alias("kind")).agg(F.sum("rejected").alias("rejected"), F.sum("rows").alias("rows"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """What is stored before an import: every evaluation but those of distance 2, some with another cp."""
    e = evals(spark, d).where("dtz <> 2")
    return e.select(_hexed(F.col("pos_key")).alias("pos_key"), (F.col("cp") + F.when(F.col("proven_depth") % 2 == 0, 1).otherwise(0)).alias("cp"), "dtm", "dtz")


def cmd_01_import(spark: SparkSession, d: str) -> DataFrame:
    """What an import writes: files against what is stored, unchanged rows and unknown positions left out."""
    return E.changed(E.read(spark, evaluation_files(spark, d)), _stored(spark, d)).select("pos_key", "cp", "dtm", "dtz", "proven_depth")


def flt_07_created(spark: SparkSession, d: str) -> DataFrame:
    """The same with unknown positions made."""
    return E.changed(E.read(spark, evaluation_files(spark, d)), _stored(spark, d), create_missing=True).select("pos_key", "cp", "dtm", "dtz", "proven_depth")


def cmd_02_export(spark: SparkSession, d: str) -> DataFrame:
    """An export of all positions that say something about their value, read back."""
    path = fresh_path(spark, "export")
    p = positions(spark, d)
    E.export(p.withColumn("pos_key", _hexed(F.col("pos_key"))), path)
    return E.read(spark, path).select("pos_key", "cp", "dtm", "dtz", "proven_depth")


def snk_07_appended(spark: SparkSession, d: str) -> DataFrame:
    """A log that evaluations are appended to, first old ones, then new ones of some positions: the latest of each."""
    log, e = fresh_path(spark, "log"), evals(spark, d)
    E.append(e, log)
    E.append(e.where("dtz = 1").withColumn("seq", F.col("seq") + 10).withColumn("cp", F.lit(7)), log)
    return E.current(spark, log)


QUERIES = {f.__name__: f for f in (
    src_01_games, src_04_openings, src_06_evaluations, grf_01_replayed, grf_01_plies, grf_02_paths, grf_03_expanded, grf_10_missing, fn_12_applied, jon_06_carried, api_01_paths, api_03_stats, api_04_keys,
    flt_07_created, flt_08_rejected, cmd_01_import, cmd_02_export, snk_07_appended,
)}

_GAMES = """
    WITH last AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id),
    e AS (
        SELECT user_id AS game_id, event_type IN ('click', 'view') AS wing, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS ply,
            CASE last WHEN 'purchase' THEN '1-0' WHEN 'error' THEN '0-1' WHEN 'signup' THEN '1/2-1/2' ELSE '*' END AS result
        FROM events JOIN last USING (user_id)),
    f AS (
        SELECT *, count(*) FILTER (ply % 2 = 0 AND wing) OVER w % 2 AS wq, count(*) FILTER (ply % 2 = 0 AND NOT wing) OVER w % 2 AS wk,
            count(*) FILTER (ply % 2 = 1 AND wing) OVER w % 2 AS bq, count(*) FILTER (ply % 2 = 1 AND NOT wing) OVER w % 2 AS bk
        FROM e WINDOW w AS (PARTITION BY game_id ORDER BY ply)),
    g AS (
        SELECT *, CASE WHEN ply % 2 = 0 THEN CASE WHEN wing THEN CASE wq WHEN 1 THEN 'Nc3' ELSE 'Nb1' END ELSE CASE wk WHEN 1 THEN 'Nf3' ELSE 'Ng1' END END
                ELSE CASE WHEN wing THEN CASE bq WHEN 1 THEN 'Nc6' ELSE 'Nb8' END ELSE CASE bk WHEN 1 THEN 'Nf6' ELSE 'Ng8' END END END AS token,
            CASE WHEN ply % 2 = 0 AND wing THEN 1 - wq ELSE wq END AS wq0, CASE WHEN ply % 2 = 0 AND NOT wing THEN 1 - wk ELSE wk END AS wk0,
            CASE WHEN ply % 2 = 1 AND wing THEN 1 - bq ELSE bq END AS bq0, CASE WHEN ply % 2 = 1 AND NOT wing THEN 1 - bk ELSE bk END AS bk0
        FROM f),"""


def _board(q: str = "") -> str:
    """The board of four bits, a point for an empty square."""
    knight = lambda bit, yes, no: f"CASE {bit}{q} WHEN 1 THEN '{yes}' ELSE '{no}' END"
    return (
        f"'r' || {knight('bq', '.', 'n')} || 'bqkb' || {knight('bk', '.', 'n')} || 'r/pppppppp/..' || {knight('bq', 'n', '.')} || '..' || {knight('bk', 'n', '.')} || '../......../......../..' || "
        f"{knight('wq', 'N', '.')} || '..' || {knight('wk', 'N', '.')} || '../PPPPPPPP/R' || {knight('wq', '.', 'N')} || 'BQKB' || {knight('wk', '.', 'N')} || 'R'"
    )


def _fen(board: str) -> str:
    for n in range(8, 0, -1):
        board = f"replace({board}, '{'.' * n}', '{n}')"
    return board


_SIDE = "CASE WHEN {0} % 2 = 0 THEN ' w KQkq -' ELSE ' b KQkq -' END"
_REPLAYED = _GAMES + f"""
    plies AS MATERIALIZED (
        SELECT game_id, ply, token, {_fen(_board("0"))} || {_SIDE.format("ply")} AS pos_key, {_fen(_board())} || {_SIDE.format("(ply + 1)")} AS child_key,
            CAST((result = '1-0' AND ply % 2 = 0) OR (result = '0-1' AND ply % 2 = 1) AS INTEGER) AS wins, CAST(result = '1/2-1/2' AS INTEGER) AS draws,
            CAST((result = '0-1' AND ply % 2 = 0) OR (result = '1-0' AND ply % 2 = 1) AS INTEGER) AS losses,
            CASE WHEN game_id % 5 = 0 THEN 0 ELSE game_id * 37 % 400 + 1900 END AS white_elo, CASE WHEN game_id % 7 = 0 THEN 0 ELSE game_id * 53 % 300 + 1950 END AS black_elo, result
        FROM g)"""
_NAMES = """,
    names AS (SELECT child_key AS pos_key, max(game_id) AS k FROM plies WHERE ply = game_id % 3 OR (ply < game_id % 3 AND ply + 1 = (SELECT max(ply) + 1 FROM plies o WHERE o.game_id = plies.game_id)) GROUP BY 1),
    named AS (SELECT pos_key, printf('A%02d', k % 100) AS eco, 'Line ' || k AS name FROM names)"""
#: Each side's moves where only knights have moved: from, to, piece, what must be true of the bits (q, k: queen's and king's knight out), and the name.
_MOVES = (
    [(f"{f}2", f"{f}{r}", "P", {"c": "q = 0", "f": "k = 0"}.get(f, "true"), f"{f}{r}") for f in "abcdefgh" for r in (3, 4)]
    + [("b1", t, "N", "q = 0", f"N{t}") for t in ("a3", "c3")] + [("c3", t, "N", "q = 1", f"N{t}") for t in ("a4", "b1", "b5", "d5", "e4")]
    + [("g1", t, "N", "k = 0", f"N{t}") for t in ("f3", "h3")] + [("f3", t, "N", "k = 1", f"N{t}") for t in ("d4", "e5", "g1", "g5", "h4")]
    + [("a1", "b1", "R", "q = 1", "Rb1"), ("h1", "g1", "R", "k = 1", "Rg1")]
)


def _moved() -> str:
    """Every position of ``here`` (wq, wk, bq, bk, white, board) with its moves."""
    rows = []
    for white in (True, False):
        flip = (lambda s: s) if white else (lambda s: s[0] + str(9 - int(s[1])))
        for a, b, piece, when, san in _MOVES:
            lost = {"a1": "Q", "h1": "K"}.get(a, "")
            lost = lost if white else lost.lower()
            name = san[:-2] + flip(san[-2:])
            rights = "KQkq".replace(lost, "")
            test = when if when == "true" else ("w" if white else "b") + when
            place = lambda s: (8 - int(s[1])) * 9 + ord(s[0]) - 96
            i, j = place(flip(a)), place(flip(b))
            piece_ = piece if white else piece.lower()
            low, high, first, second = (i, j, ".", piece_) if i < j else (j, i, piece_, ".")
            board = f"substr(board, 1, {low - 1}) || '{first}' || substr(board, {low + 1}, {high - low - 1}) || '{second}' || substr(board, {high + 1})"
            rows.append(f"SELECT parent_key, '{flip(a) + flip(b)}' AS uci, '{name}' AS token, {_fen('(' + board + ')')} || '{' b ' if white else ' w '}{rights} -' AS child_key FROM here WHERE white = {white} AND {test}")
    return " UNION ALL ".join(rows)


_EXPANDED = f""",
    here AS MATERIALIZED (SELECT DISTINCT {_fen(_board("0"))} || {_SIDE.format("ply")} AS parent_key, {_board("0")} AS board, wq0 AS wq, wk0 AS wk, bq0 AS bq, bk0 AS bk, ply % 2 = 0 AS white FROM g),
    expanded AS MATERIALIZED ({_moved()})"""
_COUNTED = ", counted AS (SELECT pos_key, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(draws) AS BIGINT) AS draws, CAST(sum(losses) AS BIGINT) AS losses FROM plies GROUP BY 1)"
_START = "'rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -'"
_HEX = "upper(substr(sha256({0}), 1, 52))"
_CP = "CASE WHEN proven_depth = 3 THEN 0 WHEN proven_depth = 4 THEN 32767 ELSE cp END"
_FILED = EVALS + f""",
    filed AS (SELECT *, {_HEX.format("pos_key")} AS hexed, CAST({_CP} AS INTEGER) AS said, dtz + proven_depth = 5 AS bad FROM evals),
    stored AS (SELECT *, cp + CASE WHEN proven_depth % 2 = 0 THEN 1 ELSE 0 END AS old FROM filed WHERE dtz <> 2)"""

SQL = {
    "src_01_games": _REPLAYED + " SELECT game_id, CAST(any_value(white_elo) AS INTEGER) AS white_elo, CAST(any_value(black_elo) AS INTEGER) AS black_elo, any_value(result) AS result, CAST(count(*) + CAST(game_id % 11 = 0 AS INTEGER) AS INTEGER) AS moves, 4 AS tags FROM plies GROUP BY game_id",
    "grf_01_replayed": _REPLAYED + " SELECT pos_key, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(draws) AS BIGINT) AS draws, CAST(sum(losses) AS BIGINT) AS losses FROM plies WHERE white_elo >= 2000 AND black_elo >= 2000 GROUP BY pos_key",
    "grf_01_plies": _REPLAYED + " SELECT game_id, ply, token, pos_key, child_key, wins, draws, losses FROM plies",
    "src_04_openings": _REPLAYED + _NAMES + " SELECT * FROM named",
    "jon_06_carried": _REPLAYED + _NAMES + """
        SELECT game_id, ply, pos_key, last_value(eco IGNORE NULLS) OVER w AS eco, last_value(name IGNORE NULLS) OVER w AS name
        FROM plies LEFT JOIN named USING (pos_key) WINDOW w AS (PARTITION BY game_id ORDER BY ply ROWS UNBOUNDED PRECEDING)""",
    "grf_02_paths": _REPLAYED + f" SELECT game_id, CAST(ply + 1 AS INTEGER) AS ply, token, child_key AS pos_key FROM plies WHERE ply < 6 UNION ALL SELECT DISTINCT game_id, 0, NULL, {_START} FROM plies",
    "grf_03_expanded": _REPLAYED + _EXPANDED + " SELECT * FROM expanded",
    "grf_10_missing": _REPLAYED + _EXPANDED + " SELECT DISTINCT child_key AS pos_key, CAST(0 AS BIGINT) AS wins, CAST(0 AS BIGINT) AS draws, CAST(0 AS BIGINT) AS losses FROM expanded WHERE child_key NOT IN (SELECT pos_key FROM plies)",
    "fn_12_applied": _REPLAYED + _EXPANDED + """
        SELECT p.parent_key AS pos_key, t.uci, x.child_key
        FROM here p CROSS JOIN (VALUES ('b1c3'), ('g8f6'), ('e2e4'), ('a1b1'), ('e7e8q'), ('nonsense')) t(uci) LEFT JOIN expanded x ON x.parent_key = p.parent_key AND x.uci = t.uci""",
    "api_04_keys": _REPLAYED + """
        , k AS (SELECT DISTINCT pos_key FROM plies)
        SELECT 'good' AS kind, pos_key || ' 7 31' AS fen, pos_key FROM k UNION ALL SELECT 'no king', replace(pos_key, 'K', 'P') || ' 0 1', NULL FROM k
        UNION ALL SELECT 'short', array_to_string(string_split(pos_key, '/')[1:7], '/'), NULL FROM k UNION ALL SELECT 'castling', replace(pos_key, 'KQkq', 'KX'), NULL FROM k""",
    "api_01_paths": _REPLAYED + _NAMES + _EXPANDED + _COUNTED + """,
        way AS (SELECT game_id, ply, child_key AS pos_key, eco, name FROM plies LEFT JOIN named ON named.pos_key = child_key WHERE ply < 3),
        last_ AS (SELECT game_id, max_by(pos_key, ply) AS parent_key, max_by(eco, ply) FILTER (eco IS NOT NULL) AS eco, max_by(name, ply) FILTER (name IS NOT NULL) AS name FROM way GROUP BY game_id),
        more AS (SELECT DISTINCT """ + _fen(_board()) + " || " + _SIDE.format("(ply + 1)") + " AS parent_key, " + _board() + """ AS board, wq, wk, bq, bk, ply % 2 = 1 AS white FROM g WHERE ply < 3),
        open_ AS (""" + _moved().replace("FROM here", "FROM more") + """),
        m AS (SELECT o.*, coalesce(wins, 0) AS wins, coalesce(draws, 0) AS draws, coalesce(losses, 0) AS losses FROM open_ o LEFT JOIN counted ON pos_key = child_key),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY parent_key ORDER BY wins + draws + losses DESC, token) AS INTEGER) AS rank FROM m),
        s AS (SELECT * REPLACE (CASE WHEN rank <= 3 THEN wins END AS wins, CASE WHEN rank <= 3 THEN draws END AS draws, CASE WHEN rank <= 3 THEN losses END AS losses), rank <= 3 AS is_top FROM r)
        SELECT game_id, parent_key, eco, name, rank, uci, token AS san, child_key, is_top, wins, draws, losses,
            '{"uci":"' || uci || '","san":"' || token || '"' || CASE WHEN is_top THEN ',"wins":' || wins || ',"draws":' || draws || ',"losses":' || losses ELSE '' END || '}' AS answer
        FROM last_ JOIN s USING (parent_key)""",
    "api_03_stats": POSITIONS + """
        , k AS (SELECT *, true AS found FROM positions UNION ALL SELECT 'x' || pos_key, 0, 0, 0, NULL, false, NULL, NULL, NULL, false, false FROM positions)
        SELECT pos_key, found, '{"pos_key":"' || pos_key || '","wins":' || wins || ',"draws":' || draws || ',"losses":' || losses || ',"count":' || (wins + draws + losses) || CASE WHEN has_cp THEN ',"cp":' || cp ELSE '' END || '}' AS answer FROM k""",
    "src_06_evaluations": _FILED + " SELECT hexed AS pos_key, said AS cp, said <> 0 OR dtm <> 0 AS has_cp, dtm, dtz, proven_depth FROM filed WHERE NOT bad",
    "flt_08_rejected": _FILED + " SELECT CASE seq WHEN 0 THEN 'new' ELSE 'old' END AS kind, count(*) FILTER (bad) AS rejected, count(*) AS rows FROM filed GROUP BY 1",
    "cmd_01_import": _FILED + " SELECT f.hexed AS pos_key, f.said AS cp, f.dtm, f.dtz, f.proven_depth FROM filed f JOIN stored s USING (pos_key) WHERE NOT f.bad AND f.said <> s.old",
    "flt_07_created": _FILED + " SELECT f.hexed AS pos_key, f.said AS cp, f.dtm, f.dtz, f.proven_depth FROM filed f LEFT JOIN stored s USING (pos_key) WHERE NOT f.bad AND (s.old IS NULL OR f.said <> s.old)",
    "cmd_02_export": POSITIONS + f" SELECT {_HEX.format('pos_key')} AS pos_key, coalesce(cp, 0) AS cp, coalesce(dtm, 0) AS dtm, coalesce(dtz, 0) AS dtz, coalesce(proven_depth, 0) AS proven_depth FROM positions WHERE coalesce(has_cp, false) OR coalesce(dtm, 0) <> 0 OR coalesce(dtz, 0) <> 0",
    "snk_07_appended": EVALS + " SELECT pos_key, CASE WHEN dtz = 1 THEN 7 ELSE cp END AS cp, has_cp, dtm, dtz, proven_depth, CASE WHEN dtz = 1 THEN seq + 10 ELSE seq END AS seq FROM evals",
}
