"""Game files: reading, filtering, replaying into plies, and expanding positions.

Files are split at their games by Spark's text reader and taken apart by
expressions, so tags are known, and games filtered by them, before any move
is looked at.  Only following the moves of a game needs the rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..functions.text import rating
from ..workers import ship
from .tables import outcome

#: Names of game files, and where a game begins in one (fixed values).
PATTERN = "*.{pgn,pgn.zst}"
FIRST_TAG = "[Event "
#: The rating both players need unless a caller says otherwise.
LEAST_RATING = 2000
RESULTS = ("1-0", "0-1", "1/2-1/2", "*")
#: Rows that a Python task makes before it hands them on, and rows that it takes apart at once.
ROWS, TAKEN = 10_000, 500
#: Moves from positions that a Python worker remembers, as games share their first ones.
STEPS = 20_000


def _outside(body: Column) -> Column:
    """What stands outside of variations, however deep they are nested."""

    def step(at: Column, piece: Column) -> Column:
        depth = F.when(piece == "(", at["depth"] + 1).when(piece == ")", F.greatest(at["depth"] - 1, F.lit(0))).otherwise(at["depth"])
        return F.struct(depth.alias("depth"), F.when((at["depth"] == 0) & ~piece.isin("(", ")"), F.concat(at["out"], F.lit(" "), piece)).otherwise(at["out"]).alias("out"))

    pieces = F.regexp_extract_all(body, F.lit(r"[()]|[^()]+"), F.lit(0))
    return F.aggregate(pieces, F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")), step, lambda at: at["out"])


def parse(text: Column) -> list[Column]:
    """Columns of one game's text: tags, result, ratings, moves."""
    tag = r'\[(\w+)\s+"((?:[^"\\]|\\.)*)"\s*\]'
    value = lambda n: F.regexp_extract(text, rf'\[{n}\s+"([^"]*)"', 1)
    names, values = F.regexp_extract_all(text, F.lit(tag), F.lit(1)), F.regexp_extract_all(text, F.lit(tag), F.lit(2))
    body = F.regexp_replace(text, tag, " ")
    body = F.regexp_replace(F.regexp_replace(body, r"\{[^}]*\}", " "), r"(?m);.*$", " ")
    body = _outside(body)
    body = F.regexp_replace(body, r"\d+\.+|\$\d+", " ")
    moves = F.filter(F.split(body, r"\s+"), lambda m: (m != "") & ~m.isin(*RESULTS))
    return [
        F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.alias("value"))).alias("tags"),
        value("Result").alias("result"), rating(value("WhiteElo")).alias("white_elo"), rating(value("BlackElo")).alias("black_elo"), moves.alias("moves"),
    ]


def read(spark: SparkSession, path: str, pattern: str = PATTERN) -> DataFrame:
    """(file, game_id, tags, result, white_elo, black_elo, moves) of the game files under ``path``.

    A game begins with its Event tag.  Ratings that are missing or not
    numbers are 0.  game_id tells games apart within one reading.
    """
    rows = spark.read.option("lineSep", FIRST_TAG).option("pathGlobFilter", pattern).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    rows = rows.where(F.trim("value") != "").select("file", F.monotonically_increasing_id().alias("game_id"), F.concat(F.lit(FIRST_TAG), "value").alias("text"))
    return rows.select("file", "game_id", *parse(F.col("text")))


def stream(spark: SparkSession, path: str, files: int = 20, archive: str | None = None) -> DataFrame:
    """read() as a stream of the files that appear under ``path``; done ones move to ``archive``, if given."""
    reader = spark.readStream.option("lineSep", FIRST_TAG).option("pathGlobFilter", PATTERN).option("maxFilesPerTrigger", files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    rows = reader.text(path).where(F.trim("value") != "")
    return rows.select(F.concat(F.lit(FIRST_TAG), "value").alias("text")).select(F.xxhash64("text").alias("game_id"), *parse(F.col("text")))


def rated(games: DataFrame, least: int | None = LEAST_RATING) -> DataFrame:
    """Games with moves whose players both have at least ``least``; None keeps all with moves."""
    games = games.where(F.size("moves") > 0)
    return games if least is None else games.where((F.col("white_elo") >= least) & (F.col("black_elo") >= least))


@lru_cache(STEPS)
def _step(p: rules.Position, text: str) -> tuple[rules.Position, str]:
    """Where a move in short notation leads, and that position's key; ValueError if it isn't legal."""
    after = rules.apply(p, rules.from_san(p, text))
    return after, rules.key(after)


def _taken(b: pa.RecordBatch) -> Iterator[tuple]:
    """A batch's rows as Python values, a few at once."""
    for first in range(0, b.num_rows, TAKEN):
        yield from zip(*(c.to_pylist() for c in b.slice(first, TAKEN).columns), strict=True)


def _handed_on(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows``, none larger than ROWS, so that a task's memory doesn't grow with what its games hold."""
    rows = iter(rows)
    while some := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def replay(games: DataFrame) -> DataFrame:
    """(game_id, ply, token, pos_key, child_key, wins, draws, losses): the position before each move.

    Games start from the usual position.  A game ends at its first move that
    isn't legal; the moves before it count.
    """

    def plies_of(b: pa.RecordBatch) -> Iterator[tuple]:
        for g, result, moves in _taken(b):
            p = rules.from_fen(rules.START)
            at = rules.key(p)
            for ply, text in enumerate(moves or []):
                try:
                    p, after = _step(p, text)
                except ValueError:
                    break
                yield g, ply, text.rstrip("+#!?"), at, after, result
                at = after

    schema = pa.schema([("game_id", pa.int64()), ("ply", pa.int32()), ("token", pa.string()), ("pos_key", pa.string()), ("child_key", pa.string()), ("result", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _handed_on(plies_of(b), schema)

    ship(games.sparkSession)
    plies = games.select("game_id", "result", "moves").mapInArrow(rows, "game_id long, ply int, token string, pos_key string, child_key string, result string")
    return plies.select("game_id", "ply", "token", "pos_key", "child_key", *outcome(F.col("result"), F.col("ply")))


def expand(positions: DataFrame) -> DataFrame:
    """(parent_key, uci, token, child_key) of every legal move, and a row without a move for a finished game.

    ``positions`` (pos_key) are FEN texts; the finished row's token says
    checkmate or stalemate.  Text that isn't a position is left out.
    """

    def moves_of(b: pa.RecordBatch) -> Iterator[tuple]:
        for (fen,) in _taken(b):
            try:
                p = rules.from_fen(fen or "")
            except ValueError:
                continue
            moves = rules.legal(p)
            for m in moves:
                yield fen, rules.uci(m), rules.san(p, m, moves), rules.key(rules.apply(p, m))
            if not moves:
                yield fen, None, "checkmate" if rules.in_check(p, p[1]) else "stalemate", None

    schema = pa.schema([(c, pa.string()) for c in ("parent_key", "uci", "token", "child_key")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _handed_on(moves_of(b), schema)

    ship(positions.sparkSession)
    return positions.select("pos_key").distinct().mapInArrow(rows, "parent_key string, uci string, token string, child_key string")


def key_of_fen(fens: DataFrame, fen: str = "fen") -> DataFrame:
    """``fens`` with pos_key: the position's key, without counters; null for text that isn't a position."""

    def key(text: str | None) -> str | None:
        try:
            return rules.key(rules.from_fen(text or ""))
        except ValueError:
            return None

    return _with_key(fens, [fen], key)


def applied(moves: DataFrame, position: str = "pos_key", uci: str = "uci") -> DataFrame:
    """``moves`` with child_key: where a move in UCI notation leads; null if it isn't legal there."""

    def key(fen: str | None, text: str | None) -> str | None:
        try:
            p = rules.from_fen(fen or "")
            return rules.key(rules.apply(p, rules.from_uci(p, text or "")))
        except ValueError:
            return None

    return _with_key(moves, [position, uci], key, "child_key")


def line_key(lines: DataFrame, moves: str = "moves") -> DataFrame:
    """``lines`` with pos_key: where their moves lead from the start; null if one isn't legal."""

    def key(line: list[str] | None) -> str | None:
        p = rules.from_fen(rules.START)
        try:
            for text in line or []:
                p, _ = _step(p, text)
        except ValueError:
            return None
        return rules.key(p)

    return _with_key(lines, [moves], key)


def paths(lines: DataFrame, name: str, moves: str = "moves") -> DataFrame:
    """(name, ply, token, pos_key) of every position on the way of each line, the first one (ply 0, no token) too.

    A line with a move that isn't legal has no rows.
    """

    def ways_of(b: pa.RecordBatch) -> Iterator[tuple]:
        start = rules.from_fen(rules.START)
        for i, (line,) in enumerate(_taken(b.select([1]))):
            p, way = start, [(i, 0, None, rules.key(start))]
            try:
                for ply, text in enumerate(line or [], 1):
                    p, at = _step(p, text)
                    way.append((i, ply, text, at))
            except ValueError:
                continue
            yield from way

    schema = pa.schema([("row", pa.int64()), ("ply", pa.int32()), ("token", pa.string()), ("pos_key", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for way in _handed_on(ways_of(b), schema):
                yield pa.RecordBatch.from_arrays([b.column(0).take(way.column(0)), *way.columns[1:]], [name, "ply", "token", "pos_key"])

    ship(lines.sparkSession)
    kind = lines.schema[name].dataType.simpleString()
    return lines.select(name, moves).mapInArrow(rows, f"`{name}` {kind}, ply int, token string, pos_key string")


def _with_key(rows: DataFrame, of: list[str], key: Callable[..., str | None], name: str = "pos_key") -> DataFrame:
    """``rows`` with one more column: ``key`` of the columns ``of``, in its place if there is one of that name."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            args = (b.column(b.schema.get_field_index(c)).to_pylist() for c in of)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([key(*x) for x in zip(*args, strict=True)], pa.string())], [*b.schema.names, name])

    ship(rows.sparkSession)
    rows = rows.drop(name)
    return rows.mapInArrow(mapped, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))
