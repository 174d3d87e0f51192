"""Columns of text: move text, ratings, keys, paths and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BYTES = 26
SIZES = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def movetext_tokens(text: Column) -> Column:
    """The moves of a line of play: no move numbers, comments or glyphs, no check marks."""
    bare = F.regexp_replace(text, r"[0-9]+\.+\s*", "")
    words = F.filter(F.split(bare, r"\s+"), lambda t: (t != "") & ~t.startswith("$") & ~t.startswith("{"))
    return F.transform(words, lambda t: F.regexp_replace(t, "[+#]+$", ""))


def rating(text: Column) -> Column:
    """A rating; 0 for nothing, ?, - and what isn't a number."""
    return F.coalesce(text.try_cast("int"), F.lit(0))


def bounded(text: Column, low: int, high: int) -> Column:
    """A whole number within bounds; 0 for text that isn't one."""
    return F.least(F.greatest(F.coalesce(text.try_cast("long"), F.lit(0)), F.lit(low)), F.lit(high)).cast("int")


def key_of(text: Column) -> Column:
    """A position key in upper-case hex from hex or any base 64 variant; null if it isn't KEY_BYTES long."""
    plain = F.regexp_replace(F.translate(text, "-_", "+/"), "=+$", "")
    padded = F.rpad(plain, 36, "=")
    sixty = F.when(plain.rlike("^[A-Za-z0-9+/]{35}$"), F.hex(F.unbase64(padded)))
    return F.when(text.rlike("^[0-9A-Fa-f]{52}$"), F.upper(text)).otherwise(sixty)


def white_to_move(fen: Column) -> Column:
    """The side to move in a FEN; anything but b counts as White."""
    return F.coalesce(F.get(F.split(fen, " "), F.lit(1)) != "b", F.lit(True))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def size_of(text: str) -> int:
    """Bytes of a size such as 512m or 4g."""
    text = text.strip().lower()
    unit = text[-1:] if text[-1:] in SIZES and text[-1:] else ""
    number = text[: len(text) - len(unit)]
    if not number.isdigit():
        raise ValueError(f"not a size: {text!r}")
    return int(number) * SIZES[unit]


def state_of(url: Column) -> Column:
    """The moves in a URL's hash, and the numbers moves and depth in its query."""
    hash_ = F.when(F.contains(url, F.lit("#")), F.substring_index(url, "#", -1)).otherwise(F.lit(""))
    query = F.substring_index(url, "#", 1)
    number = lambda name: F.regexp_extract(query, rf"[?&]{name}=([0-9]+)", 1).try_cast("int")
    return F.struct(path_parts(hash_).alias("path"), number("moves").alias("moves"), number("depth").alias("depth"))


def url_of(path: Column, moves: Column, depth: Column) -> Column:
    """A URL with display options in the query and moves in the hash; what is null or empty is left out."""
    query = F.concat_ws("&", F.concat(F.lit("moves="), moves.cast("string")), F.concat(F.lit("depth="), depth.cast("string")))
    return F.concat(F.lit("/"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")), F.when(F.size(path) > 0, F.concat(F.lit("#"), F.array_join(path, "/"))).otherwise(F.lit("")))
