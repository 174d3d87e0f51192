"""Columns for display: short numbers, evaluations and bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .records import saturated


def _short(n: Column, units: tuple[tuple[int, str], ...], plain: Column) -> Column:
    out = plain
    for least, unit in reversed(units):
        out = F.when(n >= least, F.format_string("%.1f" + unit, n / least)).otherwise(out)
    return out


def number(n: Column) -> Column:
    """1234 as 1.2K; also M and B.  Null is 0; a half rounds up."""
    n = F.coalesce(n, F.lit(0))
    return _short(n, ((10**9, "B"), (10**6, "M"), (10**3, "K")), n.cast("string"))


def thousands(n: Column) -> Column:
    """1234 as 1.2K, without other units.

    What is rounded is the binary fraction, and a half goes to the even digit, as printf does.
    """
    return F.when(n >= 1000, F.concat(F.call_function("format_number", n / 1000, F.lit("0.0")), F.lit("K"))).otherwise(n.cast("string"))


def size(n: Column) -> Column:
    """Bytes with B, KB, MB or GB.  Null is 0 B."""
    n = F.coalesce(n, F.lit(0))
    return _short(n, ((10**9, " GB"), (10**6, " MB"), (10**3, " KB")), F.concat(n.cast("string"), F.lit(" B")))


def exact(n: Column) -> Column:
    """With thousands separators.  Null is 0."""
    return F.format_number(F.coalesce(n, F.lit(0)), 0)


def signed(n: Column) -> Column:
    return F.concat(F.when(n > 0, F.lit("+")).otherwise(F.lit("")), n.cast("string"))


def evaluation(cp: Column, dtm: Column, digits: int = 2) -> Column:
    """M+5 for a mate, +0.35 for centipawns, else null."""
    pawns = F.when(cp.isNotNull(), F.concat(F.when(cp > 0, F.lit("+")).otherwise(F.lit("")), F.format_string(f"%.{digits}f", cp / 100)))
    return F.when(F.coalesce(dtm, F.lit(0)) != 0, F.concat(F.lit("M"), signed(dtm))).otherwise(pawns)


def evaluation_class(cp: Column, dtm: Column, white_moved: Column) -> Column:
    """win, loss or draw for the side that moved; a mate counts before centipawns."""
    score = F.when(F.coalesce(dtm, F.lit(0)) != 0, dtm).otherwise(F.coalesce(cp, F.lit(0)))
    mine = F.when(white_moved, score).otherwise(-score)
    return F.when(mine > 0, F.lit("win")).when(mine < 0, F.lit("loss")).otherwise(F.lit("draw"))


def results(count: Column) -> Column:
    """Loading... for -1, No games for 0, else the count."""
    return F.when(count == -1, F.lit("Loading...")).when(count == 0, F.lit("No games")).otherwise(exact(count))


def move_count(count: Column, wins: Column, draws: Column, losses: Column) -> Column:
    """Three points while loading, many at the counters' cap, else a short number."""
    return F.when(count == -1, F.lit("...")).when(saturated(wins, draws, losses), F.lit("many")).otherwise(number(count))
