"""Columns of moves: packed numbers and UCI text.

A packed move has the square it leaves in bits 0-5, the one it reaches in
bits 6-11 and the promotion in bits 12-14: none, q, r, b, n (fixed values).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROMOTIONS = ("", "q", "r", "b", "n")


def pack(source: Column, target: Column, promotion: Column) -> Column:
    return source.bitwiseAND(F.lit(63)).bitwiseOR(F.shiftleft(target.bitwiseAND(F.lit(63)), 6)).bitwiseOR(F.shiftleft(promotion.bitwiseAND(F.lit(7)), 12))


def source(move: Column) -> Column:
    return move.bitwiseAND(F.lit(63))


def target(move: Column) -> Column:
    return F.shiftright(move, 6).bitwiseAND(F.lit(63))


def promotion(move: Column) -> Column:
    return F.shiftright(move, 12).bitwiseAND(F.lit(7))


def _square(s: Column) -> Column:
    return F.concat(F.substring(F.lit("abcdefgh"), s % 8 + 1, F.lit(1)), (F.floor(s / 8) + 1).cast("string"))


def to_uci(move: Column) -> Column:
    """e2e4, e7e8q; an unknown promotion code adds nothing."""
    return F.concat(_square(source(move)), _square(target(move)), F.coalesce(F.element_at(F.array(*map(F.lit, PROMOTIONS)), F.least(promotion(move), F.lit(4)) + 1), F.lit("")))


def from_uci(uci: Column) -> Column:
    """The packed move; null for text that isn't one."""
    part = lambda g: F.regexp_extract(uci, "^([a-h])([1-8])([a-h])([1-8])([qrbn]?)$", g)
    at = lambda f, r: F.ascii(part(f)) - 97 + (F.ascii(part(r)) - 49) * 8
    code = F.when(part(5) == "", F.lit(0)).otherwise(F.instr(F.lit("qrbn"), part(5)))
    return F.when(uci.rlike("^[a-h][1-8][a-h][1-8][qrbn]?$"), pack(at(1, 2), at(3, 4), code))


def promotion_rank(uci: Column) -> Column:
    """Order in which a dropped pawn tries its promotions: the plain move, then q, r, b, n."""
    return F.when(F.length(uci) < 5, F.lit(0)).otherwise(F.instr(F.lit("qrbn"), F.substring(uci, 5, 1)))
