"""Columns of position records: saturating counters, flags and distance to mate.

Distance to mate is stored as one number (fixed values):

    1 .. 16384         the side to move wins in that many plies
    -16384 .. -1       it loses
    -32768 .. -16385   a draw, by the distance above -32768
    32767, 32766       it is mated now (White, Black to move)
    0 and the rest     unknown
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CAP = 65_535
MOST_MATE = 16_384
DRAW_BASE, MOST_DRAW = -32_768, 16_383
MATED_WHITE, MATED_BLACK = 32_767, 32_766
HAS_CP, DEPTH = 0x8000, 0x7FFF


def dtm_kind(dtm: Column) -> Column:
    """win, loss, draw or unknown."""
    return (
        F.when(dtm.between(1, MOST_MATE), F.lit("win"))
        .when(dtm.between(-MOST_MATE, -1) | dtm.isin(MATED_WHITE, MATED_BLACK), F.lit("loss"))
        .when(dtm.between(DRAW_BASE, DRAW_BASE + MOST_DRAW), F.lit("draw"))
        .otherwise(F.lit("unknown"))
    )


def dtm_distance(dtm: Column) -> Column:
    """Plies to mate or draw; 0 where unknown or mated now."""
    return F.when(dtm.between(1, MOST_MATE), dtm).when(dtm.between(-MOST_MATE, -1), -dtm).when(dtm.between(DRAW_BASE, DRAW_BASE + MOST_DRAW), dtm - DRAW_BASE).otherwise(F.lit(0)).cast("int")


def dtm_shown(dtm: Column) -> Column:
    """Distance for display: positive for a win, negative for a loss, else 0."""
    kind = dtm_kind(dtm)
    return F.when(kind == "win", dtm_distance(dtm)).when(kind == "loss", -dtm_distance(dtm)).otherwise(F.lit(0)).cast("int")


def encode_draw(distance: Column) -> Column:
    return (F.least(F.greatest(distance, F.lit(0)), F.lit(MOST_DRAW)) + DRAW_BASE).cast("int")


def encode_mate(distance: Column) -> Column:
    return F.least(F.greatest(distance, F.lit(-MOST_MATE)), F.lit(MOST_MATE)).cast("int")


def encode_mated(white_to_move: Column) -> Column:
    return F.when(white_to_move, F.lit(MATED_WHITE)).otherwise(F.lit(MATED_BLACK)).cast("int")


def is_proven(dtm: Column) -> Column:
    return dtm != 0


def is_win(dtm: Column) -> Column:
    return dtm_kind(dtm) == "win"


def is_loss(dtm: Column) -> Column:
    return dtm_kind(dtm) == "loss"


def is_draw(dtm: Column) -> Column:
    return dtm_kind(dtm) == "draw"


def is_mated(dtm: Column) -> Column:
    """Mated now, either side."""
    return dtm.isin(MATED_WHITE, MATED_BLACK)


def has_eval(has_cp: Column, dtm: Column) -> Column:
    """An evaluation is there if centipawns or a distance are; false for a missing record."""
    return F.coalesce(has_cp, F.lit(False)) | (F.coalesce(dtm, F.lit(0)) != 0)


def has_cp(depth: Column) -> Column:
    """The flag in the top bit of a stored depth."""
    return depth.bitwiseAND(F.lit(HAS_CP)) != 0


def set_has_cp(depth: Column, flag: Column) -> Column:
    return F.when(flag, depth.bitwiseOR(F.lit(HAS_CP))).otherwise(depth.bitwiseAND(F.lit(DEPTH)))


def proven_depth(depth: Column) -> Column:
    return depth.bitwiseAND(F.lit(DEPTH))


def set_proven_depth(depth: Column, value: Column) -> Column:
    return depth.bitwiseAND(F.lit(HAS_CP)).bitwiseOR(value.bitwiseAND(F.lit(DEPTH)))


def add_capped(a: Column, b: Column) -> Column:
    """a + b within 0 .. CAP, for any sign of b."""
    return F.greatest(F.least(a.cast("long") + b, F.lit(CAP)), F.lit(0)).cast("long")


def capped(count: Column) -> Column:
    return F.least(count, F.lit(CAP)).cast("long")


def saturated(*counts: Column) -> Column:
    return F.greatest(*counts) >= CAP


def share(part: Column, total: Column) -> Column:
    """Percentage of a total; 0 when there is none."""
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def to_white(score: Column, white_to_move: Column) -> Column:
    """A score from the mover's view as White sees it, and back."""
    return F.when(white_to_move, score).otherwise(-score)
