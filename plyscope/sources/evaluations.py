"""Evaluation files: import, log and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import records as R
from ..functions.text import bounded, key_of
from ..operators.counts import latest_evaluations

NEW = ("fen", "position", "cp", "dtm", "dtz", "proven_depth")
SMALL, WORD = (-32_768, 32_767), (0, 65_535)


def read(spark: SparkSession, path: str, log: bool = False) -> DataFrame:
    """(pos_key, cp, has_cp, dtm, dtz, proven_depth, seq, file) of evaluation CSVs, plain or compressed.

    Files have NEW's columns or those without ``fen``, with a header.  Keys
    are hex or base 64; a row whose key isn't one has a null pos_key, for
    rejected() to count.  Numbers are clamped, text that isn't one is 0.  A
    row of a ``log`` has centipawns if cp or dtm isn't 0, an imported one
    always.  Later rows of a file have a higher ``seq``.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"))
    lines = lines.where(~F.rlike("value", F.lit("^(fen,)?position,")))
    parts = F.from_csv("value", "a string, b string, c string, d string, e string, f string", {"mode": "PERMISSIVE"})
    p = lines.withColumn("p", parts)
    new = F.col("p.f").isNotNull()
    field = lambda i: F.when(new, F.col(f"p.{'abcdef'[i + 1]}")).otherwise(F.col(f"p.{'abcdef'[i]}"))
    cp, dtm = bounded(field(1), *SMALL), bounded(field(2), *SMALL)
    has = (cp != 0) | (dtm != 0) if log else F.lit(True)
    return p.select(key_of(field(0)).alias("pos_key"), cp.alias("cp"), has.alias("has_cp"), dtm.alias("dtm"), bounded(field(3), *WORD).alias("dtz"), R.proven_depth(bounded(field(4), *WORD)).alias("proven_depth"), "seq", "file")


def rejected(rows: DataFrame) -> DataFrame:
    """Rows per file that have no valid key."""
    return rows.groupBy("file").agg(F.count_if(F.col("pos_key").isNull()).alias("rejected"), F.count(F.lit(1)).alias("rows"))


def changed(incoming: DataFrame, stored: DataFrame, create_missing: bool = False) -> DataFrame:
    """Imported rows to write: those whose cp, dtm or dtz differ from what is stored.

    Positions that aren't stored are skipped, or taken with ``create_missing``.
    """
    old = stored.select("pos_key", *(F.col(c).alias(f"old_{c}") for c in ("cp", "dtm", "dtz")), F.lit(True).alias("is_stored"))
    both = incoming.where("pos_key is not null").join(old, "pos_key", "left")
    same: Column = F.lit(True)
    for c in ("cp", "dtm", "dtz"):
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    known = F.coalesce("is_stored", F.lit(False))
    rows = both.where(~(known & same)) if create_missing else both.where(known & ~same)
    return rows.select(*incoming.columns)


def exported(positions: DataFrame) -> DataFrame:
    """Positions that say something about their value: centipawns, a distance to mate or to a reset."""
    return positions.where(F.coalesce("has_cp", F.lit(False)) | (F.coalesce("dtm", F.lit(0)) != 0) | (F.coalesce("dtz", F.lit(0)) != 0))


def export(positions: DataFrame, path: str, fen: Column | None = None) -> None:
    """Write what exported() keeps as gzip-compressed CSV with NEW's columns."""
    rows = exported(positions).select((fen if fen is not None else F.lit("")).alias("fen"), F.col("pos_key").alias("position"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("cp", "dtm", "dtz")), R.proven_depth(F.coalesce("proven_depth", F.lit(0))).alias("proven_depth"))
    rows.write.option("header", True).option("compression", "gzip").option("emptyValue", "").csv(path)


LOG = "pos_key string, cp int, has_cp boolean, dtm int, dtz int, proven_depth int, seq long"


def append(rows: DataFrame, log: str) -> None:
    """Add evaluations to a log; Spark commits a whole append or none of it."""
    rows.select(*(F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(LOG))).write.mode("append").parquet(log)


def current(spark: SparkSession, log: str) -> DataFrame:
    """A log's evaluation of each position: the one with the highest ``seq``."""
    return latest_evaluations(spark.read.schema(LOG).parquet(log))
