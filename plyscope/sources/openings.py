"""Named openings: files of codes, names and lines, and their lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import movetext_tokens


def read(spark: SparkSession, path: str, pattern: str = "*.tsv") -> DataFrame:
    """(eco, name, moves, file, line) of all .tsv files under ``path``.

    A line is code, name and moves, set apart by tabs; a first line that
    begins with ``eco`` and a tab is a header; other lines without three
    parts are skipped.  ``line`` orders the lines of a file.
    """
    rows = spark.read.option("pathGlobFilter", pattern).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    parts = F.split("value", "\t", 3)
    rows = rows.where((F.size(parts) == 3) & ~F.startswith("value", F.lit("eco\t")))
    return rows.select(parts[0].alias("eco"), parts[1].alias("name"), movetext_tokens(parts[2]).alias("moves"), "file", "line")


def by_position(lines: DataFrame, key: Column) -> DataFrame:
    """(pos_key, eco, name): of lines that reach one position the last counts; those without a key are skipped."""
    rows = lines.withColumn("pos_key", key).where("pos_key is not null")
    return rows.groupBy("pos_key").agg(F.max_by(F.struct("eco", "name"), F.struct("file", "line")).alias("o")).select("pos_key", "o.*")


def named(positions: DataFrame, openings: DataFrame) -> DataFrame:
    """``positions`` with eco and name where they have one."""
    return positions.join(openings, "pos_key", "left")


def carried(plies: DataFrame, openings: DataFrame) -> DataFrame:
    """(game_id, ply, pos_key, eco, name): the last code and the last name on the way to each ply."""
    w = Window.partitionBy("game_id").orderBy("ply").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = named(plies.select("game_id", "ply", "pos_key"), openings)
    return rows.select("game_id", "ply", "pos_key", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in ("eco", "name")))
