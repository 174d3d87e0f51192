"""What the operators share: tables in the cluster's shared folder, widths, and Python workers."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import workers
from ..storage import fresh_path, written

__all__ = ["ROWS_AT_ONCE", "fresh_path", "looked_up", "ship", "width", "word_hashes", "written"]

#: Keys that more than this many rows name, and more than one in HOT_SHARE of all, are looked up in a broadcast table: of HOT_SHARE rows at most.
HOT, HOT_SHARE = 1000, 10_000


#: Hashes of words that a Python worker keeps.
WORDS = 100_000


class WordHashes(dict):
    """64-bit hashes of words, computed when first asked for; one table for all operators of a worker."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > WORDS:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def width(spark: SparkSession) -> int:
    """Shuffle partitions of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that a Python worker gets at once: texts are long, and Spark's 10,000 of them are too much for its memory.
ROWS_AT_ONCE = 1000
#: Settings that make a Python worker give memory back that it has freed, unless the session has its own.
GIVE_BACK = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1048576"}


def ship(spark: SparkSession) -> None:
    """Prepare Python workers: small batches, unless the session sets its own, and this package."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, ROWS_AT_ONCE)
    env = spark.sparkContext.environment
    for name, value in GIVE_BACK.items():
        env.setdefault(name, value)
    workers.ship(spark)


def looked_up(rows: DataFrame, by: str, table: DataFrame, total: int) -> DataFrame:
    """``rows`` joined with ``table`` (by, n, ...), which says how many rows name an entry; what many name is broadcast."""
    hot = F.col("n") > max(HOT, total // HOT_SHARE)
    many = table.where(hot).drop("n")
    common = rows.join(F.broadcast(many), by)
    rest = rows.join(F.broadcast(many.select(by)), by, "left_anti").join(table.where(~hot).drop("n"), by)
    return common.unionByName(rest)
