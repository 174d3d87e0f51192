"""Incremental ingestion of games: a stream of files into a store of counts.

A store is a folder of Parquet tables:

    delta/batch=N      counts of one micro-batch
    base/batches=M-N   counts of the batches from M to N, merged

A batch writes its own folder and overwrites it when it is tried again, so
counts are added once.  Compaction merges the deltas, and the last bases that
hold no more batches than what they are merged with, into a new base.  Bases
so double in size: a store of N batches has about log2(N) of them, and each
count is written again about log2(N) times, not once in every compaction.  A
base counts once its _SUCCESS marker is there, so readers see either the old
ones or the new one, and nothing that is being read is ever overwritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.counts import count_positions, merge_counts

COUNTS = "pos_key string, wins long, draws long, losses long"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _finished(spark: SparkSession, path: str, name: str) -> list[str]:
    """What follows ``name=`` in the finished folders under ``path``."""
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p)]
    done = [x for x in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return [x.getName().removeprefix(f"{name}=") for x in done if x.getName().startswith(f"{name}=")]


def _bases(spark: SparkSession, store: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """First and last batch of the bases in use, in order, and of those that another one replaces."""
    found = sorted(tuple(map(int, x.split("-"))) for x in _finished(spark, f"{store}/base", "batches"))
    held = [x for x in found if any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in found)]
    return [x for x in found if x not in held], held


def _deltas(spark: SparkSession, store: str) -> list[int]:
    return sorted(map(int, _finished(spark, f"{store}/delta", "batch")))


def _base(store: str, batches: tuple[int, int]) -> str:
    return f"{store}/base/batches={batches[0]}-{batches[1]}"


def layers(spark: SparkSession, store: str) -> tuple[int, list[str]]:
    """The last batch in a base (-1 without one), and the folders that make up the store now."""
    bases, _ = _bases(spark, store)
    upto = bases[-1][1] if bases else -1
    return upto, [_base(store, x) for x in bases] + [f"{store}/delta/batch={n}" for n in _deltas(spark, store) if n > upto]


def read_counts(spark: SparkSession, store: str) -> DataFrame:
    """Counts of everything that has been committed, merged; empty for a new store."""
    _, paths = layers(spark, store)
    parts = [spark.read.schema(COUNTS).parquet(p) for p in paths]
    return merge_counts(*parts) if parts else spark.createDataFrame([], COUNTS)


def compact(spark: SparkSession, store: str, least: int = 1) -> int:
    """Merge at least ``least`` deltas, and last bases of their size, into a base sorted by key; returns its last batch."""
    bases, _ = _bases(spark, store)
    upto = bases[-1][1] if bases else -1
    deltas = [n for n in _deltas(spark, store) if n > upto]
    if len(deltas) < max(least, 1):
        return upto
    paths = [f"{store}/delta/batch={n}" for n in deltas]
    first, last = deltas[0], deltas[-1]
    while bases and bases[-1][1] - bases[-1][0] <= last - first:
        paths.append(_base(store, bases[-1]))
        first = bases.pop()[0]
    merged = merge_counts(*(spark.read.schema(COUNTS).parquet(p) for p in paths))
    merged.repartitionByRange("pos_key").sortWithinPartitions("pos_key").write.mode("overwrite").parquet(_base(store, (first, last)))
    return last


def vacuum(spark: SparkSession, store: str) -> int:
    """Remove bases and deltas that a base replaces; returns how many. Not while older readers run."""
    bases, held = _bases(spark, store)
    gone = [_base(store, x) for x in held] + [f"{store}/delta/batch={n}" for n in _deltas(spark, store) if bases and n <= bases[-1][1]]
    for path in gone:
        fs, p = _files(spark, path)
        fs.delete(p, True)
    return len(gone)


def ingest(games: DataFrame, store: str, checkpoint: str, plies: Callable[[DataFrame], DataFrame], compact_every: int = 20, trigger: dict | None = None) -> StreamingQuery:
    """Start adding a stream of games to ``store``.

    ``plies`` turns a batch of whole games into rows (pos_key, wins, draws,
    losses).  By default the source is polled every ten seconds;
    ``trigger={"availableNow": True}`` takes what is there and ends.
    """

    def add(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        count_positions(plies(batch)).write.mode("overwrite").parquet(f"{store}/delta/batch={n}")
        compact(spark, store, compact_every)

    writer = games.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def watched(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files: int = 20, archive: str | None = None) -> DataFrame:
    """A stream of the files that appear in ``folder``, ``files`` at a time; done ones move to ``archive``, if given."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.parquet(folder)


def queued(items: DataFrame, most: int) -> DataFrame:
    """A bounded queue's content after ``items`` (key, seq) came in: each key once, at its first place, the newest ``most``.

    The bound is the queue's; older items are evicted.
    """
    first = items.groupBy("key").agg(F.min("seq").alias("seq"))
    return first.orderBy(F.col("seq").desc(), "key").limit(most)
