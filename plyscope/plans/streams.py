"""Queries that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import plies
from ..storage import fresh_path
from ..streaming import ingest as I
from .base import COUNTS, event_plies, table

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def str_02_ingested(spark: SparkSession, d: str) -> DataFrame:
    """Counts after whole games came in as files, some at a time, with a compaction on the way."""
    source, store = fresh_path(spark, "watched"), fresh_path(spark, "store")
    events = table(spark, d, "events").select(F.col("event_id").cast("long"), F.col("ts").cast("timestamp_ntz"), F.col("user_id").cast("long"), "event_type")
    events.repartition(5, "user_id").write.parquet(source)
    query = I.ingest(I.watched(spark, source, EVENTS, files=2), store, fresh_path(spark, "progress"), plies, compact_every=2, trigger={"availableNow": True})
    query.awaitTermination()
    I.compact(spark, store)
    return I.read_counts(spark, store)


def str_09_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Counts after a stream was stopped and started again: it goes on where it was, with the files that came in meanwhile."""
    source, store, progress = (fresh_path(spark, n) for n in ("watched", "store", "progress"))
    events = table(spark, d, "events").select(F.col("event_id").cast("long"), F.col("ts").cast("timestamp_ntz"), F.col("user_id").cast("long"), "event_type")
    for part in (0, 1):
        events.where(F.pmod("user_id", F.lit(2)) == part).repartition(3, "user_id").write.mode("append").parquet(source)
        query = I.ingest(I.watched(spark, source, EVENTS, files=2), store, progress, plies, compact_every=3, trigger={"availableNow": True})
        query.awaitTermination()
        query.stop()
    return I.read_counts(spark, store)


def str_04_queue(spark: SparkSession, d: str) -> DataFrame:
    """The positions of the last visits, each once, as a queue of 100 keeps them."""
    return I.queued(event_plies(spark, d).select(F.col("pos_key").alias("key"), (F.col("game_id") * 1000 + F.col("ply")).alias("seq")), 100)


QUERIES = {f.__name__: f for f in (str_02_ingested, str_04_queue, str_09_resumed)}

SQL = {
    "str_02_ingested": COUNTS + " SELECT * FROM counts",
    "str_09_resumed": COUNTS + " SELECT * FROM counts",
    "str_04_queue": COUNTS + " SELECT pos_key AS key, min(game_id * 1000 + ply) AS seq FROM plies GROUP BY 1 ORDER BY seq DESC, key LIMIT 100",
}
