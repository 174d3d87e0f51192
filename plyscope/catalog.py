"""Queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import chess, counting, exploring, formats, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**counting.QUERIES, **exploring.QUERIES, **chess.QUERIES, **formats.QUERIES, **streams.QUERIES}
SQL: dict[str, str] = {**counting.SQL, **exploring.SQL, **chess.SQL, **formats.SQL, **streams.SQL}
