"""Exact top-k by inner product with a three-phase uniform threshold.

A vector's components are dealt to a few lists of neighbouring components; a
candidate's score for a query is the sum of its local scores, one per list.
A task holds one list of a block of candidates and sees nothing of the others.

1. Gather: every list reports, for each query, its candidates with the
   highest local scores.  Their scores are resolved exactly; the k-th best is
   a score that k candidates reach: the query's bound.
2. Cut off: a candidate below ``bound / lists`` in every list can't reach the
   bound.  That cutoff is sent to all lists, and each answers with the
   entries at or above it.  The entries of a candidate are added up, and for
   a list that didn't report it the cutoff is counted.  Those that can't
   reach the k-th best of the scores that are whole by now go.
3. Resolve: the exact scores of those that are left and lack an entry.

Equal vectors have equal scores, so they are searched once: a class of equal
vectors, for which only its k + 1 smallest ids can matter, as ties go to
smaller ids.  So neither a common vector nor a common query makes a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, written
from .vectors import block_of, ceil_div, usable

#: Vectors in a block of candidates and in a block of queries, about.
CANDIDATES, QUERIES = 4096, 512
#: Candidates that each list reports for a query in the first phase, k + 1 at least: the more, the closer the bound.
GATHER = 32


def _segments(n: int, lists: int) -> list[slice]:
    ends = np.linspace(0, n, min(lists, n) + 1).astype(int)
    return [slice(s, e) for s, e in zip(ends[:-1], ends[1:], strict=True)]


def _packed(rows: DataFrame, block: str, lists: int) -> DataFrame:
    """One row for each block, vector length and list: ids, that list's components, and the bounds, if there are any."""
    bounded = "bound" in rows.columns

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["v"].to_numpy()).astype("<i8")
        ids, bound = pdf["id"].to_numpy("<i8").tobytes(), pdf["bound"].to_numpy("<i8").tobytes() if bounded else b""
        parts = [np.ascontiguousarray(m[:, s]).tobytes() for s in _segments(m.shape[1], lists)]
        return pd.DataFrame({block: pdf[block].iloc[0], "n": m.shape[1], "l": np.arange(len(parts), dtype=np.int32), "ids": ids, "m": parts, "bounds": bound})

    return rows.withColumn("n", F.size("v")).groupBy(block, "n").applyInPandas(pack, f"{block} int, n int, l int, ids binary, m binary, bounds binary")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows; through doubles where those are exact."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def _local(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries' ids, candidates' ids and their local scores in the list that a task holds."""
    q, c = np.frombuffer(r.qids, "<i8"), np.frombuffer(r.ids, "<i8")
    return q, c, products(np.frombuffer(r.qm, "<i8").reshape(len(q), -1), np.frombuffer(r.m, "<i8").reshape(len(c), -1))


def _gather(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Phase 1: a list's candidates with the highest local scores, for each query."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            q, c, x = _local(r)
            k = min(most, len(c))
            at = np.argpartition(x, len(c) - k, axis=1)[:, len(c) - k :]
            yield pd.DataFrame({"qid": np.repeat(q, k), "l": np.int32(r.l), "id": c[at].ravel(), "local": np.take_along_axis(x, at, 1).ravel()})


def _collect(batches: Iterator[pd.DataFrame], lists: int) -> Iterator[pd.DataFrame]:
    """Phase 2: a list's entries at or above the cutoff."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            q, c, x = _local(r)
            cut = -(-np.frombuffer(r.bounds, "<i8") // min(lists, r.n))
            i, j = np.nonzero(x >= cut[:, None])
            yield pd.DataFrame({"qid": q[i], "id": c[j], "local": x[i, j]})


def _ranked(rows: DataFrame, by: list[str], most: int, score: str = "score") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def _classes(rows: DataFrame, most: int) -> DataFrame:
    """(id, v, rep) of the ``most`` smallest ids of each vector; rep is the smallest."""
    w = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return few.withColumn("rep", F.min("id").over(Window.partitionBy("v"))).drop("r")


def _pairs(own: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every list of a block of candidates with the same list of each block of queries.

    Merged, never broadcast: queries are repeated for each block of candidates,
    which Spark's estimate of their size doesn't see.
    """
    return own.join(candidates.hint("merge"), ["c", "l", "n"]).select("n", "l", "ids", "m", "qids", "qm", "bounds")


def search(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, lists: int = 2) -> DataFrame:
    """Each query's k highest integer inner products among all other rows.

    Components x become floor(scale * x).  ``queries`` says which rows are
    queries.  Returns query_id, rank (from 1), vec_id, score; ties go to the
    smaller id; fewer rows where there are fewer candidates.  Vectors that
    are null or empty or hold null or non-finite components, and null keys,
    take no part; rows of another length aren't candidates of a query.  A
    repeated key counts once, with its smallest vector.  Scores, and the
    number of lists times a score, must fit 64 bits.  An empty table gives no
    rows; other columns aren't read.
    """
    spark = vectors.sparkSession
    ship(spark)
    ints = lambda df: df.groupBy("id").agg(F.min("v").alias("v")).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    most = k + 1  # the query's own row may be among them
    members = written(_classes(ints(usable(vectors, key, vector, True)), most), "topk-rows")
    rows = members.where("id = rep").select("id", "v")
    asked = ints(usable(vectors.where(queries), key, vector, True))
    first = written(asked.groupBy("v").agg(F.min("id").alias("qid")), "topk-queries")
    asked = written(asked.join(first, "v").select("id", "qid"), "topk-asked")
    one_each = first.select(F.col("qid").alias("id"), "v")
    cblocks, qblocks = ceil_div(rows.count(), CANDIDATES), ceil_div(first.count(), QUERIES)
    width = 2 * cblocks * lists
    candidates = _packed(rows.withColumn("c", block_of("id", cblocks)), "c", lists).drop("bounds")
    candidates = written(candidates, "topk-lists").repartition(width, "c", "l", "n")

    def met(questions: DataFrame) -> DataFrame:
        """Every list of every block of candidates with the same list of every block of queries, dealt by the former."""
        own = _packed(questions.withColumn("q", block_of("id", qblocks)), "q", lists).withColumnsRenamed({"ids": "qids", "m": "qm"})
        own = own.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cblocks - 1)))).repartition(width, "c", "l", "n")
        return _pairs(own, candidates)

    vector_of = lambda ids: ids.join(rows, "id").join(first.select("qid", F.col("v").alias("qv")), "qid")
    exact = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x).alias("score")

    gather = max(most, GATHER)
    gathered = met(one_each).mapInPandas(lambda b: _gather(b, gather), "qid long, l int, id long, local long")
    best = _ranked(gathered, ["qid", "l"], gather, "local").select("qid", "id").distinct()
    bounds = _ranked(vector_of(best).select("qid", "id", exact), ["qid"], most).groupBy("qid").agg(F.max("rank").alias("n"), F.min("score").alias("least"))
    # with fewer candidates than that in all, every entry counts
    bounds = bounds.select("qid", F.when(F.col("n") == most, F.col("least")).otherwise(F.lit(-(2**62))).alias("bound"))
    bounds = written(bounds, "topk-bounds")

    entries = met(one_each.join(bounds.withColumnRenamed("qid", "id"), "id")).mapInPandas(lambda b: _collect(b, lists), "qid long, id long, local long")
    lengths = first.select("qid", F.least(F.lit(lists), F.size("v")).alias("n")).join(bounds, "qid")
    added = entries.groupBy("qid", "id").agg(F.sum("local").alias("known"), F.count(F.lit(1)).alias("lists"))
    added = written(added.join(lengths, "qid"), "topk-entries")
    whole = added.where("lists = n").select("qid", "id", F.col("known").alias("score"))
    whole = written(_ranked(whole, ["qid"], most).select("qid", "id", "score", "rank"), "topk-whole")
    better = whole.where(F.col("rank") == most).select("qid", F.col("score").alias("at_least"))
    part = added.where("lists < n").join(better, "qid", "left")
    # what a list didn't report is below the cutoff there
    reach = F.col("known") * F.col("n") + (F.col("n") - F.col("lists")) * F.col("bound")
    part = part.where(reach >= F.greatest("bound", F.coalesce("at_least", "bound")) * F.col("n")).select("qid", "id")
    resolved = whole.select("qid", "id", "score").unionByName(vector_of(part).select("qid", "id", exact))

    found = _ranked(resolved, ["qid"], most).select("qid", F.col("id").alias("rep"), "score")
    found = _ranked(found.join(members.select("id", "rep"), "rep"), ["qid"], most).select("qid", "id", "score")
    answers = asked.withColumnRenamed("id", "query_id").join(found, "qid").where("id <> query_id")
    return _ranked(answers, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
