"""Approximate nearest neighbours: inverted lists and product-quantised residuals.

A bounded sample gives the coarse centroids, the codebooks of the residuals
and the number of lists to probe.  Every row is then assigned to its list
and encoded.  A query compares its own vector with the codes in its lists by
table look-ups (asymmetric distances); the best go on to exact reranking on
the original vectors.

Index rows and queries meet in bounded blocks: a long list is cut into
pieces, pieces are dealt to shards, and queries to blocks of those with
neighbouring first lists.  A piece goes only to the blocks that probe its list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, written
from .vectors import ceil_div, usable

#: Rows that the index is fitted on, the first by a hash of their ids.
SAMPLE = 20_000
#: Rows of the sample for each list, at least: more lists would have centres that mean nothing.
ROWS_PER_LIST = 8
#: Components in a subspace of the residuals; centroids there.
SUBSPACE, CODES = 2, 256
#: Share of the sample's own neighbours that the probed lists must hold.
PROBE_RECALL = 0.97
#: Candidates of a query that are reranked exactly, and the least its lists must hold.
RERANK = 128
#: Rows of a piece of a list, of a shard, and queries of a block, about.
PIECE, SHARD, BLOCK = 2048, 16_384, 256
SEED = 11


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norm = (centres**2).sum(1)
    return np.concatenate([np.argmin(norm - 2 * p @ centres.T, axis=1) for p in np.array_split(x, max(1, len(x) // 4096))])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    """k centres (fewer, if there are fewer different rows) by Lloyd's steps."""
    different = np.unique(x, axis=0)
    centres = different[rng.permutation(len(different))[:k]].copy()
    for _ in range(steps):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


@dataclass(frozen=True)
class Index:
    """Centroids, one codebook per subspace, and the number of lists to probe."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int

    @property
    def spaces(self) -> list[slice]:
        at = np.cumsum([0, *(b.shape[1] for b in self.books)])
        return [slice(s, e) for s, e in zip(at[:-1], at[1:], strict=True)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, and the part of the squared distance that doesn't depend on a query."""
        own = _nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = np.stack([_nearest(rest[:, s], b) for s, b in zip(self.spaces, self.books, strict=True)], 1).astype(np.uint8)
        back = np.hstack([b[codes[:, j]] for j, b in enumerate(self.books)])
        return own, codes, (back**2).sum(1) + 2 * (back * self.centres[own]).sum(1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Queries' inner products with all codewords: query, subspace, code."""
        out = np.zeros((len(q), len(self.books), CODES), np.float32)
        for j, (s, b) in enumerate(zip(self.spaces, self.books, strict=True)):
            out[:, j, : len(b)] = q[:, s] @ b.T
        return out


def fit(x: np.ndarray, rows: int, k: int) -> Index:
    """Fit on a sample; ``rows`` is how many the index is to hold."""
    rng = np.random.default_rng(SEED)
    centres = kmeans(x, max(1, min(len(x) // ROWS_PER_LIST, round(rows**0.5))), rng)
    own = _nearest(x, centres)
    rest = x - centres[own]
    books = [kmeans(rest[:, s : s + SUBSPACE], CODES, rng, 5) for s in range(0, x.shape[1], SUBSPACE)]
    # how far down a query's ranking of lists its neighbours in the sample lie
    ask = rng.permutation(len(x))[:256]
    far = (x**2).sum(1) - 2 * x[ask] @ x.T
    far[np.arange(len(ask)), ask] = np.inf
    near = np.argsort(far, axis=1)[:, : min(k, len(x) - 1)]
    lists = np.argsort(np.argsort((centres**2).sum(1) - 2 * x[ask] @ centres.T, axis=1), axis=1)
    depth = np.take_along_axis(lists, own[near], 1).ravel()
    probes = int(np.quantile(depth, PROBE_RECALL)) + 1 if len(depth) else len(centres)
    return Index(centres, books, probes)


def search(vectors: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows found for each query, by Euclidean distance.

    ``queries`` says which rows are queries; candidates are all rows but the
    query's own.  Returns query_id, rank (from 1), vec_id, score (the exact
    distance); ties go to the smaller id; fewer rows where there are fewer
    candidates.  Vectors that are null, empty or zero or hold null or
    non-finite components, null keys, and vectors of another length than
    most of the sample take no part.  A repeated key counts once, with its
    smallest vector.
    """
    spark = vectors.sparkSession
    ship(spark)
    once = usable(vectors, key, vector, False).groupBy("id").agg(F.min("v").alias("v"))
    rows = written(once, "ann-rows")
    asked = usable(vectors.where(queries), key, vector, False).select("id").distinct().join(rows, "id")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sample.empty:
        return empty
    lengths = sample["v"].map(len)
    size = int(lengths.mode().iloc[0])
    rows, asked = rows.where(F.size("v") == size), asked.where(F.size("v") == size)
    n = rows.count()
    index = fit(np.stack(sample["v"][lengths == size].to_numpy()), n, k)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                own, codes, fixed = index.encode(np.stack(pdf["v"].to_numpy()))
                yield pd.DataFrame({"id": pdf["id"], "list": own.astype(np.int32), "codes": [c.tobytes() for c in codes], "fixed": fixed})

    coded = written(rows.mapInPandas(encoded, "id long, list int, codes binary, fixed double"), "ann-index")
    counts = {r["list"]: r["n"] for r in coded.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per list
    held = np.array([counts.get(i, 0) for i in range(len(index.centres))])
    pieces = F.element_at(F.lit([ceil_div(int(c), PIECE) for c in held]), F.col("list") + 1)
    shards = ceil_div(n, SHARD)
    shard = F.pmod(F.xxhash64("list", "piece"), F.lit(shards)).cast("int")

    def probing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query's lists: the probed ones, and more until they hold RERANK rows."""
        for pdf in batches:
            if len(pdf):
                q = np.stack(pdf["v"].to_numpy())
                order = np.argsort((index.centres**2).sum(1) - 2 * q @ index.centres.T, axis=1, kind="stable")
                enough = (np.cumsum(held[order], axis=1) < RERANK + 1).sum(1) + 1
                pdf["lists"] = [o[: max(index.probes, e)].astype(np.int32) for o, e in zip(order, enough, strict=True)]
                pdf["first"] = order[:, 0].astype(np.int32)
                yield pdf[["id", "v", "lists", "first"]]

    probed = written(asked.mapInPandas(probing, "id long, v array<double>, lists array<int>, first int"), "ann-probes")
    # blocks of queries: lists in the order of their centres' main direction, short ones together, long ones split
    firsts = {r["first"]: r["n"] for r in probed.groupBy("first").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per list
    main = index.centres - index.centres.mean(0)
    along = np.argsort(main @ np.linalg.svd(main, full_matrices=False)[2][0], kind="stable")
    number = np.array([firsts.get(i, 0) for i in range(len(held))])
    begins = np.empty(len(held), np.int64)
    begins[along] = (np.cumsum(number[along]) - number[along]) // BLOCK
    first_block, splits = (F.element_at(F.lit([int(x) for x in y]), F.col("first") + 1) for y in (begins, [ceil_div(int(c), BLOCK) for c in number]))
    probed = probed.withColumn("block", (first_block + F.pmod(F.xxhash64("id"), splits)).cast("int")).drop("first")
    # every piece of a list, its shard, and the blocks that probe the list
    of_list = spark.range(len(held)).select(F.col("id").cast("int").alias("list")).withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    of_list = of_list.select("list", "piece", shard.alias("shard"))
    wanted = probed.select(F.col("block").alias("to"), F.explode("lists").alias("list")).distinct().join(of_list, "list").select("list", "piece", "to")
    sent = probed.select("id", F.explode("lists").alias("list")).join(of_list, "list").select("id", "shard").distinct()
    left = coded.withColumn("piece", F.pmod(F.xxhash64("id"), pieces).cast("int")).withColumn("shard", shard).join(wanted, ["list", "piece"])
    left = left.select("id", "list", "codes", "fixed", "shard", F.col("to").alias("block"))

    def scan(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            ids, own, fixed = rows["id"].to_numpy(), rows["list"].to_numpy(), rows["fixed"].to_numpy()
            codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
            q = np.stack(asked["v"].to_numpy())
            tables = index.tables(q)
            for i, (qid, lists) in enumerate(zip(asked["id"], asked["lists"], strict=True)):
                at = np.flatnonzero(np.isin(own, lists) & (ids != qid))
                if len(at):
                    inner = np.zeros(len(at), np.float32)
                    for j in range(codes.shape[1]):
                        inner += tables[i, j, codes[at, j]]
                    to_centre = ((q[i] - index.centres) ** 2).sum(1)
                    d = to_centre[own[at]] + fixed[at] - 2 * inner
                    d = np.round(d, 6)
                    if len(at) > RERANK:
                        cut = np.partition(d, RERANK - 1)[RERANK - 1]
                        keep = d <= cut
                        at, d = at[keep], d[keep]
                    best = np.lexsort((ids[at], d))[:RERANK]
                    out.append(pd.DataFrame({"qid": qid, "id": ids[at[best]], "about": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "about": pd.Series(dtype="float64")})

    right = probed.join(sent, "id")
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(scan, "qid long, id long, about double")
    by = Window.partitionBy("qid")
    short = found.withColumn("r", F.row_number().over(by.orderBy("about", "id"))).where(F.col("r") <= RERANK).select("qid", "id")
    both = short.join(rows, "id").join(asked.select(F.col("id").alias("qid"), F.col("v").alias("qv")), "qid")
    exact = F.sqrt(F.aggregate(F.zip_with("qv", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    ranked = both.select("qid", "id", exact.alias("score")).withColumn("rank", F.row_number().over(by.orderBy("score", "id")))
    return ranked.where(F.col("rank") <= k).select(F.col("qid").alias("query_id"), F.col("rank").cast("int"), F.col("id").alias("vec_id"), "score")
