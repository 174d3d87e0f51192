"""Pack tokenised texts into windows with a non-negative least squares plan.

A text's tokens are cut into whole windows and a rest.  Only the histogram
of the rests' lengths, bounded by the window, goes to the driver.  There all
combinations of up to three lengths that fill a window are enumerated, and
non-negative least squares finds how often to repeat each so that their sum
comes close to the histogram; the counts are rounded down.  What is left is
packed greedily, longest first, each window filled to its end, so that a
rest there may be cut once.

A rest's place follows from its length and its rank among rests of that
length by arithmetic, so texts never gather in one task.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SETTLED, WORDS, codec, default_vocabulary
from .shared import ship, written

WINDOW, DEPTH, STEPS = 1024, 3, 300
#: Characters whose class the tokenizers' libraries may see differently.
UNSETTLED = re.compile(f"[{SETTLED}-\U0010ffff]")
#: Runs of blanks that tiktoken's pattern engine isn't given: its stack overflows at about a million.
BLANKS = re.compile(r"\s{10000}")


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    """Encode a text to ids (uint32): by tiktoken with the vocabulary's ranks, else by the exact codec."""
    import tiktoken

    c = codec(path)
    ranks = {b: i for i, b in enumerate(c.bytes_of) if b.decode("utf-8", "replace") not in c.special}
    e = tiktoken.Encoding("byte-level", pat_str=WORDS.pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if UNSETTLED.search(text) or BLANKS.search(text) or any(s in text for s in c.special):
            return np.frombuffer(c.encode_batch([text])[0], "<u4")
        return np.array(e.encode_ordinary(text), "<u4")

    return encode


def combinations(window: int, depth: int) -> np.ndarray:
    """All ways to fill ``window`` with two, or up to ``depth`` = 3, lengths; unused places hold 0."""
    a = np.arange(1, window // 2 + 1)
    out = [np.stack([window - a, a, 0 * a], 1)] if window > 1 else []
    if depth > 2:
        x, y = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
        z = window - x - y
        ok = (x >= y) & (y >= z) & (z > 0)
        out.append(np.stack([x[ok], y[ok], z[ok]], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), int)


def least_squares(combos: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|, where A counts lengths in combinations.

    Accelerated projected gradient steps; A is only applied, never stored.
    """
    size = len(counts)

    def used(x: np.ndarray) -> np.ndarray:
        y = np.bincount(combos.ravel(), np.repeat(x, combos.shape[1]), size)
        y[0] = 0
        return y

    weight = used(np.ones(len(combos)))
    step = 1 / (combos.shape[1] * max(weight.max(), 1))
    target = counts.astype(float)
    target[0] = 0
    x = np.zeros(len(combos))
    ahead, t = x.copy(), 1.0
    for _ in range(STEPS):
        miss = used(ahead) - target
        miss[0] = 0
        new = np.maximum(ahead - step * miss[combos].sum(1), 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


class Plan:
    """Where the rests of each length go, by rank."""

    def __init__(self, counts: np.ndarray, window: int, depth: int) -> None:
        combos = combinations(window, depth)
        # combinations with a length that nobody has can't be repeated
        combos = combos[((counts[combos] > 0) | (combos == 0)).all(1)]
        x = least_squares(combos, counts)
        left = counts.astype(np.int64).copy()
        left[0] = 0
        self.window = window
        #: by length: first rank, repeats, first sequence, offset of each run of ranks
        self.runs: list[list[tuple[int, int, int, int]]] = [[] for _ in range(window)]
        next_rank = np.zeros(window, np.int64)
        sequence = 0
        # rounded down, with a hair for solutions just below a whole number; the most repeated first
        whole = np.floor(x + 1e-3).astype(np.int64)
        for turn in (whole, None):
            if turn is None:  # once more with what is still there: combinations that the rounding cost
                order = np.argsort(-x, kind="stable")[: 4 * window]
            else:
                order = np.flatnonzero(turn > 0)
                order = order[np.argsort(-turn[order], kind="stable")]
            for k in order.tolist():
                parts = [int(p) for p in combos[k] if p]
                n = min(int(left[p]) // parts.count(p) for p in parts)
                if turn is not None:
                    n = min(n, int(turn[k]))
                if n <= 0:
                    continue
                offset = 0
                for p in parts:
                    self.runs[p].append((int(next_rank[p]), n, sequence, offset))
                    next_rank[p] += n
                    left[p] -= n
                    offset += p
                sequence += n
        self.planned, self.first = sequence, next_rank
        # the rest in one stream, longest first: where each length begins
        self.stream = np.zeros(window, np.int64)
        at = 0
        for p in range(window - 1, 0, -1):
            self.stream[p] = at
            at += p * int(left[p])
        self.sequences = sequence + -(-at // window)
        self.starts = [np.array([r[0] for r in runs], np.int64) for runs in self.runs]

    def places(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of the pieces of the rest of this length and rank."""
        if rank < self.first[length]:
            start, _, sequence, offset = self.runs[length][int(np.searchsorted(self.starts[length], rank, "right")) - 1]
            return [(sequence + rank - start, offset, length)]
        at = int(self.stream[length]) + (rank - int(self.first[length])) * length
        sequence, offset = self.planned + at // self.window, at % self.window
        head = min(length, self.window - offset)
        out = [(sequence, offset, head)]
        if head < length:
            out.append((sequence + 1, 0, length - head))
        return out


def tokens(docs: DataFrame, key: str, text: str, window: int, path: str) -> DataFrame:
    """Per row: key, chunk (the task), n tokens with the closing id 0, rest, its rank in the chunk, whole windows before it there, ids."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        chunk, seen, whole = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        for b in batches:
            n, rank, before, raw, size = [], [], [], [], 0
            first = 0
            for i, t in enumerate(b.column(1)):
                ids = np.append(encode(t.as_py() or ""), np.uint32(0)).astype("<u4")
                rest = len(ids) % window
                n.append(len(ids))
                rank.append(int(seen[rest]))
                before.append(whole)
                seen[rest] += 1
                whole += len(ids) // window
                raw.append(ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else ids.tobytes())
                size += len(raw[-1])
                if size > 4_000_000 or i == b.num_rows - 1:
                    m = len(n)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, m), pa.array([chunk] * m, pa.int32()), pa.array(n, pa.int64()), pa.array([x % window for x in n], pa.int32()), pa.array(rank, pa.int64()), pa.array(before, pa.int64()), pa.array(raw, pa.binary())], names)
                    n, rank, before, raw, size, first = [], [], [], [], 0, i + 1

    names = ["key", "chunk", "n", "rest", "rank", "before", "ids"]
    return docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(rows, f"key {kind}, chunk int, n long, rest int, rank long, before long, ids binary")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, depth: int = DEPTH, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Cut and place the tokens of all texts into sequences of at most ``window``.

    A text's tokens are its ids and a closing 0; null texts count as empty.
    Returns per piece: key, start (tokens of its text before it), length,
    ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens,
    sequence_id, offset; with ``with_ids`` also ids (bytes, the same layout).
    All sequences but one at most are full.  Repeated and null keys are
    packed like any others; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    docs = docs.select(F.col(key), F.col(text).alias("text"))
    rows = written(tokens(docs, key, "text", window, path), "packing-tokens")
    by_chunk = written(rows.groupBy("rest", "chunk").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    counts = np.zeros(window, np.int64)
    for r in by_chunk.groupBy("rest").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        counts[r["rest"]] = r["n"]
    plan = Plan(counts, window, depth)
    earlier = Window.partitionBy("rest").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = by_chunk.select("rest", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source, out, raws = [], [], []
            for i, (chunk, n, rest, rank, before, base, raw) in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 8)), strict=True)):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                # a text's whole windows are sequences of their own, numbered within its task
                own = [(plan.sequences + (chunk << 40) + before + k, 0, window) for k in range(n // window)]
                start = 0
                for sequence, offset, length in own + (plan.places(rest, rank + base) if rest else []):
                    part = ids[4 * start : 4 * (start + length)]
                    source.append(i)
                    out.append((start, length, zlib.crc32(part), n, sequence, offset))
                    if with_ids:
                        raws.append(part)
                    start += length
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, pa.int64()) for c in cols), *([pa.array(raws, pa.binary())] * with_ids)], names)

    placed = rows.join(base, ["chunk", "rest"]).select("key", "chunk", "n", "rest", "rank", "before", "base", "ids")
    schema = ", ".join([f"`{key}` {kind}", *(f"{c} long" for c in names[1:7]), *(["ids binary"] * with_ids)])
    return placed.mapInArrow(pieces, schema)
