"""Quality scores learnt from preference pairs, after Bradley and Terry.

A labelled good text is preferred to a labelled bad one with probability
sigmoid(score(good) - score(bad)); the weights minimise the logistic loss of
feature differences over such pairs.  Features are statistics of the whole
text, each cut into bins by its quantiles over the training texts, and what it
says: the shares of its words and pairs of words in GRAMS cells that their
hashes name.  A score is one weight per statistic's bin plus the mean weight
of the cells.  A quantile of the training scores is the threshold, and scores
are shifted so that it lies at ``THRESHOLD``.

The sample is drawn and put in order by hashes of the keys, so a model depends
on the rows alone, not on how they are dealt to partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ship, word_hashes

#: Scores of at least this are predicted to be good.
THRESHOLD = 0.3
#: Most labelled rows that a model is fitted on, the first by a hash of their ids.
SAMPLE = 20_000
PAIRS, BINS, STEPS, SEED = 60_000, 12, 400, 7
#: Cells for hashed words and pairs of words, and how strongly their weights are drawn to 0.
GRAMS, CALM = 256, 1e-3

FEATURES = (
    "bytes", "words", "word_bytes", "upper", "digit", "stop", "comma", "exclaim", "bar", "junk", "quote", "other", "line_words",
    "distinct", "repeated", "top_word", "capital_words", "letter_words", "short_words", "long_words", "letter_entropy", "space", "repeated_lines", "ends",
)
BYTES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".", "comma": b",;:", "exclaim": b"!?", "bar": b"|", "junk": b"#$%&*@^~<>{}[]\\=+_", "quote": b"\"'`"}


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; zeros where nothing can be counted."""
    raw = (text or "").encode()
    n = len(raw)
    words = raw.split()
    w = len(words)
    if not w:
        return [float(n)] + [0.0] * (len(FEATURES) - 1)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = {k: float(count[list(v)].sum()) / n for k, v in BYTES.items()}
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, w)
    p = count[count > 0] / n
    known = sum(share.values())
    letters = float(count[97:123].sum()) / n
    return [
        float(np.log1p(n)), float(np.log1p(w)), float(sizes.mean()), share["upper"], share["digit"], share["stop"], share["comma"], share["exclaim"], share["bar"], share["junk"], share["quote"],
        1.0 - known - letters, float(np.log1p(w / max(len(lines), 1))),
        len(seen) / w, sum(map(bytes.__eq__, words, words[1:])) / w, max(seen.values()) / w, sum(map(bytes.istitle, words)) / w, sum(map(bytes.isalpha, words)) / w,
        float((sizes <= 2).mean()), float((sizes >= 12).mean()), float(-(p * np.log2(p)).sum()), float(count[[32, 9, 10, 13]].sum()) / n, 1 - len(set(lines)) / len(lines), float(raw.rstrip()[-1:] in (b".", b"!", b"?")),
    ]


def grams(text: str | None) -> np.ndarray:
    """Cell of every word and every pair of neighbouring words of a text, in lower case."""
    words = (text or "").encode().lower().split()
    h = word_hashes(words)
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    both = np.concatenate([h * np.uint64(0xBF58476D1CE4E5B9), pairs * np.uint64(0xBF58476D1CE4E5B9)])
    return (both >> np.uint64(54)).astype(np.int64) % GRAMS


def shares(cells: np.ndarray) -> np.ndarray:
    """Square roots of the shares of a text's grams in the cells, so that common ones don't drown the others."""
    count = np.bincount(cells, minlength=GRAMS).astype(float)
    return np.sqrt(count / max(len(cells), 1))


@dataclass(frozen=True)
class Model:
    """Bin borders by feature, weights by feature and bin, weights of cells, and the score at the threshold."""

    borders: np.ndarray
    weights: np.ndarray
    cells: np.ndarray
    cut: float

    def raw(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(b, x[:, k], "right") for k, b in enumerate(self.borders)], 1)
        return self.weights[np.arange(x.shape[1]), bins].sum(1) + (g * self.cells).sum(1)

    def score(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        at = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(self.raw(x, g) - self.cut + at, -500, 500)))


def fit(x: np.ndarray, g: np.ndarray, y: np.ndarray) -> Model:
    """Learn from statistics, shares of cells and labels (1 good, 0 bad).

    Without labels of both kinds every text scores 1 or 0, as the labels
    say, or 1 without any.
    """
    borders = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(x) else np.zeros((len(FEATURES), BINS - 1))
    weights, cells = np.zeros((len(FEATURES), BINS)), np.zeros(GRAMS)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(borders, weights, cells, 50.0 if len(bad) else -50.0)
    bins = np.stack([np.searchsorted(b, x[:, k], "right") for k, b in enumerate(borders)], 1) + np.arange(len(FEATURES)) * BINS
    rng = np.random.default_rng(SEED)
    a, b = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
    flat, velocity, drift = weights.ravel(), np.zeros(weights.size), np.zeros(GRAMS)
    for _ in range(STEPS):  # gradient descent with momentum on the mean logistic loss
        s = flat[bins].sum(1) + g @ cells
        miss = 1 / (1 + np.exp(np.clip(s[a] - s[b], -50, 50))) / PAIRS
        by_text = np.bincount(b, miss, len(s)) - np.bincount(a, miss, len(s))
        gradient = np.bincount(bins.ravel(), np.repeat(by_text, len(FEATURES)), weights.size) + 1e-4 * flat
        velocity = 0.9 * velocity - 2.0 * gradient
        flat = flat + velocity
        drift = 0.9 * drift - 2.0 * (by_text @ g + CALM * cells)
        cells = cells + drift
    model = Model(borders, flat.reshape(weights.shape), cells, 0.0)
    # of all quantiles of the training scores, the one that puts fewest texts on the wrong side
    raw = model.raw(x, g)
    order = np.argsort(raw, kind="stable")
    wrong = np.concatenate([[0], np.cumsum(y[order] == 1)]) + np.concatenate([[(y == 0).sum()], (y == 0).sum() - np.cumsum(y[order] == 0)])
    k = int(np.argmin(wrong))
    s = raw[order]
    cut = s[0] - 1 if k == 0 else s[-1] + 1 if k == len(s) else (s[k - 1] + s[k]) / 2
    return Model(borders, model.weights, cells, float(cut))


def held_out(key: Column) -> Column:
    """Rows whose labels no model may see."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit a model on at most SAMPLE labelled rows that aren't held out.

    Labels other than 0 and 1 and null keys are skipped.  A key with several
    labels counts with each, one with several texts with that of the smallest
    hash, repeated rows once.  The sample bounds what the driver and the
    broadcast hold.
    """
    spark = docs.sparkSession
    ship(spark)
    k = F.col("key")
    some = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & k.isNotNull() & ~held_out(k))
    some = some.distinct().orderBy(F.xxhash64(k), k, "label").limit(SAMPLE)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(some), "key").select("key", "label", F.xxhash64("text").alias("hash"), "text")
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("x", T.BinaryType()), T.StructField("g", T.BinaryType())])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, g = [], []
            for t in b.column(3):
                text = t.as_py()
                x.append(np.array(features(text), "<f8").tobytes())
                g.append(shares(grams(text)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(x, pa.binary()), pa.array(g, pa.binary())], schema.names)

    once = rows.mapInArrow(mapped, schema).groupBy("key", "label").agg(F.min(F.struct("hash", "x", "g")).alias("of")).select("key", "label", "of.x", "of.g")
    found = once.orderBy(F.xxhash64("key"), "key", "label").toArrow()  # SAMPLE rows of some 1,300 bytes at most
    x = np.frombuffer(b"".join(b.as_py() for b in found.column("x")), "<f8").reshape(-1, len(FEATURES))
    g = np.frombuffer(b"".join(b.as_py() for b in found.column("g")), "<f4").reshape(-1, GRAMS).astype(float)
    return fit(x, g, found.column("label").to_numpy())


def _scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Scores of whole texts, a text at a time: equal texts score equally in any batch."""
    out = []
    for t in texts:
        text = t.as_py()
        x = np.array(features(text)).reshape(1, -1)
        out.append(model.score(x, shares(grams(text)).astype(np.float32).astype(float)[None])[0])
    return np.array(out, float)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, held_out, score (0 to 1) and predicted (score >= THRESHOLD).

    Null texts count as empty and are scored like any other; null and
    repeated keys are kept; other columns aren't read.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(key), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    schema = T.StructType([docs.schema[key], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _scores(model, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], schema.names)

    return docs.mapInArrow(mapped, schema)


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose texts are predicted to be good."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(model, b.column(at)) >= THRESHOLD))

    return docs.mapInArrow(mapped, docs.schema)
