"""Similarity join of n-gram sets with prefix trees.

All sets are ordered by one global order of their n-grams: rare first, by a
counting sketch of fixed size over the whole corpus.  Two similar sets then
share an n-gram among the first few of each, so those are posted by n-gram
and only sets under one n-gram meet.

Texts with equal sets are one class.  The classes under an n-gram aren't
paired off: one of them, the most central, is compared with the others; once
components are known from that, n-grams whose classes all lie in one
component are done, and the next round takes another centre for the rest.
Of what is still open after ROUNDS rounds, the classes under an n-gram of FEW are
paired off.  Under others they are dealt to cells of two bounded blocks each; a
cell compares its sets with one another and gives only links.

A comparison puts the sets that face one class into a prefix tree: their
ordered n-grams, sorted, so that neighbours share their beginnings.  The
traversal keeps the overlap of the shared beginning and turns back as soon
as the remaining lengths can't make up the overlap that is needed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import looked_up, ship, word_hashes, written

#: Counters of the sketch and the blocks that they are added up in: 4 MB in all, however large the corpus.
SKETCH, BLOCKS = 1 << 20, 64
#: Rounds of comparing with centres, members of one prefix tree, about, and classes that are paired off at most.
ROUNDS, MEMBERS, FEW = 3, 128, 32
#: Sets that a Python worker holds at once, and n-grams of a block in a cell, about.
PATHS, CELL = 64, 1 << 19
#: Postings of an n-gram that go to one task, about: those of more common ones are dealt to several.
POSTINGS = 512
#: Bits of the filter for texts that pairs need: 4 MB.
BITS = 1 << 25
MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles of a text.

    A-Z count as lower case; words end at spaces and control characters 9 to
    13.  A text of fewer words is one shingle; without words there is none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = word_hashes(words)
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        h = h * MIX + w[i : len(w) - size + 1 + i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def class_of(g: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(g.tobytes())).astype(np.int64)))


def needed(n: int, m: int, share: int) -> int:
    """Least overlap of sets of n and m for ``100 * both >= share * either``."""
    return -(-share * (n + m) // (100 + share))


def _cell(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)


def _described(docs: DataFrame, n: int) -> DataFrame:
    """(key, cls, size) for every row, and the sketch of each task in compressed blocks."""
    kind = docs.schema[0].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, cells, many = np.zeros(SKETCH, np.uint32), [], 0
        for b in batches:
            cls, size, key_type = [], [], b.column(0).type
            for t in b.column(1):
                g = grams(t.as_py(), n)
                cells.append(_cell(g))
                many += len(g)
                if many > SKETCH:
                    sketch += np.bincount(np.concatenate(cells), minlength=SKETCH).astype(np.uint32)
                    cells, many = [], 0
                cls.append(class_of(g) if len(g) else None)
                size.append(len(g))
            m = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls, pa.int64()), pa.array(size, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        if many:
            sketch += np.bincount(np.concatenate(cells), minlength=SKETCH).astype(np.uint32)
        if sketch.any():
            blobs = [zlib.compress(x.tobytes(), 1) for x in np.split(sketch, BLOCKS)]
            none = [pa.nulls(BLOCKS, key_type), pa.nulls(BLOCKS, pa.int64()), pa.nulls(BLOCKS, pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(BLOCKS), pa.int32()), pa.array(blobs, pa.binary())], names)

    names = ["key", "cls", "size", "block", "counts"]
    return docs.mapInArrow(rows, f"key {kind}, cls long, size long, block int, counts binary")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the sketch blocks of a partition as they stream by."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            counts = np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
            total[k] = total[k] + counts if k in total else counts
    yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["block", "counts"])


def _sketch(parts: DataFrame) -> np.ndarray:
    """The corpus's sketch: SKETCH counters in BLOCKS rows, whatever the corpus."""
    parts = parts.where("block is not null").select("block", "counts", F.pmod(F.xxhash64("counts"), F.lit(4)).alias("salt"))
    once = parts.repartition("block", "salt").select("block", "counts").mapInArrow(_added, "block int, counts binary")
    rows = once.repartition("block").mapInArrow(_added, "block int, counts binary").collect()
    out = np.zeros((BLOCKS, SKETCH // BLOCKS), np.uint32)
    for r in rows:
        out[r["block"]] += np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return out.ravel()


def ordered(g: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set in the global order, rare first, and its counts in the sketch."""
    c = sketch[_cell(g)]
    at = np.argsort(c, kind="stable")
    return g[at], c[at]


def _postings(docs: DataFrame, n: int, share: int, sketch) -> DataFrame:
    """The first n-grams of each class: (gram, cls, size, at, weight, salt); one row per gram, class and task at least.

    Where the sketch, which never counts too low, has more than POSTINGS of
    an n-gram, the salt deals its classes to several tasks; else it is 0.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, done = sketch.value, set()
        held: list[tuple] = []
        for b in batches:
            for t in b.column(1):
                g = grams(t.as_py(), n)
                if not len(g) or (c := class_of(g)) in done:
                    continue
                done.add(c)
                g, counts = ordered(g, order)
                first = len(g) + share * len(g) // -100 + 1
                parts = (counts[:first].astype(np.int64) + POSTINGS - 1) // POSTINGS
                salt = np.where(parts > 1, 1 + (c & (1 << 62) - 1) % np.maximum(parts, 1), 0).astype(np.int32)
                held.append((g[:first].view(np.int64), c, len(g), int(1e4 * np.log1p(counts.astype(float)).mean()), salt))
                if len(held) == 1000:
                    yield batch(held)
                    held = []
        yield batch(held)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        k = [len(x[0]) for x in held]
        many = lambda i, t: pa.array(np.repeat(np.array([x[i] for x in held], t), k))
        gram = np.concatenate([x[0] for x in held]) if held else np.zeros(0, np.int64)
        at = np.concatenate([np.arange(x, dtype=np.int32) for x in k]) if held else np.zeros(0, np.int32)
        salt = np.concatenate([x[4] for x in held]) if held else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(gram), many(1, np.int64), many(2, np.int32), pa.array(at), many(3, np.int32), pa.array(salt)], ["gram", "cls", "size", "at", "weight", "salt"])

    return docs.mapInArrow(rows, "gram long, cls long, size int, at int, weight int, salt int")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by gram and class: each once, and only of grams with several classes or dealt to several tasks."""
    last: tuple | None = None  # gram and class of the last row
    waiting: pa.RecordBatch | None = None  # that row, if it is the only one of its gram so far
    for b in batches:
        gram, cls = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(gram):
            continue
        before = np.concatenate([[gram[0] if last and gram[0] == last[0] else ~gram[0]], gram[:-1]])
        repeat = np.concatenate([[bool(last) and last == (gram[0], cls[0])], (gram[1:] == gram[:-1]) & (cls[1:] == cls[:-1])])
        at = np.flatnonzero(~repeat)
        if not len(at):
            continue
        b, gram, cls, before = b.take(pa.array(at)), gram[at], cls[at], before[at]
        as_before = gram == before
        as_next = np.concatenate([gram[1:] == gram[:-1], [False]])
        if waiting is not None and as_before[0]:
            yield waiting
        dealt = b.column(5).to_numpy() > 0
        yield b.filter(pa.array(as_before | as_next | dealt))
        waiting = None if as_before[-1] or dealt[-1] else b.slice(len(at) - 1, 1)
        last = (gram[-1], cls[-1])


class Walk:
    """A walk through a prefix tree, whose paths come in sorted order, with one set that they are compared with.

    ``sums[d]`` is the overlap of the current path's first d n-grams with the
    set; ``known`` of them hold.
    """

    def __init__(self, own: np.ndarray, share: int) -> None:
        self.own, self.share = np.sort(own), share
        self.path, self.sums, self.known = np.zeros(0, ">u8"), np.zeros(1, np.int64), 0

    def similar(self, new: np.ndarray) -> bool:
        """Go on to the next path: what it shares with the last one isn't compared again, and what can't be enough is left."""
        m = min(len(new), len(self.path))
        differ = np.flatnonzero(new[:m] != self.path[:m])
        known = min(int(differ[0]) if len(differ) else m, self.known)
        own, sums = self.own, np.concatenate([self.sums[: known + 1], np.zeros(len(new) - known, np.int64)])
        need = needed(len(own), len(new), self.share)
        while known < len(new) and sums[known] + min(len(new) - known, len(own) - sums[known]) >= need:
            step = new[known : known + 64]
            at = np.minimum(np.searchsorted(own, step), len(own) - 1)
            sums[known + 1 : known + 1 + len(step)] = sums[known] + np.cumsum(own[at] == step)
            known += len(step)
        self.path, self.sums, self.known = new, sums, known
        return known == len(new) and bool(sums[known] >= need)


def _trees(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """Walk the prefix tree of each centre's members, in sorted order.

    Rows come sorted by (centre, salt, member?, path); a centre's own row
    stands first.
    """
    centre, walk = None, None
    a, b_ = [], []
    for b in (x.slice(k, PATHS) for x in batches for k in range(0, x.num_rows, PATHS)):
        for c, member, cls, raw in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 5)), strict=True):
            new = np.frombuffer(raw, ">u8")
            if not member:
                centre, walk = c, Walk(new, share)
            elif walk.similar(new):
                a.append(centre)
                b_.append(cls)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b_, pa.int64())], ["a", "b"])
        a, b_ = [], []


def fits(n: Column, m: Column, share: int) -> Column:
    """Sizes that two similar sets can have."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * share


def _needed(n: Column, m: Column, share: int) -> Column:
    return F.ceil(F.lit(share) * (n + m) / (100 + share))


def meet(at: Column, n: Column, at2: Column, m: Column, share: int) -> Column:
    """Whether an n-gram's places in the order of two sets let them be similar through it.

    Sets that share as many n-grams as they need share one among the first
    ``size - needed + 1`` of each.
    """
    need = _needed(n, m, share)
    return fits(n, m, share) & (at <= n - need) & (at2 <= m - need)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, share: int, sketch) -> DataFrame:
    """Of pairs (a, b) of classes those that are similar.

    A tree is a centre and about MEMBERS classes that face it.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("trees"))
    members = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("trees")).cast("int").alias("salt"), F.lit(1).alias("member"), F.col("b").alias("cls"))
    centres = many.select("a", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("a").alias("cls"))
    trees = _with_texts(members.unionByName(centres), classes, docs).repartition("a", "salt")

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, PATHS) for x in batches for k in range(0, x.num_rows, PATHS)):
            sets = [_path(t.as_py(), c, n, sketch) for t, c in zip(b.column("text"), b.column("cls").to_pylist(), strict=True)]
            b = b.drop_columns(["text"]).append_column("size", pa.array([0 if x is None else len(x) for x in sets], pa.int32())).append_column("path", pa.array([None if x is None else x.tobytes() for x in sets], pa.binary()))
            yield b.filter(b.column("path").is_valid())

    sets = trees.mapInArrow(paths, "a long, salt int, member int, cls long, size int, path binary")
    return sets.sortWithinPartitions("a", "salt", "member", "path").mapInArrow(lambda b: _trees(b, share), "a long, b long").distinct()


def _path(text: bytes, cls: int, n: int, sketch) -> np.ndarray | None:
    """A compressed text's set from frequent to rare; None for a text that isn't of the class, as rows with equal keys may not be."""
    g = grams(zstandard.decompress(text).decode(), n)
    return ordered(g, sketch.value)[0][::-1].astype(">u8") if len(g) and class_of(g) == cls else None


def _with_texts(placed: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``placed``, which has a column cls, with the compressed text of each class.

    Texts travel compressed, as they are smaller than their sets, and only
    those that are needed, but for the few that share a bit with one of these.
    """
    placed = written(placed.join(classes.withColumnRenamed("rep", "key"), "cls"), "gram-trees")
    bits = _bits(placed)

    def needed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(2).to_numpy()
            b = b.filter(pa.array(bits.value[at >> 3] >> (at & 7) & 1 == 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zstandard.compress((t.as_py() or "").encode()) for t in b.column(1)], pa.binary())], ["key", "text"])

    kind = docs.schema[0].dataType.simpleString()
    texts = docs.where("key is not null").withColumn("bit", _bit()).mapInArrow(needed_texts, f"key {kind}, text binary")
    return placed.join(texts, "key").select(*(c for c in placed.columns if c not in ("key", "cls")), "cls", "text")


def _in_pairs(open_: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) of classes under one n-gram of FEW that may be similar through it."""
    right = open_.select("gram", *(F.col(c).alias(f"{c}2") for c in ("cls", "size", "label", "at")))
    near = meet(F.col("at"), F.col("size"), F.col("at2"), F.col("size2"), share)
    return open_.join(right, "gram").where((F.col("cls") < F.col("cls2")) & (F.col("label") != F.col("label2")) & near).select(F.col("cls").alias("a"), F.col("cls2").alias("b"))


def _in_cells(open_: DataFrame, classes: DataFrame, docs: DataFrame, n: int, share: int, sketch) -> DataFrame:
    """Links (a, b) among all classes under one n-gram: (gram, cls, size, label, at, and how many there are and n-grams in all).

    The classes of an n-gram are dealt to blocks, and every two blocks, or
    one with itself, are a cell; there each class walks the tree of the
    others that it may be similar to.
    """
    blocks = F.greatest(F.ceil(F.col("many") / MEMBERS), F.ceil(F.col("all") / CELL)).cast("int")
    rows = open_.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("gram", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cls", "size", "label", "at")

    def compared(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        paths = [_path(x.as_py(), c, n, sketch) for x, c in zip(t.column("text"), t.column("cls").to_pylist(), strict=True)]
        right = [i for i, p in enumerate(paths) if p is not None]
        by = sorted(right, key=lambda i: paths[i].tobytes())
        block, cls, size, label, at = (t.column(c).to_numpy()[by].astype(np.int64) for c in ("block", "cls", "size", "label", "at"))
        paths = [paths[i] for i in by]
        one = t.column("low")[0] == t.column("high")[0]
        a, b = [], []
        for i, own in enumerate(paths):
            need = -(-share * (size[i] + size) // (100 + share))
            may = (label != label[i]) & (cls > cls[i]) & (np.minimum(size, size[i]) * 100 >= np.maximum(size, size[i]) * share) & (at[i] <= size[i] - need) & (at <= size - need)
            may &= one | (block != block[i])
            walk = Walk(own, share)
            found = [k for k in np.flatnonzero(may).tolist() if walk.similar(paths[k])]
            a += [int(cls[i])] * len(found)
            b += cls[found].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _with_texts(rows, classes, docs).groupBy("gram", "low", "high").applyInArrow(compared, "a long, b long").distinct()


def _bit() -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(BITS))


def _bits(rows: DataFrame):
    """A bit for the hash of each key: BITS in all, however many rows; broadcast."""
    at = _bit() + 1  # buckets of 32,768 bits count from 1
    found = rows.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros((BITS >> 15, 1 << 12), np.uint8)
    for r in found:
        out[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out.ravel())


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, share: int = 80) -> DataFrame:
    """Link texts whose sets of n-word shingles have ``100 * intersection >= share * union``.

    Returns for every row of ``docs``: key, n_shingles, class_id (the
    smallest key with the same set) and component_id (the smallest key that
    links reach, its own included).  Null and empty texts and texts without
    words have no shingles and link with nothing; so do rows with a null
    key, whose class and component are null.  Repeated keys are kept; other
    columns aren't read.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    described = written(_described(docs, n), "gram-sets")
    sketch = spark.sparkContext.broadcast(_sketch(described))
    rows = described.where("block is null").select("key", "cls", "size")
    classes = written(rows.where("cls is not null and key is not null").groupBy("cls").agg(F.min("key").alias("rep")), "gram-classes")
    posted = _postings(docs.where("key is not null"), n, share, sketch)
    posted = posted.repartition("gram", "salt").sortWithinPartitions("gram", "cls").mapInArrow(_shared, posted.schema)
    posted = written(posted.drop("salt"), "gram-postings")
    edges, labels, open_, total = None, None, posted, posted.count()
    for turn in range(ROUNDS + 1):
        if labels is not None:
            open_ = open_.drop("label").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        else:
            open_ = open_.withColumn("label", F.col("cls"))
        stats = open_.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("size").alias("least"), F.max(F.struct("weight", "cls", "size", "label", "at")).alias("hub")).where("low < high")
        # a posting past where even the smallest possible partner needs it serves no pair
        smallest = F.greatest(F.col("least"), F.ceil(F.col("size") * share / 100))
        stats = written(stats.select("gram", "n", "least", "hub"), "gram-stats")
        met = looked_up(open_, "gram", stats, total).where(F.col("at") <= F.col("size") - _needed(F.col("size"), smallest, share)).drop("least")
        if turn == 0:
            met = written(met, "gram-met")
        if turn < ROUNDS:
            open_ = written(met.where("cls <> hub.cls"), "gram-open")
            near = meet(F.col("at"), F.col("size"), F.col("hub.at"), F.col("hub.size"), share)
            pairs = open_.where((F.col("label") != F.col("hub.label")) & near).select(F.col("hub.cls").alias("a"), F.col("cls").alias("b"))
            open_ = open_.drop("hub")
        else:
            open_ = written(met.drop("hub", "weight"), "gram-open")
            sizes = written(open_.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all")).withColumn("many", F.col("n")), "gram-sizes")
            open_ = written(looked_up(open_, "gram", sizes, total), "gram-open")
            pairs = _in_pairs(open_.where(F.col("many") <= FEW), share)
        found = None
        pairs = written(pairs.distinct(), "gram-pairs")
        if pairs.limit(1).count():
            found = written(_verified(pairs, classes, docs, n, share, sketch), "gram-links")
        if turn == ROUNDS and open_.where(F.col("many") > FEW).limit(1).count():
            more = written(_in_cells(open_.where(F.col("many") > FEW), classes, docs, n, share, sketch), "gram-links")
            found = more if found is None else found.unionByName(more)
        if found is None:
            if turn == ROUNDS or not open_.limit(1).count():
                break
            continue
        edges = found if edges is None else edges.unionByName(found)
        labels = components(edges)
    known = classes.withColumn("lowest", F.col("rep"))
    if labels is not None:
        low = labels.join(classes, labels["node"] == classes["cls"]).groupBy("label").agg(F.min("rep").alias("low"))
        of = labels.join(low, "label").select(F.col("node").alias("cls"), "low")
        known = written(classes.join(of, "cls", "left").select("cls", "rep", F.coalesce("low", "rep").alias("lowest")), "gram-components")
    full = rows.join(known, "cls", "left")
    own = F.when(F.col("key").isNotNull(), F.coalesce("lowest", "rep", "key"))
    return full.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("rep", "key")).alias("class_id"), own.alias("component_id"))
