"""Duplicate passages by a distributed merge sort of suffixes.

Every byte covered by a WINDOW-byte string that also starts in a document
with a smaller id goes.  Comparing all suffixes would move the corpus many
times over, so only anchored ones are sorted: each window names the smallest
of its GRAM-byte strings (by a hash) as its anchor, so equal windows have
equal anchors at equal places, and neighbouring windows mostly share one.

1. Anchors that occur in several documents are found from their hashes.
2. For those, each chunk of documents sorts the suffixes at its anchors into
   runs, one for each bucket of anchors.  Equal contexts of a chunk are one
   entry, of its smallest document; the chunk's other documents with that
   context are covered already.  Runs travel front-coded.
3. A bucket merges its runs with a loser tree whose players know how many
   bytes they share with the last winner, so that no known prefix is compared
   again.  The merged order's common prefixes, and those of the reversed
   bytes before the anchors, tell equal windows; each group's smallest
   document keeps them.
4. Chunks apply what comes back to their texts.

The texts are shuffled once, by chunk, and that shuffle is read three times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ship, width

#: Bytes of a window and of the strings that anchor it, and how many of those a window has.
WINDOW, GRAM = 50, 26
PER = WINDOW - GRAM + 1
#: Bytes that are hashed at once, and bytes of text in a chunk, about.
BUFFER, CHUNK = 1 << 20, 8 << 20
CELL = np.uint64(BUFFER - 1)
ODD = 0x9E3779B97F4A7C15
U = np.uint64


def _powers(base: int) -> np.ndarray:
    out = np.full(BUFFER, U(base & (2**64 - 1)))
    out[0] = U(1)
    return np.cumprod(out)


_POWERS: list[np.ndarray] = []


def anchors(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows inside segments of ``buf``.

    Returns position, first and last window that it anchors, and hash.
    """
    if not _POWERS:
        _POWERS.extend((_powers(ODD), _powers(pow(ODD, -1, 2**64))))
    none = np.zeros(0, np.int64)
    n = len(buf)
    if n < WINDOW:
        return none, none, none, none.astype(U)
    power, inverse = _POWERS
    total = np.zeros(n + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * power[:n], out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1]
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    low = (h & ~CELL) | np.arange(len(h), dtype=U)  # equal hashes: the leftmost
    span = 1
    while span * 2 <= PER:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < PER:
        low = np.minimum(low[: len(low) - (PER - span)], low[PER - span :])
    at = (low & CELL).astype(np.int64)
    edge = np.zeros(n + 2, np.int32)
    long = sizes >= WINDOW
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, starts[long] + sizes[long] - WINDOW + 1, -1)
    valid = np.cumsum(edge)[: len(at)] > 0
    same = valid[1:] & valid[:-1] & (at[1:] == at[:-1])
    first = np.flatnonzero(valid & ~np.concatenate([[False], same]))
    last = np.flatnonzero(valid & ~np.concatenate([same, [False]]))
    p = at[first]
    return p, first, last, h[p]


def _buffers(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of whole texts, or of overlapping segments of long ones: bytes, starts, sizes, text and offset of each segment."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def made() -> tuple[np.ndarray, ...]:
        sizes = np.array([len(x[2]) for x in held], np.int64)
        buf = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        return buf, np.cumsum(sizes) - sizes, sizes, np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)

    step = BUFFER // 2
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), step):
            part = t[at : at + step + WINDOW - 1]
            if len(part) < WINDOW:
                continue
            if size + len(part) > BUFFER:
                yield made()
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield made()


def _cells(h: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket in the upper half, 32 more bits of the hash in the lower."""
    return ((h >> U(32)) % U(buckets)) << U(32) | (h & U(0xFFFFFFFF))


def _rows(table: pa.Table, key: str, text: str) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids, texts and numbers of the rows of a chunk that have an id; equal rows share a number.

    Numbers follow the order of a hash, so they don't depend on the order in
    which a shuffle brings the rows.
    """
    table = table.filter(pa.compute.is_valid(table.column(key)))
    ids = table.column(key).cast(pa.int64()).to_numpy()
    texts = [(x or "").encode() for x in table.column(text).to_pylist()]
    keys = np.fromiter((xxhash.xxh3_64_intdigest(t, int(i) & 0xFFFFFFFFFFFFFFFF) for i, t in zip(ids, texts, strict=True)), U, len(texts))
    return ids, texts, np.unique(keys, return_inverse=True)[1].astype("<u4")


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers as 4 bytes each, if they all fit, else as 8."""
    return x.astype("<u4" if len(x) and x.min() >= 0 and x.max() < 1 << 32 else "<i8").tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<i8").astype(np.int64)


def _split(cells: np.ndarray) -> list[tuple[int, slice]]:
    """Buckets of sorted cells and where each lies."""
    b = (cells >> U(32)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
    return [(int(b[s]), slice(s, e)) for s, e in zip(cut, [*cut[1:], len(b)], strict=True)]


MARKS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("cells", T.BinaryType()), T.StructField("several", T.BinaryType())])
RUNS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("n", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("shared", "size", "tail", "before", "doc", "span", "of", "row", "at"))])
HITS = T.StructType([T.StructField("chunk", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("row", "at", "mask"))])


def _table(rows: list[tuple], schema: T.StructType) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(cols, schema, strict=True)], schema.names)


def mark(table: pa.Table, key: str, text: str, buckets: int) -> pa.Table:
    """Step 1, chunk: the hashes of its anchors by bucket, and which of them several of its documents have."""
    if not table.num_rows:
        return _table([], MARKS)
    chunk = table.column("__chunk")[0].as_py()
    ids, texts, _ = _rows(table, key, text)
    cells, docs = [], []
    for buf, starts, sizes, of, _ in _buffers(texts):
        p, _, _, h = anchors(buf, starts, sizes)
        cells.append(_cells(h, buckets))
        docs.append(ids[of[np.searchsorted(starts, p, "right") - 1]])
    if not cells:
        return _table([], MARKS)
    c, d = np.concatenate(cells), np.concatenate(docs)
    order = np.argsort(c)
    c, d = c[order], d[order]
    cut = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(d, cut) != np.maximum.reduceat(d, cut) if len(c) else np.zeros(0, bool)
    c = c[cut]
    return _table([(b, chunk, c[s].astype("<u4").tobytes(), np.packbits(several[s]).tobytes()) for b, s in _split(c)], MARKS)


def repeated(table: pa.Table) -> pa.Table:
    """Step 1, bucket: tell each chunk which of its anchors occur in several documents."""
    cells = [np.frombuffer(x, "<u4") for x in table.column("cells").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(c)).astype(bool) for x, c in zip(table.column("several").to_pylist(), cells, strict=True)]
    flat = np.concatenate(cells)
    values, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    wanted = count > 1
    wanted[back[np.concatenate(several)]] = True
    keep = np.split(wanted[back], np.cumsum([len(c) for c in cells])[:-1])
    bucket = table.column("bucket")[0].as_py()
    return _table([(bucket, chunk, c[k].tobytes(), b"") for chunk, c, k in zip(table.column("chunk").to_pylist(), cells, keep, strict=True) if k.any()], MARKS)


def common(a: np.ndarray) -> np.ndarray:
    """Bytes that each row of a sorted matrix shares with the row before; 0 for the first."""
    out = np.zeros(len(a), np.int64)
    if len(a) > 1:
        differ = a[1:] != a[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), a.shape[1])
    return out


def sort_runs(table: pa.Table, wanted: pa.Table, key: str, text: str, buckets: int) -> pa.Table:
    """Step 2, chunk: front-coded sorted runs of the suffixes at its repeated anchors, by bucket.

    An entry has the bytes from its anchor on (as far as its windows reach),
    the bytes before it reversed, its document and the windows it anchors; a
    window is told by how many bytes it starts before the anchor.
    """
    if not table.num_rows or not wanted.num_rows:
        return _table([], RUNS)
    chunk = table.column("__chunk")[0].as_py()
    ids, texts, keys = _rows(table, key, text)
    known = np.sort(np.concatenate([(np.frombuffer(c, "<u4").astype(U) | U(b) << U(32)) for b, c in zip(wanted.column("bucket").to_pylist(), wanted.column("cells").to_pylist(), strict=True)]))
    parts: list[tuple[np.ndarray, ...]] = []
    ahead, back = np.arange(WINDOW), np.arange(PER - 1)
    for buf, starts, sizes, of, offset in _buffers(texts):
        p, first, last, h = anchors(buf, starts, sizes)
        c = _cells(h, buckets)
        at = np.minimum(np.searchsorted(known, c), len(known) - 1)
        hit = known[at] == c
        p, first, last, c = p[hit], first[hit], last[hit], c[hit]
        seg = np.searchsorted(starts, p, "right") - 1
        padded = np.concatenate([buf, np.zeros(WINDOW, np.uint8)])
        m = np.zeros((len(p), WINDOW + PER + 1), np.uint8)
        m[:, :WINDOW] = np.where(ahead < (last + WINDOW - p)[:, None], padded[p[:, None] + ahead], 0)
        m[:, WINDOW : WINDOW + PER - 1] = np.where(back < (p - first)[:, None], buf[np.maximum(p[:, None] - 1 - back, 0)], 0)
        m[:, -2], m[:, -1] = p - last, p - first
        parts.append((m, c, ids[of[seg]], keys[of[seg]], p - starts[seg] + offset[seg]))
    m, c, doc, row, p = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros((0, WINDOW + PER + 1), np.uint8), *[np.zeros(0, np.int64)] * 4)
    if not len(m):
        return _table([], RUNS)
    order = np.argsort(m.view(f"S{m.shape[1]}").ravel(), kind="stable")
    m, c, doc, row, p = m[order], c[order], doc[order], row[order], p[order]
    fresh = np.concatenate([[True], (m[1:] != m[:-1]).any(1)])
    cut, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
    least = np.minimum.reduceat(doc, cut)
    own = doc == least[group]
    masks = np.array([[(1 << hi + 1) - (1 << lo) if lo <= hi else 0 for hi in range(PER)] for lo in range(PER)], np.int64)
    other = ~own
    out = [(chunk % buckets, chunk, 0, b"", b"", b"", b"", b"", masks[m[other, -2], m[other, -1]].astype("<u4").tobytes(), b"", _narrow(row[other]), _narrow(p[other]))] if other.any() else []
    # entries by bucket, still in the order of their suffixes
    e, ec, bucket_of = m[cut], least, (c[cut] >> U(32)).astype(np.int64)
    by = np.argsort(bucket_of, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    orow, op, og = row[own], p[own], place[group[own]]
    o = np.argsort(og, kind="stable")
    orow, op, og = orow[o], op[o], og[o]
    for b, s in _split(bucket_of[by].astype(U) << U(32)):
        x, k = e[by[s]], slice(*np.searchsorted(og, [s.start, s.stop]))
        right = np.ascontiguousarray(x[:, :WINDOW])
        shared, size = common(right), WINDOW - x[:, -2].astype(np.int64)
        tail = right[(ahead >= shared[:, None]) & (ahead < size[:, None])]
        before = x[:, WINDOW : WINDOW + PER - 1][back < x[:, -1:]]
        of = og[k] - s.start
        out.append((b, chunk, len(x), shared.astype(np.uint8).tobytes(), size.astype(np.uint8).tobytes(), tail.tobytes(), before.tobytes(), _narrow(ec[by[s]]), x[:, -2:].tobytes(), b"" if np.array_equal(of, np.arange(len(x))) else _narrow(of), _narrow(orow[k]), _narrow(op[k])))
    return _table(out, RUNS)


def unfront(shared: np.ndarray, size: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The matrix of a front-coded run."""
    out = np.zeros((len(shared), WINDOW), np.uint8)
    at = np.arange(WINDOW)
    out[(at >= shared[:, None]) & (at < size[:, None])] = tail
    k = np.arange(len(shared))
    for j in range(int(shared.max(initial=0))):
        out[:, j] = out[np.maximum.accumulate(np.where(shared > j, 0, k)), j]
    return out


def merge(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs: the run of each output in turn, and its common prefix with the output before.

    A loser tree.  Every player carries how many bytes it shares with the
    last winner.  Of two players the one that shares more is smaller; only
    if both share the same are bytes compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    head, known = [0] * k, [0] * k
    heads: list[bytes | None] = [runs[i][0] if i < len(runs) and runs[i] else None for i in range(k)]

    def beats(a: int, b: int) -> bool:
        """Whether a's head comes first; the loser learns what it shares with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return True
        if x is None:
            return False
        if known[a] != known[b]:
            return known[a] > known[b]
        u, v = x[known[a] :], y[known[a] :]
        if u == v:
            known[max(a, b)] = len(x)
            return a < b
        same = len(u) - ((int.from_bytes(u) ^ int.from_bytes(v)).bit_length() + 7) // 8
        known[b if u < v else a] += same
        return u < v

    losers, winners = [0] * k, [*([0] * k), *range(k)]
    for i in range(k - 1, 0, -1):
        a, b = winners[2 * i], winners[2 * i + 1]
        winners[i], losers[i] = (a, b) if beats(a, b) else (b, a)
    w = winners[1] if k > 1 else 0
    order, lcp = [], []
    while heads[w] is not None:
        order.append(w)
        lcp.append(known[w])
        head[w] += 1
        if head[w] < len(runs[w]):
            heads[w], known[w] = runs[w][head[w]], shared[w][head[w]]
        else:
            heads[w] = None
        i = (w + k) // 2
        while i:
            if not beats(w, losers[i]):
                w, losers[i] = losers[i], w
            i //= 2
    return order, lcp


def merge_bucket(table: pa.Table) -> pa.Table:
    """Step 3, bucket: merge the runs and find, per entry, the windows that a smaller document has."""
    rows = table.to_pylist()
    out = [(r["chunk"], r["row"], r["at"], r["span"]) for r in rows if not r["n"]]
    runs = [r for r in rows if r["n"]]
    if not runs:
        return _table(out, HITS)
    get = lambda c, t: [np.frombuffer(r[c], t) for r in runs]
    shared = get("shared", np.uint8)
    right = [unfront(s.astype(np.int64), z.astype(np.int64), t) for s, z, t in zip(shared, get("size", np.uint8), get("tail", np.uint8), strict=True)]
    order, lcp = merge([[x.tobytes() for x in m] for m in right], [s.tolist() for s in shared])
    # from runs in turn to the merged order
    n = [r["n"] for r in runs]
    source = np.argsort(np.argsort(np.array(order), kind="stable"), kind="stable")  # entry of the concatenated runs, per output
    lcp_ = np.array(lcp)
    span = np.concatenate([x.reshape(-1, 2) for x in get("span", np.uint8)])
    before = np.zeros((len(span), PER - 1), np.uint8)
    before[np.arange(PER - 1) < span[:, 1:]] = np.concatenate(get("before", np.uint8))
    before, span = before[source], span[source]
    doc = np.concatenate([_wide(r["doc"], r["n"]) for r in runs])[source]
    left_order = np.argsort(np.ascontiguousarray(before).view(f"S{PER - 1}").ravel(), kind="stable")
    left_lcp = common(before[left_order])
    left = np.empty(len(before), np.int64)
    mask = np.zeros(len(doc), np.int64)
    for o in range(PER):
        some = np.flatnonzero((span[:, 0] <= o) & (o <= span[:, 1]))
        if len(some) < 2:
            continue
        left[left_order] = np.cumsum(left_lcp < o)
        both = (np.cumsum(lcp_ < WINDOW - o)[some] << 32) | left[some]
        by = np.argsort(both, kind="stable")
        both, d = both[by], doc[some[by]]
        fresh = np.concatenate([[True], both[1:] != both[:-1]])
        least = np.minimum.reduceat(d, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        mask[some[by[d > least]]] |= 1 << o
    back = np.empty(len(mask), np.int64)
    back[source] = mask
    for r, m in zip(runs, np.split(back, np.cumsum(n)[:-1]), strict=True):
        if m.any():
            of = m[_wide(r["of"], len(r["of"]) // 4)] if r["of"] else m
            k = of != 0
            out.append((r["chunk"], _narrow(_wide(r["row"], len(of))[k]), _narrow(_wide(r["at"], len(of))[k]), of[k].astype("<u4").tobytes()))
    return _table(out, HITS)


def covered(size: int, starts: np.ndarray) -> np.ndarray:
    """Which bytes the windows at ``starts`` cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def removals(table: pa.Table, hits: pa.Table, key: str, text: str) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Step 4: index, bytes and removed bytes of every row of a chunk."""
    texts = [(x or "").encode() for x in table.column(text).to_pylist()]
    numbers = iter(_rows(table, key, text)[2].tolist())
    masks = [np.frombuffer(x, "<u4").astype(np.int64) for x in hits.column("mask").to_pylist()]
    join = lambda c: np.concatenate([np.zeros(0, np.int64), *(_wide(x, len(m)) for x, m in zip(hits.column(c).to_pylist(), masks, strict=True))])
    row, at, mask = join("row"), join("at"), np.concatenate([np.zeros(0, np.int64), *masks])
    order = np.argsort(row, kind="stable")
    row, at, mask = row[order], at[order], mask[order]
    bits = np.arange(PER)
    for i, (known, t) in enumerate(zip(table.column(key).is_valid().to_pylist(), texts, strict=True)):
        s = e = 0
        if known:
            n = next(numbers)
            s, e = np.searchsorted(row, [n, n + 1])
        k, o = np.nonzero(mask[s:e, None] >> bits & 1)
        yield i, t, covered(len(t), at[s:e][k] - o)


def _spans(gone: np.ndarray) -> int:
    return int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def _plan(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The documents by chunk, and the hits for each chunk."""
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(2 * width(spark), -(-size // CHUNK))
    buckets = chunks
    # rows without a key match nothing, so any chunk will do for them
    d = docs.withColumn("__chunk", F.pmod(F.when(F.col(key).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(key)), F.lit(chunks)))
    marks = d.groupBy("__chunk").applyInArrow(lambda t: mark(t, key, text, buckets), MARKS)
    wanted = marks.groupBy("bucket").applyInArrow(repeated, MARKS)
    runs = d.groupBy("__chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(lambda t, w: sort_runs(t, w, key, text, buckets), RUNS)
    return d, runs.groupBy("bucket").applyInArrow(merge_bucket, HITS)


def dedupe_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte covered by a WINDOW-byte string that also starts in
    a document with a smaller key; strings are judged on the input.  Null and
    short texts lose nothing; a row with a null key loses nothing and takes
    nothing from others; rows with equal keys don't count against each
    other.  Keys are whole numbers.  Other columns aren't read.
    """
    docs = docs.select(F.col(key), F.col(text))
    d, hits = _plan(docs, key, text)
    schema = T.StructType([docs.schema[key], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def apply(t: pa.Table, h: pa.Table) -> pa.Table:
        found = []
        for _, raw, gone in removals(t, h, key, text):
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            found.append((len(raw), int(gone.sum()), _spans(gone), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*found, strict=True)) or [[]] * 4
        return pa.Table.from_arrays([t.column(key).combine_chunks(), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], schema.names)

    return d.groupBy("__chunk").cogroup(hits.groupBy("chunk")).applyInArrow(apply, schema)


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with the repeated bytes taken out of the texts.

    As dedupe_digests(); where a removed stretch cuts a character, what is
    left of that character goes too.  Null stays null.
    """
    if taken := [c for c in docs.columns if c.lower() == "__chunk"]:
        free = "__chunk_" + "_" * max(map(len, docs.columns))
        return dedupe(docs.withColumnRenamed(taken[0], free), key, text).withColumnRenamed(free, taken[0])
    d, hits = _plan(docs, key, text)

    def apply(t: pa.Table, h: pa.Table) -> pa.Table:
        kept = [np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") for _, raw, gone in removals(t, h, key, text)]
        at = t.schema.get_field_index(text)
        null = t.column(at).is_null().to_pylist()
        t = t.set_column(at, t.schema.field(at), pa.array([None if n else k for k, n in zip(kept, null, strict=True)], t.schema.field(at).type))
        return t.drop_columns(["__chunk"])

    return d.groupBy("__chunk").cogroup(hits.groupBy("chunk")).applyInArrow(apply, docs.schema)
