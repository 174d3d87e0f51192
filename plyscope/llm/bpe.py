"""Byte-pair encoding and decoding by speculation and verification.

A word's encoding under byte-pair merging is the one sequence of tokens
whose neighbours are pairwise *compatible*: merging the bytes of both
tokens alone would leave the border between them in place.  So instead of
merging, greedy longest match proposes tokens, one vectorised pass tests
all borders of all new words at once, and only words with a failing border
are merged exactly.

Words repeat, so each Python worker keeps a bounded table of what it has
already encoded; what falls out of it is encoded again, to the same ids.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ship

#: How byte-level vocabularies of this family cut text into words (fixed value).
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Below this character, Unicode's letter, number and space classes agree between the libraries.
SETTLED = "Ԁ"
#: Entries of a worker's newer table of encoded chunks; as many stay in an older one.
TABLE = 250_000
#: Bytes up to which failing words are merged together.
SHORT = 32
#: Later than every merge.
NEVER = 1 << 60
#: Characters whose new words are verified together.
TOGETHER = 2_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary with its merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        added = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.path, self.special = path, added
        alphabet = byte_alphabet()
        n = max([*vocab.values(), *added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * n
        for text, i in vocab.items():
            self.bytes_of[i] = bytes(map(alphabet.__getitem__, text))
        for text, i in added.items():
            self.bytes_of[i] = text.encode()
        self.n = n
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        keys = np.empty(len(merges), np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if self.rank[k] >= 0:
                raise ValueError(f"token {k} is made by two merges")
            self.rank[k], self.left[k], self.right[k] = r, i, j
            keys[r] = i * n + j
            self.merges[i, j] = (r, k)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.single = [-1] * 256
        for i in range(n):
            if len(self.bytes_of[i]) == 1:
                self.single[self.bytes_of[i][0]] = i
        made = np.flatnonzero(self.rank >= 0)
        stays = self._stays(self.left[made], self.right[made], 2 * self.rank[made])
        lost = set(made[~stays].tolist())
        self.greedy = {self.bytes_of[i]: i for i in vocab.values() if i not in lost}
        self.reach: dict[bytes, int] = {}  # longest token by its first three bytes
        for w in self.greedy:
            self.reach[w[:3]] = max(len(w), self.reach.get(w[:3], 3))
        self.made = np.zeros(len(merges), np.int64)
        self.made[self.rank[made]] = made
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._library = None

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def _stays(self, a: np.ndarray, b: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Whether no merge joins a's end with b's start before time ``until``.

        Time 2r is a merge of rank r inside the left token, 2r + 1 one inside
        the right token: among equal ranks the leftmost goes first, so a join
        across the border (time 2r) comes after the former, before the latter.
        The border is replayed backwards from the finished tokens.
        """
        a, b, until = a.copy(), b.copy(), until.copy()
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y, t = a[live], b[live], until[live]
            joined = 2 * self._rank_of(x, y) < t
            ok[live[joined]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~joined & ((rx >= 0) | (ry >= 0))
            undo_left = rx > ry
            a[live] = np.where(go & undo_left, self.right[x], x)
            b[live] = np.where(go & ~undo_left, self.left[y], y)
            until[live] = np.where(undo_left, 2 * rx, 2 * ry + 1)
            live = live[go]
        return ok

    def _propose(self, word: bytes) -> list[int]:
        out, i, n, table, reach = [], 0, len(word), self.greedy.get, self.reach.get
        while i < n:
            j = min(n, i + reach(word[i : i + 3], 3))
            while (k := table(word[i:j])) is None:
                j -= 1
            out.append(k)
            i = j
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the lowest rank, leftmost first."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(p[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (p := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (p := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (p[0], x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def merge_together(self, words: list[bytes]) -> list[list[int]]:
        """merge() for many short words at once: each round does one merge in every unfinished word."""
        n, size = len(words), max(map(len, words))
        ids = np.full((n, size + 1), -1, np.int64)
        length = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(size + 1) < length[:, None]
        ids[inside] = np.array(self.single)[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.where(inside[:, 1:], self._rank_of(np.maximum(ids[:, :-1], 0), np.maximum(ids[:, 1:], 0)), NEVER)
        ranks = np.hstack([ranks, np.full((n, 1), NEVER)])
        out: list[list[int]] = [[]] * n
        row, place = np.arange(n), np.arange(size + 1)
        while len(row):
            at = ranks.argmin(axis=1)  # the leftmost among equals
            r = ranks[np.arange(len(row)), at]
            done = r >= NEVER
            for k in np.flatnonzero(done).tolist():
                out[row[k]] = ids[k][ids[k] >= 0].tolist()
            keep = ~done
            row, ids, ranks, at, r = row[keep], ids[keep], ranks[keep], at[keep], r[keep]
            if not len(row):
                break
            shift = np.minimum(place + (place > at[:, None]), size)
            ids, ranks = np.take_along_axis(ids, shift, 1), np.take_along_axis(ranks, shift, 1)
            k = np.arange(len(row))
            ids[k, at] = self.made[r]
            for p in (at - 1, at):
                ok = (p >= 0) & (p < size)
                x, y = ids[k[ok], p[ok]], ids[k[ok], p[ok] + 1]
                ranks[k[ok], p[ok]] = np.where(y >= 0, self._rank_of(x, np.maximum(y, 0)), NEVER)
        return out

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Encode words: propose for all, verify all borders, merge those that fail."""
        if not new:
            return {}
        raw = [w.encode() for w in new]
        proposed = [self._propose(w) for w in raw]
        size = np.fromiter(map(len, proposed), np.int64, len(new))
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(size.sum()))
        word = np.repeat(np.arange(len(new)), size)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(flat[inside] * self.n + flat[inside + 1], return_inverse=True)
        a, b = pairs // self.n, pairs % self.n
        ok = self._stays(a, b, np.full(len(pairs), 2 * NEVER))[back]
        failing = np.unique(word[inside[~ok]]).tolist()
        out, ends = flat.astype("<u4").tobytes(), np.cumsum(4 * size).tolist()
        found = {w: out[s:e] for w, s, e in zip(new, [0, *ends], ends, strict=False)}
        short = [i for i in failing if len(raw[i]) <= SHORT]
        for k in range(0, len(short), 20_000):
            some = short[k : k + 20_000]
            for i, ids in zip(some, self.merge_together([raw[i] for i in some]), strict=True):
                found[new[i]] = np.array(ids, "<u4").tobytes()
        for i in failing:
            if len(raw[i]) > SHORT:
                found[new[i]] = np.array(self.merge(raw[i]), "<u4").tobytes()
        return found

    def split(self, text: str) -> list[str]:
        """The words of a text; past SETTLED as the tokenizers library cuts them."""
        if not text or max(text) < SETTLED:
            return [text] if text[text[0] == " " :].isalpha() else WORDS.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[s:e] for _, (s, e) in self._library.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """Cut before single spaces, which are borders of words in any context.

        The first piece stands as it is; the others lack their space.
        """
        cut = text.split(" ")
        return [text] if "" in cut else cut

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        if len(self.chunks) > TABLE:
            self.chunks, self.older = {}, self.chunks
        parts, first, rest = [], set(), set()
        for text in texts:
            row = [(i, self.pieces(s) if s else []) for s, i in self._spans(text)]
            parts.append(row)
            for _, cut in row:
                first.update(cut[:1])
                rest.update(cut[1:])
        short, spaced = list(first), []
        for c in rest:
            if c not in self.chunks:
                if (ids := self.older.get(c)) is None:
                    spaced.append(c)
                else:
                    self.chunks[c] = ids
        split = [*map(self.split, short), *(self.split(" " + c) for c in spaced)]
        words = self.learn(list({w for ws in split for w in ws})).__getitem__
        whole = [words(ws[0]) if len(ws) == 1 else b"".join(map(words, ws)) for ws in split]
        starts = dict(zip(short, whole[: len(short)], strict=True))  # may be whole texts: not kept
        self.chunks.update(zip(spaced, whole[len(short) :], strict=True))
        get = self.chunks.__getitem__
        return [b"".join([starts[cut[0]] + b"".join(map(get, cut[1:])) if cut else i or b"" for i, cut in row]) for row in parts]

    def _spans(self, text: str) -> Iterator[tuple[str, bytes | None]]:
        """Ordinary stretches, and the ids of added tokens that stand between them."""
        found = [x for x in self.special if x in text]
        if not found:
            yield text, None
            return
        for part in regex.split("(" + "|".join(map(regex.escape, sorted(found, key=len, reverse=True))) + ")", text):
            if part in self.special:
                yield "", np.array([self.special[part]], "<u4").tobytes()
            elif part:
                yield part, None

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """encode_batch over bounded batches; null counts as empty."""
        batch, size = [], 0
        for text in texts:
            batch.append(text or "")
            size += len(batch[-1])
            if size >= TOGETHER:
                yield from self.encode_batch(batch)
                batch, size = [], 0
        yield from self.encode_batch(batch)

    def decode(self, ids: bytes) -> str:
        """Text of ids (little-endian unsigned 32 bits); broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _mapped(df: DataFrame, rows, schema: T.StructType) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(rows, schema)


def encode(docs: DataFrame, text: str = "text", out: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Add the column ``out``: token ids (array of int) of the column ``text``.

    Null and empty texts give an empty array.  The string of an added token
    in a text becomes that token.  A column already named ``out`` is replaced;
    all other columns stay as they are.
    """
    path = vocabulary or default_vocabulary()
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            raw = list(c.encode(b.column(b.schema.get_field_index(text)).to_pylist()))
            ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, out])

    return _mapped(docs, rows, schema)


def decode(df: DataFrame, ids: str = "ids", out: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Add the column ``out``: the text of the token ids in ``ids``.

    Null and empty arrays give an empty text; special tokens are kept.  An
    id outside the vocabulary or a null inside an array is an error.
    """
    path = vocabulary or default_vocabulary()
    df = df.drop(out) if out != ids else df
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids)).to_pylist()
            texts = pa.array([c.decode(np.array(x or [], "<u4").tobytes()) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, out])

    return _mapped(df, rows, schema)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encode every text, decode the ids again, and return digests of both.

    One row per row of ``docs``: key, n_tokens, ids_sha256, decoded_sha256.
    Null texts count as empty; null and repeated keys are kept; other columns
    aren't read.
    """
    path = vocabulary or default_vocabulary()
    docs = docs.select(F.col(key), F.col(text))
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, ids, decoded = [], [], []
            for raw in c.encode(b.column(1).to_pylist()):
                n.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(c.decode(raw).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], schema.names)

    return _mapped(docs, rows, schema)
