"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

The patterns give the base spans.  On top of them every maximal run of
key-like characters is a candidate: a window slides over it with a count per
character, and Shannon entropy follows from the counts by what enters and
leaves.  Windows whose entropy is high for their character class merge into
spans; an allow-list suppresses what is known to be harmless.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ship

#: Base kinds in their order: name, pattern, group that is measured, its least characters (fixed values).
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
#: A text without any of these has no assignment.
WORDS = ("passw", "secret", "token", "api")
#: Runs that may be keys; those without a digit are words.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGIT = re.compile(r"[0-9]")


@dataclass(frozen=True)
class Window:
    """A character class, the width of its window and the bits that make a window suspect."""

    kind: str
    chars: re.Pattern
    width: int
    bits: float


#: The first class that holds all of a window's characters counts for it.
WINDOWS = (
    Window("entropy_hex", re.compile(r"[0-9a-fA-F]+"), 20, 2.9),
    Window("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 20, 3.6),
)
KINDS = {k: i for i, k in enumerate([*(b[0] for b in BASE), *(w.kind for w in WINDOWS)])}
#: What is known not to be a secret.  UUIDs are whole tokens, set apart by = and /; checksums of lock files have their digest's length.
TOKEN = re.compile(r"[^=/]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_DIGESTS = "|".join(f"{name}[-=_/](?:[0-9a-f]{{{n * 2}}}|[a-z0-9+/_-]{{{-(-n * 4 // 3)}}}{'=' * (-n % 3)})" for name, n in (("md5", 16), ("sha1", 20), ("sha256", 32), ("sha384", 48), ("sha512", 64)))
CHECKSUM = re.compile(rf"(?<![a-z0-9+_-])(?:{_DIGESTS})(?![a-z0-9+_-])", re.IGNORECASE)
#: Placeholders take what stands beside them in their token, unless a whole window fits there.
PLACEHOLDER = re.compile(r"example|placeholder|changeme|x{6,}|0{8,}|123456789", re.IGNORECASE)
#: Paths of words and short numbers.
PATH = re.compile(r"([A-Za-z]+[/_=-]|[0-9]{1,4}[/_=-])*([A-Za-z]+|[0-9]{1,4})")

Span = tuple[int, str, int]


def suspect_windows(run: str, width: int, bits: float) -> Iterator[tuple[int, int]]:
    """Spans of merged windows of ``run`` with at least ``bits`` of entropy, a letter and a digit.

    Entropy of a window is log2(width) - sum(c * log2(c)) / width over its
    character counts c; one step changes two counts.
    """
    if len(run) < width:
        return
    term = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    most = (math.log2(width) - bits) * width
    count: dict[str, int] = {}
    total, digits, letters = 0.0, 0, 0
    start = end = -1
    for i, c in enumerate(run):
        n = count.get(c, 0)
        count[c] = n + 1
        total += term[n + 1] - term[n]
        digits += c.isdigit()
        letters += c.isalpha()
        if i >= width:
            old = run[i - width]
            n = count[old]
            count[old] = n - 1
            total += term[n - 1] - term[n]
            digits -= old.isdigit()
            letters -= old.isalpha()
        if i >= width - 1 and digits and letters and total <= most + 1e-9:
            if i - width + 1 > end and end >= 0:
                yield start, end
                start = -1
            if start < 0:
                start = i - width + 1
            end = i + 1
    if end >= 0:
        yield start, end


def base_spans(text: str) -> list[Span]:
    """Spans (start, kind, end) of the fixed patterns, by start, then kind as listed."""
    out = []
    lower = text.lower()
    for kind, pattern, group, least in BASE:
        if kind == "assign" and not any(w in lower for w in WORDS) or kind == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS[s[1]]))


def allowed(run: str) -> list[tuple[int, int]]:
    """Spans of ``run`` that are known not to be secrets, by start."""
    out = [m.span() for m in CHECKSUM.finditer(run)]
    least = min(w.width for w in WINDOWS)
    for t in TOKEN.finditer(run):
        if UUID.fullmatch(t.group()):
            out.append(t.span())
            continue
        at = t.start()
        words = [m.span() for m in PLACEHOLDER.finditer(run, *t.span())]
        for s, e in [*words, (t.end(), t.end())] if words else []:
            out.append((at if s - at < least else s, e))
            at = e
    return sorted(out)


def outside(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What is left of a span without the spans ``taken``, which are sorted."""
    for s, e in taken:
        if e <= start or s >= end:
            continue
        if start < s:
            yield start, s
        start = max(start, e)
    if start < end:
        yield start, end


def stretches(run: str) -> Iterator[tuple[int, int]]:
    """Merged suspect windows of ``run``: each window by its own class, wherever it lies."""
    narrow, wide = WINDOWS
    found = [(m.start() + s, m.start() + e) for m in narrow.chars.finditer(run) for s, e in suspect_windows(m.group(), narrow.width, narrow.bits)]
    if not narrow.chars.fullmatch(run):
        found += suspect_windows(run, wide.width, wide.bits)
    start = end = -1
    for s, e in sorted(found):
        if s > end:
            if end >= 0:
                yield start, end
            start = s
        end = max(end, e)
    if end >= 0:
        yield start, end


def is_path(run: str) -> bool:
    """Whether there are only words and short numbers; those at an end may be cut off from their separators."""
    run = run.strip("/_=-")
    return not run or PATH.fullmatch(run) is not None


def entropy_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans found by entropy alone: what lies outside base spans and isn't on the allow-list."""
    if not DIGIT.search(text):
        return []
    out = []
    taken = sorted((s, e) for s, _, e in base)
    hexed, least = WINDOWS[0], min(w.width for w in WINDOWS)
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if not DIGIT.search(run) or PATH.fullmatch(run):
            continue
        for first, last in outside(0, len(run), allowed(run)):
            part = run[first:last]
            for s, e in stretches(part):
                # whole tokens, so that no number is taken for a shorter one
                before, after = max(part.rfind("=", 0, s), part.rfind("/", 0, s)) + 1, min(x for x in (part.find("=", e), part.find("/", e), len(part)) if x >= 0)
                if is_path(part[before:after]):
                    continue
                s, e = s + first + m.start(), e + first + m.start()
                for p, q in outside(s, e, taken):
                    # a short rest of words is the name of what was found
                    if (p, q) == (s, e) or q - p >= least or not is_path(text[p:q]):
                        out.append((p, (hexed if hexed.chars.fullmatch(text, p, q) else WINDOWS[1]).kind, q))
    return out


def secret_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by start, then kind."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + entropy_spans(text, base), key=lambda s: (s[0], KINDS[s[1]]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of every whole text, one row per row of ``docs``.

    Columns: key, n_assign, n_access, n_hex (base spans by kind), n_entropy,
    base_sha256 and spans (``kind:start:end``, code points, end exclusive).
    Null and empty texts have no spans; null and repeated keys are kept;
    other columns aren't read.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(key), F.col(text))
    names = [*(f"n_{b[0]}" for b in BASE), "n_entropy"]
    schema = T.StructType([docs.schema[key], *(T.StructField(n, T.LongType()) for n in names), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(len(names) + 2)]
            for t in b.column(1):
                base, found = secret_spans(t.as_py())
                kinds = [s[1] for s in base]
                for c, (k, *_) in zip(cols, BASE, strict=False):
                    c.append(kinds.count(k))
                cols[len(BASE)].append(len(found) - len(base))
                cols[-2].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[-1].append(joined(found))
            kinds = [pa.int64()] * len(names) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], schema.names)

    return docs.mapInArrow(rows, schema)


def masked(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    if not text:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in secret_spans(text)[1]:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets in its texts replaced; all rows and columns stay.

    Null stays null.  A text without secrets is returned as it is.
    """
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([masked(t.as_py(), mark) for t in b.column(at)], b.schema.field(at).type))

    return docs.mapInArrow(rows, docs.schema)
