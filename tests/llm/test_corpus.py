"""Operators across a corpus: similar texts, repeated passages, archives, vectors."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from plyscope.llm import ann, components, jaccard, shared, suffixes, topk, warc
from plyscope.llm.shared import fresh_path
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)


def near_copies(seed, groups=14, alone=25):
    """Groups of edited and exact copies, texts that share a passage, short ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 5, 8, 40, 120]))]
        for _ in range(rng.randint(2, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\n"]).join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    texts += [" ".join([*passage, *(word() for _ in range(rng.randint(0, 9)))]) for _ in range(alone)]
    texts += ["", None, "one", "One", "one two three", " \t ", "one two three"]
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


def brute_components(rows, n, share):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("seed", "n", "share"), [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_similar_texts(spark, seed, n, share):
    rows = near_copies(seed)
    d = docs(spark, rows).repartition(3).withColumn("component_id", F.lit("clash"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(d, n=n, share=share).collect()}
    assert got == brute_components(rows, n, share)


def test_similar_texts_odd_tables(spark):
    assert jaccard.join(docs(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long), (1, long), (2, long + " end"), (None, long), (3, None), (3, "")]
    got = sorted(map(tuple, jaccard.join(docs(spark, rows)).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, None), (3, 3), (3, 3)], key=str)


def test_hubs_that_miss_members_lose_no_link(spark, monkeypatch):
    """Chains of copies: no centre is similar to all, so later rounds and the exact last one must find the rest."""
    base = [f"t{i}" for i in range(60)]
    rows = [(k, " ".join(base[k * 3 : k * 3 + 40])) for k in range(7)] + [(20 + k, " ".join([*base[:40], f"x{k}"])) for k in range(5)]
    for rounds, few, members in ((0, 32, 128), (0, 0, 3), (1, 0, 128), (1, 2, 2), (3, 32, 128)):
        monkeypatch.setattr(jaccard, "ROUNDS", rounds)
        monkeypatch.setattr(jaccard, "FEW", few)
        monkeypatch.setattr(jaccard, "MEMBERS", members)
        monkeypatch.setattr(jaccard, "POSTINGS", rounds + 1)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs(spark, rows), n=2, share=80).collect()}
        assert got == brute_components(rows, 2, 80)


def test_many_unlike_texts_under_one_gram(spark, monkeypatch):
    """Texts that all share a line and little else, and some near copies among them."""
    monkeypatch.setattr(shared, "HOT", 10)
    monkeypatch.setattr(shared, "HOT_SHARE", 100)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    monkeypatch.setattr(jaccard, "FEW", 5)
    monkeypatch.setattr(jaccard, "MEMBERS", 20)
    rows = [(i, f"a b c d e x{i // 2 % 45}" + " y" * (i % 2)) for i in range(90)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs(spark, rows), n=2, share=70).collect()}
    assert got == brute_components(rows, 2, 70)


@pytest.mark.parametrize("kind", ["smallint", "decimal(12,0)", "string", "date"])
def test_similar_texts_with_other_keys(spark, kind):
    key = F.expr("date_add(date'2020-01-01', int(doc_id))") if kind == "date" else F.col("doc_id").cast(kind)
    d = docs(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words in this text")]).withColumn("doc_id", key)
    rows = {r["doc_id"]: r["component_id"] for r in jaccard.join(d).collect()}
    assert len(rows) == 3 and sorted(rows.values())[:2] == [min(rows)] * 2


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(50)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(rows, window=50):
    seen, out = {}, {}
    by = {}
    for i, t in rows:
        by.setdefault(i, []).append((t or "").encode())
    for i in sorted(by):
        for b in by[i]:
            gone = bytearray(len(b))
            for s in range(len(b) - window + 1):
                if b[s : s + window] in seen:
                    gone[s : s + window] = b"\1" * window
            spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
            kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
            out.setdefault(i, []).append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
        for b in by[i]:
            for s in range(len(b) - window + 1):
                seen[b[s : s + window]] = i
    return {k: sorted(v) for k, v in out.items()}


def passages(seed):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abcdefgh ", "xyzé\0 "])
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(rng.choice([49, 50, 51, 80, 300])) for _ in range(6)]
    rows = []
    for i in range(40):
        parts = [rng.choice(shared)[rng.randint(0, 5) :] if rng.random() < 0.5 else text(rng.randint(0, 90)) for _ in range(rng.randint(0, 5))]
        rows.append((i * 3, "".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (4, rows[5][1]), (4, rows[5][1]), (5, None), (6, ""), (7, "ab" * 900), (8, "ba" * 500)]
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_repeated_passages(spark, seed, monkeypatch):
    rows = passages(seed)
    got = {}
    for r in suffixes.dedupe_digests(docs(spark, rows).repartition(3)).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in got.items()} == brute_removed(rows)


def test_repeated_passages_with_ids_that_share_their_lower_half(spark):
    """As monotonically_increasing_id() gives them; with so many some are in the smallest one's chunk."""
    rows = [(1 + (k << 32), "ab" * 20 + "one passage that every copy has" * 3) for k in range(60)]
    got = {r["doc_id"]: [tuple(r)[1:]] for r in suffixes.dedupe_digests(docs(spark, rows)).collect()}
    assert got == brute_removed(rows) and got[1][0][1] < got[1 + (1 << 32)][0][1]
    ids, texts = [1, 1 + (1 << 32), -1], ["same"] * 3
    assert len(set(suffixes._rows(pa.table({"doc_id": ids, "text": texts}), "doc_id", "text")[2].tolist())) == 3


def test_repeated_passages_in_long_texts(monkeypatch):
    """Segments of a text longer than a buffer name the same windows as the whole."""
    rng = random.Random(7)
    raw = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = {}
    for size in (1 << 20, 1 << 9):
        monkeypatch.setattr(suffixes, "BUFFER", size)
        monkeypatch.setattr(suffixes, "CELL", np.uint64(size - 1))
        monkeypatch.setattr(suffixes, "_POWERS", [])
        found = {}
        for buf, starts, sizes, _, offset in suffixes._buffers([raw]):
            p, first, last, h = suffixes.anchors(buf, starts, sizes)
            seg = np.searchsorted(starts, p, "right") - 1
            for a, f, e, x, o in zip(p, first, last, h, offset[seg] - starts[seg], strict=True):
                found |= {int(s + o): (int(a + o), int(x)) for s in range(f, e + 1)}
        whole[size] = found
    assert sorted(whole[1 << 20]) == list(range(len(raw) - 49)) and {k: v[0] for k, v in whole[1 << 20].items()} == {k: v[0] for k, v in whole[1 << 9].items()}


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(9)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        lcp = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))
        shared = [[0, *(lcp(a, b) for a, b in zip(r, r[1:], strict=False))][: len(r)] for r in runs]
        order, known = suffixes.merge(runs, shared)
        heads, out = [iter(r) for r in runs], []
        out = [next(heads[i]) for i in order]
        assert out == sorted(x for r in runs for x in r)
        assert known[1:] == [lcp(a, b) for a, b in zip(out, out[1:], strict=False)]


def test_repeated_passages_keep_rows_and_columns(spark):
    d = docs(spark, [(1, "x" * 30 + "é" * 40), (2, "y" + "é" * 40 + "z"), (None, "é" * 40), (3, None)]).withColumn("n_bytes", F.lit("clash"))
    rows = {r["doc_id"]: r for r in suffixes.dedupe(d).collect()}
    assert len(rows) == 4 and rows[1]["text"] == "x" * 30 + "é" * 40 and rows[2]["text"] == "yz" and rows[3]["text"] is None and rows[None]["text"] == "é" * 40
    assert suffixes.dedupe(docs(spark, [])).count() == 0 and suffixes.dedupe_digests(docs(spark, [])).count() == 0


def test_archives(spark):
    html = ["<p>a</p>", "<p>a</p>", "", None, "tricky\r\n\r\nWARC/1.1\r\n", "<p>a</p>", "é😀", "tricky\r\n\r\nWARC/1.1\r\n", "x" * 200_000]
    pages = spark.createDataFrame([(9 - i, f"http://e/{i}\r\nX: y" if i % 2 else None, h) for i, h in enumerate(html)] + [(None, "u", "<p>a</p>")], "page_id long, url string, html string")
    path = fresh_path(spark, "warc")
    warc.write(warc.resolve(pages.withColumn("payload", F.lit("clash")).withColumn("key", F.lit(0))), path)
    rows = {r["key"]: r for r in warc.joined_revisits(warc.read(spark, path)).collect()}
    assert len(rows) == 10
    few = fresh_path(spark, "warc")
    warc.write(warc.resolve(pages), few, records_per_file=2)
    files = warc.read(spark, few).groupBy(F.input_file_name()).count().collect()
    assert len(spark.read.format("binaryFile").load(few).select("path").collect()) >= 5 and sum(r["count"] for r in files) == 10
    for i, h in enumerate(html):
        raw, r = (h or "").encode(), rows[9 - i]
        first = min(9 - j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == 9 - i else ("revisit", first))
        assert (r["payload"] == raw) if r["record_type"] == "response" else r["payload"] is None
    assert rows[None]["record_type"] == "response"
    empty = fresh_path(spark, "warc")
    warc.write(warc.resolve(pages.limit(0)), empty)
    assert warc.read(spark, empty).count() == 0
    some = fresh_path(spark, "warc")
    warc.write(warc.resolve(pages, least_bytes=9), some)
    assert {r["key"] for r in warc.read(spark, some).where("record_type = 'revisit'").collect()} == {5}


def test_archives_with_a_common_payload_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT", 5)
    monkeypatch.setattr(shared, "HOT_SHARE", 10)
    html = ["" if i % 3 == 0 else f"p{i % 20}" for i in range(200)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)] + [(5, "u", html[5]), (65, "u", html[65])], "page_id long, url string, html string")
    path = fresh_path(spark, "warc")
    warc.write(warc.resolve(pages), path)
    got = [(r["key"], r["record_type"], r["refers_to"]) for r in warc.joined_revisits(warc.read(spark, path)).collect()]
    first = {h: html.index(h) for h in html}
    want = [(i, "response", None) if first[h] == i else (i, "revisit", first[h]) for i, h in enumerate(html)]
    assert sorted(got, key=str) == sorted([*want, want[5], want[65]], key=str)


def vectors(spark, seed, n=600, size=16):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, size)).astype(np.float32)
    m[100:140] = m[100]
    m[7] = 0
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(m)]
    rows += [(1000, None, 0), (1050, [1.0, None] + [0.0] * (size - 2), 0), (1100, [float("nan")] * size, 0), (1150, [float("inf")] * size, 0), (1200, [], 0), (None, rows[3][1], 0)]
    return m, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("clash")).withColumn("score", F.lit(1))


def test_rows_without_a_key_are_spread(spark):
    rows = docs(spark, [*((None, f"text {i}") for i in range(60)), (1, "same"), (2, "same")]).repartition(4)
    d, _ = suffixes._plan(rows, "doc_id", "text")
    assert d.where("doc_id is null").select("__chunk").distinct().count() > 2
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = warc.resolve(rows, "doc_id", "text", "lang").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert len(got) == 62 and len({r["task"] for r in got if r["key"] is None}) > 2
    assert {r["key"]: r["refers_to"] for r in got} == {None: None, 1: None, 2: 1}


@pytest.mark.parametrize("lists", [1, 2, 4])
def test_exact_topk(spark, lists, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 200)
    monkeypatch.setattr(topk, "QUERIES", 10)
    m, v = vectors(spark, lists)
    ints = np.floor(256 * m.astype(float)).astype(np.int64)
    got = {}
    for r in topk.search(v, F.col("vec_id") % 10 == 0, lists=lists).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for q in range(0, 600, 10):
        s = sorted((-int(ints[q] @ ints[c]), c) for c in range(600) if c != q)[:5]
        want[q] = [(k, c, -x) for k, (x, c) in enumerate(s, 1)]
    assert {q: sorted(x) for q, x in got.items()} == want


def test_topk_with_few_and_no_rows(spark):
    three = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, -2.0]), (2, [0.0, 0.0]), (2, [9.0, 0.0])], "vec_id long, embedding array<double>")
    rows = topk.search(three, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in rows] == [(2, 0), (1, 65536 - 4 * 65536)]
    assert topk.search(three.limit(0), F.col("vec_id") == 0).count() == 0
    near = ann.search(three, F.col("vec_id") == 0)
    assert [r["vec_id"] for r in near.orderBy("rank").collect()] == [1, 2]
    assert ann.search(three.limit(0), F.col("vec_id") == 0).count() == 0


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 150)
    monkeypatch.setattr(ann, "BLOCK", 20)
    monkeypatch.setattr(ann, "PIECE", 16)
    m, v = vectors(spark, 8)
    x = m.astype(float)
    got = {}
    for r in ann.search(v, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(0, 600, 10):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [c for _, c in sorted((d[c], c) for c in range(600) if c not in (q, 7))[:10]]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 11)) and all(abs(d[c] - s) < 1e-9 for _, c, s in rows) and q not in {c for _, c, _ in rows}
        hits += len(set(want) & {c for _, c, _ in rows})
        total += 10
    assert hits / total >= 0.95
    assert [c for _, c, _ in sorted(got[110])] == [c for c in range(100, 111) if c != 110]


def test_exact_topk_of_equal_vectors(spark):
    """A third of all rows and of the queries share one vector, others are equal in pairs; ids break the ties."""
    rng = np.random.default_rng(8)
    data = [(i, [0.5] * 8 if i % 3 == 0 else rng.normal(size=8).round(1).tolist()) for i in range(240)]
    data += [(i + 240, list(data[i][1])) for i in range(1, 60, 3)] + [(7, list(data[7][1]))]
    v = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    ints = {i: np.floor(256 * np.array(x)).astype(int) for i, x in data}
    got = {}
    for r in topk.search(v, F.col("vec_id") % 2 == 0, k=4, lists=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (i for i in ints if i % 2 == 0):
        want = sorted(((-int(ints[q] @ x), i) for i, x in ints.items() if i != q))[:4]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]


def test_topk_blocks_are_not_broadcast(spark, tmp_path):
    """Queries repeated for each block of candidates would go through the driver, many times as large as estimated."""
    from plyscope.llm import topk

    blocks = spark.range(8).selectExpr("cast(id as int) as c", "0 as l", "4 as n", "binary('i') as ids", "binary('m') as m")
    blocks.write.parquet(f"{tmp_path}/c")
    candidates = spark.read.parquet(f"{tmp_path}/c").repartition(4, "c", "l", "n")
    own = spark.range(3).selectExpr("explode(sequence(0, 7)) as c", "0 as l", "4 as n", "binary('q') as qids", "binary('x') as qm", "binary('') as bounds").repartition(4, "c", "l", "n")
    both = topk._pairs(own, candidates)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and both.count() == 24
