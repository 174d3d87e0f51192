"""Records and merging: facts of the storage format and of the merge rules."""

import itertools
import random

import pytest
from plyscope.functions import moves as M
from plyscope.functions import records as R
from plyscope.functions import text as S
from plyscope.operators import counts as C
from plyscope.operators import explore as X
from plyscope.operators import graph as G
from plyscope.operators import lookup as K
from pyspark.sql import functions as F

COUNTS = "pos_key string, wins long, draws long, losses long"
EVALS = "pos_key string, cp int, has_cp boolean, dtm int, dtz int, proven_depth int, seq long"


def test_distances_to_mate(spark):
    rows = {0: ("unknown", 0), 32767: ("loss", 0), 32766: ("loss", 0), 5: ("win", 5), -10: ("loss", 10), -32768: ("draw", 0), -32668: ("draw", 100), 1: ("win", 1), 16384: ("win", 16384), 16385: ("unknown", 0), 32765: ("unknown", 0), -1: ("loss", 1), -16384: ("loss", 16384), -16385: ("draw", 16383)}
    d = spark.createDataFrame([(x,) for x in rows], "x int")
    got = {r["x"]: (r["k"], r["d"]) for r in d.select("x", R.dtm_kind(F.col("x")).alias("k"), R.dtm_distance(F.col("x")).alias("d")).collect()}
    assert got == rows


def test_saturating_sums(spark):
    rows = [(100, 200, 300), (65000, 1000, 65535), (100, 50, 150), (100, -150, 0), (65000, 1000, 65535)]
    d = spark.createDataFrame(rows, "a long, b long, c long")
    assert d.where(R.add_capped(F.col("a"), F.col("b")) != F.col("c")).count() == 0


def test_packed_moves(spark):
    rows = [("e2e4", 12, 28, 0), ("e7e8q", 52, 60, 1), ("a7a8r", 48, 56, 2), ("c7c8b", 50, 58, 3), ("b7b8n", 49, 57, 4), ("xyz", None, None, None), ("e2e", None, None, None)]
    m = spark.createDataFrame(rows, "uci string, s int, t int, p int").withColumn("m", M.from_uci(F.col("uci")))
    for r in m.select("*", M.source(F.col("m")).alias("s2"), M.target(F.col("m")).alias("t2"), M.promotion(F.col("m")).alias("p2"), M.to_uci(F.col("m")).alias("back")).collect():
        assert (r["s"], r["t"], r["p"]) == (r["s2"], r["t2"], r["p2"]) and r["back"] == (r["uci"] if r["s"] is not None else None)


def test_counts_add_up_and_merging_in_any_grouping_agrees(spark):
    def layer(rows):
        return spark.createDataFrame(rows, COUNTS)

    a, b, c = layer([("1", 1, 0, 0), ("3", 3, 0, 0), ("5", 5, 0, 0)]), layer([("2", 2, 0, 0), ("3", 30, 0, 0), ("4", 4, 0, 0)]), layer([("1", 10, 0, 0), ("6", 6, 0, 0)])
    want = {"1": 11, "2": 2, "3": 33, "4": 4, "5": 5, "6": 6}
    for x, y, z in itertools.permutations((a, b, c)):
        assert {r["pos_key"]: r["wins"] for r in C.merge_counts(C.merge_counts(x, y), z).collect()} == want
    big = C.described(C.merge_counts(layer([("k", 60000, 0, 10)]), layer([("k", 10000, 0, 10)]), layer([("k", 5, 0, 5)]))).first()
    assert (big["wins"], big["losses"], big["wins_capped"], big["losses_capped"], big["wdl_saturated"]) == (70005, 25, 65535, 25, True)
    assert C.described(layer([("z", 0, 0, 0)])).first()["win_pct"] == 0.0


def test_the_latest_evaluation_counts_whole(spark):
    a = spark.createDataFrame([("x", 10, True, 0, 1, 5, 1), ("y", 0, False, 7, 0, 0, 1), ("z", 3, True, 0, 0, 0, 1)], EVALS)
    b = spark.createDataFrame([("x", 0, False, -3, 0, 0, 2), ("z", 9, False, 0, 9, 9, 2)], EVALS)
    got = {r["pos_key"]: (r["cp"], r["dtm"], r["seq"]) for r in C.latest_evaluations(a, b).collect()}
    assert got == {"x": (0, -3, 2), "y": (0, 7, 1), "z": (3, 0, 1)}
    both = {r["pos_key"]: r for r in C.overlay(spark.createDataFrame([("x", 1, 2, 3), ("w", 4, 0, 0)], COUNTS), C.latest_evaluations(a, b)).collect()}
    assert both["w"]["has_eval"] is False and both["w"]["cp"] is None and both["y"]["wins"] == 0 and both["y"]["has_eval"] and both["x"]["losses"] == 3


def test_keys_and_numbers_from_text(spark):
    import base64

    raw = bytes([255, 254, *range(24)])
    texts = [raw.hex(), base64.b64encode(raw).decode(), base64.b64encode(raw).decode().rstrip("="), base64.urlsafe_b64encode(raw).decode(), raw.hex()[:-1] + "g", "", raw.hex()[:50]]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in d.select(S.key_of(F.col("t"))).collect()] == [raw.hex().upper()] * 4 + [None] * 3
    n = spark.createDataFrame([("12",), ("-70000",), ("x",), ("",), ("?",), (None,), ("99999999999999999999",)], "t string")
    assert [r[0] for r in n.select(S.bounded(F.col("t"), -32768, 32767)).collect()] == [12, -32768, 0, 0, 0, 0, 0]
    assert [r[0] for r in n.select(S.rating(F.col("t"))).collect()] == [12, -70000, 0, 0, 0, 0, 0]
    assert (S.size_of("512m"), S.size_of("4G"), S.size_of("17")) == (512 << 20, 4 << 30, 17)
    with pytest.raises(ValueError):
        S.size_of("many")


def test_orders_and_pages(spark):
    rows = [("p", "a", "1", 0, 0, 0, True, True, 50, 0), ("p", "b", "2", 0, 0, 0, True, True, -50, 0), ("p", "c", "3", 0, 0, 0, True, False, 0, 4), ("p", "d", "4", 5, 0, 0, False, None, None, None), ("p", "e", "5", 9, 0, 0, False, None, None, None)]
    m = spark.createDataFrame(rows, "parent_key string, token string, child_key string, wins long, draws long, losses long, has_eval boolean, has_cp boolean, cp int, dtm int")
    order = lambda w: "".join(r["token"] for r in X.ranked(m, w).orderBy("rank").collect())
    assert order(X.server_order(F.lit(True))) == "acbed" and order(X.server_order(F.lit(False))) == "bcaed"
    assert order(X.client_order(F.lit(True))) == "cabed" and order(X.client_order(F.lit(False))) == "cbaed"
    page = X.page(m, X.server_order(F.lit(True)), 3, 3).orderBy("place").collect()
    assert [r["token"] for r in page] == ["e", "d", "a"]
    assert X.page(m, X.server_order(F.lit(True)), 3, 9).count() == 5
    top = X.top_moves(m, X.server_order(F.lit(True)), 99)
    assert top.where("is_top").count() == 3 and top.where("wins is not null").count() == 3


def test_ranges(spark):
    low = [i * 10 for i in range(10)]
    files = spark.createDataFrame([("g", f"{x:03d}", i) for i, x in enumerate(low)], "by string, low string, id int")
    keys = spark.createDataFrame([("g", "025"), ("g", "000"), ("g", "999"), ("h", "050")], "by string, pos_key string")
    assert {(r["by"], r["pos_key"]): r["id"] for r in K.rightmost(keys, files, "by").collect()} == {("g", "025"): 2, ("g", "000"): 0, ("g", "999"): 9, ("h", "050"): None}
    a = spark.createDataFrame([(1, "a", "f"), (2, "g", "k")], "id int, low string, high string")
    b = spark.createDataFrame([(7, "e", "g"), (8, "l", "z")], "id int, low string, high string")
    assert sorted(map(tuple, K.overlapping(a, b).collect())) == [(1, 7), (2, 7)]


def test_ranges_against_brute_force(spark):
    """One group holds most rows, and many keys and lows are equal; null groups and empty tables too."""
    pick = random.Random(5)
    lows = [(pick.choice("gggggh"), pick.randrange(40), i) for i in range(60)] + [(None, 3, 99)]
    keys = [(pick.choice("gggggh"), pick.randrange(60)) for _ in range(300)] + [("none", 5), (None, 2), (None, 7)]
    files = spark.createDataFrame(lows, "by string, low int, id int")
    want = [(g, k, max(((low, i) for h, low, i in lows if h == g and low <= k), default=(0, None))[1]) for g, k in keys]
    asked = spark.createDataFrame(keys, "by string, pos_key int")
    assert sorted(map(tuple, K.rightmost(asked, files, "by").collect()), key=repr) == sorted(want, key=repr)
    assert K.rightmost(asked, files.limit(0), "by").where("id is not null").count() == 0
    a, b = ([(i, x := pick.randrange(50), x + pick.randrange(-1, 15)) for i in range(40)] for _ in range(2))
    pairs = [(i, j) for i, x, y in a for j, u, v in b if x <= y and u <= v and x <= v and u <= y]
    ranges = "id int, low int, high int"
    assert sorted(map(tuple, K.overlapping(spark.createDataFrame(a, ranges), spark.createDataFrame(b, ranges)).collect())) == sorted(pairs)


def test_searches_end_on_cycles_and_proofs_are_minimal(spark):
    rng = random.Random(3)
    edges = [(f"n{a}", f"t{b}", f"n{b}") for a in range(30) for b in rng.sample(range(40), rng.randint(0, 3))]
    e = spark.createDataFrame(edges, "parent_key string, token string, child_key string")
    depth, front, d = {"n0": 0}, ["n0"], 0
    while front:
        d += 1
        front = list({c for p, _, c in edges if p in front and c not in depth})
        depth |= dict.fromkeys(front, d)
    root = spark.createDataFrame([("n0",)], "pos_key string")
    assert {r["pos_key"]: r["depth"] for r in G.reachable(e, root).collect()} == depth
    ends = {f"n{i}": rng.choice(["loss", "draw"]) for i in range(40) if not any(p == f"n{i}" for p, _, _ in edges)}
    known = {k: (v, 0) for k, v in ends.items()}
    for n in range(1, 45):
        new = {}
        for p in {x[0] for x in edges} - set(known):
            kids = [known.get(c) for q, _, c in edges if q == p]
            lost = [k[1] for k in kids if k and k[0] == "loss"]
            if lost:
                new[p] = ("win", min(lost) + 1)
            elif all(kids):
                new[p] = ("draw", 0) if any(k[0] == "draw" for k in kids) else ("loss", max(k[1] for k in kids) + 1)
        known |= {k: v for k, v in new.items() if v[1] <= n}
    terminals = spark.createDataFrame([(k, v, 0) for k, v in ends.items()], "pos_key string, kind string, distance int")
    assert {r["pos_key"]: (r["kind"], r["distance"]) for r in G.prove(e, terminals).collect()} == known
