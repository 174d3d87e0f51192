"""Graph queries take all plies of a game: checked against brute force on a few games longer than any default depth."""

import datetime
import random

import pytest
from plyscope import catalog
from plyscope.operators import graph, lookup
from plyscope.plans import base
from plyscope.sources.tables import TOKENS

SIZES = (53, 24, 9)


@pytest.fixture(scope="module")
def games(spark, tmp_path_factory):
    """A folder with the tables, and its edges as {parent: {(token, child)}}."""
    folder, rng = str(tmp_path_factory.mktemp("games")), random.Random(3)
    events, edges, at = [], {}, datetime.datetime(2024, 1, 1)
    for game, size in enumerate(SIZES):
        place = [0] * len(TOKENS)
        for ply in range(size):
            token = rng.randrange(len(TOKENS)) if ply > 4 else ply % 2
            events.append((len(events), game, at + datetime.timedelta(seconds=ply), TOKENS[token]))
            parent = ".".join(map(str, place))
            place[token] += 1
            edges.setdefault(parent, set()).add((TOKENS[token], ".".join(map(str, place))))
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz, event_type string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame([(n, f"N{n}") for n in range(25)], "n_nationkey int, n_name string").coalesce(1).write.parquet(f"{folder}/nation.parquet")
    return folder, edges


def played(key):
    return sum(map(int, key.split(".")))


def rows(spark, games, name):
    return [tuple(r) for r in catalog.QUERIES[name](spark, games[0]).collect()]


def test_moves_of_all_plies(spark, games):
    want = {(p, t, c) for p, moves in games[1].items() for t, c in moves}
    assert {tuple(r) for r in base.graph(spark, games[0]).collect()} == want
    assert {r[:3] for r in rows(spark, games, "jon_04_children")} == want
    assert {(r[0], r[1]) for r in rows(spark, games, "prj_12_move_rows")} == {w[:2] for w in want}
    assert {r[0] for r in rows(spark, games, "jon_06_openings")} == set(games[1])
    assert len(rows(spark, games, "prj_09_last_opening")) == sum(SIZES)


def test_searches_reach_all_plies(spark, games):
    found = graph.reachable(base.graph(spark, games[0]), spark.createDataFrame([(base.ROOT,)], "pos_key string"), depth=None).collect()
    assert {r["pos_key"]: r["depth"] for r in found} == {k: played(k) for k in {*games[1], *(c for m in games[1].values() for _, c in m)}}
    known = {r["pos_key"]: r for r in base.positions(spark, games[0]).collect()}
    hits = [k for k, r in known.items() if r["has_cp"] and r["dtm"] == 0 and abs(r["cp"]) >= 300]
    assert sum(r[2] for r in rows(spark, games, "grf_05_extreme_by_depth")) == len(hits)
    assert [r[0] for r in rows(spark, games, "srt_08_batch")] == sorted(hits, key=lambda k: (played(k), k))[:50]


def test_expected_depths_are_proven_or_searched_for(spark):
    """Right ones are confirmed by one join; of wrong, missing or unfounded ones the search makes up for all."""
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "b"), ("x", "y"), ("y", "x"), ("d", "d")]
    right = {"a": 0, "b": 1, "c": 1, "d": 2}
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    moves, root = frame(edges, "parent_key string, child_key string"), frame([("a",)], "pos_key string")
    wrong = [right | {"c": 2}, right | {"d": 1}, {"a": 0, "b": 1, "c": 1}, right | {"x": 1, "y": 2}, right | {"x": 0}, right | {"a": 1}, {"b": 1, "c": 1, "d": 2}]
    for depths, holds in [(right, True), *((w, False) for w in wrong)]:
        expected = frame(list(depths.items()), "pos_key string, depth int")
        assert graph.fewest(moves.withColumnRenamed("parent_key", "pos_key"), root, expected) is holds, depths
    for depths in (right, wrong[0], wrong[3]):
        found = graph.reachable(moves, root, depth=None, expected=frame(list(depths.items()), "pos_key string, depth int")).collect()
        assert {r["pos_key"]: r["depth"] for r in found} == right and len(found) == 4
    stored = frame([("a",), ("b",), ("c",)], "pos_key string")
    found = graph.reachable(moves, root, stored, None, frame(list(right.items()), "pos_key string, depth int")).collect()
    assert {r["pos_key"]: r["depth"] for r in found} == {"a": 0, "b": 1, "c": 1}


def test_depths_of_games_need_no_search(spark, games, monkeypatch):
    """What games have at their plies is confirmed, so the rounds, whose number grows with the longest game, aren't run."""
    monkeypatch.setattr(graph, "LEVELS", None)
    assert len(rows(spark, games, "grf_04_reachable")) == len(games[1])
    assert rows(spark, games, "grf_05_extreme_by_depth") and len(rows(spark, games, "srt_08_batch")) <= 50


def brute_proof(edges):
    """Outcomes from the last positions on, deepest first."""
    known = {}
    for k in {c for m in edges.values() for _, c in m} - set(edges):
        code = sum((i + 1) * int(x) for i, x in enumerate(k.split("."))) % 4
        if code != 3:
            known[k] = ("draw" if code == 1 else "loss", 0)
    for k in sorted(edges, key=played, reverse=True):
        found = [known.get(c) for _, c in edges[k]]
        lost = [f[1] for f in found if f and f[0] == "loss"]
        if lost:
            known[k] = ("win", min(lost) + 1)
        elif all(found):
            known[k] = ("draw", 0) if any(f[0] == "draw" for f in found) else ("loss", max(f[1] for f in found) + 1)
    return known


def test_proof_of_all_plies(spark, games):
    want = brute_proof(games[1])
    assert {r[0]: r[1:] for r in rows(spark, games, "grf_07_proof")} == want


def test_small_jobs_take_all_games_and_plies(spark, games):
    want = {(g, n) for g, size in enumerate(SIZES) for n in range(1, (size + 1) // 2 + 1)}
    assert {r[:2] for r in rows(spark, games, "fn_26_move_rows")} == want
    assert {r[0] for r in rows(spark, games, "jon_01_lookup")} == {x + k for k in games[1] for x in ("", "x")}
    known = {r["pos_key"]: r["cp"] if r["has_cp"] else None for r in base.positions(spark, games[0]).collect()}
    depth, front = {base.ROOT: 0}, [base.ROOT]
    for d in range(1, 7):
        best = [sorted(games[1].get(p, ()), key=lambda m: (known.get(m[1]) is None, (1 if played(p) % 2 else -1) * (known.get(m[1]) or 0), m[0]))[:5] for p in front]
        front = sorted({c for moves in best for _, c in moves} - set(depth))
        depth |= dict.fromkeys(front, d)
    assert dict(rows(spark, games, "grf_06_beam")) == depth


def pairs(a, b):
    hits = {i: [j for j, p, q in b if p <= high and q >= low] for i, low, high in a}
    return {i: (len(h), min(h)) for i, h in hits.items() if h}


def test_overlapping_files_of_all_games(spark, games):
    p = base.event_plies(spark, games[0]).collect()
    files = [(g, min(r["pos_key"] for r in p if r["game_id"] == g), max(r["pos_key"] for r in p if r["game_id"] == g)) for g in range(len(SIZES))]
    assert {r[0]: r[1:] for r in rows(spark, games, "jon_09_overlapping_files")} == pairs(files[::2], files[1::2])


@pytest.mark.parametrize("most", [6, 40, 3000])
def test_overlaps_are_those_of_pairs(spark, most):
    rng = random.Random(most)
    made = lambda n: [(i, *sorted(f"{rng.randrange(most):05d}" for _ in range(2))) for i in range(n)]
    a, b = made(120), made(90)
    a.append((999, "99999", "99999"))
    frame = lambda t: spark.createDataFrame(t, "id long, low string, high string")
    found = lookup.overlaps(frame(a), frame(b)).collect()
    assert {r["a_id"]: (r["files"], r["first"]) for r in found} == pairs(a, b) and 999 not in {r["a_id"] for r in found}
    assert len(found) == len(pairs(a, b))
