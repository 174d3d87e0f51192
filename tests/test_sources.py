"""Game, opening and evaluation files."""

import gzip

import pyarrow as pa
import pytest
from plyscope.operators import counts as C
from plyscope.operators import graph as G
from plyscope.sources import evaluations as E
from plyscope.sources import games, openings
from plyscope.functions import rules
from pyspark.sql import functions as F

PGN = """[Event "One"]
[Site "a \\"b\\""]
[White "A"]
[WhiteElo "2400"]
[BlackElo "2300"]
[Result "1-0"]

1. e4 {best by test} e5 2. Nf3 (2. f4 exf4 (2... d5)) Nc6 $1 3. Bc4+ 1-0

[Event "Two"]
[WhiteElo "?"]
[BlackElo "2300"]
[Result "0-1"]

1. d4 d5 0-1

[Event "Three"]
[WhiteElo "2100"]
[BlackElo "2000"]
[Result "*"]

1. Nf3 e5 2. e4 Nc6 3. Ke5 Bc5 *

[Event "Four"]
[WhiteElo "2100"]
[BlackElo "2000"]
[Result "1/2-1/2"]

1/2-1/2
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.pgn").write_text(PGN)
    (tmp_path / "notes.txt").write_text(PGN)
    return tmp_path


def test_games_are_read_filtered_and_replayed(spark, folder):
    rows = games.read(spark, str(folder)).cache()
    by = {r["tags"][0]["value"]: r for r in rows.collect()}
    assert set(by) == {"One", "Two", "Three", "Four"}
    assert by["One"]["moves"] == ["e4", "e5", "Nf3", "Nc6", "Bc4+"] and (by["One"]["white_elo"], by["One"]["black_elo"], by["One"]["result"]) == (2400, 2300, "1-0")
    assert by["Two"]["white_elo"] == 0 and by["Four"]["moves"] == []
    good = games.rated(rows)
    assert good.count() == 2 and games.rated(rows, None).count() == 3
    plies = games.replay(good)
    assert plies.count() == 5 + 4  # the third game ends at its illegal move
    c = {r["pos_key"]: tuple(r)[1:] for r in C.count_positions(plies).collect()}
    start = rules.key(rules.from_fen(rules.START))
    assert c[start] == (1, 0, 0)
    # both games reach this by different orders; Black is to move in the first and lost it, the second has no result
    italian = [k for k, v in c.items() if k.startswith("r1bqkbnr/pppp1ppp/2n5/4p3/4P3/5N2")]
    assert len(italian) == 1 and c[italian[0]] == (1, 0, 0)
    assert plies.where(F.col("pos_key") == italian[0]).count() == 1


def test_compressed_games(spark, tmp_path):
    import zstandard

    half = PGN.index('[Event "Three')
    frames = [zstandard.ZstdCompressor().compress(x.encode()) for x in (PGN[:half], PGN[half:])]
    (tmp_path / "b.pgn.zst").write_bytes(b"".join(frames))
    assert games.read(spark, str(tmp_path)).count() == 4


def test_streamed_games_give_the_counts_of_the_batch(spark, folder, tmp_path):
    from plyscope.streaming import ingest as I

    store, progress = f"file://{tmp_path}/store", f"{tmp_path}/progress"
    play = lambda batch: games.replay(games.rated(batch))
    want = sorted(map(tuple, C.count_positions(games.replay(games.rated(games.read(spark, f"{folder}/a.pgn")))).collect()))
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.pgn").write_text(PGN)
    for _ in range(2):  # a second run finds nothing new
        I.ingest(games.stream(spark, str(source)), store, progress, play, trigger={"availableNow": True}).awaitTermination()
        assert sorted(map(tuple, I.read_counts(spark, store).collect())) == want
    (source / "b.pgn").write_text(PGN)
    I.ingest(games.stream(spark, str(source)), store, progress, play, trigger={"availableNow": True}).awaitTermination()
    twice = sorted((k, 2 * w, 2 * d, 2 * x) for k, w, d, x in want)
    assert sorted(map(tuple, I.read_counts(spark, store).collect())) == twice
    assert I.compact(spark, store) == 1 and I.layers(spark, store)[1] == [f"{store}/base/batches=0-1"]
    assert sorted(map(tuple, I.read_counts(spark, store).collect())) == twice
    assert I.vacuum(spark, store) == 2 and sorted(map(tuple, I.read_counts(spark, store).collect())) == twice
    # a batch that is tried again replaces itself
    C.count_positions(games.replay(games.rated(games.read(spark, f"{folder}/a.pgn")))).write.mode("overwrite").parquet(f"{store}/delta/batch=2")
    C.count_positions(games.replay(games.rated(games.read(spark, f"{folder}/a.pgn")))).write.mode("overwrite").parquet(f"{store}/delta/batch=2")
    assert sorted(map(tuple, I.read_counts(spark, store).collect())) == sorted((k, 3 * w, 3 * d, 3 * x) for k, w, d, x in want)
    assert I.read_counts(spark, f"{store}-none").count() == 0


def test_bases_double_in_size(spark, tmp_path):
    """Every compaction merges what has come in with bases of that size, and nothing is counted twice or lost."""
    from plyscope.streaming import ingest as I

    store = f"file://{tmp_path}/store"
    bases = []
    for n in range(8):
        spark.createDataFrame([("a", 1, 0, 0), (f"k{n}", 0, n, 0)], I.COUNTS).coalesce(1).write.parquet(f"{store}/delta/batch={n}")
        assert I.compact(spark, store, 3 if n == 7 else 1) == min(n, 6)
        bases.append(len([x for x in I.layers(spark, store)[1] if "/base/" in x]))
    assert bases == [1, 1, 2, 1, 2, 2, 3, 3]
    want = sorted([("a", 8, 0, 0)] + [(f"k{n}", 0, n, 0) for n in range(8)])
    assert sorted(map(tuple, I.read_counts(spark, store).collect())) == want
    assert I.vacuum(spark, store) == 7 + 4  # the deltas but the last, and the bases 0-0, 2-2, 0-1 and 4-4
    assert sorted(map(tuple, I.read_counts(spark, store).collect())) == want


def test_openings(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("eco\tname\tpgn\nB00\tKing's Pawn\t1. e4\nC50\tItalian\t1. e4 e5 2. Nf3 Nc6 3. Bc4\nbroken\nX\tbad\t1. e5\nB01\tKing's Pawn again\t1. e4\n")
    known = openings.by_position(games.line_key(openings.read(spark, str(tmp_path))), F.col("pos_key"))
    found = {r["eco"]: r["name"] for r in known.collect()}
    assert found == {"B01": "King's Pawn again", "C50": "Italian"}
    lines = spark.createDataFrame([(["e4"],), (["e4", "e5", "Nf3", "Nc6", "Bc4"],), (["d4"],)], "moves array<string>")
    assert [r["eco"] for r in openings.named(games.line_key(lines), known).orderBy(F.size("moves"), F.col("eco").desc_nulls_last()).collect()] == ["B01", None, "C50"]


def test_expansion_and_proof(spark):
    """A king in the corner: mate in one, found from the moves alone."""
    fen = "k7/8/1K6/8/8/8/8/7R w - -"
    first = games.expand(spark.createDataFrame([(fen,), ("junk",)], "pos_key string")).cache()
    assert first.where("uci = 'h1h8'").select("token").first()[0] == "Rh8"
    second = games.expand(first.select(F.col("child_key").alias("pos_key"))).cache()
    ends = second.where("uci is null").select(F.col("parent_key").alias("pos_key"), F.when(F.col("token") == "checkmate", "loss").otherwise("draw").alias("kind"), F.lit(0).alias("distance"))
    proof = {r["pos_key"]: (r["kind"], r["distance"]) for r in G.prove(first.select("parent_key", "child_key"), ends).collect()}
    assert proof[fen] == ("win", 1)


def test_evaluations_are_imported_and_exported(spark, tmp_path):
    import base64

    key = bytes(range(26))
    sixty, hexed = base64.urlsafe_b64encode(key).decode(), bytes(range(1, 27)).hex()
    (tmp_path / "new.csv").write_text(f"fen,position,cp,dtm,dtz,proven_depth\nf,{sixty},35,0,1,32770\nf,{hexed},99999,x,-4,7\nf,zz,1,1,1,1\n")
    with gzip.open(tmp_path / "old.csv.gz", "wt") as f:
        f.write(f"position,cp,dtm,dtz,proven_depth\n{hexed},0,-5,0,1\n{hexed},0,0,0,1\n")
    rows = E.read(spark, str(tmp_path)).cache()
    got = sorted(((r["pos_key"] or "", r["cp"], r["has_cp"], r["dtm"], r["dtz"], r["proven_depth"]) for r in rows.collect()))
    assert got == sorted([("", 1, True, 1, 1, 1), (key.hex().upper(), 35, True, 0, 1, 2), (hexed.upper(), 32767, True, 0, 0, 7), (hexed.upper(), 0, True, -5, 0, 1), (hexed.upper(), 0, True, 0, 0, 1)])
    assert {r["rejected"] for r in E.rejected(rows).collect()} == {0, 1}
    assert sorted(r["has_cp"] for r in E.read(spark, f"{tmp_path}/old.csv.gz", log=True).collect()) == [False, True]
    stored = rows.where("cp = 35").select("pos_key", "cp", "dtm", "dtz")
    assert E.changed(rows, stored).count() == 0 and E.changed(rows, stored, create_missing=True).count() == 3
    assert E.changed(rows.withColumn("dtz", F.col("dtz") + 1), stored).count() == 1
    out = f"{tmp_path}/out"
    E.export(C.overlay(spark.createDataFrame([("A" * 52, 1, 2, 3)], "pos_key string, wins long, draws long, losses long"), C.latest_evaluations(rows.where("pos_key is not null"))), out)
    back = {r["pos_key"]: (r["cp"], r["dtm"]) for r in E.read(spark, out).collect()}
    assert back[key.hex().upper()] == (35, 0) and len(back) == 2


def test_variations_of_any_depth(spark):
    deep = "1. e4 " + "(1. d4 " * 12 + "d5" + ")" * 12 + " e5 {a ) in a comment} 2. Nf3 (2. f4 exf4) (2. Nc3) Nc6 *"
    row = spark.createDataFrame([(deep,), ("1. e4 ) e5 (",)], "t string").select(*games.parse(F.col("t"))).collect()
    assert row[0]["moves"] == ["e4", "e5", "Nf3", "Nc6"] and row[1]["moves"] == ["e4", "e5"]


def test_positions_that_are_not_are_left_out(spark):
    rows = spark.createDataFrame([("8/8/8/8/8/8/8/8 w - -",), ("4k3/8/8/8/8/8/8/4K3 w X -",), (None,), ("7k/5Q2/6K1/8/8/8/8/8 b - -",)], "pos_key string")
    assert [tuple(r) for r in games.expand(rows).collect()] == [("7k/5Q2/6K1/8/8/8/8/8 b - -", None, "stalemate", None)]
    keys = games.key_of_fen(rows.withColumnRenamed("pos_key", "fen")).collect()
    assert [r["pos_key"] is None for r in keys] == [True, True, True, False]


def test_files_are_archived_once_done(spark, tmp_path):
    """A stream's finished game files move to the archive."""
    for n in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"g{n}.pgn").write_text(f'[Event "{n}"]\n[Result "1-0"]\n\n1. e4 e5 1-0\n')
        q = games.stream(spark, str(tmp_path / "in"), archive=str(tmp_path / "done")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3 and any((tmp_path / "done").rglob("*.pgn"))


def test_a_task_hands_plies_on_in_bounded_batches():
    """However many games come at once; before, all plies of a batch of games were one batch."""
    schema = pa.schema([("n", pa.int64())])
    taken = games._taken(pa.RecordBatch.from_pydict({"n": list(range(25_001))}))
    sizes = [b.num_rows for b in games._handed_on(taken, schema)]
    assert sizes == [10_000, 10_000, 5_001] and list(games._handed_on([], schema)) == []


def test_long_games_are_replayed_whole(spark):
    """Games whose plies fill several batches, a move that isn't legal, and no moves: as following each move by the rules."""
    moves = ["Nf3", "Nf6", "Ng1", "Ng8"] * 40
    rows = [(g, "1-0", moves[:g] + ["Ke4"] * (g % 2)) for g in range(160)]
    got = games.replay(spark.createDataFrame(rows, "game_id long, result string, moves array<string>").coalesce(1)).collect()
    assert sorted((r["game_id"], r["ply"]) for r in got) == [(g, n) for g in range(160) for n in range(g)]
    p, keys = rules.from_fen(rules.START), []
    for m in moves:
        keys.append(rules.key(p))
        p = rules.apply(p, rules.from_san(p, m))
    assert all(r["pos_key"] == keys[r["ply"]] and r["child_key"] == (keys + [rules.key(p)])[r["ply"] + 1] for r in got)
    lines = spark.createDataFrame([(str(g), m) for g, _, m in rows], "line string, moves array<string>").coalesce(1)
    assert sorted((int(r["line"]), r["ply"]) for r in games.paths(lines, "line").collect()) == [(g, n) for g in range(0, 160, 2) for n in range(g + 1)]
