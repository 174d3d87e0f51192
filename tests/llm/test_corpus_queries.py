"""Registered queries and the pipeline over small tables, against brute force."""

import hashlib
import sys
from pathlib import Path

import duckdb
import pytest
from plyscope.llm import queries
from pyspark.sql import functions as F
from test_corpus import brute_components, brute_removed, near_copies, passages

sys.path.insert(0, str(Path(__file__).parents[2]))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables in the driver's layout."""
    d = tmp_path_factory.mktemp("sf")
    rows = near_copies(5, 8, 10) + [(i + 500, t) for i, t in passages(1)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").dropDuplicates(["doc_id"])
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 3 % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, f"http://e/{i}", "p" * (i % 7)) for i in range(40)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.range(300).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.sin(F.col("id") * k).cast("float")).alias("embedding"), F.lit(0).alias("label")).write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.fixture(scope="module")
def texts(spark, tables):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_gives_the_same_rows(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, tables)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(repr, want.select(", ".join(sorted(want.columns))).fetchall())) == sorted(repr(tuple(r)) for r in got.select(*sorted(want.columns)).collect())


def test_similarity_and_passages(spark, tables, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op3_jaccard(spark, tables).collect()}
    assert got == brute_components(texts, 4, 85)
    rows = {r["doc_id"]: [tuple(r)[1:]] for r in queries.op5_suffixes(spark, tables).collect()}
    assert rows == brute_removed(texts)


def test_every_query_returns_its_whole_table(spark, tables, texts):
    for name in ("op1_bpe", "op2_secrets", "op9_quality", "op10_pii"):
        rows = queries.QUERIES[name](spark, tables)
        assert sorted(r["doc_id"] for r in rows.select("doc_id").collect()) == sorted(i for i, _ in texts)
    pieces = queries.op8_packing(spark, tables).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert len(pieces) == len(texts) and all(p["n"] == p["t"] for p in pieces)
    # row 0 is a zero vector, which takes no part
    assert queries.op4_ann(spark, tables).groupBy("query_id").count().where("count = 10").count() == 2


def test_pipeline_stages(spark, tables):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in P.STAGES[1:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == columns, name
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name == "near_duplicates":
            lowest = brute_components(rows, 5, 80)
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, _ in rows if lowest[i][1] == i)
        else:
            assert out.count() == len(rows) and out.where(F.length("text") != F.col("n_chars")).count() == 0
        if name == "passages":
            want = brute_removed(rows)
            for r in out.collect():
                raw = (r["text"] or "").encode()
                assert want[r["doc_id"]][0][1] or want[r["doc_id"]][0][3] == hashlib.sha256(raw).hexdigest()
        docs = out
    kept = P.STAGES[0][1](spark, spark.read.parquet(f"{tables}/documents.parquet"), tables)
    assert kept.columns == columns and kept.count() <= before
    assert {"doc_id", "sequence_id", "ids"} <= set(P.run(spark, tables).columns)


def odd_documents(spark, d, n_rows):
    """A folder with documents (null and empty texts, repeated rows, a very long text, clashing columns) and labels of some of them."""
    long = " ".join(f"w{i % 5000}x{i}" for i in range(60_000)) + " password=Zx9pQ4mN7tR2vB8w"
    rows = [(1, None), (2, ""), (3, "some good words that make a text. " * 3), (3, "some good words that make a text. " * 3), (4, long), (5, long), (None, "no key but words"), (6, "token: Zx9pQ4mN7tR2vB8wKq")][:n_rows]
    extra = (F.lit(1).alias("__chunk"), F.lit("c").alias("matches"), F.lit("d").alias("score"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").select("*", *extra)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 7)] * bool(n_rows), "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return docs


@pytest.mark.parametrize("n_rows", [0, 8])
def test_stages_take_odd_tables(spark, tmp_path, n_rows):
    """Each stage alone and all of them: columns stay, and only what a stage decides goes."""
    import corpus_pipeline

    docs = odd_documents(spark, str(tmp_path), n_rows)
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        left[name] = out.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= n_rows // 4
    if n_rows:
        assert left["quality"] == 8 and left["near_duplicates"] == 7 and left["passages"] == left["secrets"] == 8 and left["packing"] >= 8
    else:
        assert set(left.values()) == {0}


def test_pipeline_does_not_depend_on_partitions(spark, tables, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels"):
        spark.read.parquet(f"{tables}/{t}.parquet").repartition(5).write.parquet(f"{tmp_path}/{t}.parquet")
    pieces = lambda d: sorted(tuple(r)[:3] for r in corpus_pipeline.run(spark, d).groupBy("doc_id").agg(F.max("doc_tokens"), F.sum("length")).collect())
    assert pieces(tables) == pieces(str(tmp_path))
