"""Every registered query of the library gives the rows of its SQL, and the entry points hold together."""

import glob
import os

import duckdb
import pytest
from plyscope import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return int(v) if isinstance(v, float) and v.is_integer() else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_its_sql(spark, con, name):
    want = con.sql(catalog.SQL[name])
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda data: sorted(repr(tuple(map(plain, r))) for r in data)
    assert rows(want.select(", ".join(f'"{c}"' for c in cols)).fetchall()) == rows(got.select(*cols).collect())


def test_move_rows_of_many_games(spark, tmp_path):
    """Counts at halves, past the counters' cap and past a million: by the query as by its SQL."""
    from plyscope.functions.labels import thousands
    from pyspark.sql import functions as F

    sizes = {"error": 1250, "purchase": 70_000, "signup": 1_000_050}
    end = 0
    kind = F.lit(None).cast("string")
    for k, n in sizes.items():
        kind, end = F.when(F.col("id").between(end, end + n - 1), F.lit(k)).otherwise(kind), end + n
    games = spark.range(end).select(F.col("id").alias("user_id"), kind.alias("event_type"))
    both = games.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    both.select((F.col("user_id") * 2 + F.col("n")).alias("event_id"), "user_id", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, n)").alias("ts"), "event_type").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cols = ["parent_key", "token", "label", "class", "games"]
    got = sorted(repr(tuple(r)) for r in catalog.QUERIES["prj_12_move_rows"](spark, str(tmp_path)).select(*cols).collect())
    assert got == sorted(repr(r) for r in con.sql(catalog.SQL["prj_12_move_rows"]).select(*cols).fetchall())
    assert {"1.2K", "70.0K", f"{1000.05:.1f}K"} <= {eval(r)[4] for r in got}
    rows = spark.range(0, 200_000, 5).select("id", thousands(F.col("id")).alias("t")).collect()
    assert [r["t"] for r in rows] == [f"{r['id'] / 1000:.1f}K" if r["id"] >= 1000 else str(r["id"]) for r in rows]


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())
    assert catalog.QUERIES.keys() == catalog.SQL.keys()
