"""Every registered query runs; those with a SQL twin give its rows."""

import os

import duckdb
import pandas as pd
import pytest

import stepweave.plans  # noqa: F401
from stepweave.plans.registry import QUERIES

SF = os.environ.get("STEPWEAVE_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def text(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype("float64").round(6)
    df = df.astype(str).replace({"nan": "None", "<NA>": "None", "NaT": "None"})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name].run(spark, SF).toPandas()
    assert len(got.columns)
    if QUERIES[name].sql:
        pd.testing.assert_frame_equal(text(got), text(db.execute(QUERIES[name].sql).df()), check_dtype=False)


def test_the_entry_point():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_rules_reach_the_scan(spark, db):
    plan = QUERIES["rule_pushdown"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag)" in plan and "l_comment" not in plan


def test_diff_ratio_reads_whole_texts(spark, tmp_path):
    import difflib

    head = "".join(chr(0x4E00 + i) for i in range(450))
    texts = [(1, head + "tail one", head + "quite another end"), (2, head[:400] + "x" * 900, head[:400]), (3, "same " * 300, "same " * 300), (4, "a", "b")]
    spark.createDataFrame([(i, a) for i, a, _ in texts], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, b) for i, _, b in texts], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.item_id: r.chars for r in QUERIES["diff_ratio"].run(spark, str(tmp_path)).collect()}
    assert got == {i: difflib.SequenceMatcher(None, a, b).ratio() for i, a, b in texts}


def test_threshold_pairs_of_all_vectors(spark, tmp_path, monkeypatch):
    import numpy as np

    from stepweave.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 16)
    x = np.random.default_rng(3).normal(size=(60, 6))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.query_id, r.vec_id): r.score for r in QUERIES["knn_threshold_all"].run(spark, str(tmp_path)).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosines = unit @ unit.T
    want = {(i, j): cosines[i, j] for i in range(60) for j in range(60) if i != j and 1 - cosines[i, j] < 0.7}
    assert got == pytest.approx(want, abs=1e-6) and max(i for i, _ in got) > 10


def repeated_lines(spark, path, *rows):
    """lineitem of (order, line number, flag, status, quantity), in one file, and a database that holds it."""
    spark.createDataFrame(list(rows), "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double").coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{path}/lineitem.parquet/*.parquet'")
    return con


RUNS = [(1, 1, "N", "O", 1.0), (1, 1, "R", "F", 50.0), (1, 1, "A", "O", 3.0), (1, 2, "N", "O", 2.0), (2, 1, "R", "O", 4.0), (2, 1, "N", "O", 4.0), (2, 1, "N", "O", 4.0)]


def test_runs_of_repeated_line_numbers(spark, tmp_path):
    """All lines count, whichever of a number comes first."""
    from stepweave.plans.metrics import _runs

    found = []
    for name, rows in (("as", RUNS), ("reversed", RUNS[::-1])):
        con = repeated_lines(spark, tmp_path / name, *rows)
        pd.testing.assert_frame_equal(text(QUERIES["metric_runs"].run(spark, str(tmp_path / name)).toPandas()), text(con.execute(QUERIES["metric_runs"].sql).df()), check_dtype=False)
        runs = _runs(spark, str(tmp_path / name)).collect()
        found.append(sorted(runs))
        assert len(runs) == len({(r.p, r.r) for r in runs}) == len(RUNS)
    assert found[0] == found[1]


SLIDES = [(1, 1, "R", "O", 400.0), (1, 1, "R", "O", 2.0), (1, 2, "R", "O", 400.0), (2, 1, "R", "O", 400.0), (2, 5, "N", "O", 400.0)]


@pytest.mark.parametrize("rows, moved, struck", [(SLIDES, 0, 1), (SLIDES[::-1], 0, 1), ([SLIDES[0], *SLIDES[2:]], 1, 1), ([*SLIDES, (3, 2, "N", "F", 1.0)], 0, 0)])
def test_slides_of_repeated_line_numbers(spark, tmp_path, rows, moved, struck):
    con = repeated_lines(spark, tmp_path, *rows)
    got = QUERIES["metric_slides"].run(spark, str(tmp_path)).toPandas()
    pd.testing.assert_frame_equal(text(got), text(con.execute(QUERIES["metric_slides"].sql).df()), check_dtype=False)
    scores = dict(zip(got.name, got.score))
    assert (scores["same"], scores["moved"], scores["strike"]) == (1, moved, struck)
