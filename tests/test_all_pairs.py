"""Pairs of a whole table: every one of them, once, and no table of rows for each pair of blocks."""

import os

import numpy as np
import pandas as pd
import pytest

from quarrylight import queries
from quarrylight.operators import cluster as C
from quarrylight.operators import pairs

HERE = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables")


def from_sql(name, where):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        path = f"{where}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con.sql(queries.ORACLES[name]).df()


def same(found, want):
    keys = [c for c in want.columns if c != "d"]
    found, want = (x.sort_values(keys).reset_index(drop=True)[[*keys, "d"]] for x in (found, want))
    pd.testing.assert_frame_equal(found, want, check_dtype=False, rtol=0, atol=1.1e-6)


@tables
def test_time_decay_has_all_pairs_of_a_user(spark):
    found = queries.QUERIES["time_decay"](spark, HERE).toPandas()
    n = spark.read.parquet(f"{HERE}/events.parquet").groupBy("user_id").count().toPandas()["count"]
    assert len(found) == (n * (n - 1) // 2).sum() and (found["i"] % 20 != 0).any()
    same(found, from_sql("time_decay", HERE))


def test_time_decay_of_odd_rows(spark, tmp_path):
    """No user, no time, one time for two events."""
    rows = "(1, timestamp_ntz'2024-01-01 00:00:00', 7), (2, timestamp_ntz'2024-01-01 00:00:00', 7), (3, null, 7), (4, null, 7), (5, timestamp_ntz'2024-01-02 00:00:00', null), (6, timestamp_ntz'2024-01-01 00:00:00', null)"
    spark.sql(f"select * from values {rows} as t(event_id, ts, user_id)").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = queries.QUERIES["time_decay"](spark, str(tmp_path)).toPandas()
    assert len(found) == 7
    same(found, from_sql("time_decay", str(tmp_path)))


@tables
def test_chi_square_has_all_pairs(spark):
    found = queries.QUERIES["chi_square_pairs"](spark, HERE).toPandas()
    n = spark.read.parquet(f"{HERE}/events.parquet").select("user_id").distinct().count()
    assert len(found) == n * (n - 1) // 2 and (found["i"] % 20 != 0).any()
    same(found, from_sql("chi_square_pairs", HERE))


@tables
def test_signal_distance_has_all_pairs(spark):
    found = queries.QUERIES["signal_distance"](spark, HERE).toPandas()
    n = spark.read.parquet(f"{HERE}/embeddings.parquet").count()
    assert len(found) == n * (n - 1) // 2 and (found["i"] % 20 != 0).any()
    same(found, from_sql("signal_distance", HERE))


@tables
@pytest.mark.parametrize("name", ["signal_distance", "border_distances", "chi_square_pairs"])
def test_blocks_meet_without_a_shuffle(spark, name):
    """Rows went to as many calls as there are blocks: n * n / 2,048 rows on disk."""
    plan = queries.QUERIES[name](spark, HERE)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and not any(x in plan for x in ("Exchange", "Generate", "FlatMap"))


def apart(a, b):
    return np.abs(a["x"].to_numpy()[:, None] - b["x"].to_numpy())


@pytest.mark.parametrize("block", [3, 7, 10, 500])
def test_every_pair_once(spark, block):
    """Ids that are below zero, missing or there twice, and more and fewer chunks than partitions of a side."""
    rnd = np.random.default_rng(block)
    ids, x = [*range(-50, 50), 7, 8, None], rnd.integers(0, 40, 103) / 8
    rows = spark.createDataFrame([*zip(ids, x.tolist())], "item_id long, x double")
    known = [(i, v) for i, v in zip(ids, x.tolist()) if i is not None]
    want = sorted((i, j, abs(v - w)) for i, v in known for j, w in known if i < j)
    assert sorted(map(tuple, pairs.all_pairs(rows, apart, block=block).collect())) == want
    assert sorted(map(tuple, pairs.all_pairs(rows, apart, 1.0, block).collect())) == [x for x in want if x[2] < 1]
    assert sorted(map(tuple, pairs.all_pairs(rows, apart, block=block, keep=lambda d: d > 3).collect())) == [x for x in want if x[2] > 3]
    some = pairs.against(rows.filter("item_id % 10 = 0"), rows, apart, block=block).collect()
    assert sorted(map(tuple, some)) == sorted((i, j, abs(v - w)) for i, v in known if i % 10 == 0 for j, w in known if i != j)
    none = rows.limit(0)
    assert not pairs.all_pairs(none, apart, block=block).collect() and not pairs.against(none, rows, apart, block=block).collect()


def test_rounded_as_sql_does():
    duckdb = pytest.importorskip("duckdb")
    x = np.r_[np.arange(0, 1, 1 / 4096), np.random.default_rng(1).random(4000), 0.1234565, 1.0]
    t = pd.DataFrame({"x": x})  # noqa: F841
    assert (pairs.rounded(x, 6) == duckdb.sql("select round(x, 6) as r from t").df()["r"].to_numpy()).all()


@pytest.mark.parametrize("kinds", [3, 40])
def test_histograms_of_many_and_few_kinds(kinds):
    rnd = np.random.default_rng(kinds)
    full = np.where(rnd.random((90, kinds)) < 3 / kinds, rnd.random((90, kinds)), 0)
    rows = pd.DataFrame({"kinds": [[f"k{k}" for k in np.flatnonzero(x)] for x in full], "shares": [x[x > 0].tolist() for x in full]})
    assert np.abs(C.chi_square_lists(C.Histograms(rows[:37]), rows[30:]) - C.chi_square_matrix(full[:37], full[30:])).max() < 1e-12
