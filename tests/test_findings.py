"""Faults that were found in larger or odd tables, each beside the SQL of its query."""

import time

import numpy as np
import pandas as pd
import pytest

from quarrylight import queries
from quarrylight.llm import simhash
from quarrylight.operators import cluster as C
from quarrylight.operators import dedup as D
from quarrylight.operators import frame_lists, hamming
from quarrylight.operators import vector_index as VI


def beside_sql(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL over tables given as SQL, which Spark and DuckDB both read."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t, sql in tables.items():
        con.sql(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    return sorted(map(tuple, got), key=repr), sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["human_size", "spaced_sizes"])
def test_sizes_beyond_the_last_unit(spark, tmp_path, name):
    got, want = beside_sql(spark, tmp_path, name, orders="select unnest([0, 1, 5, 40000, 1048577, 8999999])::bigint as o_orderkey")
    assert got == want


def test_film_without_data(spark, tmp_path):
    got, want = beside_sql(spark, tmp_path, "probed_files", supplier="select unnest([996, 997, 998, 999, 1000, 3988])::bigint as s_suppkey, 3 as s_nationkey")
    assert got == want


def test_size_ladder_without_a_shuffle(spark, tmp_path):
    part = "select unnest(range(1, 60))::bigint as p_partkey, (p_partkey % 50)::int as p_size, 900.0 + p_partkey as p_retailprice"
    got, want = beside_sql(spark, tmp_path, "size_ladder", part=part)
    assert got == want
    plan = queries.QUERIES["size_ladder"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_histograms_cost_the_kinds_that_both_have():
    """18,000 kinds, of which each row has 30 of its own and one of all: columns of all kinds would take minutes."""
    rows = pd.DataFrame({"kinds": [[f"{i}-{k}" for k in range(30)] + ["all"] for i in range(600)], "shares": [[0.03] * 30 + [0.1]] * 600})
    start = time.monotonic()
    d = C.chi_square_lists(rows, rows)
    assert time.monotonic() - start < 10
    assert np.allclose(d[~np.eye(600, dtype=bool)], 0.9, atol=1e-6) and np.abs(np.diag(d)).max() < 1e-9


def test_histograms_of_shared_kinds_are_those_of_columns():
    rng = np.random.default_rng(3)
    x = rng.random((70, 9)) * (rng.random((70, 9)) < 0.5)
    rows = pd.DataFrame({"kinds": [[str(k) for k in np.flatnonzero(r)] for r in x], "shares": [r[r > 0] for r in x]})
    assert np.allclose(C.chi_square_lists(rows[:40], rows), C.chi_square_matrix(x[:40], x), atol=1e-12)


def test_few_rows_of_a_query_that_asks_for_all_cells(spark, monkeypatch):
    """A query far from all cells is repeated for each of them, but not in one batch."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)]
    refs = spark.createDataFrame(rows, "ref_id long, emb array<double>")
    monkeypatch.setattr(VI, "ROWS", 7)
    asked = refs.withColumnRenamed("ref_id", "item_id").filter("item_id < 20")
    got = {(r["item_id"], r["rank"]): r["ref_id"] for r in VI.search(asked, VI.build(refs, cells=20), 3).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    best = np.argsort(-(x[:20] @ x.T), axis=1)[:, :3]
    assert got == {(i, k + 1): int(best[i, k]) for i in range(20) for k in range(3)}


def test_pairs_of_lists_in_chunks(spark):
    """Each list in one call for each pair of chunks of its block, copies once; before, a join made a row of all pairs of a block."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        base = np.random.default_rng(i % 40).integers(-(1 << 63), 1 << 63, rng.integers(0, 6)).tolist()
        flipped = [x ^ (1 << int(rng.integers(0, 60))) if rng.random() < 0.5 else x for x in base]
        rows.append((i, flipped, i % 3, float(rng.integers(0, 3))))
    lists = spark.createDataFrame(rows, "item_id long, frames array<long>, block long, duration_s double")
    want = set()
    for i, x, p, s in rows:
        for j, y, q, t in rows:
            n = min(len(x), len(y))
            if i < j and p == q and n and abs(s - t) <= 2 and sum((u ^ v).bit_count() if u ^ v >= 0 else 64 - (~(u ^ v)).bit_count() for u, v in zip(x, y)) / n <= 1.5:
                want.add((i, j))
    for chunk in (7, 10_000):
        pairs = frame_lists.list_pairs(lists, 1.5, True, chunk)
        got = [(r["i"], r["j"]) for r in pairs.collect()]
        assert len(got) == len(want) and set(got) == want
    for large in (10, 10_000):  # by keys, and by pairs of chunks
        links = frame_lists.list_links(lists, 1.5, True, 20, large).collect()
        roots = lambda edges: [min(c) for c in map(frozenset, components(edges, 300))]
        assert roots([(r["src"], r["dst"]) for r in links]) == roots(want)


def components(edges, n):
    of = {i: {i} for i in range(n)}
    for i, j in edges:
        if of[i] is not of[j]:
            of[i] |= of[j]
            for k in of[j]:
                of[k] = of[i]
    return [of[i] for i in range(n)]


def test_pairs_of_frame_lists_are_made_by_no_join(spark, tmp_path):
    """The plan before joined each block with itself."""
    lists = spark.createDataFrame([(i, [i, i + 1], 9.0) for i in range(50)], "item_id long, frame_hashes array<long>, duration_s double")
    plan = D.blocked_pairs(lists, D.DedupSpec.timed_frames())._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" in plan and "a_item_id" not in plan


def test_links_of_a_band_beyond_its_centres(spark):
    """Texts of one band in several clusters: all pairs that all bands bring together, near ones linked, none lost to centres."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(60)]
    texts = []
    for i in range(160):
        mine = list(words)
        for p in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            mine[p] = f"x{rng.integers(0, 4)}"
        texts.append(" ".join(mine))
    texts = sorted(set(texts))
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    bands = [set(enumerate(simhash.bands_of(t, 5))) for t in texts]
    fps = [np.array([simhash.fingerprint(t)], np.uint64).view(np.int64)[0].item() for t in texts]
    want = [(i, j) for i in range(len(texts)) for j in range(i) if bands[i] & bands[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    found = simhash.similar_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    place = {f: k for k, f in enumerate(dict.fromkeys(fps))}
    parts = lambda edges: [min(c) for c in components([(place[a], place[b]) for a, b in edges], len(place))]
    assert parts([(r["src"], r["dst"]) for r in found]) == parts([(fps[i], fps[j]) for i, j in want])


def signatures(centres, n, bits, seed):
    """n signatures, each a centre with up to `bits` of its bits turned; no centres: random ones."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, centres or n, dtype=np.uint64)[rng.integers(0, centres, n) if centres else slice(None)]
    for _ in range(bits):
        base = base ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    return base


def parts(pairs, nodes):
    """The smallest node of each node's component."""
    forest = hamming.Forest()
    for a, b in pairs:
        forest.link(int(a), int(b))
    return [forest.root(int(x)) for x in nodes]


@pytest.mark.parametrize("centres, bits", [(0, 0), (1, 3), (40, 5), (300, 6), (2, 1)])
@pytest.mark.parametrize("tile", [16, 1 << 18])
def test_links_of_large_groups(monkeypatch, centres, bits, tile):
    """Groups of every density give the components of all near pairs, and with `new` of all but those of two that are not."""
    monkeypatch.setattr(hamming, "TILE", tile)
    rng = np.random.default_rng(5)
    sig = np.concatenate([signatures(centres, n, bits, n) for n in (700, 1, 64, 65, 3)])
    key = np.repeat(np.arange(5), (700, 1, 64, 65, 3))
    near = (key[:, None] == key) & (np.bitwise_count(sig[:, None] ^ sig) <= 8) & (sig[:, None] != sig)
    for new in (None, rng.random(len(sig)) < 0.3, np.zeros(len(sig), bool)):
        forest = hamming.Forest()
        hamming._compare(sig, key, 8, forest, new)
        assert all((a ^ b).bit_count() <= 8 for a, b in forest.links)
        known = near & ~(new[:, None] | new) if new is not None else np.zeros_like(near)
        stored = [(sig[i], sig[j]) for i, j in zip(*np.nonzero(known))]
        assert parts(stored + forest.links, sig) == parts([(sig[i], sig[j]) for i, j in zip(*np.nonzero(near))], sig)


def test_links_without_a_call_for_each_signature(monkeypatch):
    """batched_groups at 6 GB: buckets of some hundred signatures that are not near."""
    calls, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: calls.append(x.size) or count(x))
    hamming._compare(signatures(0, 20_000, 0, 1), np.repeat(np.arange(50), 400), 8, hamming.Forest())
    assert len(calls) <= 100
    calls.clear()
    hamming._compare(signatures(1, 20_000, 2, 1), np.zeros(20_000, np.int64), 8, hamming.Forest())
    assert sum(calls) < 20_000 * 400
