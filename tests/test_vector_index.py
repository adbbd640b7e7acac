"""Searches in cells beside all products: clustered and random vectors, ties, copies, zeros and nulls."""

import numpy as np
import pytest

from quarrylight.operators import vector_index as VI

REFS, ASKED = "ref_id long, emb array<double>", "item_id long, emb array<double>"


def plain(asked, refs, k):
    out = {}
    for i, x in asked:
        if x is None:
            continue
        rows = sorted((-round(float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-8)), 9) + 0.0, j) for j, y in refs if y is not None)
        out[i] = rows[:k]
    return out


def found(spark, asked, refs, k, **kw):
    index = VI.build(spark.createDataFrame(refs, REFS), **kw)
    out = {}
    for r in VI.search(spark.createDataFrame(asked, ASKED), index, k).orderBy("item_id", "rank").collect():
        out.setdefault(r["item_id"], []).append((-r["score"] + 0.0, r["ref_id"]))
    return out


def same(a, b):
    assert set(a) == set(b)
    for i in a:
        assert [j for _, j in a[i]] == [j for _, j in b[i]] and np.allclose([s for s, _ in a[i]], [s for s, _ in b[i]], atol=2e-9)


def clustered(seed, n, groups, spread):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(groups, 16))
    return [(rnd.choice(base) + spread * rnd.normal(size=16)).tolist() for _ in range(n)]


@pytest.mark.parametrize("groups, spread, k, sample", [(12, 0.05, 3, 20_000), (1, 1.0, 5, 60), (12, 0.3, 1, 20_000)])
def test_same_as_all_products(spark, monkeypatch, groups, spread, k, sample):
    monkeypatch.setattr(VI, "BLOCK", 50)  # cells in several chunks
    vectors = clustered(groups, 400, groups, spread)
    refs, asked = list(enumerate(vectors[:350])), list(enumerate(vectors[330:]))
    same(found(spark, asked, refs, k, sample=sample), plain(asked, refs, k))


def test_few_cells_are_visited(spark):
    vectors = clustered(3, 1000, 30, 0.05)
    index = VI.build(spark.createDataFrame(list(enumerate(vectors)), REFS))
    assert VI.visited_share(spark.createDataFrame(list(enumerate(vectors[::20])), ASKED), index, 3) < 0.25


def test_awkward_vectors(spark):
    one = [1.0, 0.0, 0.0]
    refs = [(5, one), (3, one), (4, [2.0, 0.0, 0.0]), (9, [0.0, 0.0, 0.0]), (10, None), (-1, [-1.0, 0.0, 0.0])]
    asked = [(1, one), (2, [0.0, 0.0, 0.0]), (3, None), (4, [-3.0, 0.0, 0.0])]
    same(found(spark, asked, refs, 9), plain(asked, refs, 9))
    same(found(spark, asked, refs, 2, cells=3), plain(asked, refs, 2))
    assert found(spark, asked, [], 2) == {} and found(spark, [], refs, 2) == {}
    copies = [(i, one) for i in range(300)]
    assert [j for _, j in found(spark, [(1, one)], copies, 3, sample=10)[1]] == [0, 1, 2]


def test_references_beyond_the_broadcast(spark, monkeypatch):
    """The nearest person, the earlier on ties, from the index as from references sent to every task."""
    from quarrylight.operators import matching as M

    rnd = np.random.default_rng(6)
    refs = [(f"p{k % 7}", k % 7, rnd.normal(size=8).tolist()) for k in range(60)] + [("same", 8, [1.0] * 8), ("twin", 9, [1.0] * 8)]
    faces = spark.createDataFrame([(i, rnd.normal(size=8).tolist()) for i in range(40)] + [(99, [2.0] * 8), (100, None)], ASKED)
    references = spark.createDataFrame(refs, "person string, person_ord int, emb array<double>")
    rows = lambda: {r["item_id"]: (r["person"], pytest.approx(r["score"], abs=1e-8)) for r in M.nearest_reference(faces, references, ["item_id"], 0.3).collect()}
    sent = rows()
    monkeypatch.setattr(M, "LARGEST_REFERENCES", 3)
    assert rows() == sent and sent[99][0] == "same" and 100 not in sent
