"""Groups that grow by batches beside one run: any order, batches that come twice, a stream that starts again."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import dedup as D
from quarrylight.streaming import groups

ITEMS = "item_id long, sha256 string, sig long"


def sample(seed, n=90):
    rnd = random.Random(seed)
    roots = [rnd.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(n):
        x = rnd.choice(roots)
        for b in rnd.sample(range(56), rnd.randint(0, 7)):
            x ^= 1 << b
        rows.append((i, rnd.choice([None, f"s{rnd.randrange(60)}"]), None if i % 17 == 0 else x - (1 << 64) if x >> 63 else x))
    return rows


def as_set(df):
    return sorted(map(tuple, df.select("group_id", "item_id", "match_type").collect()))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_any_order(spark, tmp_path, order):
    df = spark.createDataFrame(sample(4), ITEMS)
    for k in order:
        groups.add_batch(df.filter(F.col("item_id") % 3 == k), str(tmp_path / "s"), k)
    groups.add_batch(df.filter(F.col("item_id") % 3 == order[1]), str(tmp_path / "s"), order[1])  # comes again
    assert as_set(groups.groups(spark, str(tmp_path / "s"))) == as_set(D.duplicate_groups(df, D.DedupSpec.stills())) != []


def test_a_batch_that_bridges(spark, tmp_path):
    """Two items too far apart are one group once a third between them is known."""
    store = str(tmp_path / "s")
    groups.add_batch(spark.createDataFrame([(1, None, 0), (2, None, 0xFFF)], ITEMS), store, "a")
    assert groups.groups(spark, store).count() == 0
    groups.add_batch(spark.createDataFrame([], ITEMS), store, "nothing")
    groups.add_batch(spark.createDataFrame([(3, None, 0x3F)], ITEMS), store, "b")
    assert as_set(groups.groups(spark, store)) == [(1, 1, "near"), (1, 2, "near"), (1, 3, "near")]


def test_a_batch_does_not_compare_the_store_again(spark, tmp_path):
    """Each link of a batch has an item of that batch; what the store has is linked already."""
    store = str(tmp_path / "s")
    for k, sigs in enumerate(([0, 1, 3], [7], [15])):
        groups.add_batch(spark.createDataFrame([(10 * k + i, None, x) for i, x in enumerate(sigs)], ITEMS), store, k)
    found = spark.read.schema("src long, dst long, batch string").parquet(f"{store}/links").collect()
    assert {r["batch"] for r in found} == {"0", "1", "2"}
    assert all({"1": 7, "2": 15}.get(r["batch"], r["src"]) in (r["src"], r["dst"]) for r in found)
    assert {r[0] for r in as_set(groups.groups(spark, store))} == {0}


def test_stream(spark, tmp_path):
    rows = sample(9, 60)
    for k in range(2):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], ITEMS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ITEMS).parquet(str(tmp_path / "in"))
        query = groups.follow(stream, str(tmp_path / "s"), str(tmp_path / "c"))
        assert query.awaitTermination(120) and query.exception() is None
    assert as_set(groups.groups(spark, str(tmp_path / "s"))) == as_set(D.duplicate_groups(spark.createDataFrame(rows, ITEMS), D.DedupSpec.stills()))
