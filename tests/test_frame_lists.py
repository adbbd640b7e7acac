"""Links of frame lists beside all pairs, with blocks in one task, blocks that meet by keys, and keys in chunks."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import dedup as D
from quarrylight.operators import frame_lists
from quarrylight.operators.components import connected_components

LISTS = "item_id long, frames array<long>, block long, duration_s double"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def sample(seed, n, most=8, flips=9):
    """Lists in families: of each some bits of each frame are turned, up to `flips` a frame."""
    rnd = random.Random(seed)
    roots = [[rnd.getrandbits(64) for _ in range(most)] for _ in range(max(2, n // 5))]
    rows = []
    for i in range(n):
        frames = []
        for x in rnd.choice(roots)[: rnd.choice([most, most, most - 1, 1, 0])]:
            for b in rnd.sample(range(64), rnd.randint(0, flips)):
                x ^= 1 << b
            frames.append(signed(x))
        rows.append((i, frames, rnd.randint(0, 1), rnd.choice([1.0, 2.5, 100.0, 104.0, 106.0])))
    return rows


def near(a, b, threshold, timed):
    n = min(len(a[1]), len(b[1]))
    if a[2] != b[2] or not n or timed and abs(a[3] - b[3]) > max(2.0, 0.05 * max(a[3], b[3])):
        return False
    return sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a[1], b[1])) <= threshold * n


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("threshold, timed, bucket", [(8, False, 10_000), (8, False, 20), (8, True, 20), (3, False, 20), (12.5, True, 20), (0, False, 20)])
def test_all_pairs(spark, threshold, timed, bucket):
    rows = sample(f"{threshold}{bucket}", 120)
    wanted = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b, threshold, timed)]
    links = frame_lists.list_links(spark.createDataFrame(rows, LISTS), threshold, timed, bucket).collect()
    pairs = {tuple(sorted((r["src"], r["dst"]))) for r in links}
    assert pairs <= set(wanted)
    assert groups(pairs) == groups(wanted)


def test_keys_meet_at_the_bound(spark):
    """Lists whose every frame differs by exactly the threshold share a key, however the bits lie."""
    rnd = random.Random(8)
    for threshold in (1, 2, 5, 8, 11):
        rows = []
        for k in range(40):
            base = [rnd.getrandbits(64) for _ in range(3)]
            bits = [sum(1 << b for b in rnd.sample(range(64), threshold)) for _ in base]
            rows += [(2 * k, [signed(x) for x in base], 0, 1.0), (2 * k + 1, [signed(x ^ m) for x, m in zip(base, bits)], 0, 1.0)]
        df = spark.createDataFrame(rows, LISTS)
        keys = df.select(F.floor(F.col("item_id") / 2).alias("k"), "item_id", F.explode(frame_lists.meeting_keys(F.col("frames"), threshold)).alias("x")).distinct()
        met = keys.groupBy("k", "x").agg(F.countDistinct("item_id").alias("n")).filter("n = 2").select("k").distinct().count()
        assert met == 40


def test_copies_and_dense_groups_do_not_multiply(spark):
    """5,000 lists within a few bits of each other, and 3,000 equal ones: links are fewer than lists."""
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(8)]
    rows = [(i, [signed(x ^ (1 << rnd.randrange(64))) for x in base], 0, 50.0) for i in range(5000)] + [(10_000 + i, [signed(x) for x in base], 0, 50.0) for i in range(3000)]
    items = spark.createDataFrame(rows, LISTS).withColumnRenamed("frames", "frame_hashes").withColumn("sha256", F.lit(None).cast("string"))
    edges = D.near_edges(items, D.DedupSpec.timed_frames())
    assert edges.count() < 8000
    assert connected_components(edges).select("component").distinct().count() == 1


def test_awkward_lists(spark):
    rows = [(1, [], 1.0), (2, [], 1.0), (3, None, 1.0), (4, [5], None), (5, [5], None), (6, [5], 9.0), (7, [5], 9.0), (8, [5, 6], 9.5), (-9, [7], 9.0)]
    items = spark.createDataFrame(rows, "item_id long, frame_hashes array<long>, duration_s double").withColumn("sha256", F.lit(None).cast("string"))
    groups = {r["item_id"]: (r["group_id"], r["match_type"]) for r in D.duplicate_groups(items, D.DedupSpec.timed_frames(1)).collect()}
    assert groups == {i: (-9, "near") for i in (6, 7, 8, -9)}
    untimed = {r["item_id"]: r["group_id"] for r in D.duplicate_groups(items, D.DedupSpec.frames(1)).collect()}
    assert untimed == {i: -9 for i in (4, 5, 6, 7, 8, -9)}
    assert D.duplicate_groups(items.filter("false"), D.DedupSpec.timed_frames()).count() == 0
