"""Acceptance tests of the media operators, each on a few literal rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.functions import rules as R
from quarrylight.functions import strings as S
from quarrylight.functions import vectors as V
from quarrylight.operators import cluster as C
from quarrylight.operators import dedup as D
from quarrylight.operators import links as L
from quarrylight.operators import tables as T
from quarrylight.operators.components import connected_components
from quarrylight.plans import files as P

MEDIA = "item_id long, sha256 string, sig long, size long"


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def absolute(threshold):
    return D.DedupSpec(lambda a, b: F.abs(a - b), F.lit(0), threshold=threshold)


def groups(spark, rows, threshold=5):
    found = D.duplicate_groups(spark.createDataFrame(rows, MEDIA), absolute(threshold)).collect()
    return sorted((r["group_id"], r["item_id"], r["match_type"]) for r in found)


@pytest.mark.parametrize("edges, want", [([(0, 1)], {0: 0, 1: 0}), ([(0, 1), (1, 2)], {0: 0, 1: 0, 2: 0}), ([(0, 1), (0, 1), (1, 1)], {0: 0, 1: 0}), ([], {})])
def test_components(spark, edges, want):
    found = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r["node"]: r["component"] for r in found} == want and len(found) == len(want)


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 560)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert found == {x: root(x) for x in list(up) if x not in loops}


def test_groups(spark):
    assert groups(spark, [(1, "a", 0, 1), (2, "a", 0, 1), (3, "b", 90, 1)]) == [(1, 1, "exact"), (1, 2, "exact")]
    assert groups(spark, [(1, "a", 0, 1), (2, "b", 2, 1), (3, "c", 50, 1)]) == [(1, 1, "near"), (1, 2, "near")]
    assert groups(spark, [(1, "a", 0, 1), (2, "b", 10, 1)]) == []
    assert groups(spark, [(1, None, None, 1), (2, None, None, 1)]) == []
    assert groups(spark, []) == []
    bridged = [(1, "a", 0, 1), (2, "a", 0, 1), (3, "b", 4, 1), (4, "b", 4, 1)]
    assert {g[2] for g in groups(spark, bridged)} == {"exact"} and {g[0] for g in groups(spark, bridged)} == {1}


def test_blocks_hide_pairs(spark):
    rows = [(1, "a", 0, 1), (2, "b", 1 << 62, 1), (3, "c", 3, 1), (4, "d", -1, 1), (5, "e", -2, 1)]
    found = D.blocked_pairs(spark.createDataFrame(rows, MEDIA), D.DedupSpec.stills()).collect()
    assert {(r["i"], r["j"], r["d"]) for r in found} == {(1, 3, 2.0), (4, 5, 1.0)}


@pytest.mark.parametrize("threshold", [0, 3, 8, 20])
def test_near_groups_against_all_pairs(spark, threshold):
    """Bands and spanning links give the pairs and groups that all pairs of a block would."""
    rnd = random.Random(threshold)
    centres = [rnd.getrandbits(64) for _ in range(5)]
    sigs = [c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(14))) for c in centres for _ in range(40)] + [centres[0]] * 5
    rows = [(i, str(i), s - (1 << 64) if s >> 63 else s, 1) for i, s in enumerate(sigs)]
    items, spec = spark.createDataFrame(rows, MEDIA), D.DedupSpec.stills(threshold)
    near = {(i, j): float((a ^ b).bit_count()) for i, a in enumerate(sigs) for j, b in enumerate(sigs) if i < j and a >> 56 == b >> 56 and (a ^ b).bit_count() <= threshold}
    found = [tuple(r) for r in D.blocked_pairs(items, spec).collect()]
    assert len(found) == len(near) and {(i, j): d for i, j, d in found} == near
    up = list(range(len(sigs)))
    for _ in sigs:
        for i, j in near:
            up[i] = up[j] = min(up[i], up[j])
    want = {i: g for i, g in enumerate(up) if up.count(g) > 1}
    assert {r["item_id"]: r["group_id"] for r in D.duplicate_groups(items, spec).collect()} == want


def test_frames(spark):
    schema = "item_id long, sha256 string, frame_hashes array<long>, duration_s double"
    rows = [(1, None, [1, 2, 3], 9.0), (2, None, [1, 2], 9.2), (3, None, [], 9.0), (4, None, [1, 2, 3], 30.0)]
    found = D.blocked_pairs(spark.createDataFrame(rows, schema), D.DedupSpec.timed_frames(1)).collect()
    assert [(r["i"], r["j"], r["d"]) for r in found] == [(1, 2, 0.0)]


def test_move_plan(spark):
    rows = [(1, "a/photo.jpg", True, 1), (2, "photo.jpg", False, 1), (3, "photo.jpg", False, 1), (4, "photo.jpg", False, 1)]
    found = P.move_plan(spark.createDataFrame(rows, "item_id long, name string, primary boolean, group_id long")).orderBy("item_id").collect()
    assert [r["dst_path"] for r in found] == ["Duplicate/photo_dup.jpg", "Duplicate/photo_dup1.jpg", "Duplicate/photo_dup2.jpg"]


@pytest.mark.parametrize("n, want", [(0, "0B"), (500, "500.0B"), (1024, "1.0KB"), (1536, "1.5KB"), (1024**2, "1.0MB"), (1024**3, "1.0GB")])
def test_sizes(spark, n, want):
    assert one(spark, S.format_size(F.lit(n).cast("long"))) == want


@pytest.mark.parametrize("s, want", [(5.0, "5.0s"), (125.0, "2m 5s"), (3725.0, "1h 2m")])
def test_elapsed(spark, s, want):
    assert one(spark, S.elapsed(F.lit(s))) == want


def test_names(spark):
    assert one(spark, S.safe_filename(F.lit('a<b>c:d"e/f\\g|h?i*j'))) == "a_b_c_d_e_f_g_h_i_j"
    assert one(spark, S.safe_filename(F.lit("  .hidden.  "))) == "hidden"
    assert one(spark, S.safe_filename(F.lit("..."))) == "unnamed"
    assert one(spark, S.safe_filename(F.lit("a" * 300 + ".txt"), 20)) == "a" * 16 + ".txt"
    assert one(spark, S.slug(F.lit("Beach or coast"))) == "beach"
    assert one(spark, S.clock_seconds(F.lit("Duration: 01:02:03.5, x"))) == 3723.5 and one(spark, S.clock_seconds(F.lit("none"))) == 0.0
    assert one(spark, S.absolute_url(F.lit("https://a.b/c/d.html"), F.lit("e.mp4"))) == "https://a.b/c/e.mp4"


@pytest.mark.parametrize("n, want", [(0, [0]), (1, [0]), (8, list(range(8))), (9, [0, 1, 2, 3, 5, 6, 7, 8])])
def test_samples(spark, n, want):
    assert one(spark, V.sample_indices(F.lit(n))) == want


def test_vectors(spark):
    vec = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, V.cosine(vec(0.0, 0.0), vec(1.0, 0.0))) == 0.0
    assert one(spark, V.l2_normalize(vec(0.0, 0.0))) is None
    assert one(spark, V.mean_hamming(vec(1, 2).cast("array<long>"), F.array().cast("array<long>"))) is None


def test_rules(spark):
    assert one(spark, R.optimal_fps(F.lit(40), F.lit(5), F.lit(900))) == 5
    assert one(spark, R.trim(F.lit(15.0)))["source"] == "delete" and one(spark, R.trim(F.lit(15.1)))["source"] == "keep"


def test_segments(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 45.0), (3, 50.0)], "item_id long, duration_s double")
    assert sorted((r[0], r[2], r[3]) for r in T.segments(rows).collect()) == [(2, 0.0, 15.0), (3, 0.0, 15.0), (3, 45.0, 50.0)]


def test_links(spark):
    """Literal pages, one for each kind of link, and one without."""
    rows = [
        (1, "http://h/p/q", '<div>Cat\n clip<video src="/a.mp4"><source src="b.webm" type="video/webm" data-quality="hd"><source src="add_to_home.mp4"></video><script>x</script></div><source src="no.mp4"><VIDEO><source src="c.mp4"></VIDEO>'),
        (2, "http://h/", """x "http://c/d.MP4" http://c/e.mkv?x=1 'http://c/a b.avi' http://c/add_to_home.mp4"""),
        (3, "http://h/", r'"hd_src":"http:\/\/f\/v" "sd_src":"http://f/w" "video_url": "http://i/add_to_home" "playAddr": "http://t?a\u0026b"'),
        (4, "http://h/", 'http://s/l.M3U8?x "http://s/a b.m3u8" http://s/m.mpd'),
        (5, "http://h/", '<a href="y"><a href="z">' + '<a href="y">' * 12),
        (6, None, None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted(tuple(r) for r in L.video_links(pages, lambda html: L.listed(L.anchors(html))).collect())
    assert found == [
        (1, 1, "http://h/a.mp4", "Video 1", "mp4", "unknown"),
        (1, 2, "http://h/p/b.webm", "Cat", "webm", "hd"),
        (1, 3, "http://h/p/c.mp4", "Cat", "mp4", "unknown"),
        (2, 1, "http://c/d.MP4", "Embedded Video 1", "mp4", "unknown"),
        (2, 2, "http://c/e.mkv", "Embedded Video 2", "mkv", "unknown"),
        (2, 3, "http://c/a b.avi", "Embedded Video 4", "avi", "unknown"),
        (3, 1, "http://f/v", "Facebook Video", "mp4", "unknown"),
        (3, 2, "http://f/w", "Facebook Video", "mp4", "unknown"),
        (3, 3, "http://i/add_to_home", "Instagram Video", "mp4", "unknown"),
        (3, 4, "http://t?a&b", "Tiktok Video", "mp4", "unknown"),
        (4, 1, "http://s/l.M3U8?x", "Streaming Video (DASH)", "dash", "adaptive"),
        (4, 2, "http://s/m.mpd", "Streaming Video (DASH)", "dash", "adaptive"),
        (4, 3, "http://s/a b.m3u8", "Streaming Video (HLS)", "hls", "adaptive"),
        (5, 1, "y", "Link", "unknown", "unknown"),
        (5, 2, "z", "Link", "unknown", "unknown"),
    ]
    assert [r["page_id"] for r in L.video_links(pages).filter("page_id > 4").collect()] == []


def test_titles_of_videos():
    title = lambda text: L.tagged_videos(f"<p>{text}<video><source src='a'></video></p>", "http://h")[0][1]
    assert title("a b<br>c") == "a bc" and title("x" * 99) == "x" * 50 and title("x" * 100) == "Video 1" and title("<style>y</style> ") == "Video 1"
    assert L.tagged_videos("<div>t<video><p>in<source src='a'></div><source src='b'>", "http://h") == [("http://h/a", "tin", "mp4", "unknown")]


def slow_linkage(d, t):
    parts = [[i] for i in range(len(d))]
    while len(parts) > 1:
        best = min((np.mean([d[x][y] for x in a for y in b]), a[0], b[0], i, j) for i, a in enumerate(parts) for j, b in enumerate(parts) if i < j)
        if best[0] >= t:
            break
        parts[best[3]] = sorted(parts[best[3]] + parts.pop(best[4]))
    return sorted(map(tuple, parts))


def test_average_linkage():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.random((25, 2))
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        label = C.average_linkage(d.copy(), 0.25)
        assert sorted(tuple(np.flatnonzero(label == k)) for k in set(label)) == slow_linkage(d.tolist(), 0.25)


def test_empty_tables_and_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
