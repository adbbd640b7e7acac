"""Encoders by profile, the search for a size, survivors, labels in blocks, the order of paths, reports that say what was done."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import dedup as D
from quarrylight.operators import encoders, tables
from quarrylight.operators import matching as M
from quarrylight.plans import files as P
from quarrylight.sinks import reports
from quarrylight.sources import files


def test_encoders(spark):
    asked = [(1, "a", "h265", "auto"), (2, "a", "av1", "auto"), (3, "a", "h265", "vtb"), (4, "a", "av1", "vtb"), (5, "b", "h264", "auto"), (6, "a", "h265", "cpu"), (7, "a", "h264", "nvenc"), (8, "a", "vp8", "auto"), (9, None, "h264", "qsv"), (10, "a", "h264", None)]
    have = [("a", "HEVC_VideoToolbox"), ("a", "hevc_amf"), ("a", "hevc_amf"), ("a", "h264_qsv"), ("c", "h264_nvenc")]
    got = encoders.choose_encoders(spark.createDataFrame(asked, "k int, host string, codec string, mode string"), spark.createDataFrame(have, "host string, encoder string")).collect()
    assert {r["k"]: (r["encoder"], r["hardware"], r["fell_back"]) for r in got} == {
        1: ("hevc_amf", True, False), 2: ("libsvtav1", False, False), 3: ("hevc_videotoolbox", True, False), 4: ("libsvtav1", False, True), 5: ("libx264", False, False),
        6: ("libx265", False, False), 7: ("libx264", False, True), 8: (None, None, None), 9: ("libx264", False, True), 10: ("libx264", False, True),
    }


def test_size_search(spark):
    items = spark.createDataFrame([(1, 9, 10.0), (2, 3, 100.0), (3, 3, 100.0), (4, 1, 100.0), (5, 9, 100.0)], "item_id long, frames int, original double").withColumn("target", F.lit(50.0))
    tries = tables.search_steps(items)
    assert [r["step"] for r in tries.filter("item_id = 2 and phase = 'frames'").orderBy("place").collect()] == [2]  # 3 frames: every second leaves two
    sizes = {(2, "quality", 45): 50.0, (2, "quality", 35): 20.0, (3, "palette", 128): 10.0, (3, "frames", 2): 50.1, (5, "quality", 85): None, (5, "frames", 3): 49.0, (5, "palette", 128): 1.0}
    known = spark.createDataFrame([(*k, v) for k, v in sizes.items()], "item_id long, phase string, step int, size double")
    found = tables.first_under(tries.join(known, ["item_id", "phase", "step"], "left").withColumn("size", F.when(F.col("item_id") == 4, 60.0).otherwise(F.col("size")))).collect()
    assert {r["item_id"]: (r["outcome"], r["phase"], r["step"], r["size"]) for r in found} == {1: ("unchanged", None, None, 10.0), 2: ("reduced", "quality", 45, 50.0), 3: ("reduced", "palette", 128, 10.0), 4: ("restored", None, None, 100.0), 5: ("reduced", "frames", 3, 49.0)}


def test_survivors(spark):
    rows = [(1, 5, None, 2), (1, 6, 7, 2), (1, 7, 7, 1), (2, 9, None, 3), (2, 8, None, 3)]
    got = D.ranked(spark.createDataFrame(rows, "group_id long, item_id long, pixels long, size long"), -F.col("pixels"), F.col("size"))
    assert got.columns == ["group_id", "item_id", "pixels", "size", "primary"] and got.count() == 5
    assert sorted(r["item_id"] for r in got.filter("primary").collect()) == [7, 8]


@pytest.mark.parametrize("most", [10_000, 3])
def test_labels_in_blocks(spark, monkeypatch, most):
    """Labels sent to every task, and in blocks with the vectors; several vectors of a label, ties, a null vector."""
    rnd = np.random.default_rng(1)
    names = [(f"l{k}", k) for k in range(9)]
    vectors = [(label, k, rnd.normal(size=4).tolist()) for label, k in names for _ in range(1 + k % 2)] + [("twin", 100, [1.0, 0.0, 0.0, 0.0]), ("first", 99, [1.0, 0.0, 0.0, 0.0])]
    items = [(i, rnd.normal(size=4).tolist()) for i in range(40)] + [(50, [1.0, 0.0, 0.0, 0.0]), (51, None)]
    monkeypatch.setattr(tables, "LARGEST_REFERENCES", most)
    blocks = tables.across
    monkeypatch.setattr(tables, "across", lambda a, b, f, kinds: blocks(a, b, f, kinds, 15, 4))
    got = {r["item_id"]: r for r in tables.zero_shot(spark.createDataFrame(items, "item_id long, emb array<double>"), spark.createDataFrame(vectors, "label string, ord long, label_emb array<double>"), 5.0).collect()}
    assert set(got) == {i for i, e in items if e is not None}
    for i, e in items[:-1]:
        cosine = {}
        for label, k, v in vectors:
            c = np.dot(e, v) / (np.linalg.norm(e) * np.linalg.norm(v) + 1e-8)
            cosine[k, label] = max(c, cosine.get((k, label), -9))
        share = {k: np.exp(5 * c) for k, c in cosine.items()}
        best = sorted(share, key=lambda k: (-share[k], k))[:3]
        assert [x["label"] for x in got[i]["top"]] == [label for _, label in best]
        assert got[i]["score"] == pytest.approx(share[best[0]] / sum(share.values()), abs=6e-5) and got[i]["accepted"] == (got[i]["score"] >= 0.2)
    assert got[50]["label"] == "first"


def test_persons_in_order(spark):
    rows = [(f"x/{n}_{k}.jpg", 1.0, [float(k)]) for n in ("zoe", "Ann", "bo") for k in range(2)] + [("x/none.jpg", 1.0, None)]
    got = M.load_references(spark.createDataFrame(rows, "path string, area double, emb array<double>")).collect()
    assert {r["person"]: r["person_ord"] for r in got} == {"Ann": 1, "bo": 2, "zoe": 3} and len(got) == 6


def test_paths_by_parts(spark):
    rows = files.named(spark.createDataFrame([("a-b.jpg",), ("a/z.jpg",), ("a/b/c.jpg",), ("a.jpg",)], "path string")).drop("lower_name")
    assert [r["path"] for r in files.ordered(rows, files.LISTINGS["stills"]).collect()] == ["a/b/c.jpg", "a/z.jpg", "a-b.jpg", "a.jpg"]


def test_series(spark):
    names = ["IMG_3_1", "IMG_12_004", "img_99_1", "IMG_4_1b", "xIMG_7_7", "IMG_5", None, "I.G_50_1"]
    df = spark.createDataFrame([(n,) for n in names], "stem string")
    assert sorted(r["stem"] or "" for r in P.not_in_series(df, "IMG").collect()) == sorted(n or "" for n in names[2:])
    assert tuple(P.last_series(df, "IMG").first()) == (12, 2) and tuple(P.last_series(df, "I.G").first()) == (50, 1) and tuple(P.last_series(df.limit(0), "IMG").first()) == (0, 0)


def test_reports_say_what_was_done(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "near", True, "a", 5, "3 x 4", "QUJD"), (1, 2, "near", False, "b", 1024, None, None)], "group_id long, item_id long, match_type string, primary boolean, name string, size long, meta string, thumb string")

    def text(**kw):
        reports.write_html(reports.duplicate_report(rows, **kw), str(tmp_path / "r"), True)
        return "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))

    dry = text(threshold=8.0, source="/a<b")
    assert "DRY RUN" in dry and "EXECUTED" not in dry and "threshold 8, source /a&lt;b" in dry
    assert '<img src="data:image/jpeg;base64,QUJD"><div>a</div><div>3 x 4</div>' in dry and "<b>DUP</b><div>b</div><div>1.0KB</div>" in dry
    done = text(executed=True)
    assert "EXECUTED" in done and "DRY RUN" not in done and "threshold" not in done


def test_tag_document(spark):
    rows = [(3, "c.jpg", None, "s", 0.5, True, "t", 0.1, False, None, "s__t"), (1, "a.jpg", "gone", *[None] * 8)]
    tags = spark.createDataFrame(rows, "item_id long, name string, error string, scene string, scene_score double, scene_ok boolean, theme string, theme_score double, theme_ok boolean, posture string, group_key string")
    got = json.loads("\n".join(r["json"] for r in reports.tag_document(tags, version="1.0", source_folder='a "b"').orderBy("place").collect()))
    assert got["meta"] == {"version": "1.0", "source_folder": 'a "b"', "total_images": 2}
    assert [(x["file"], x["error"]) for x in got["images"]] == [("a.jpg", "gone"), ("c.jpg", None)]
    assert json.loads("".join(r["json"] for r in reports.tag_document(tags.limit(0)).orderBy("place").collect()))["images"] == []
