"""Numbering, matching, sources, sinks, control and the feature stream, on small literal tables."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrylight import control, storage
from quarrylight.functions.arrays import first_of_each
from quarrylight.operators import matching as M
from quarrylight.operators.numbering import numbered
from quarrylight.sinks import reports
from quarrylight.sources import files
from quarrylight.streaming import features


@pytest.mark.parametrize("most", [5, 10**6])
@pytest.mark.parametrize("keys", [["k"], ["k", "m"], []])
def test_numbering(spark, keys, most):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([1, None]), i) for i in range(200)]
    rnd.shuffle(rows)
    found = numbered(spark.createDataFrame(rows, "k string, m int, i int").repartition(7), keys, ["i"], most=most).collect()
    want, seen = {}, {}
    for k, m, i in sorted(rows, key=lambda r: r[2]):
        key = tuple({"k": k, "m": m}[x] for x in keys)
        seen[key] = want[i] = seen.get(key, 0) + 1
    assert {r["i"]: r["number"] for r in found} == want
    assert numbered(spark.createDataFrame([], "k string, m int, i int"), keys, ["i"], most=most).collect() == []


@pytest.mark.parametrize("most", [3, 20_000])
def test_nearest_references(spark, monkeypatch, most):
    """References that are sent, and references by blocks."""
    monkeypatch.setattr(M, "LARGEST_REFERENCES", most)
    rng = np.random.default_rng(3)
    faces, refs = rng.normal(size=(50, 8)), rng.normal(size=(12, 8))
    refs[7] = refs[2]  # a tie: the earlier person wins
    a = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(faces)] + [(99, None)], "item_id long, emb array<double>")
    b = spark.createDataFrame([(f"p{i // 2}", i // 2, x.tolist()) for i, x in enumerate(refs)], "person string, person_ord int, emb array<double>")
    cosine = faces @ refs.T / (np.linalg.norm(faces, axis=1)[:, None] * np.linalg.norm(refs, axis=1) + 1e-8)
    per = cosine.reshape(50, 6, 2).max(axis=2)
    found = {r["item_id"]: (r["person"], round(r["score"], 9)) for r in M.nearest_reference(a, b, ["item_id"], 0.3).collect()}
    assert found == {i: (f"p{x.argmax()}" if x.max() >= 0.3 else "Others", round(x.max(), 9)) for i, x in enumerate(per)}
    assert M.scores(a, b, ["item_id"], least=0.3).count() == (per >= 0.3).sum() and M.scores(a, b, ["item_id"]).count() == 300
    assert M.nearest_reference(a, b.limit(0), ["item_id"]).collect() == []


def test_first_of_each(spark):
    rows = F.from_json(F.lit('[{"u":"b","t":1},{"u":"a","t":2},{"u":"b","t":3}]'), "array<struct<u:string,t:int>>")
    assert [tuple(x) for x in spark.range(1).select(first_of_each(rows, "u").alias("x")).first()["x"]] == [("b", 1), ("a", 2)]


def test_broadcasts_are_measured(spark):
    few = spark.range(10)
    assert storage.fits(few, 10) and not storage.fits(few, 9)
    assert not storage.fits(few.select(F.repeat(F.lit("x"), 1000).alias("t")), 10, 5000)
    assert storage.fits(few.limit(0), 0) and storage.fits(few.select(F.array("id").alias("a"), F.lit(None).cast("string").alias("b")), 10)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda s: type("O", (), {"isEmpty": lambda o: True})()})()})()

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, k, d: d})()

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())


def chunk(kind, data):
    return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def test_animated_webp():
    file = lambda *parts: b"RIFF" + struct.pack("<I", 4 + sum(map(len, parts))) + b"WEBP" + b"".join(parts)
    extended = lambda flag: chunk(b"VP8X", bytes([flag]) + b"\0" * 9)
    assert files.animated_webp(file(extended(2))) and files.animated_webp(file(extended(0x12)))
    assert files.animated_webp(file(extended(0), chunk(b"ICCP", b"abc"), chunk(b"ANIM", b"\0" * 6)))
    for no in (file(extended(0x10)), file(chunk(b"VP8 ", b"ANIM1234")), b"", None, b"RIFF", b"GIF89a" + b"ANIM" * 9, file(chunk(b"VP8X", b""))):
        assert not files.animated_webp(no)


def test_file_or_folder(spark, tmp_path):
    for name in ("b.mp4", "a.txt", "c.mp4"):
        (tmp_path / name).write_bytes(b"12345")
    names = lambda path: sorted(r["name"] for r in files.file_or_folder(spark, str(path), files.LISTINGS["compress"]).collect())
    assert names(tmp_path) == ["b.mp4", "c.mp4"] and names(tmp_path / "b.mp4") == ["b.mp4"]
    with pytest.raises(ValueError):
        names(tmp_path / "a.txt")
    with pytest.raises(FileNotFoundError):
        names(tmp_path / "none.mp4")


def test_address_file(spark, tmp_path):
    (tmp_path / "list.txt").write_text("  http://b \n\n\thttp://a\n   \nhttp://b\n")
    found = sorted(tuple(r) for r in files.address_file(spark, str(tmp_path / "list.txt")).collect())
    assert found == [(1, "http://b"), (2, "http://a"), (3, "http://b")]


GROUPS = "group_id long, item_id long, match_type string, primary boolean, name string, size long"


def test_duplicate_report(spark, tmp_path):
    rows = [(1, 1, "exact", True, "a<b", 2048), (1, 2, "exact", False, "c", 1024)]
    for one in (True, False):
        reports.write_html(reports.duplicate_report(spark.createDataFrame(rows, GROUPS)), str(tmp_path / "r"), one)
        text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
        assert text.startswith("<!DOCTYPE html>") and text.rstrip().endswith("</html>")
        assert text.index("1 groups, 1 duplicates (1 exact, 0 near), 1.0KB") < text.index("Exact duplicates") < text.index("PRIMARY") < text.index("a&lt;b") < text.index("DUP<") < text.index("</section>")
        assert "Near duplicates" not in text
    reports.write_html(reports.duplicate_report(spark.createDataFrame([], GROUPS)), str(tmp_path / "r"), True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert "0 groups, 0 duplicates" in text and "<section>" not in text and "<h2>" not in text and text.rstrip().endswith("</html>")


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ok", None, 5, 3)], "file string, status string, error string, orig_size long, new_size long")
    reports.write_log(reports.outcome_log(rows, crf=24), str(tmp_path / "log"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "log")).select("crf", "file", "new_size").collect()] == [(24, "a", 3)]


def test_save_features(spark, tmp_path):
    path, schema = str(tmp_path / "f"), StructType().add("path", "string").add("mtime", "double")
    assert files.feature_table(spark, path, schema).count() == 0
    reports.save_features(spark, spark.createDataFrame([("a", 1.0)], schema), path)
    now = files.feature_table(spark, path, schema).unionByName(spark.createDataFrame([("b", 2.0)], schema))
    reports.save_features(spark, now, path)
    assert sorted(tuple(r) for r in files.feature_table(spark, path, schema).collect()) == [("a", 1.0), ("b", 2.0)]
    with pytest.raises(Exception):  # noqa: B017  of Spark or of its Java side
        reports.save_features(spark, now.select(F.expr("raise_error('boom')").cast("string").alias("path"), "mtime"), path)
    assert files.feature_table(spark, path, schema).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["f"]


def test_termination(spark):
    calls = []
    with control.Termination(spark) as t:
        assert t.tag in spark.getTags()
        t.register(lambda: calls.append(1))
        t.register(lambda: 1 / 0)
        t.register(lambda: calls.append(2))
        with pytest.raises(TypeError):
            t.register(5)
        t.end()
        t.end()
        assert t.ended and calls == [2, 1]
    assert t.tag not in spark.getTags() and calls == [2, 1]


def test_tries():
    waits, left = [], [0, 0, 5]
    f = lambda: 1 / left.pop(0)
    assert control.retried(f, 3, 1.0, errors=ZeroDivisionError, sleep=waits.append) == 0.2 and waits == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        control.retried(lambda: 1 / 0, 2, sleep=waits.append)


def test_valid_paths(tmp_path):
    (tmp_path / "a.MP4").write_text("x")
    assert control.valid_file(tmp_path / "a.MP4", (".mp4",)) and not control.valid_file(tmp_path / "a.MP4", (".gif",))
    assert not control.valid_file(tmp_path) and not control.valid_file(tmp_path / "no")
    assert control.valid_folder(tmp_path) and not control.valid_folder(tmp_path / "x" / "y") and control.valid_folder(tmp_path / "x" / "y", create=True)


FILES = "path string, mtime double, size long"


def test_feature_stream(spark, tmp_path):
    """Each file is described once; a newer one again; a batch that runs twice leaves its rows once."""
    table, seen = str(tmp_path / "table"), str(tmp_path / "in")
    schema = StructType().add("path", "string").add("mtime", "double").add("kb", "double")
    described = lambda df: df.select("path", "mtime", (F.col("size") / 1024).alias("kb"))

    def arrive(*rows):
        spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(seen)
        features.feature_stream(spark, spark.readStream.schema(FILES).parquet(seen), described, table, schema, str(tmp_path / "check")).awaitTermination()
        return sorted((r["path"], r["mtime"], r["kb"]) for r in features.latest(spark.read.parquet(table)).collect())

    assert arrive(("a", 1.0, 1024), ("b", 1.0, 2048)) == [("a", 1.0, 1.0), ("b", 1.0, 2.0)]
    assert arrive(("a", 1.5, 9999), ("b", 7.0, 4096), ("c", 1.0, 1024)) == [("a", 1.0, 1.0), ("b", 7.0, 4.0), ("c", 1.0, 1.0)]
    assert spark.read.parquet(table).count() == 4
    run = features.upsert(described, table, schema)
    run(spark.createDataFrame([("d", 1.0, 1024)], FILES), 9)
    run(spark.createDataFrame([("d", 1.0, 1024)], FILES), 9)
    assert spark.read.parquet(table).filter("path = 'd'").count() == 1 and spark.read.parquet(table).count() == 5


def test_sampled_windows(spark):
    start = 1_704_067_200
    events = spark.createDataFrame([(start + s, float(s)) for s in (0, 14, 15, 44, 45, 50, 61)], "s long, value double").select(F.timestamp_seconds("s").alias("ts"), "value")
    want = {}
    for s in (0, 14, 15, 44, 45, 50, 61):
        at = start + s
        if at % 45 < 15:
            n, total = want.get(at // 45, (0, 0.0))
            want[at // 45] = (n + 1, total + s)
    found = features.sampled_windows(events).collect()
    assert sorted((r["n"], r["total"]) for r in found) == sorted(want.values())
