"""File sources on a small tree. b.png has no bytes: Spark does not list it."""

from pyspark.sql.types import StructType

from quarrylight.sources import files


def test_listing(spark, tmp_path):
    for name in ("a.JPG", "b.png", "c.txt", "in/d.jpg", "in/Duplicate/e.jpg", "Duplicate/f.jpg"):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"" if name == "b.png" else b"12345")
    names = lambda **more: sorted(r["name"] for r in files.media_files(spark, str(tmp_path), (".jpg", ".png"), **more).collect())
    assert names() == ["a.JPG", "d.jpg"]
    assert names(recursive=False) == ["a.JPG"]
    assert names(without=()) == ["a.JPG", "d.jpg", "e.jpg", "f.jpg"]
    rows = {r["name"]: r for r in files.media_files(spark, str(tmp_path)).filter(files.valid_size()).collect()}
    assert set(rows) == {"a.JPG", "c.txt", "d.jpg"} and rows["a.JPG"]["size"] == 5 and rows["a.JPG"]["ext"] == ".jpg" and rows["a.JPG"]["stem"] == "a"


def test_feature_table(spark, tmp_path):
    schema = StructType().add("path", "string").add("mtime", "double")
    assert files.feature_table(spark, str(tmp_path / "none"), schema).collect() == []
    spark.createDataFrame([("a", 1.0)], schema).write.parquet(str(tmp_path / "some"))
    assert [tuple(r) for r in files.feature_table(spark, str(tmp_path / "some"), schema).collect()] == [("a", 1.0)]
