"""Metrics that come with a job: the same as from a second one, and none."""

from pyspark.sql import functions as F

from quarrylight.operators import metrics

ROWS = [("ok", 10, 4), ("ok", 10, 9), ("skipped", 5, 6), ("error", None, None)]
SCHEMA = "status string, orig_size long, new_size long"


def test_metrics_come_with_the_job(spark, tmp_path):
    """The rows are read once: a counter in the source says so."""
    read = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.createDataFrame(ROWS * 50, SCHEMA).mapInPandas(once, SCHEMA)
    with metrics.Run("x", **metrics.outcome_metrics()) as run:
        run.watch(rows).write.parquet(str(tmp_path / "out"))
    got = run.summary(spark).first().asDict()
    assert read.value == 200
    assert {k: got[k] for k in ("run", "n_rows", "n_ok", "n_skipped", "n_error", "saved")} == {"run": "x", "n_rows": 200, "n_ok": 100, "n_skipped": 50, "n_error": 50, "saved": 350}
    assert got["seconds"] > 0 and abs(got["rate"] - 200 / got["seconds"]) < 1e-6


def test_no_rows_and_two_runs(spark, tmp_path):
    for k, rows in enumerate(([], ROWS)):
        with metrics.Run("same name", last=F.max("new_size")) as run:
            run.watch(spark.createDataFrame(rows, SCHEMA)).write.parquet(str(tmp_path / str(k)))
        assert run.get() == {"n_rows": len(rows), "last": max((r[2] or 0 for r in rows), default=None)}
