"""Counts and rates of a run that come with the job that does the work, without a second look at the rows."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Run:
    """Metrics of one action over rows that pass through: `watch` the rows, run one action, ask for the `summary`.

    with Run("convert", converted=F.count_if(ok)) as run:
        run.watch(rows).write.parquet(path)
    run.summary(spark)

    The aggregates are partial sums in the tasks of that action, so nothing is read again. Rows that an action does not reach,
    as behind a limit, are not counted; a stage that runs again after a lost executor counts once, when it completes. An action
    that fails leaves no metrics.
    """

    def __init__(self, name: str, **metrics: Column):
        self.name, self.metrics = name, metrics
        self.observation = Observation(f"{name}-{time.time_ns()}")
        self.began = self.took = None

    def watch(self, rows: DataFrame) -> DataFrame:
        every = {"n_rows": F.count(F.lit(1)), **self.metrics}
        return rows.observe(self.observation, *(c.alias(name) for name, c in every.items()))

    def __enter__(self) -> Run:
        self.began = time.monotonic()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.took = time.monotonic() - self.began

    def get(self) -> dict:
        """The metrics by name; waits for the action, so one must have run."""
        return dict(self.observation.get)

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row: run, the metrics, seconds and rows a second, null where no time has passed."""
        found = self.get()
        row = spark.range(1).select(F.lit(self.name).alias("run"), *(F.lit(v).alias(k) for k, v in found.items()))
        rate = found["n_rows"] / self.took if self.took else None
        return row.withColumns({"seconds": F.lit(self.took).cast("double"), "rate": F.lit(rate).cast("double")})


def outcome_metrics(status: str = "status", old: str = "orig_size", new: str = "new_size") -> dict[str, Column]:
    """Metrics of rows with a status (ok, skipped, error) and sizes: how many of each, and the bytes saved by those that are ok."""
    is_ = lambda name: F.col(status) == name
    return {
        "n_ok": F.count_if(is_("ok")),
        "n_skipped": F.count_if(is_("skipped")),
        "n_error": F.count_if(is_("error")),
        "saved": F.coalesce(F.sum(F.when(is_("ok"), F.col(old) - F.col(new))), F.lit(0)),
    }
