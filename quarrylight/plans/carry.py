"""Carrying out a plan of moves: in two phases by tasks that may run twice, with a journal from which a stopped run goes on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.shipping import ship
from quarrylight.sources.heads import store_of

PLANNED = "src_path string, dst_path string, temporary string"
STEPS = "src_path string, dst_path string, temporary string, state string"
FILES = 500  #: of a task


def _known(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table at path, null where there is none or where it was not finished."""
    try:
        spark.read.text(f"{path}/_SUCCESS")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return spark.read.schema(schema).parquet(path)


def _there(store, path: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(path).type != fs.FileType.NotFound


def _set_aside(store, src: str, temporary: str, dst: str, copy: bool) -> str:
    """A file's first phase: to its temporary name. Says the same if the file is there already, or was moved on."""
    if _there(store, temporary):
        return "aside"
    if _there(store, src):
        store.create_dir(temporary.rsplit("/", 1)[0], recursive=True)
        if copy:
            store.copy_file(src, temporary + ".part")
            store.move(temporary + ".part", temporary)
        else:
            store.move(src, temporary)
        return "aside"
    return "missing"


def _put_in_place(store, src: str, temporary: str, dst: str, copy: bool) -> str:
    """Its second: from there to its new name. A name that another file has is not taken: the file goes back."""
    if not _there(store, temporary):
        return "moved" if _there(store, dst) else "missing"
    if not _there(store, dst):
        store.move(temporary, dst)
        return "moved"
    if copy:
        store.delete_file(temporary)
    elif not _there(store, src):
        store.move(temporary, src)
    return "restored"


def _phase(rows: DataFrame, folder: str, step, copy: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = store_of(folder)
        at = lambda path: f"{top.rstrip('/')}/{path}"
        for batch in batches:
            states = [step(store, at(s), at(t), at(d), copy) for s, t, d in zip(batch["src_path"], batch["temporary"], batch["dst_path"])]
            yield batch.assign(state=states)

    return rows.mapInPandas(run, STEPS)


def carry_out(plan: DataFrame, folder: str, journal: str, execute: bool = False, copy: bool = False) -> DataFrame:
    """(src_path, dst_path, state) of a plan (src_path, dst_path, ...), paths relative to folder; rows without a dst_path stay
    out. Without execute nothing is touched: every state is `planned`, and no journal is written.

    With it, files first go to temporary names of their own in the folders where they are wanted, then to the names planned, so
    that names may be handed round. journal is a folder of this plan alone: what was planned, then the state after each
    phase. A run that finds a plan there goes on with that one, not with `plan`. Every step looks at what there is before it
    does anything, so a task that is lost or runs twice, and a run that was stopped anywhere, move each file once.

    moved: it has its new name. missing: there is no such file. restored: another file has the name, this one has its old name
    again. copy: files keep their old names too. A plan must not name a dst_path twice; the later file would be `restored`.
    """
    spark = plan.sparkSession
    rows = plan.filter("src_path is not null and dst_path is not null").select("src_path", "dst_path")
    if not execute:
        return rows.withColumn("state", F.lit("planned"))
    ship(spark)
    place = F.regexp_replace("dst_path", r"[^/]*$", "")
    named = rows.withColumn("temporary", F.concat(place, F.lit("."), F.sha2(F.concat_ws("\0", "src_path", "dst_path"), 256), F.lit(".moving")))
    planned = _known(spark, f"{journal}/planned", PLANNED)
    if planned is None:
        named.select("src_path", "dst_path", "temporary").write.mode("overwrite").parquet(f"{journal}/planned")
        planned = spark.read.schema(PLANNED).parquet(f"{journal}/planned")
    parts = max(1, -(-planned.count() // FILES))
    aside = _known(spark, f"{journal}/aside", STEPS)
    if aside is None:
        _phase(planned.repartition(parts), folder, _set_aside, copy).write.mode("overwrite").parquet(f"{journal}/aside")
        aside = spark.read.schema(STEPS).parquet(f"{journal}/aside")
    done = _known(spark, f"{journal}/done", STEPS)
    if done is None:
        moving = aside.filter("state = 'aside'").drop("state").repartition(parts)
        gone = aside.filter("state != 'aside'")
        _phase(moving, folder, _put_in_place, copy).unionByName(gone).write.mode("overwrite").parquet(f"{journal}/done")
        done = spark.read.schema(STEPS).parquet(f"{journal}/done")
    return done.select("src_path", "dst_path", "state")


def after(items: DataFrame, outcome: DataFrame) -> DataFrame:
    """items (path, ...) with the paths that they have after a plan was carried out."""
    moved = outcome.filter("state = 'moved'").select(F.col("src_path").alias("__src"), "dst_path")
    return items.join(moved, F.col("path") == F.col("__src"), "left").withColumn("path", F.coalesce("dst_path", "path")).select(*items.columns)
