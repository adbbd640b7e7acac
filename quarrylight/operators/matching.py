"""Entities by their nearest reference vectors: loading, gates, thresholds, greedy exclusion, categories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from quarrylight.functions.strings import person_key, stem
from quarrylight.operators import vector_index
from quarrylight.operators.numbering import numbered
from quarrylight.operators.pairs import across
from quarrylight.shipping import ship
from quarrylight.storage import fits, small, written

LARGEST_REFERENCES = 20_000  #: references that are sent to every task; more meet the vectors by blocks


def gates(faces: DataFrame, least_score: float = 0.65, of_image: float = 0.005, of_largest: float = 0.18) -> DataFrame:
    """Detections (image_id, area, image_area, det_score) that are sure, large in their image, and large beside its largest."""
    kept = faces.filter((F.col("det_score") >= least_score) & (F.col("area") / F.col("image_area") >= of_image))
    largest = F.max("area").over(Window.partitionBy("image_id"))
    return kept.withColumn("largest", largest).filter(F.col("area") >= of_largest * F.col("largest")).drop("largest")


def load_references(faces: DataFrame) -> DataFrame:
    """(person, person_ord, path, emb) of detections (path, area, emb): the largest face of each file, the first of equals by
    its emb; the person is the file's name without extension and number. Files without a vector give none; persons are in
    order of their names. No references at all is the caller's error to raise."""
    there = faces.filter("emb is not null")
    best = there.groupBy("path").agg(F.max_by("emb", F.struct("area", "emb")).alias("emb"))
    named = best.select(person_key(stem(F.element_at(F.split("path", "/"), -1))).alias("person"), "path", "emb")
    order = numbered(named.select("person").distinct(), [], ["person"], "person_ord")
    return named.join(small(order, LARGEST_REFERENCES), "person").select("person", "person_ord", "path", "emb")


def _matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 1))
    return x, np.sqrt((x * x).sum(axis=1))


def _persons(faces: pd.DataFrame, refs: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
    """The best cosine of each vector (rows) with each person (columns), and the persons in their order."""
    refs = refs.sort_values(["person_ord", "person"], kind="stable", ignore_index=True)
    (x, nx), (y, ny) = _matrix(faces["emb"]), _matrix(refs["emb"])
    cosine = (x @ y.T) / (nx[:, None] * ny + 1e-8)
    starts = np.flatnonzero(np.r_[True, refs["person"].to_numpy()[1:] != refs["person"].to_numpy()[:-1]])
    return np.maximum.reduceat(cosine, starts, axis=1), refs.iloc[starts]


def scores(faces: DataFrame, references: DataFrame, keys: list[str], least: float | None = None, best: bool = False) -> DataFrame:
    """keys, person, person_ord, score: each vector's best cosine with a person, by matrix products; with `least`, those at
    that score or more; with `best`, the first best person only. A null vector has none.

    References are measured before they are sent to every task. Of more, the best one is looked up in an index of cells where
    the key is one long (`vector_index`, scores to 9 decimals); otherwise they meet the vectors block by block.
    """
    ship(faces.sparkSession)
    faces = faces.filter("emb is not null").select(*keys, "emb")
    refs = references.filter("emb is not null").select("person", F.col("person_ord").cast("long").alias("person_ord"), "emb")
    kinds = StructType([faces.schema[k] for k in keys]).add("person", StringType()).add("person_ord", LongType()).add("score", DoubleType())

    text = [f.name for f in kinds if isinstance(f.dataType, StringType)]

    def rows(part: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(own):
            return pd.DataFrame({f.name: pd.Series([], dtype=object) for f in kinds})
        score, persons = _persons(part, own)
        wanted = np.ones(score.shape, bool) if least is None else score >= least
        if best:
            wanted &= np.arange(score.shape[1]) == score.argmax(axis=1)[:, None]
        i, j = np.nonzero(wanted)
        out = part[keys].iloc[i].reset_index(drop=True)
        person = pd.Series(persons["person"].to_numpy(object)[j], dtype=object)
        return out.assign(person=person, person_ord=persons["person_ord"].to_numpy()[j], score=score[i, j]).astype({k: object for k in text})

    if fits(refs, LARGEST_REFERENCES):
        sent = faces.sparkSession.sparkContext.broadcast(refs.toPandas())

        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield rows(part, sent.value)

        return faces.mapInPandas(batches, kinds)
    if best and least is None and len(keys) == 1 and isinstance(faces.schema[keys[0]].dataType, LongType):
        known = written(numbered(refs, [], ["person_ord", "person"], "ref_id"), "references")
        index = vector_index.build(known.select("ref_id", "emb"))
        top = vector_index.search(faces.withColumnRenamed(keys[0], "item_id"), index).withColumnRenamed("item_id", keys[0])
        return top.join(known.drop("emb"), "ref_id").select(*keys, "person", "person_ord", "score")
    met = across(faces, refs, rows, kinds).groupBy(*keys, "person", "person_ord").agg(F.max("score").alias("score"))
    if not best:
        return met
    top = met.groupBy(*keys).agg(F.max_by(F.struct("person", "person_ord", "score"), F.struct("score", -F.col("person_ord"))).alias("b"))
    return top.select(*keys, "b.*")


def nearest_reference(faces: DataFrame, references: DataFrame, keys: list[str], threshold: float = 0.40) -> DataFrame:
    """keys, person, score: the best person, the earlier on ties; Others below the threshold."""
    found = scores(faces, references, keys, best=True)
    return found.select(*keys, F.when(F.col("score") >= threshold, F.col("person")).otherwise("Others").alias("person"), "score")


def greedy_match(faces: DataFrame, references: DataFrame, threshold: float = 0.40) -> DataFrame:
    """(image_id, face_ord, person, score): faces of an image in order each take the best person not yet taken there.

    One pandas call an image; an image's faces and persons over the threshold are few.
    """
    all_ = scores(faces, references, ["image_id", "face_ord"], least=threshold)

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for face, own in rows.sort_values(["face_ord", "score", "person_ord"], ascending=[True, False, True]).groupby("face_ord"):
            for person, score in zip(own["person"], own["score"]):
                if person not in taken:
                    taken.add(person)
                    out.append((rows["image_id"].iat[0], face, person, score))
                    break
        return pd.DataFrame(out, columns=["image_id", "face_ord", "person", "score"])

    return all_.groupBy("image_id").applyInPandas(take, "image_id long, face_ord int, person string, score double")


def categorise(hits: DataFrame) -> DataFrame:
    """(image_id, category, score) from hits (image_id, person, score, is_priority): Group for two priority persons or more,
    that person for one, else the best other. An unknown priority is none."""
    first = F.coalesce("is_priority", F.lit(False))
    agg = hits.groupBy("image_id").agg(
        F.count_if(first).alias("n"),
        F.max(F.when(first, F.col("score"))).alias("top"),
        F.max_by(F.when(first, F.col("person")), F.when(first, F.col("score"))).alias("one"),
        F.max_by("person", "score").alias("other"),
        F.max("score").alias("best"),
    )
    return agg.select(
        "image_id",
        F.when(F.col("n") >= 2, "Group").when(F.col("n") == 1, F.col("one")).otherwise(F.coalesce("other", F.lit("Others"))).alias("category"),
        F.when(F.col("n") >= 1, F.col("top")).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def category_order(name) -> object:
    """Named ones first, then Group, then Others."""
    return F.when(name == "Others", 2).when(name == "Group", 1).otherwise(0)


def category_summary(found: DataFrame, name: str = "person") -> DataFrame:
    c = F.col(name)
    out = found.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(category_order(c), c)).cast("long"))


def category_counts(found: DataFrame, name: str = "person") -> DataFrame:
    """One row: matched, in Group, in Others, and how many different persons are matched."""
    c = F.col(name)
    named = ~c.isin("Group", "Others")
    return found.agg(F.count_if(named).alias("matched"), F.count_if(c == "Group").alias("group"), F.count_if(c == "Others").alias("others"), F.count_distinct(F.when(named, c)).alias("persons"))
