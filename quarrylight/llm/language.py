"""10. Language: nearest of several clustered centroids a language, by the cosine of TF-IDF n-gram vectors, with rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import SHARE, table
from quarrylight.shipping import ship
from quarrylight.storage import written

DIMENSIONS = 4096
SAMPLE = 400  #: different texts of a language, at most, that its centroids are fitted on
CENTROIDS = 4
REJECT = 0.01  #: of a centroid's own texts, the share that may lie farther from it than what it accepts
MOST_LANGUAGES = 2_000  #: a model holds 64 KB for each
UNKNOWN = "und"
#: ASCII that is no letter becomes a space; letters are lowered before.
_TABLE = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vector(text: str) -> np.ndarray:
    """Hashed counts of byte n-grams, n from 2 to 4, of the lowered text with everything but letters as spaces."""
    data = np.frombuffer((" " + " ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).decode("utf-8", "surrogatepass").split()) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(data), 1 << 18):  # bounded memory; parts overlap by the longest n-gram less one
        a = data[at : at + (1 << 18) + 3].astype(np.uint32)
        last = at + (1 << 18) >= len(data)
        gram = a
        for n in (2, 3, 4):
            gram = gram[: len(a) - n + 1] * np.uint32(257) + a[n - 1 :]
            own = gram if last else gram[: 1 << 18]
            out += np.bincount((own * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(20), minlength=DIMENSIONS)
    return out


@dataclass(frozen=True)
class Model:
    """Centroids of unit length, their languages and the least cosine at which each still accepts a text."""

    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    accepts: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, accepted). A text that is null or has no letter is UNKNOWN; the language of one that is not
        accepted is the nearest still."""
        if text is None or not has_letter(text) or not len(self.owner):
            return UNKNOWN, 0.0, False
        x = np.sqrt(vector(text)) * self.idf
        cosine = self.centroids @ (x / max(np.linalg.norm(x), 1e-12))
        k = int(np.argmax(cosine))
        return self.languages[self.owner[k]], float(min(max(cosine[k], 0.0), 1.0)), bool(cosine[k] >= self.accepts[k])


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the row farthest from those chosen before; rows have unit length."""
    centre = x.mean(axis=0)
    chosen = [int(np.argmax(x @ centre))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    c = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def idf_of(n: int, there: np.ndarray) -> np.ndarray:
    """Weights from the number of documents and of those with each n-gram."""
    return (np.log((1 + n) / (1 + there)) + 1).astype(np.float32)


def centroids_of(counts: np.ndarray, idf: np.ndarray, k: int = CENTROIDS, reject: float = REJECT) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of one language from rows of counts, and the least cosine that each accepts: that of all but `reject` of its own rows, less a tenth."""
    x = np.sqrt(counts.astype(np.float32)) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = _clusters(x, k)
    near = x @ c.T
    own = np.argmax(near, axis=1)
    accepts = [0.9 * float(np.quantile(near[own == j, j], reject)) if (own == j).any() else 1.0 for j in range(len(c))]
    return c.astype(np.float32), np.array(accepts)


def _chosen(rows: DataFrame, sample: int) -> DataFrame:
    """(lang, key, text): of each language the `sample` different texts with the least hashes, all if it has fewer.

    A hash bound from the number of different texts, which is never under a language's least hash, leaves about three
    times as many; copies of a text are one, before any leaves its task; then the least are taken exactly."""
    key = F.xxhash64("text")
    keyed = rows.select("lang", key.alias("key"), F.shiftrightunsigned(key, 1).alias("place"), "text")
    sizes = keyed.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"), F.min("place").alias("least")).limit(MOST_LANGUAGES + 1).collect()  # one row a language
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: a label like this is no language")
    most = rows.sparkSession.createDataFrame([(r["lang"], max(r["least"], min(SHARE - 1, SHARE * 3 * sample // max(r["n"], 1)))) for r in sizes], "own string, most long")
    few = keyed.join(F.broadcast(most), F.col("lang") == F.col("own")).filter("place <= most")
    few = few.groupBy("lang", "key").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("key", 1), "key")
    return few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample).select("lang", "key", "text")


def fit(docs: DataFrame, allowed: Column, sample: int = SAMPLE, k: int = CENTROIDS, reject: float = REJECT) -> Model:
    """A model from text and lang of the rows that are allowed, where both are there and the text has a letter; of each
    language at most `sample` different texts, chosen by their hashes, so that copies and the size of a language do not matter.

    Whole texts are counted where they lie, and each language is clustered in a task of its own, whose rows `sample` bounds;
    what reaches the driver is `k` centroids and one vector of document counts for each language. No rows give a model
    without languages.
    """
    ship(docs.sparkSession)
    rows = docs.filter(allowed & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([vector(t).astype("<i4").tobytes() for t in texts], dtype=object)

    chosen = written(_chosen(rows, sample).select("lang", "key", F.pandas_udf(vectors, "binary")("text").alias("counts")), "languages")

    def table_of(rows: pd.DataFrame) -> np.ndarray:
        return np.stack([np.frombuffer(x, "<i4") for x in rows.sort_values("key")["counts"]])

    def seen(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(rows)], "there": [(table_of(rows) > 0).sum(axis=0).astype("<i8").tobytes()]})

    parts = chosen.groupBy("lang").applyInPandas(seen, "n long, there binary").collect()  # a row a language
    if not parts:
        return Model((), np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
    idf = idf_of(sum(r["n"] for r in parts), sum(np.frombuffer(bytes(r["there"]), "<i8") for r in parts))

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        c, accepts = centroids_of(table_of(rows), idf, k, reject)
        return pd.DataFrame({"lang": rows["lang"].iat[0], "number": range(len(c)), "centroid": [x.astype("<f4").tobytes() for x in c], "accepts": accepts})

    found = sorted(map(tuple, chosen.groupBy("lang").applyInPandas(cluster, "lang string, number int, centroid binary, accepts double").collect()))
    names = tuple(sorted({r[0] for r in found}))
    owner = np.array([names.index(r[0]) for r in found])
    return Model(names, idf, np.stack([np.frombuffer(bytes(r[2]), "<f4") for r in found]), owner, np.array([r[3] for r in found]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with __ql_l: struct (lang, score, accepted) from the whole text, and nothing but the text.

    Nulls: a null text, or one without a letter, is `und` with score 0. Repeated rows are predicted each; an empty table
    gives none. A model of no languages gives `und`. Equal cosines go to the language that is first by code point. Other columns stay, whatever their names. A very long text is counted
    in parts of a quarter of a megabyte.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for texts in batches:
            yield pd.DataFrame([own.predict(t) for t in texts], columns=["lang", "score", "accepted"])

    return docs.withColumn("__ql_l", F.pandas_udf(predict, "lang string, score double, accepted boolean")("text"))


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out())
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("__ql_l.lang").alias("lang_pred"), F.col("__ql_l.score").alias("score"), F.col("__ql_l.accepted").alias("accepted"))
