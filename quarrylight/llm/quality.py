"""4. Quality rules: a decision list of threshold conjunctions, learned by sequential covering from labelled statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import among, table
from quarrylight.shipping import ship
from quarrylight.storage import small

SYMBOLS = b"#*$%&|<>"
STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_different long"
SAMPLE = 20_000  #: labelled rows, at most about so many, that the rules are learned from
LEAST_WORDS, MOST_REPEATED = 50, 50


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts of STATISTICS for a whole text; words are parted by ASCII white space."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return 0, 0, sum(map(data.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))), 0, 0, 0, 0, 0
    tokens = b"".join(words)
    chars = len(tokens) if tokens.isascii() else len(tokens.decode("utf-8", "surrogatepass"))
    symbols = sum(data.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(different := set(windows)) < len(windows):
        del different
        often = Counter(windows)
        reach = 0  # end of the words that are counted
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    upper = len(tokens) - len(tokens.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, len(set(words))


def _statistics(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in STATISTICS.split(", ")]
    for texts in batches:
        yield pd.DataFrame([statistics(t) for t in texts], columns=names, dtype=np.int64)


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with a struct column __ql_q of STATISTICS. A null text has no words."""
    ship(docs.sparkSession)
    return docs.withColumn("__ql_q", F.pandas_udf(_statistics, STATISTICS)("text"))


def features(q: str = "__ql_q") -> dict[str, Column]:
    """What the rules look at: shares, so that they mean the same in short and long texts."""
    x = lambda name: F.col(f"{q}.{name}").cast("double")
    words = F.greatest(x("n_words"), F.lit(1.0))
    return {
        "word_length": x("word_chars") / words,
        "symbol_share": x("n_symbols") / words,
        "dup_line_share": x("n_dup_lines") / F.greatest(x("n_lines"), F.lit(1.0)),
        "repeat_share": x("n_repeat_words") / words,
        "upper_share": x("n_upper") / F.greatest(x("word_chars"), F.lit(1.0)),
        "different_share": x("n_different") / words,
    }


@dataclass(frozen=True)
class Rule:
    """All of the conditions (feature, above?, threshold) hold: the document is rejected."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, t in self.conditions:
            out &= x[name] > t if above else x[name] <= t
        return out

    def column(self, x: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, t in self.conditions:
            out = out & (x[name] > t if above else x[name] <= t)
        return out


def _best_condition(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray):
    """The condition with the largest FOIL gain among rows inside; thresholds lie halfway between values."""
    p, n = (bad & inside).sum(), (~bad & inside).sum()
    before = np.log2(p / (p + n))
    best = (0.0, None)
    for name, values in x.items():
        v, y = values[inside], bad[inside]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        ends = np.flatnonzero(v[1:] > v[:-1])
        if not len(ends):
            continue
        low_p = np.cumsum(y)[ends]
        low_n = np.cumsum(~y)[ends]
        for above, a, b in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
            gain = np.where(a > 0, a * (np.log2(np.maximum(a, 1e-9) / np.maximum(a + b, 1)) - before), 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), (name, above, float((v[ends[k]] + v[ends[k] + 1]) / 2)))
    return best[1]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, precision: float = 0.95, least: int = 5, most_conditions: int = 4) -> list[Rule]:
    """Sequential covering: grow a conjunction on the rows that are not in `prune`, cut it back to the prefix that is worth
    most on those that are, keep it if it is precise enough on both, take away what it covers, and go on."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while (bad & left & ~prune).any():
        inside = left & ~prune
        conditions: list[tuple[str, bool, float]] = []
        while len(conditions) < most_conditions and (~bad & inside).any():
            c = _best_condition(x, bad, inside)
            if c is None:
                break
            conditions.append(c)
            inside &= Rule((c,)).covers(x)
        worth = []
        for k in range(1, len(conditions) + 1):
            got = Rule(tuple(conditions[:k])).covers(x) & left & prune
            p, n = (got & bad).sum(), (got & ~bad).sum()
            worth.append(((p - n) / max(p + n, 1), -k))
        if not worth:
            break
        rule = Rule(tuple(conditions[: -max(worth)[1]]))
        got = rule.covers(x) & left
        if (got & bad).sum() < least or (got & bad).sum() < precision * got.sum():
            break
        rules.append(rule)
        left &= ~got
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **settings) -> list[Rule]:
    """Rules from about `sample` labelled documents, chosen by a hash of doc_id; fewer labels are all used. Rows without a
    label or text, ids with labels of both kinds, and documents that the base rules reject anyway teach nothing. An id with
    several texts teaches by the one with the least statistics, so no more rows than ids reach the driver. Of conditions that
    are worth the same the first feature's, and of a feature's the first threshold, is taken. Without both kinds there are no rules."""
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high")
    n = marks.count()
    if n > sample:
        marks = marks.filter(among(F.xxhash64("doc_id"), sample, n))
    own = with_statistics(docs.filter("text is not null").select("doc_id", "text").join(small(marks, 4 * sample), "doc_id"))
    rows = own.filter(~base_failed()).select("doc_id", F.struct("low", *(c.alias(name) for name, c in features().items())).alias("x"))
    rows = rows.groupBy("doc_id").agg(F.min("x").alias("x")).select("doc_id", "x.*").toPandas()
    rows = rows.sort_values(["doc_id", *features()], kind="stable", ignore_index=True)
    bad = rows["low"].to_numpy() == 0
    if not bad.any() or bad.all():
        return []
    return learn({name: rows[name].to_numpy(float) for name in features()}, bad, np.arange(len(rows)) % 3 == 2, **settings)


def base_failed(q: str = "__ql_q") -> Column:
    n = F.col(f"{q}.n_words")
    return (n < LEAST_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > MOST_REPEATED * n)


def verdict(rules: list[Rule], q: str = "__ql_q") -> Column:
    """The decision list as one ordered conditional expression: true keeps."""
    out, x = F.when(base_failed(q), False), features(q)
    for rule in rules:
        out = out.when(rule.column(x), False)
    return out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with __ql_q (STATISTICS) and __ql_kept, the verdict. Statistics are of whole texts; one text at a time is in a
    worker's memory, with its windows of words.

    Nulls: a null text is empty and fails the base rules; null ids are judged like others. Repeated rows are judged each;
    an empty table gives no rows, and no labels leave the base rules alone. Other columns stay.
    """
    rules = learn_rules(docs, labels, sample)
    return with_statistics(docs).withColumn("__ql_kept", verdict(rules))


def op4(spark, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *(f"__ql_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base_failed().alias("base_failed"), F.col("__ql_kept").alias("kept"))
