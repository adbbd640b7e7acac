"""12. Spelling variant grouping: an errata trie merged along heavy paths, whose coinciding terminals are words one edit apart."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import ASCII_LOWER, ASCII_UPPER, table
from quarrylight.llm.nested_schema import CRC_SQL, crc_sql
from quarrylight.shipping import ship
from quarrylight.storage import small, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)
HELD = 4 << 20  #: characters of the different words that a task holds before it passes its counts on
PRIMES = ((2147483647, 1000003), (2147483629, 998244341))  #: moduli and bases of the hash of a prefix
HOT = 1000  #: a node with over this part of all words is met by a broadcast
WORD, DROPPED, ADDED = -1, -2, -3  #: `at` of terminals; of one with a character replaced it is the character's place


def count_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, spoil: int | None = None) -> DataFrame:
    """(word, n) of the runs of letters of whole texts, A-Z lowered, with at least least_length code points and least_count
    occurrences. spoil: of runs whose CRC-32 of `<doc_id>:<run>` it divides, one character is left out first.

    Counted in tasks by text and then by task, so a frequent word is a row for each task. A null text has no words, a null id
    reads as empty. Repeated rows count each; an empty table has none; other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter[str] = Counter()
        size = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64())], ["word", "n"])
            totals.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                before = crc32(f"{key or ''}:".encode())
                runs: Counter[str] = Counter()
                for run, n in Counter(RUN.findall(text or "")).items():
                    runs[run.lower() if run.isascii() else run.translate(LOWER)] += n
                for run, n in runs.items():
                    if len(run) < least_length:
                        continue
                    if spoil and (h := crc32(run.encode(), before)) % spoil == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                        if len(run) < least_length:
                            continue
                    if run not in totals:
                        size += len(run)
                    totals[run] += n
                if size > HELD:
                    yield flush()
                    size = 0
        yield flush()

    words = docs.select(F.col("doc_id").cast("string"), F.col("text")).mapInArrow(counted, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, node, at, step) for each node of the trie on each word's path: its prefix's hash, its depth, and the code point
    of the child that the path goes on to, 0 where the word ends."""
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            words = part.column(1).to_pylist()
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            ends = np.cumsum(lengths + 1)
            starts = ends - lengths - 1
            steps = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            at = np.arange(len(steps), dtype=np.int64) - np.repeat(starts, lengths + 1)
            node = np.zeros(len(steps), dtype=np.uint64)
            for prime, base in PRIMES:
                powers = np.ones(1, dtype=np.uint64)
                while len(powers) <= at.max(initial=0):
                    powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), prime)) % np.uint64(prime)])
                sums = np.concatenate([[np.uint64(0)], np.cumsum(steps * powers[at] % np.uint64(prime))[:-1]])
                node = (node << np.uint64(31)) | ((sums - np.repeat(sums[starts], lengths + 1)) % np.uint64(prime))
            ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), lengths + 1)
            columns = [pa.array(ids, pa.int64()), pa.array(node.astype(np.int64)), pa.array(at.astype(np.int32)), pa.array(steps.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "at", "step"])


def _errata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, at, word, n): where a word lands when the light subtree that it lies in is merged into its heavy sibling, with
    the character at the light edge replaced by the heavy one, left out, or put after the heavy one."""
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for word, n, light in zip(*(c.to_pylist() for c in batch.columns)):
            for edge in light:
                i, heavy = edge["at"], chr(edge["heavy"])
                head, own, tail = word[:i], word[i : i + 1], word[i + 1 :]
                out.append((head + heavy + own + tail, ADDED, word, n))
                if own:
                    out.append((head + heavy + tail, i, word, n))
                    if not tail.startswith(own):  # else the two words part further down
                        out.append((head + tail, DROPPED, word, n))
                held += 6 * len(word)
                if held > 1 << 22:
                    yield _batch(out)
                    out, held = [], 0
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*rows)) or [[]] * 4, kinds)], ["key", "at", "word", "n"])


def terminals(words: DataFrame) -> DataFrame:
    """(key, at, word, n): the terminals of the merged trie. Words themselves have `at` -1; others are words with one character
    replaced at `at`, left out (-2) or added (-3). Two words are one edit apart exactly if one lands on the other itself, or
    both land on one key with the same character replaced; each such pair meets once, at the node where the two part.

    Each word takes the edges of its path that do not lead to the child with most words below: log2 of the words at most, so
    small subtrees move into large ones and the terminals are n log n. All words at a node must agree about its heavy child and
    need not agree about more, so a node is known by a hash of its prefix. Nodes above a thousandth of the words are
    few; they are broadcast where they fit, and no other node is a large group of the join.
    """
    ship(words.sparkSession, 10_000)
    vocabulary = written(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words")
    steps = written(vocabulary.select("id", "word").mapInArrow(_steps, "id long, node long, at int, step int"), "steps")
    children = steps.groupBy("node", "step").agg(F.count(F.lit(1)).alias("n"))
    first = F.max_by("step", F.struct(F.col("step") > 0, F.col("n"), -F.col("step")))
    nodes = written(children.groupBy("node").agg(first.alias("heavy"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kids")).filter("kids > 1").drop("kids"), "nodes")
    total = vocabulary.count()
    hot = small(nodes.filter(F.col("n") * HOT > total).select("node", "heavy"), 500_000)
    cold = nodes.filter(F.col("n") * HOT <= total).select("node", "heavy")
    light = steps.join(hot, "node").unionByName(steps.join(hot, "node", "left_anti").join(cold, "node")).filter("step != heavy")
    light = light.groupBy("id").agg(F.collect_list(F.struct("at", "heavy")).alias("light"))
    landed = vocabulary.join(light, "id").select("word", "n", "light").mapInArrow(_errata, "key string, at int, word string, n long")
    return vocabulary.select(F.col("word").alias("key"), F.lit(WORD).alias("at"), "word", "n").unionByName(landed)


def near_words(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n) of different words with their counts: how many of them differ by exactly one inserted,
    deleted or replaced code point, and the one with the largest n of these (ties: the smallest word), if that is at
    least ratio times the word's own.

    Terminals are shuffled by key. A key holds at most one word for each character and place, whatever the number of words;
    its words are ranked, not paired. Null words must not occur; an empty table gives no rows.
    """
    both = Window.partitionBy("key")
    one = Window.partitionBy("key", "at")
    best = F.struct((-F.col("n")).alias("n"), F.col("word").alias("word"))
    is_word = F.col("at") == WORD
    rows = terminals(words).withColumn("met", F.count(F.lit(1)).over(both)).filter((F.col("met") > 1) | is_word)
    rows = rows.withColumn("itself", F.min(F.when(is_word, best)).over(both)).withColumn("landed", F.min(F.when(~is_word, best)).over(both))
    rows = rows.withColumn("alike", F.count(F.lit(1)).over(one))
    order = one.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("first", F.first(best).over(order)).withColumn("second", F.nth_value(best, 2).over(order))
    other = F.when(F.col("at") >= 0, F.when(F.col("first")["word"] == F.col("word"), F.col("second")).otherwise(F.col("first")))
    near = F.when(is_word, F.col("met") - 1).otherwise(F.col("itself").isNotNull().cast("long") + F.when(F.col("at") >= 0, F.col("alike") - 1).otherwise(0))
    rows = rows.select("word", "n", near.alias("n_near"), F.when(is_word, F.col("landed")).otherwise(F.least("itself", other)).alias("best"))
    out = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    large = -F.col("best")["n"] >= ratio * F.col("n")
    return out.select("word", "n", "n_near", F.when(large, F.col("best")["word"]).alias("form"), F.when(large, -F.col("best")["n"]).alias("form_n"))


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """`near_words` with root: the last word when forms are followed, the word itself if it has none.

    A form has at least `ratio` times the count, so a chain is as long as a logarithm of the largest count; roots come down
    level by level. In a level a form is the key of its own variants alone, one edit away each, however many words its
    root has.
    """
    found = written(near_words(words, ratio), "near")
    forms = found.filter("form is not null").select("word", "form")
    level = found.filter("form is null").select(F.col("word").alias("of"), F.col("word").alias("root"))
    levels = []
    while not level.isEmpty():
        level = written(forms.join(level, F.col("form") == F.col("of")).select(F.col("word").alias("of"), "root"), "roots")
        levels.append(level)
    below = levels[0] if levels else level
    for x in levels[1:]:
        below = below.unionByName(x)
    return found.join(below, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark, sf_dir: str) -> DataFrame:
    return variants(count_words(table(spark, sf_dir, "documents"), spoil=97))


OP12_SQL = rf"""
with recursive {CRC_SQL},
runs as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents),
low as (select doc_id, translate(run, '{ASCII_UPPER}', '{ASCII_LOWER}') as run, count(*) as n from runs group by 1, 2),
hashed as (select run, n, {crc_sql("doc_id || ':' || run")} as h from low, crc_table),
words as (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed),
v as materialized (select word, sum(n)::bigint as n from words where length(word) >= 5 group by 1 having sum(n) >= 3),
cut as materialized (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as c from (select word, unnest(range(1, length(word) + 1)) as i from v)),
pairs as materialized (select a.word, b.word as other from cut a join cut b on a.i = b.i and a.c = b.c and a.word <> b.word
  union select word, c from cut where c in (select word from v) union select c, word from cut where c in (select word from v)),
ranked as (select p.word, other, n, count(*) over (partition by p.word) as n_near, row_number() over (partition by p.word order by n desc, other) as r from pairs p join v on v.word = other),
forms as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when ranked.n >= 2 * v.n then other end as form, case when ranked.n >= 2 * v.n then ranked.n end as form_n
  from v left join ranked on v.word = ranked.word and r = 1),
chain as (select word, word as last from forms union all select chain.word, forms.form from chain join forms on forms.word = chain.last where forms.form is not null),
roots as (select chain.word, last as root from chain join forms on forms.word = last where forms.form is null)
select forms.word, form, root, n, n_near, form_n from forms join roots using (word)
"""
