"""1. Benchmark decontamination: windows of benchmark words, found in documents through a broadcast hash set of n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.arrays import bound
from quarrylight.llm.common import ASCII_LOWER, ASCII_UPPER, matches, replaced, table
from quarrylight.storage import cut, fits, small

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"  #: a word of a text as it is, in either case
BREAKS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def plain(text: Column) -> Column:
    """The words of the text, A-Z lowered, each followed by one space. Words are runs of digits, ASCII letters and
    everything beyond ASCII. Null and texts without words give ''."""
    spaced = F.translate(text, ASCII_UPPER + BREAKS, ASCII_LOWER + " " * len(BREAKS))
    spaced = F.trim(F.regexp_replace(spaced, " {2,}+", " "))
    return F.coalesce(F.when(spaced != "", F.concat(spaced, F.lit(" "))), F.lit(""))


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, n, w, window) of the items with words."""
    w = F.array_remove(F.split(plain(F.col("text")), " "), "")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), w.alias("w")).filter(F.size("w") > 0)
    return items.withColumn("n", F.size("w")).withColumn("window", F.least("n", F.lit(window)))


def _item_blocks(items: DataFrame, window: int) -> DataFrame:
    """Different (item_id, window, block, item_around): all runs of b words, b the largest for which a window holds a whole one
    of the blocks that a text is cut into, wherever it lies; with the words that a window around it can hold, null beyond the
    ends. A run that an item repeats between the same words is one row, so repeated words do not multiply."""
    b = (window + 1) // 2
    edge = F.array_repeat(F.lit(None).cast("string"), window - b)
    padded = F.concat(edge, F.col("w"), edge)
    own = items.filter(F.col("window") == window).select("item_id", "window", "w", padded.alias("padded"), F.explode(F.sequence(F.lit(1), F.col("n") - b + 1)).alias("i"))
    block = F.concat(F.array_join(F.slice("w", F.col("i"), b), " "), F.lit(" "))
    return own.select("item_id", "window", block.alias("block"), F.slice("padded", F.col("i"), 2 * window - b).alias("item_around")).distinct()


def _blocks(window: int) -> Column:
    """The text `plain`, cut into blocks of b words (the last may have fewer), each with its neighbours and first word's place."""
    b = (window + 1) // 2
    name = f"blocks_{window}"
    return F.transform(
        F.col(name),
        lambda x, i: F.struct(
            F.lit(window).alias("window"), (i * b).alias("at"), x.alias("block"), F.get(F.col(name), i - 1).alias("previous"), F.get(F.col(name), i + 1).alias("next")
        ),
    )


def _words(block: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(block, " "), ""), F.array().cast("array<string>"))


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 13, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, item_ids, contaminated, hits) for each different row (doc_id, text).

    A window is that many consecutive words of an item, or all words of a shorter one; items without words have none.
    Documents are cut into blocks so long that each window holds a whole one; a block whose hash is in the set of all
    blocks of the benchmark is verified word by word, and the run of equal words around it is a hit if a window fits.
    The set is broadcast with its words up to broadcast_rows rows; beyond, its hashes alone are, 16 times as many, so that only
    blocks which they know are shuffled to the words; and where those do not fit either, all blocks are. One scan, one shuffle
    of matching blocks and of a row for each document. hits: array of [from, to) in words.

    Nulls: a null text has no words; a null doc_id is a row of its own; a null item_id counts as ''. Repeated rows give
    one row; the same doc_id with other text gives another. Empty tables give no rows, or no hits. Other columns are ignored,
    whatever their names. A very long text is blocks of words like any other; those that match none leave their task at once.
    """
    items = _items(benchmark, window)
    # at most `window` different lengths
    lengths = sorted(r[0] for r in items.select("window").distinct().collect())
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), plain(F.col("text")).alias("plain"))
    cut_up = [F.regexp_extract_all("plain", F.lit(f"(?:[^ ]++ ){{1,{(n + 1) // 2}}}+"), F.lit(0)).alias(f"blocks_{n}") for n in lengths]
    rows = rows.select("doc_id", "text_hash", (F.length("plain") - F.length(F.replace("plain", F.lit(" ")))).cast("long").alias("n_words"), *cut_up)
    # the first element stands for the document itself, so that no second scan has to bring those without hits back
    none = F.lit(None).cast("string")
    own = F.array(F.struct(F.lit(0).alias("window"), F.lit(-1).alias("at"), none.alias("block"), none.alias("previous"), none.alias("next")))
    rows = rows.select("doc_id", "text_hash", "n_words", F.explode(F.concat(own, *map(_blocks, lengths))).alias("g")).select("doc_id", "text_hash", "n_words", "g.*")
    rows = rows.withColumn("h", F.xxhash64("block"))
    if lengths:
        grams = _item_blocks(items, lengths[0])
        for n in lengths[1:]:
            grams = grams.unionByName(_item_blocks(items, n))
        grams = grams.select("window", F.xxhash64("block").alias("h"), "item_id", "item_around")
        if fits(grams, broadcast_rows):
            grams = F.broadcast(grams)
        else:
            known = small(grams.select("window", "h").distinct().withColumn("known", F.lit(True)), 16 * broadcast_rows)
            rows = rows.join(known, ["window", "h"], "left").filter("known or at < 0").drop("known")
        found = rows.join(grams, ["window", "h"], "left").filter("item_id is not null or at < 0")
    else:
        found = rows.withColumn("item_id", none).withColumn("item_around", F.array(none))
    b = F.floor((F.col("window") + 1) / 2).cast("int")
    edge = F.col("window") - b
    before, after = _words(F.col("previous")), _words(F.col("next"))
    gap = lambda have: F.array_repeat(none, F.greatest(edge - F.size(have), F.lit(0)))
    before = F.concat(gap(before), F.slice(before, F.greatest(F.size(before) - edge + 1, F.lit(1)), edge))
    around = F.when(F.col("at") >= 0, F.concat(before, _words(F.col("block")), F.slice(after, 1, edge), gap(after)))
    found = found.withColumn("b", b).withColumn("edge", edge).withColumn("around", around)
    same = F.zip_with("around", "item_around", lambda x, y: F.coalesce(x == y, F.lit(False)))
    found = found.withColumn("same", same)
    left = F.array_position(F.reverse(F.slice("same", 1, F.col("edge"))), False)
    right = F.array_position(F.slice("same", F.col("edge") + F.col("b") + 1, F.col("edge")), False)
    found = found.withColumn("before", F.when(left == 0, F.col("edge")).otherwise(left - 1).cast("int")).withColumn("after", F.when(right == 0, F.col("edge")).otherwise(right - 1).cast("int"))
    whole = F.forall(F.slice("same", F.col("edge") + 1, F.col("b")), lambda x: x) & (F.col("before") + F.col("b") + F.col("after") >= F.col("window"))
    hit = F.when((F.col("at") >= 0) & whole, F.struct((F.col("at") - F.col("before")).alias("from"), (F.col("at") + F.col("b") + F.col("after")).alias("to")))
    found = found.select("doc_id", "text_hash", "n_words", hit.alias("hit"), F.when(hit.isNotNull(), F.col("item_id")).alias("item_id"))
    out = found.groupBy("doc_id", "text_hash", "n_words").agg(F.array_sort(F.collect_set("hit")).alias("hits"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda done, x: F.struct((done["n"] + F.greatest(x["to"] - F.greatest(x["from"], done["to"]), F.lit(0))).alias("n"), F.greatest(x["to"], done["to"]).alias("to")),
        lambda done: done["n"].cast("long"),
    )
    out = out.withColumn("n_hit", covered)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, broadcast_rows: int = 500_000) -> DataFrame:
    """docs without the contaminated documents, all columns and repeated rows kept. Null ids and texts stay; an empty table
    gives none, an empty benchmark removes nothing; columns of any name stay. `remove_spans` cuts passages out instead."""
    bad = find_benchmark(docs, benchmark, window, broadcast_rows).filter("contaminated").select(F.col("doc_id").alias("__ql_id"), F.col("text_hash").alias("__ql_hash"))
    bad = cut(bad)
    return docs.join(small(bad, 2_000_000), F.col("doc_id").eqNullSafe(F.col("__ql_id")) & (F.xxhash64("text") == F.col("__ql_hash")), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, broadcast_rows: int = 500_000) -> DataFrame:
    """docs, same columns, without the passages that occur in the benchmark, from the first letter of their first word to the
    last of their last; every document stays, what is around a passage too. n_chars, if there, follows.

    Nulls: null ids and texts stay. Repeated rows are all kept; an empty table gives none; columns of any name stay. Only
    documents with a passage are cut, in n log n of their words.
    """
    found = find_benchmark(docs, benchmark, window, broadcast_rows).filter(F.size("hits") > 0)
    found = cut(found.select(F.col("doc_id").alias("__ql_id"), F.col("text_hash").alias("__ql_hash"), F.col("hits").alias("__ql_hits")))
    rows = docs.join(small(found, 2_000_000), F.col("doc_id").eqNullSafe(F.col("__ql_id")) & (F.xxhash64("text") == F.col("__ql_hash")), "left")
    place = lambda words: F.transform("__ql_hits", lambda x: F.struct(F.get(words, x["from"])["s"].alias("s"), F.get(words, x["to"] - 1)["e"].alias("e")))
    clean = bound(bound(matches(F.col("text"), WORD), place), lambda spans: replaced(F.col("text"), spans, lambda x: F.lit("")))
    hit = F.col("__ql_hits").isNotNull()
    out = rows.withColumn("text", F.when(hit, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP1_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select item_id, n, array_to_string(w[i:i + n - 1], ' ') as g from (select item_id, w, least(len(w), 13) as n, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)),
lens as (select distinct n from win),
hits as (select doc_id, i, n, g from (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)) where g in (select g from win)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
its as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct doc_id, cast(item_id as varchar) as item from hits join win using (g, n)) group by doc_id)
select d.doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) as contaminated
from d left join pos on d.doc_id = pos.doc_id left join its on d.doc_id = its.doc_id
"""
