"""2. Personal data: patterns for what identifies directly, and information-theoretic sanitisation of the words that reveal it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.arrays import bound
from quarrylight.llm.common import matches, none_found, part, replaced, spans_text, table, wide
from quarrylight.storage import cut, small, written

#: Fixed order of the kinds. Runs are taken whole from their first character (or from the end of the match before),
#: so the patterns match the same as without look-behind and possessive marks, in linear time.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NEAR = 80  #: characters on either side of an entity in which words count as its context, unless said otherwise


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of Luhn is right."""
    back = F.reverse(F.transform(F.split(digits, ""), lambda x: x.try_cast("int")))
    odd = F.transform(back, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x)))
    return F.aggregate(odd, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _octets(x: Column) -> Column:
    """Whether each part is at most 255, however many zeros lead it."""
    return F.forall(F.split(x, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
        F.split(x, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255
    )


def direct(text: Column) -> Column:
    """Spans (s, rank, e, kind, value) of the four kinds by start, then kind; value is the entity in a normal form."""

    def of(rank: int, pattern: str, asked: Column, valid, value) -> Column:
        spans = F.when(F.coalesce(asked, F.lit(False)), matches(text, pattern)).otherwise(none_found())
        return F.transform(
            F.filter(spans, lambda x: valid(x["m"])),
            lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(KINDS[rank]).alias("kind"), value(x["m"]).alias("value")),
        )

    def long_enough(least: int, most: int):
        return lambda m: F.length(_digits(m)).between(least, most)

    return F.array_sort(
        F.concat(
            of(0, EMAIL, text.contains("@"), lambda m: F.lit(True), F.lower),
            of(1, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), _octets, lambda m: m),
            of(2, CARD, text.rlike(CARD), lambda m: long_enough(12, 19)(m) & _luhn(_digits(m)), _digits),
            of(3, PHONE, text.contains("+"), long_enough(9, 15), _digits),
        )
    )


def _nearby(text: Column, spans: Column, near: int) -> Column:
    """For each span (kind, value, s, e, before, after): the text within `near` characters on either side and one more, which
    shows whether a word is cut there. Spans are blanked first, so that one entity is no context of another."""
    blank = replaced(text, spans, lambda x: F.repeat(F.lit(" "), x["e"] - x["s"]))
    padded = F.concat(F.lit(" "), blank, F.lit(" "))  # character i of the text is character i + 1 here

    def one(w: Column, x: Column) -> Column:
        before = part(w, F.greatest(x["s"] - near, F.lit(0)), x["s"] + 1)
        after = part(w, x["e"] + 1, F.least(x["e"] + near + 2, F.octet_length(w) / 4))
        return F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["s"].alias("s"), x["e"].alias("e"), before.alias("before"), after.alias("after"))

    return bound(wide(padded), lambda w: F.transform(spans, lambda x: one(w, x)))


def _terms(near: int) -> Column:
    """The words of `before` and `after`: array of (term, s, e). Letters in runs of 3 or more, lowered."""

    def of(side: str, pattern: str, shift: Column) -> Column:
        return F.transform(matches(F.col(side), pattern), lambda m: F.struct(F.lower(m["m"]).alias("term"), (m["s"] + shift).alias("s"), (m["e"] + shift).alias("e")))

    return F.concat(of("before", r"(?<=\P{L})\p{L}{3,}+", F.greatest(F.col("s") - near, F.lit(0)) - 1), of("after", r"\p{L}{3,}+(?=\P{L})", F.col("e")))


def _protected() -> Column:
    """What an entity (kind, value) stands for, from itself to its kind: an address, its domain, any address; a network; the
    issuer of a card; a phone number without its last four digits. A single value is rarely met often enough to count by."""
    kind, value = F.col("kind"), F.col("value")
    group = (
        F.when(kind == "email", F.substring_index(value, "@", -1))
        .when(kind == "ip", F.substring_index(value, ".", 3))
        .when(kind == "card", F.substring(value, 1, 6))
        .otherwise(F.expr("substring(value, 1, greatest(length(value) - 4, 1))"))
    )
    return F.array(F.concat(kind, F.lit(" = "), value), F.concat(kind, F.lit(" of "), group), kind)


def _lowered_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}+"), F.lit(0)))


def _document_counts(docs: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """(term, df_t): the documents that each word is in, for all words; a row of (document, word) is met by no join and
    shuffled only as partial counts. repeated holds (doc_id, text_hash, copies) of rows that come more than once, if any do."""
    rows = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    if repeated is None:
        return rows.select(F.explode(_lowered_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_t"))
    again = repeated.select(F.col("doc_id").alias("__ql_id"), F.col("text_hash").alias("__ql_hash"), "copies")
    rows = rows.join(again, F.col("doc_id").eqNullSafe(F.col("__ql_id")) & (F.col("text_hash") == F.col("__ql_hash")), "left")
    words = rows.select(F.coalesce("copies", F.lit(1)).alias("copies"), F.explode(_lowered_words(F.col("text"))).alias("term"))
    each = words.groupBy("term", "copies").agg(F.count(F.lit(1)).alias("rows"))  # a document of k copies gives k rows: rows / copies is whole
    return each.groupBy("term").agg(F.sum(F.expr("rows div copies")).alias("df_t"))


def find_personal(docs: DataFrame, disclosure: float = 0.8, support: int = 2, broadcast_rows: int = 500_000, near: int = NEAR) -> DataFrame:
    """(doc_id, text_hash, base, terms) for each different row (doc_id, text): the direct spans, and the words that reveal them.

    What is protected is an entity, the group that it belongs to, and its kind (`_protected`). Over all documents, a word t
    beside a protected e discloses PMI(t; e) / IC(e) of the information that e carries, with
    PMI = log(N df(t,e) / (df(t) df(e))), IC = log(N / df(e)) and df(t, e) the documents where t is within `near` characters
    of e. A word is marked beside e if that share is at least `disclosure` and the two meet in at least `support`
    different contexts, so that copies of one document prove nothing. base: array of (s, rank, e, kind, value); terms: array of
    (s, e, share). Statistics cover all documents and all of their words, with partial counts before each shuffle. Tables that are broadcast are measured first and shuffled if larger.

    Nulls: a null text is empty; a null doc_id is a row of its own. Repeated rows give one row and count as one document.
    An empty table gives none. Other columns are ignored, whatever their names. A text of n spans costs n log n.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("base", direct(F.col("text")))
    rows = rows.withColumn("near", F.when(F.size("base") > 0, _nearby(F.col("text"), F.col("base"), near)))
    found = written(rows.select("doc_id", "text_hash", "base", "near"), "personal")
    copies = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    n, n_repeated = copies.agg(F.count(F.lit(1)), F.count_if(F.col("copies") > 1)).first()
    met = found.filter("near is not null").select("doc_id", "text_hash", F.explode("near").alias("x")).select("doc_id", "text_hash", "x.*")
    met = met.select("doc_id", "text_hash", _protected().alias("protected"), _terms(near).alias("terms"))
    met = written(met.withColumn("context", F.xxhash64(F.transform("terms", lambda t: t["term"]))), "contexts")
    entities = met.select("doc_id", "text_hash", "context", "terms", F.explode("protected").alias("entity"))
    beside = entities.select("doc_id", "text_hash", "context", "entity", F.explode("terms").alias("t")).select("doc_id", "text_hash", "context", "entity", "t.*")
    often = beside.select("term", "entity", "context").distinct().groupBy("term", "entity").agg(F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= support)
    often = cut(often.select("term", "entity"))
    none = F.array().cast("array<struct<s:int,e:int,share:double>>")
    if often.isEmpty():
        return found.groupBy("doc_id", "text_hash").agg(F.first("base").alias("base")).withColumn("terms", none)
    per_term = _document_counts(docs, small(copies.filter("copies > 1"), broadcast_rows) if n_repeated else None)
    per_pair = beside.join(small(often, broadcast_rows), ["term", "entity"], "left_semi").select("term", "entity", "doc_id", "text_hash").distinct().groupBy("term", "entity").agg(F.count(F.lit(1)).alias("df_te"))
    named = small(often.select("entity").distinct(), broadcast_rows)
    per_entity = entities.join(named, "entity", "left_semi").select("entity", "doc_id", "text_hash").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("df_e"))
    per_entity = small(cut(per_entity), broadcast_rows)  # a kind has a large part of all pairs
    share = F.log(n * F.col("df_te") / (F.col("df_t") * F.col("df_e"))) / F.log(n / F.col("df_e"))
    reveal = per_pair.join(per_entity, "entity").join(per_term, "term").filter(F.col("df_e") < n).withColumn("share", share).filter(F.col("share") >= disclosure)
    reveal = small(cut(reveal.select("term", "entity", F.round("share", 9).alias("share"))), broadcast_rows)
    # a word beside several entities is one span with the largest share
    marks = beside.join(reveal, ["term", "entity"]).groupBy("doc_id", "text_hash", "s", "e").agg(F.max("share").alias("share"))
    marks = marks.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("s", "e", "share"))).alias("marks"))
    marks = marks.select(F.col("doc_id").alias("__ql_id"), F.col("text_hash").alias("__ql_hash"), "marks")
    out = found.groupBy("doc_id", "text_hash").agg(F.first("base").alias("base"))
    out = out.join(marks, F.col("doc_id").eqNullSafe(F.col("__ql_id")) & (F.col("text_hash") == F.col("__ql_hash")), "left")
    return out.select("doc_id", "text_hash", "base", F.coalesce("marks", none).alias("terms"))


def sanitise(docs: DataFrame, disclosure: float = 0.8, remove: float = 0.95, support: int = 2, broadcast_rows: int = 500_000, near: int = NEAR) -> DataFrame:
    """docs, same columns, with direct spans replaced by [KIND], words that disclose `remove` or more taken out and other
    disclosing words generalised to [TERM]. n_chars, if there, follows. Only documents with spans are joined.

    Of spans that overlap, the first says what stands for all. Nulls: a null text stays null, a null id stays. Repeated
    rows are all sanitised and kept; an empty table gives none; columns of any name stay.
    """
    spans = find_personal(docs, disclosure, support, broadcast_rows, near)
    all_ = F.concat(
        F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("by"))),
        F.transform("terms", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["share"] >= remove, F.lit("")).otherwise(F.lit("[TERM]")).alias("by"))),
    )
    spans = cut(spans.select(F.col("doc_id").alias("__ql_id"), F.col("text_hash").alias("__ql_hash"), F.array_sort(all_).alias("__ql_spans")).filter(F.size("__ql_spans") > 0))
    rows = docs.join(small(spans, broadcast_rows), F.col("doc_id").eqNullSafe(F.col("__ql_id")) & (F.xxhash64("text") == F.col("__ql_hash")), "left")
    out = rows.withColumn("text", F.when(F.col("__ql_spans").isNotNull(), replaced(F.col("text"), F.col("__ql_spans"), lambda x: x["x"]["by"])).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__ql_spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op2(spark, sf_dir: str) -> DataFrame:
    found = find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    typed = lambda column, rank, kind: F.transform(column, lambda x: F.struct(x["s"].alias("s"), rank(x).alias("rank"), x["e"].alias("e"), kind(x).alias("kind")))
    all_ = F.array_sort(F.concat(typed("base", lambda x: x["rank"], lambda x: x["kind"]), typed("terms", lambda x: F.lit(len(KINDS)), lambda x: F.lit("term"))))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(all_).alias("spans"))
