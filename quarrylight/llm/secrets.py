"""5. Secret scans: a trigram inverted index chooses the documents in which each rule is verified."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import matches, none_found, replaced, spans_text, table
from quarrylight.llm.trigrams import holds, query, trigrams
from quarrylight.storage import cut, small


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if the named group has at least `least` characters. Patterns are possessive where
    giving back could not help, so that long runs cost linear time and no stack."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
#: A run that is long enough has its first match at the run's start, so the least length can stand in the pattern.
BASE = (Rule("assign", ASSIGN, 2, 6), Rule("access", r"AKIA[A-Z0-9]{16,}+"), Rule("hex", r"[0-9a-f]{24,}+"))
#: Published formats of tokens.
MORE = (
    Rule("code_host", r"gh[opsur]_[A-Za-z0-9]{36,}+"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{20,}+"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}+"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
)
RULES = BASE + MORE


def _key(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, doc_id, text_hash) of the trigrams that any rule asks for, over lower-cased texts."""
    wanted = sorted({t for r in rules for t in trigrams(query(r.pattern))})
    low = docs.filter("text is not null").select(*_key(docs), F.lower("text").alias("low"))
    # first bits, in generated code, then rows: the functions that make rows would look into the text by interpretation
    flags = low.select("doc_id", "text_hash", *(_bits(wanted, w, F.col("low").contains).alias(f"w{w}") for w in range(len(wanted) // 62 + 1)))
    own = [F.when(F.col(f"w{i // 62}").bitwiseAND(F.lit(1 << i % 62).cast("long")) != 0, F.lit(t)) for i, t in enumerate(wanted)]
    has = F.array_compact(F.array(*own)) if own else F.array().cast("array<string>")
    return flags.select("doc_id", "text_hash", F.explode(has).alias("trigram"))


def _bits(wanted: list[str], word: int, has) -> Column:
    """Bit i of word w is set if has(trigram 62 w + i)."""
    out = F.lit(0).cast("long")
    for i, t in enumerate(wanted[62 * word : 62 * word + 62]):
        out = out.bitwiseOR(F.when(has(t), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, text_hash, kinds): the documents in which the trigram query of a rule holds, by intersecting postings.

    A document's postings meet as bits, set in the task that reads the document, so one row per document is shuffled.
    """
    asked = {r.kind: query(r.pattern) for r in rules}
    wanted = sorted({t for q in asked.values() for t in trigrams(q)})
    if not wanted:
        return postings.select("doc_id", "text_hash", F.array().cast("array<string>").alias("kinds")).limit(0)
    place = {t: (i // 62, i % 62) for i, t in enumerate(wanted)}
    words = range(len(wanted) // 62 + 1)

    found = postings.groupBy("doc_id", "text_hash").agg(*(F.bit_or(_bits(wanted, w, lambda t: F.col("trigram") == t)).alias(f"w{w}") for w in words))
    has = lambda t: F.col(f"w{place[t][0]}").bitwiseAND(F.lit(1 << place[t][1]).cast("long")) != 0
    kinds = F.array_compact(F.array(*(F.when(holds(q, has), F.lit(kind)) for kind, q in asked.items() if q is not None)))
    return found.select("doc_id", "text_hash", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def _verified(rank: int, rule: Rule) -> Column:
    """Spans of a rule in the documents that the index names, or in all if the rule has no mandatory trigram."""
    asked = F.col("text").rlike(rule.pattern) if query(rule.pattern) is None else F.array_contains("__ql_kinds", rule.kind)
    spans = F.when(F.coalesce(asked, F.lit(False)), matches(F.col("text"), rule.pattern, rule.group)).otherwise(none_found())
    spans = F.filter(spans, lambda x: F.length(x["m"]) >= rule.least)
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(rule.kind).alias("kind")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = 2_000_000) -> DataFrame:
    """docs with `__ql_found`: array of (s, rank, e, kind) by start, then by the order of the rules; code points, end exclusive.

    Rules with mandatory trigrams are verified where the index says so, the others everywhere. The candidates are
    broadcast up to broadcast_rows and joined by a shuffle beyond. Nulls: a null text is empty; a null doc_id is matched
    as such. Repeated rows, equal ids with other texts and other columns stay as they are; an empty table gives none. A text
    of n matches costs n log n.
    """
    chosen = cut(candidates(build_index(docs, rules), rules))
    chosen = small(chosen.select(F.col("doc_id").alias("__ql_id"), F.col("text_hash").alias("__ql_hash"), F.col("kinds").alias("__ql_kinds")), broadcast_rows)
    rows = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("__ql_id")) & (F.xxhash64("text") == F.col("__ql_hash")), "left")
    return rows.withColumn("__ql_found", F.array_sort(F.concat(*(_verified(rank, rule) for rank, rule in enumerate(rules))))).drop("__ql_id", "__ql_hash", "__ql_kinds")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs, same columns, with each secret replaced by [SECRET:kind]; n_chars, if there, follows.

    Of secrets that overlap, the first names the kind of all. Nulls: a null text stays null, a null id stays. Repeated
    rows are all redacted and kept; an empty table gives none; columns of any name stay.
    """
    out = scan(docs, rules).withColumn("text", replaced(F.col("text"), F.col("__ql_found"), lambda x: F.concat(F.lit("[SECRET:"), x["x"]["kind"], F.lit("]"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__ql_found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op5(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("__ql_found", lambda x: x["rank"] < len(BASE))
    count = lambda kind: F.size(F.filter("__ql_found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("__ql_found")).alias("spans"),
    )


def _plain(pattern: str) -> str:
    """The pattern as RE2 takes it: without possessive marks."""
    return pattern.replace("*+", "*").replace("++", "+").replace("}+", "}")


def op5_sql() -> str:
    """Spans of each rule from the pieces between matches and the matches, as DuckDB SQL."""
    parts = []
    for rank, r in enumerate(RULES):
        p = _plain(r.pattern).replace("'", "''")
        parts.append(
            f"""select doc_id, {rank} as rank, '{r.kind}' as kind, ms[i] as m, gs[i] as g,
  coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as s
  from (select doc_id, ms, gs, ps, unnest(range(1, len(ms) + 1)) as i from (select doc_id, regexp_extract_all(text, '{p}') as ms, regexp_extract_all(text, '{p}', {r.group}) as gs, string_split_regex(text, '{p}') as ps from documents))
  where length(gs[i]) >= {r.least}"""
        )
    spans = "\nunion all ".join(f"({p})" for p in parts)
    return f"""
with f as (select *, s + length(m) as e, kind || ':' || s::bigint || ':' || (s + length(m))::bigint as t from ({spans})),
a as (select doc_id, {', '.join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in BASE)}, string_agg(t, ',' order by s, rank) filter (rank < {len(BASE)}) as base, string_agg(t, ',' order by s, rank) as spans from f group by doc_id)
select d.doc_id, {', '.join(f"coalesce(n_{r.kind}, 0)::bigint as n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents d left join a on d.doc_id = a.doc_id
"""
