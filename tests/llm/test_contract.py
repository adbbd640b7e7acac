"""The queries and the pipeline over the smallest tables, beside SQL, brute force and the tokenizer libraries."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylight.llm import language, quality, queries, secrets, simhash
from tests.llm.test_operators import alike, components, direct, hits, near

HERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables")
P = pytest.importorskip("public_tokenizers")
SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{HERE}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def items(spark):
    return {str(r["item_id"]): r["text"] for r in spark.read.parquet(f"{HERE}/benchmark.parquet").collect()}


def run(spark, name):
    return {r["doc_id"]: r for r in queries.QUERIES[name](spark, HERE).collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "clicks"):
        con.sql(f"create view {t} as select * from '{HERE}/{t}.parquet'")
    rows = lambda df: (sorted(df.columns), sorted(map(tuple, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()), key=repr))
    assert rows(queries.QUERIES[name](spark, HERE).toPandas()) == rows(con.sql(queries.ORACLES[name]).df())


def test_op1(spark, texts, items):
    found = run(spark, "op1_decontaminate")
    for i, t in texts.items():
        n, hit, got = hits_of(t, items)
        r = found[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, hit, len(got), sha(",".join(sorted(got)))), i
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def hits_of(text, items):
    keys = list(items)
    n, hit, got = hits(text, list(items.values()))
    return n, hit, {keys[int(k)] for k in got}


def test_op2(spark, texts):
    found = run(spark, "op2_personal_data")
    assert len(found) == len(texts)
    for i, t in texts.items():
        base = [f"{kind}:{s}:{e}" for s, _, e, kind in direct(t)]
        assert found[i]["base_sha256"] == sha(",".join(base))
        assert [found[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(b.startswith(k + ":") for b in base) for k in ("email", "ip", "card", "phone")]
        assert [x for x in found[i]["spans"].split(",") if x and not x.startswith("term:")] == base


def test_op3(spark, texts):
    found, ids = run(spark, "op3_simhash"), sorted(texts)
    fps = near([texts[i] for i in ids])
    assert {i: (found[i]["fingerprint"], found[i]["component_id"]) for i in ids} == {i: (f"{fp:016x}", ids[k]) for i, fp, k in zip(ids, fps, components(fps))}


def statistics(text):
    w = re.findall(SPACE, text or "")
    tri = list(zip(w, w[1:], w[2:]))
    often = Counter(tri)
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len({i + k for i, x in enumerate(tri) if often[x] > 1 for k in range(3)})


def judged(text, rules):
    """The decision list, worked out for one text in plain Python."""
    n, chars, symbols, dup, repeat = statistics(text)
    if n < 50 or 100 * repeat > 50 * n:
        return False
    w = re.findall(SPACE, text)
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    x = {"word_length": chars / n, "symbol_share": symbols / n, "dup_line_share": dup / len(lines), "repeat_share": repeat / n, "upper_share": sum("A" <= c <= "Z" for c in "".join(w)) / chars, "different_share": len(set(w)) / n}
    return not any(all((x[k] > t) == above for k, above, t in r.conditions) for r in rules)


def learned(spark, docs):
    return quality.learn_rules(docs, spark.read.parquet(f"{HERE}/labels.parquet"))


def test_op4(spark, texts):
    found = run(spark, "op4_quality_rules")
    rules = learned(spark, spark.read.parquet(f"{HERE}/documents.parquet"))
    for i, t in texts.items():
        r, want = found[i], statistics(t)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == judged(t, rules)


def packed(rows, ids):
    """Each id in one piece, sequences gapless and no longer than 4096."""
    for r in rows:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(own) and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] * 4 == len(own)
    assert Counter({i: len(x) for i, x in ids.items()}) == sum((Counter({r["doc_id"]: r["length"]}) for r in rows), Counter())
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096
    return len(ends)


def encoded(texts, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in texts.items()}


def test_op6(spark, texts):
    ids = encoded(texts, "word_bpe_49k.json")
    n = packed(queries.QUERIES["op6_packing"](spark, HERE).collect(), ids)
    assert n <= 1.02 * -(-sum(map(len, ids.values())) // 4096) + 1


def test_op8(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    found = run(spark, "op8_token_counts")
    for i, t in texts.items():
        n = len(sp.encode(t or ""))
        assert (found[i]["n_bytes"], found[i]["n_tokens"], found[i]["over_limit"]) == (len((t or "").encode()), n, n > 4096)


def test_op9(spark, texts):
    found, start = run(spark, "op9_token_files"), 0
    for i, ids in sorted(encoded(texts, "byte_bpe_50k.json").items()):
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def counted(text):
    """Hashed counts of byte n-grams by plain loops."""
    lowered = text.lower().encode()
    data = b" " + b" ".join(bytes(c if c > 127 or chr(c).isalpha() else 32 for c in lowered).split()) + b" "
    out = Counter()
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            x = 0
            for c in data[i : i + n]:
                x = (x * 257 + c) % (1 << 32)
            out[((x * 2654435761 + n * 40503) % (1 << 32)) >> 20] += 1
    return out


def test_op10(spark, texts):
    docs = spark.read.parquet(f"{HERE}/documents.parquet")
    model = language.fit(docs, ~language.held_out())
    found = run(spark, "op10_language")
    right = total = 0
    for r in docs.select("doc_id", "lang", "text").collect():
        got = found[r["doc_id"]]
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= got["score"] <= 1
        if not any(map(str.isalpha, r["text"] or "")):
            assert (got["lang_pred"], got["score"]) == ("und", 0.0)
            continue
        if len(r["text"]) < 4000:
            x = {k: np.sqrt(v) * model.idf[k] for k, v in counted(r["text"]).items()}
            norm = np.sqrt(sum(v * v for v in x.values()))
            cosine = [sum(v * c[k] for k, v in x.items()) / norm for c in model.centroids]
            assert abs(max(cosine) - got["score"]) < 1e-5
            close = {model.languages[model.owner[k]] for k, c in enumerate(cosine) if c > max(cosine) - 1e-6}
            assert got["lang_pred"] in close
        if got["held_out"] and r["lang"]:
            total += 1
            right += got["lang_pred"] == r["lang"]
    assert total and right >= 0.97 * total


def redacted(text):
    rules = [r.pattern.replace("*+", "*").replace("++", "+").replace("}+", "}") for r in secrets.RULES]
    spans = sorted((m.start(), rank, m.end(), r.kind) for rank, (r, p) in enumerate(zip(secrets.RULES, rules)) for m in re.finditer(p, text) if len(m[r.group]) >= r.least)
    out, at = [], 0
    for s, _, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[SECRET:{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_pipeline(spark, texts, items):
    """The whole pipeline, worked out document by document."""
    rules = learned(spark, spark.read.parquet(f"{HERE}/documents.parquet"))
    left = {i: t for i, t in sorted(texts.items()) if judged(t, rules)}
    ids = list(left)
    kept = {ids[k] for k in alike(list(left.values()))}
    left = {i: t for i, t in left.items() if i in kept}
    counts = {i: hits_of(t, items) for i, t in left.items()}
    left = {i: t for i, t in left.items() if not (counts[i][1] > 0 and 20 * counts[i][1] >= counts[i][0])}
    left = {i: redacted(t) for i, t in left.items()}
    found = corpus_pipeline.run(spark, HERE).collect()
    assert {r["doc_id"] for r in found} == set(left) and 0 < len(left) < len(texts)
    packed(found, encoded(left, "word_bpe_49k.json"))


def test_stages_on_awkward_rows(spark):
    """Each stage on nulls, empty and very long texts, repeated rows, an empty table and extra columns."""
    fine = " ".join(f"word{i} and{i % 7}" for i in range(60))
    rows = [(1, None, "en", "s", 0, "x"), (2, "", "en", "s", 0, "x"), (3, fine, "en", "s", len(fine), "x"), (3, fine, "en", "s", len(fine), "x"), (4, fine + " token=abcdef123", "en", "s", 0, "x"), (None, fine, None, None, None, "y"), (5, " ".join(f"w{i}" for i in range(40_000)), "en", "s", 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __ql_kept string")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            table = table.drop("__ql_kept").withColumn("found", F.lit(7)).withColumn("kept", F.lit("own"))
            out = stage(spark, table, HERE)
            got = out.collect()
            if name != "packing":
                assert out.columns == table.columns and all(r["found"] == 7 and r["kept"] == "own" for r in got), name
            assert bool(got) == bool(table.count()), name
    kept = corpus_pipeline.quality_rules(spark, docs.drop("__ql_kept"), HERE).collect()
    assert {r["doc_id"] for r in kept} >= {3, 4, 5} and not {r["doc_id"] for r in kept} & {1, 2}
    one = corpus_pipeline.near_duplicates(spark, docs.drop("__ql_kept"), HERE).collect()
    assert sorted(r["doc_id"] for r in one if r["doc_id"] in (1, 2, 3)) == [1, 3] and None not in {r["doc_id"] for r in one}
    scanned = {r["doc_id"]: r for r in corpus_pipeline.secret_scan(spark, docs.drop("__ql_kept"), HERE).collect()}
    assert scanned[4]["text"] == fine + " [SECRET:assign]" and scanned[4]["n_chars"] == len(fine) + 16 and scanned[1]["text"] is None
