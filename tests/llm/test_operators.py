"""The operators for training text on awkward rows, against brute force, and round trips."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import binary, chat, common, decontaminate, language, packing, personal, quality, secrets, simhash, token_counts
from quarrylight.llm.trigrams import holds, query, trigrams
from quarrylight.storage import written

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, __x string, text_hash long, found int, n int"
LONG = "word " * 30_000


def docs(spark, texts, extra=()):
    rows = [(i, t, "en", "s", len(t or ""), "x", 5, 1, 2) for i, t in enumerate(texts)] + list(extra)
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [None, "", " \n ", "Grüße 😀 a@b.co", LONG, "same text here", "same text here", "\x00\x01 odd", "z"]
NO_ID = (None, "without an id", None, None, None, None, None, None, None)
TWICE = (1, "", "en", "s", 0, "x", 5, 1, 2)


@pytest.fixture(scope="module")
def awkward(spark):
    return docs(spark, AWKWARD, [NO_ID, TWICE])


def benchmark(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


LABELS = "doc_id long, quality int, toxic int"


def all_operators(spark, d):
    bench, labels = benchmark(spark, "same text here", None, ""), spark.createDataFrame([], LABELS)
    model = language.fit(d, ~language.held_out(), 10)
    return {
        "1": lambda: decontaminate.find_benchmark(d, bench),
        "1b": lambda: decontaminate.decontaminate(d, bench),
        "2": lambda: personal.find_personal(d),
        "2b": lambda: personal.sanitise(d),
        "3": lambda: simhash.near_duplicates(d),
        "3b": lambda: simhash.keep_one(d),
        "4": lambda: quality.judge(d, labels),
        "5": lambda: secrets.scan(d),
        "5b": lambda: secrets.redact(d),
        "6": lambda: packing.pack(d, P.path("word_bpe_49k.json")),
        "8": lambda: token_counts.count_tokens(d, P.path("piece_bpe_32k.model")),
        "9": lambda: binary.read_ids(spark, binary.write_ids(d, P.path("byte_bpe_50k.json"))),
        "10": lambda: language.identify(d, model),
    }


def test_awkward_rows(spark, awkward):
    n = len(AWKWARD) + 2
    counts = {k: len(f().collect()) for k, f in all_operators(spark, awkward).items()}
    assert counts["1"] == counts["2"] == n - 1  # repeated rows are one
    assert all(counts[k] == n for k in ("2b", "3", "4", "5", "5b", "8", "9", "10"))
    assert counts["1b"] == n - 2 and counts["6"] >= n


def test_empty_tables(spark, awkward):
    for name, f in all_operators(spark, awkward.limit(0)).items():
        assert f().collect() == [], name
    assert chat.read_back(chat.render(chat.reconstruct(spark.createDataFrame([], "conv_id long, seq long, slot long, kind string, role string, text string")))).collect() == []


def hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, on, got = low(text), set(), set()
    for k, t in enumerate(items):
        b = low(t)
        m = min(13, len(b))
        wins = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if m else set()
        for i in range(len(w) - m + 1) if m else ():
            if tuple(w[i : i + m]) in wins:
                on |= set(range(i, i + m))
                got.add(str(k))
    return len(w), len(on), sorted(got)


def test_benchmark_against_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = ["a", "B", "ça", "d9", "É", "f"]
    text = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", ",", "\n", "--"]) for _ in range(n))
    items = [text(n) for n in (1, 2, 3, 7, 12, 13, 14, 40, 60)] + ["", None, "- -"]
    texts = [text(rnd.randrange(80)) for _ in range(60)]
    for i in range(30):  # pieces of items within texts
        w = items[rnd.choice((4, 5, 6, 7, 8))].split()
        a = rnd.randrange(len(w))
        texts.append(text(rnd.randrange(20)) + " " + " ".join(w[a : a + rnd.randrange(10, 30)]).upper().replace("ÇA", "ça") + " " + text(rnd.randrange(20)))
    for some in (items, items[5:], items[7:9]):
        found = decontaminate.find_benchmark(docs(spark, texts), benchmark(spark, *some)).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in found} == {i: hits(t, some) for i, t in enumerate(texts)}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def direct(text):
    out = []
    for rank, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 12 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15):
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def noise(rnd, alphabet, n):
    return "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(n)))


def test_personal_against_brute_force(spark):
    rnd = random.Random(4)
    texts = [noise(rnd, "a@.b_1-😀 ", 30) for _ in range(400)] + [noise(rnd, "0123456789.- +()", 60) for _ in range(400)] + [noise(rnd, "12. ", 40) for _ in range(300)]
    texts += ["4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "001.2.3.04", "10.0.0.1", "0.0.0.0", "000.00.0.256", "99999999999.1.1.1", "256.1.1.1", "a@b.c_d@e.f", None, "é x+y@z.de +1 (555) 555-1234.", "1 " * 3000]
    found = personal.find_personal(docs(spark, texts)).collect()
    got = {(r["doc_id"]): [(x["s"], x["rank"], x["e"], x["kind"]) for x in r["base"]] for r in found}
    assert got == {i: direct(t) for i, t in enumerate(texts)}


def test_words_that_reveal(spark):
    rnd = random.Random(9)
    fill = lambda n: " ".join("word" + chr(97 + rnd.randrange(26)) for _ in range(n))
    texts = [f"{fill(12)} captain of zephyrion writes as boss@ship.org {fill(12)}" for _ in range(6)]
    texts += [f"{fill(30)} captain" for _ in range(60)] + ["copied uniquely beside one@two.org"] * 5
    rows = {r["doc_id"]: r for r in personal.find_personal(docs(spark, texts)).collect()}
    words = lambda i: {texts[i][x["s"] : x["e"]] for x in rows[i]["terms"]}
    assert "zephyrion" in words(0) and "captain" not in words(0) and not words(10) and not words(70)
    clean = {r["doc_id"]: r["text"] for r in personal.sanitise(docs(spark, texts)).collect()}
    assert "zephyrion" not in clean[0] and "[EMAIL]" in clean[0] and clean[20] == texts[20]


def near(texts):
    import xxhash

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    return [fp(t) for t in texts]


def components(fps):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("fine", [False, True])
@pytest.mark.parametrize("bucket", [40, 20_000])
def test_simhash_links(spark, bucket, fine):
    """Fingerprints at 0 to 6 bits from some centres, whose buckets must be cut into chunks at the smaller limit."""
    rnd = random.Random(8)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(7))) for c in centres for _ in range(60)})
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = [(r["src"] % (1 << 64), r["dst"] % (1 << 64)) for r in simhash.links(rows, bucket, fine).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    place = {x: i for i, x in enumerate(fps)}
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in found:
        x, y = root(place[a]), root(place[b])
        up[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(fps))] == components(fps)


def test_near_duplicates(spark):
    rnd = random.Random(6)
    base = [" ".join(rnd.choice("abcdefghijkl") * 3 for _ in range(300)) for _ in range(8)]
    texts = base + [b.replace("aaa", "aab", 1) for b in base] + base[:2] + [None, "", "One", "one  "]
    fps = near(texts)
    found = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert found == dict(enumerate(zip(fps, components(fps))))
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs(spark, texts)).collect())
    assert kept == sorted(set(components(fps)))


def alike(texts, similar=0.8):
    """Components of links of fingerprints and of sets of five words in a row, by all pairs."""
    own = components(near(texts))
    sets = [set(zip(*(w[i:] for i in range(5)))) or {tuple(w)} for w in ((t or "").lower().split() for t in texts)]
    place = {c: c for c in own}

    def root(x):
        while place[x] != x:
            x = place[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] != {()} and len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j]):
                a, b = sorted((root(own[i]), root(own[j])))
                place[b] = a
    return [root(c) for c in own]


def test_similar_texts(spark):
    """Copies with words replaced, left out and added: a component wherever shingles say so, texts that share less stay apart."""
    rnd = random.Random(11)
    texts = []
    for k in range(25):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(40, 400))]
        texts.append(" ".join(words))
        for _ in range(rnd.randint(1, 4)):
            copy = list(words)
            for _ in range(rnd.randint(1, 1 + len(words) // 60)):
                at = rnd.randrange(len(copy))
                copy[at : at + 1] = rnd.choice([["other"], [], [copy[at], "more"]])
            texts.append(" ".join(copy))
        texts.append(" ".join(words[: len(words) // 2] + [f"v{rnd.randrange(5000)}" for _ in words[len(words) // 2 :]]))
    texts += [None, "", "one two", "ONE  two", "one", "x y z w v u"]
    wanted = alike(texts)
    assert len(set(wanted)) < len(set(components(near(texts))))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs(spark, texts), similar=0.8).collect()}
    assert [found[i] for i in range(len(texts))] == wanted
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs(spark, texts), similar=0.8).collect()) == sorted(set(wanted))


def test_large_band_makes_no_pairs(spark, monkeypatch):
    """200 texts that share half of their words, and bands, but are not near: no table grows with their pairs, in one task or in
    chunks; a chain of near ones among them is found."""
    rnd = random.Random(13)
    common = [f"c{k}" for k in range(100)]
    texts = [" ".join(common + [f"t{i}_{k}" for k in range(44)]) for i in range(200)]
    words = [*common, *(f"x{k}" for k in range(44))]
    for at in range(12, 24, 2):
        words[-at] = f"y{at}"
        texts.append(" ".join(words))
    rnd.shuffle(texts)
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    linked = {i for i in range(len(texts)) for j in range(len(texts)) if i != j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    fps, rows = near(texts), []
    monkeypatch.setattr(simhash, "written", lambda df, name: (out := written(df, name), rows.append(out.count()))[0])
    for limits in ({}, {"bucket": 40}, {"held": 10_000}):
        parts = simhash.connected_components(simhash.similar_links(docs(spark, texts), 0.8, **limits)).collect()
        assert {r["node"] % (1 << 64) for r in parts} == {fps[i] for i in linked} and len({r["component"] for r in parts}) == 1
        assert limits or max(rows) <= 16 * len(texts)


def test_bands_meet(spark):
    """Texts at 0.8 share a band almost always, texts at 0.3 seldom."""
    rnd = random.Random(12)
    met = {0.8: 0, 0.3: 0}
    for similar in met:
        for _ in range(200):
            n = 300
            common = round(n * 2 * similar / (1 + similar))
            words = [str(rnd.random()) for _ in range(n)]
            other = words[:common] + [str(rnd.random()) for _ in range(n - common)]
            met[similar] += bool(set(simhash.bands_of(" ".join(words))) & set(simhash.bands_of(" ".join(other))))
    assert met[0.8] >= 195 and met[0.3] <= 60


def test_statistics_against_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        t = noise(rnd, "ab \n#é|\t", 80)
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = list(zip(w, w[1:], w[2:]))
        c = Counter(tri)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len({i + k for i, x in enumerate(tri) if c[x] > 1 for k in range(3)}))
        assert quality.statistics(t)[:5] == want


def test_learned_rules():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(600), "b": rng.random(600)}
    bad = (x["a"] > 0.7) | ((x["b"] < 0.2) & (x["a"] < 0.3))
    rules = quality.learn(x, bad, np.arange(600) % 3 == 2)
    got = np.any([r.covers(x) for r in rules], axis=0)
    assert (got == bad).mean() > 0.97 and not quality.learn(x, np.zeros(600, bool), np.zeros(600, bool))


SECRETS = [r.pattern.replace("*+", "*").replace("++", "+").replace("}+", "}") for r in secrets.RULES]


def test_secrets_against_full_scan(spark):
    rnd = random.Random(3)
    parts = ["password", "PassWd", "api_key", "ApiKey", "toKen", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "😀", "\n", "x", "ghp_" + "a1" * 18, "sk_live_" + "A1" * 9, "xoxb-1234567890-abcdefghijk", "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "B_-2" * 9, "eyJabcdefghi.eyJabcdefghi.abcdefghi"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(400)] + [None]
    want = {}
    for i, t in enumerate(texts):
        own = []
        for rank, (r, p) in enumerate(zip(secrets.RULES, SECRETS)):
            own += [(m.start(), rank, m.end(), r.kind) for m in re.finditer(p, t or "") if len(m[r.group]) >= r.least]
        want[i] = sorted(own)
    found = secrets.scan(docs(spark, texts)).collect()
    assert {r["doc_id"]: [(x["s"], x["rank"], x["e"], x["kind"]) for x in r["__ql_found"]] for r in found} == want
    assert len({x[3] for v in want.values() for x in v}) == len(secrets.RULES)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs(spark, texts)).collect()}
    assert all((clean[i] == t) == (not want[i]) for i, t in enumerate(texts))


def test_trigram_queries_never_miss():
    rnd = random.Random(7)
    patterns = [r"ab(cd|ef)+gh", r"(?:foo|bar)?bazz", r"x[yz]w{3}q", r"[a-z]+", r"a?b?c?", r"(abc|abd)x*def", r"(?i:KeY)_\d+"]
    for p in patterns:
        q = query(p)
        for _ in range(3000):
            t = "".join(rnd.choice(["abcd", "ef", "gh", "foo", "bazz", "xy", "www", "q", "abd", "x", "def", "key_", "7", "cd"]) for _ in range(rnd.randrange(8)))
            if q is not None and re.search(p, t):
                assert holds(q, lambda g: g in t.lower()), (p, t)
    assert query(r"[a-z]+") is None and trigrams(query(r"bazz")) == ["azz", "baz"]


def test_packing_is_gapless(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["Stein", "a,b", "über", "x1", "<|endoftext|>", "it's"]) for _ in range(rnd.randrange(2500))) for _ in range(60)] + AWKWARD
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in enumerate(texts)}
    rows = packing.pack(docs(spark, texts), P.path("word_bpe_49k.json")).toPandas()
    for r in rows.itertuples():
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert own == bytes(r.ids) and zlib.crc32(own) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert rows.groupby("doc_id")["length"].sum().to_dict() == {i: len(x) for i, x in ids.items()}
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 4096


def test_plan_for_any_histogram():
    rng = np.random.default_rng(2)
    for _ in range(5):
        h = np.zeros(4097, np.int64)
        h[rng.integers(1, 4097, 300)] = rng.integers(1, 200, 300)
        p = packing.plan(h)
        used = np.zeros_like(h)
        np.add.at(used, p["length"].to_numpy(), p["repeats"].to_numpy())
        assert (used == h).all()
        # no packing of whole pieces has fewer sequences than pieces over half a window, or than the ids fill
        least = max(h[2049:].sum(), -(-(h * np.arange(4097)).sum() // 4096))
        assert (p["sequence"] + p["repeats"]).max() <= 1.05 * least


def test_token_ids_and_counts(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    rnd = random.Random(5)
    alphabet = [*"ab cdé.,!? \n\t'0 9ÀΣſ中 文　\x85\xa0▁<>|ﬁ́İ  ß", "<|endoftext|>", "</s>", " the", "'s", "'LL", "\r\n", "…", " x"]
    texts = [noise(rnd, alphabet, 40) for _ in range(2000)] + AWKWARD
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert token_counts.counts(texts, P.path("piece_bpe_32k.model")) == [len(sp.encode(t or "")) for t in texts]
    long = LONG + "".join(texts[:200])
    assert sum(len(sp.encode(p)) for p in token_counts.split_safely(long, 1000)) == len(sp.encode(long))
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    path = binary.write_ids(docs(spark, texts), P.path("byte_bpe_50k.json"))
    found = {r["doc_id"]: r for r in binary.read_ids(spark, path).collect()}
    start = 0
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        r = found[i]
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids and r["start"] == start and r["n_tokens"] == len(ids)
        start += len(ids)
    block = spark.read.parquet(f"{path}/blocks").first()
    key = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    entry = binary.index(bytes(block["block"]))[2][0]
    assert binary.read_document(bytes(block["block"]), 0, key) == bytes(found[entry[0]]["ids"])


def test_chat_round_trip(spark):
    rnd = random.Random(1)
    bits = ["[INST:user]", "</s>", "\\", "\\s", "\\b", "\\l", "[", "]", "<", "ok", "\n", "😀", ""]
    rows = [(c, n, rnd.choice(["user", "assistant", "a]b[c", None]), rnd.choice([None, "".join(rnd.choice(bits) for _ in range(5))])) for c in range(40) for n in range(rnd.randrange(1, 9))]
    rows += rows[:3]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.read_back(chat.render(chat.reconstruct(chat.as_events(table)))).collect()
    for r in found:
        own = sorted((n, ro or "", t or "") for c, n, ro, t in rows if c == r["conv_id"])
        assert [(x["role"], x["text"]) for x in r["turns"]] == [x[1:] for x in own]
        assert r["loss_text"] == "".join(t for _, ro, t in own if ro == "assistant")


def test_events_fold(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "he"), (1, 2, 1, "delta", None, "y"), (1, 3, 1, "regenerate", None, None),
        (1, 4, 1, "delta", "assistant", "hel"), (1, 6, 1, "delta", None, "o"), (1, 5, 1, "delta", None, "l"), (1, 7, 0, "edit", None, "hello?"),
        (1, 8, 2, "message", "user", "bye"), (1, 9, 2, "delete", None, None), (None, 0, None, "strange", None, None),
    ]
    found = chat.reconstruct(spark.createDataFrame(log, "conv_id long, seq long, slot long, kind string, role string, text string"))
    assert sorted((r["seq"], r["role"], r["text"]) for r in found.filter("conv_id = 1").collect()) == [(0, "user", "hello?"), (1, "assistant", "hello")]
    assert found.filter("conv_id is null").first()["text"] == ""


def test_language_held_out(spark):
    rnd = random.Random(2)
    words = {"en": "the of and thing house there".split(), "de": "der die und straße häuser nicht".split(), "es": "el los que niño mañana está".split()}
    rows = [(i, " ".join(rnd.choice(words[k]) for _ in range(30)), k, "s", 0, "x", 1, 1, 1) for i, k in enumerate(rnd.choice(list(words)) for _ in range(300))]
    rows += [(1000, None, "en", "s", 0, "x", 1, 1, 1), (1001, "123 !?", "en", "s", 0, "x", 1, 1, 1), (1002, "漢字漢字", None, "s", 0, "x", 1, 1, 1)]
    d = spark.createDataFrame(rows, DOCS)
    model = language.fit(d, ~language.held_out(), 60)
    found = {r["doc_id"]: r["__ql_l"] for r in language.identify(d, model).collect()}
    assert all(found[r[0]]["lang"] == r[2] and 0 <= found[r[0]]["score"] <= 1 for r in rows[:300])
    assert found[1000]["lang"] == found[1001]["lang"] == "und" and not found[1002]["accepted"]


def test_repeated_rows_count_once(spark):
    rnd = random.Random(9)
    fill = lambda n: " ".join("word" + chr(97 + rnd.randrange(26)) for _ in range(n))
    texts = [f"{fill(12)} zephyrion writes as boss@ship.org {fill(12)}" for _ in range(6)] + [f"{fill(30)} zephyrion"] + [fill(30) for _ in range(40)] + [None]
    once = docs(spark, texts)
    marks = lambda d: {r["doc_id"]: (r["base"], r["terms"]) for r in personal.find_personal(d, 0.1).collect()}
    found = marks(once)
    assert found[0][1] and marks(once.unionByName(once.filter("doc_id < 9")).unionByName(once.filter("doc_id in (0, 6)"))) == found


def test_samples_of_any_size(spark):
    """A share is never nothing, however many rows there are, and is about what was asked."""
    keys = spark.range(20_000).select(F.xxhash64("id").alias("k"))
    count = lambda sample, n: keys.filter(common.among(F.col("k"), sample, n)).count()
    assert 800 < count(1000, 20_000) < 1200 and count(5, 3) == 20_000 and count(1, 10**12) <= 1
    least = common.among(F.lit(0).cast("long"), 1, 10**30)
    assert spark.range(1).select(least.alias("x")).first()["x"]


def test_a_million_matches(spark):
    """Places of a million matches in one text in seconds, and texts put together again as fast."""
    n = 1_000_000
    big = docs(spark, ["token=abcdef12; " * n])
    start = time.time()
    row = secrets.scan(big).select(F.size("__ql_found").alias("n"), F.element_at("__ql_found", -1).alias("last")).first()
    assert row["n"] == n and (row["last"]["s"], row["last"]["e"]) == (16 * n - 16, 16 * n - 2)
    row = secrets.redact(big).select(F.length("text").alias("n"), F.expr("right(text, 17)").alias("end")).first()
    assert row["n"] == 17 * n and row["end"] == "[SECRET:assign]; "
    people = docs(spark, ["a@b.co, " * (n // 5)])
    row = personal.find_personal(people).select(F.size("base").alias("n"), F.element_at("base", -1).alias("last")).first()
    assert row["n"] == n // 5 and row["last"]["e"] == 8 * n // 5 - 2
    assert personal.sanitise(people).select(F.length("text")).first()[0] == 9 * n // 5
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("hi [there]").alias("text"))
    back = chat.read_back(chat.render(chat.reconstruct(chat.as_events(turns)))).select(F.size("turns"), F.length("loss_text")).first()
    assert tuple(back) == (n, 5 * n)
    assert time.time() - start < 200


def test_running_results(spark):
    rnd = random.Random(3)
    for n in (0, 1, 2, 3, 7, 64, 65, 300):
        x = [rnd.randrange(100) for _ in range(n)]
        row = spark.createDataFrame([(x,)], "x array<int>").select(common.sums(F.col("x")).alias("s"), common.running(F.col("x"), F.greatest).alias("m")).first()
        assert row["s"] == [sum(x[: i + 1]) for i in range(n)] and row["m"] == [max(x[: i + 1]) for i in range(n)]


def test_texts_put_together(spark):
    rnd = random.Random(4)
    for _ in range(40):
        text = "".join(rnd.choice("ab😀\ufeffé\n") for _ in range(rnd.randrange(1, 30)))
        spans = sorted((s, s + rnd.randrange(1, 6)) for s in (rnd.randrange(len(text)) for _ in range(rnd.randrange(6))))
        spans = [(s, min(e, len(text)), str(i)) for i, (s, e) in enumerate(spans)]
        out, at = [], 0
        for s, e, by in spans:
            if s >= at:
                out += [text[at:s], by]
            at = max(at, e)
        row = spark.createDataFrame([(text, spans)], "text string, spans array<struct<s:int,e:int,by:string>>")
        assert row.select(common.replaced(F.col("text"), F.col("spans"), lambda x: x["x"]["by"])).first()[0] == "".join(out) + text[at:]


def test_terms_against_brute_force(spark):
    """Marks of disclosing words beside plain PMI over the same contexts."""
    rnd = random.Random(12)
    names = ["ann.12@corp.org", "bob@corp.org", "eve@else.net", "10.0.7.1", "10.0.7.9", "4111 1111 1111 1111", "+49 30 1234567"]
    near_words = {0: "hydrology", 2: "zeppelin", 3: "rackmount", 6: "switchboard"}
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "straße", "of", "an"]
    texts = []
    for _ in range(160):
        parts = [rnd.choice(words) for _ in range(rnd.randrange(5, 40))]
        for k in rnd.sample(range(len(names)), rnd.choice([0, 0, 1, 2])):
            at = rnd.randrange(len(parts))
            parts[at:at] = [rnd.choice(words), near_words.get(k, rnd.choice(words)), names[k] + " ,", rnd.choice(words)]
        texts.append(" ".join(parts))
    texts += texts[:3] + [None, ""]
    width, disclosure, support = 30, 0.6, 2

    def contexts(text):
        """(protected, context, [(term, s, e)]) of each entity."""
        spans = direct(text)
        blank = list(text or "")
        for s, _, e, _ in spans:
            blank[s:e] = " " * (e - s)
        blank = "".join(blank)
        out = []
        for s, _, e, kind in spans:
            value = text[s:e].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[s:e])
            group = {"email": value.split("@")[-1], "ip": ".".join(value.split(".")[:3]), "card": value[:6], "phone": value[: max(len(value) - 4, 1)]}[kind]
            found = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", blank) if (s - width <= m.start() and m.end() <= s) or (e <= m.start() and m.end() <= e + width)]
            out.append(((f"{kind} = {value}", f"{kind} of {group}", kind), tuple(x[0] for x in found), found))
        return out

    n = len(texts)
    with_term, with_entity, together, shapes = Counter(), Counter(), Counter(), {}
    for t in texts:
        with_term.update({w.lower() for w in re.findall(r"[^\W\d_]{3,}", t or "")})
        with_entity.update({p for ps, _, _ in contexts(t) for p in ps})
        together.update({(w, p) for ps, _, found in contexts(t) for p in ps for w, _, _ in found})
        for ps, context, found in contexts(t):
            for p in ps:
                for w, _, _ in found:
                    shapes.setdefault((w, p), set()).add(context)
    share = {}
    for (w, p), k in together.items():
        if len(shapes[w, p]) >= support and with_entity[p] < n:
            share[w, p] = np.log(n * k / (with_term[w] * with_entity[p])) / np.log(n / with_entity[p])
    want = {}
    for i, t in enumerate(texts):
        best = {}
        for ps, _, found in contexts(t):
            for w, s, e in found:
                own = max((share.get((w, p), 0) for p in ps), default=0)
                if own >= disclosure:
                    best[s, e] = max(best.get((s, e), 0), own)
        want[i] = [(s, e, round(x, 6)) for (s, e), x in sorted(best.items())]
    found = {r["doc_id"]: [(x["s"], x["e"], round(x["share"], 6)) for x in r["terms"]] for r in personal.find_personal(docs(spark, texts), disclosure, support, near=width).collect()}
    assert found == want
    marked = {texts[i][s:e] for i, x in want.items() for s, e, _ in x}
    assert {"hydrology", "zeppelin", "switchboard"} <= marked and not marked & {"alpha", "beta"}


def test_passages_cut_out(spark):
    item = " ".join(f"item{i}" for i in range(14))
    texts = [f"Before, {item.upper()}! After.", item, "nothing here", f"{item} mid {item}", None, ""]
    rows = docs(spark, texts)
    out = {r["doc_id"]: r for r in decontaminate.remove_spans(rows, benchmark(spark, item, None)).collect()}
    assert [out[i]["text"] for i in range(6)] == ["Before, ! After.", "", "nothing here", " mid ", None, ""]
    assert out[0]["n_chars"] == 16 and out[0]["found"] == 1 and decontaminate.remove_spans(rows, benchmark(spark, item)).columns == rows.columns
    assert sorted(map(tuple, decontaminate.remove_spans(rows, benchmark(spark).limit(0)).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)


def test_other_columns_stay(spark, awkward):
    """Columns of users with the names of results are not touched."""
    labels = spark.createDataFrame([], LABELS)
    for out in (secrets.scan(awkward), quality.judge(awkward, labels), personal.sanitise(awkward), secrets.redact(awkward), language.identify(awkward, language.fit(awkward, ~language.held_out()))):
        assert {(r["found"], r["n"], r["text_hash"], r["__x"]) for r in out.collect() if r["doc_id"] is not None} == {(1, 2, 5, "x")}
    log = chat.as_events(spark.createDataFrame([(1, 0, "user", LONG, 5), (1, 1, "assistant", LONG, 5), (2, None, None, None, 5)], "conv_id long, turn long, role string, text string, seq int"))
    back = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.reconstruct(log)).withColumn("turns", F.lit(1)).drop("turns")).collect()}
    assert back[1]["loss_text"] == LONG and [x["text"] for x in back[1]["turns"]] == [LONG, LONG] and [tuple(x) for x in back[2]["turns"]] == [("", "")]


def test_random_logs_against_brute_force(spark):
    rnd = random.Random(5)
    kinds = ["message", "delta", "delta", "delta", "edit", "regenerate", "delete", "odd"]
    log = [(c, s, rnd.randrange(4), rnd.choice(kinds), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b\ufeff", "[", None])) for c in range(30) for s in range(rnd.randrange(1, 25))]
    want = {}
    for c, s, slot, kind, role, text in sorted(log, key=lambda x: x[:2]):
        m = want.setdefault((c, slot), {"seq": s, "role": "", "text": "", "there": True})
        m["role"] = role or m["role"]
        if kind == "delta":
            m["text"] += text or ""
            m["there"] = True
        elif kind in ("message", "edit"):
            m.update(text=text or "", there=True)
        elif kind == "regenerate":
            m.update(text="", there=True)
        elif kind == "delete":
            m.update(text="", there=False)
    rnd.shuffle(log)
    found = chat.reconstruct(spark.createDataFrame(log, "conv_id long, seq long, slot long, kind string, role string, text string"))
    rows = {(r["conv_id"], r["slot"]): (r["seq"], r["role"], r["text"]) for r in found.collect()}
    assert rows == {k: (m["seq"], m["role"], m["text"]) for k, m in want.items() if m["there"]}
    for r in chat.read_back(chat.render(found)).collect():
        own = sorted((m["seq"], k[1], m["role"], m["text"]) for k, m in want.items() if k[0] == r["conv_id"] and m["there"])
        assert [(x["role"], x["text"]) for x in r["turns"]] == [x[2:] for x in own] and r["loss_text"] == "".join(x[3] for x in own if x[2] == "assistant")


@pytest.mark.parametrize("long, batch", [(0, 1), (3, 64), (40, 1 << 18)])
def test_counts_of_parts(long, batch):
    import sentencepiece

    rnd = random.Random(long)
    alphabet = [*"ab cdé.,!? \n\t'0 9ÀΣſ中 文　\x85\xa0▁<>|ﬁ́İ  ß", "</s>", " the", "\r\n", "…", " x", "\u0301", "\u200b"]
    texts = [noise(rnd, alphabet, 60) for _ in range(3000)] + AWKWARD
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert token_counts.counts(texts, P.path("piece_bpe_32k.model"), batch, long) == [len(sp.encode(t or "")) for t in texts]


def test_languages_with_copies(spark):
    """A text with many copies is one; a language of few texts is still learned; a model has no more texts than asked."""
    rnd = random.Random(2)
    words = {"en": "the of and thing house there".split(), "de": "der die und straße häuser nicht".split(), "es": "el los que niño mañana está".split()}
    text = lambda k: " ".join(rnd.choice(words[k]) for _ in range(30))
    rows = [(i, text("en"), "en") for i in range(300)] + [(1000 + i, "el los que niño", "es") for i in range(400)] + [(2000, text("de"), "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    chosen = language._chosen(d, 20).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in chosen} == {"en": 20, "es": 1, "de": 1}
    model = language.fit(d, F.lit(True), 20)
    assert model.languages == ("de", "en", "es") and model.predict("die häuser und nicht")[0] == "de" and model.predict("los niño mañana el que")[0] == "es"


def test_repeated_words_do_not_multiply(spark):
    """An item of 3,000 equal words and a document of 30,000: 13 different surroundings of a block, not 3,000."""
    rows = docs(spark, ["ha " * 30_000, "ho ha ha ha ho"])
    item = benchmark(spark, "ha " * 3_000)
    start = time.time()
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate.find_benchmark(rows, item).collect()}
    assert found == {0: (30_000, 30_000, True), 1: (5, 0, False)} and time.time() - start < 60


def test_benchmark_beyond_the_broadcast(spark, monkeypatch):
    """The words of the benchmark too many to broadcast, their hashes not; and neither."""
    rnd = random.Random(4)
    word = lambda: rnd.choice("abcdefg")
    items = [" ".join(word() for _ in range(20)) for _ in range(5)]
    rows = docs(spark, [" ".join([word() for _ in range(30)] + items[k % 5].split()[2:17] + [word()]) for k in range(12)] + ["no words of these"])
    plain = sorted(map(repr, decontaminate.find_benchmark(rows, benchmark(spark, *items)).collect()))
    assert sorted(map(repr, decontaminate.find_benchmark(rows, benchmark(spark, *items), broadcast_rows=20).collect())) == plain
    assert sorted(map(repr, decontaminate.find_benchmark(rows, benchmark(spark, *items), broadcast_rows=0).collect())) == plain


def test_one_id_with_many_texts_teaches_once(spark, monkeypatch):
    """What learns is at most a row for each labelled id, whatever the number of rows with it."""
    taught = []
    monkeypatch.setattr(quality, "learn", lambda x, bad, prune, **kw: taught.append(len(bad)) or [])
    rows = docs(spark, [" ".join(f"w{i}x{k}" for k in range(60 + i)) for i in range(20)] * 5).withColumn("doc_id", F.col("doc_id") % 20)
    quality.learn_rules(rows, spark.createDataFrame([(i, i % 2, 0) for i in range(20)], LABELS))
    assert taught == [20]


def test_null_ids_are_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "BLOCK", 1 << 12)
    rows = docs(spark, [f"text number {i} {'x' * (i % 50)}" for i in range(3000)]).withColumn("doc_id", F.lit(None).cast("long"))
    path = binary.write_ids(rows, P.path("byte_bpe_50k.json"), f"{tmp_path}/ids")
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("documents").alias("n")).collect()
    assert len(parts) >= 6 and max(r["n"] for r in parts) < 1500
    got = binary.read_ids(spark, path).orderBy("start").collect()
    assert len(got) == 3000 and [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]))


def test_labels_that_are_no_languages(spark):
    rows = docs(spark, ["some words"] * 2).crossJoin(spark.range(3000)).withColumn("lang", F.col("id").cast("string"))
    with pytest.raises(ValueError, match="languages"):
        language.fit(rows, F.lit(True))


def test_least_squares_against_active_sets():
    """The solver beside Lawson and Hanson's active sets, on histograms that patterns fill and on others."""
    rnd = np.random.default_rng(7)
    for case in range(6):
        sizes = sorted(rnd.choice(np.arange(1, 30), 6, replace=False).tolist())
        patterns = sorted({tuple(sorted(rnd.choice(sizes, rnd.integers(1, 4)).tolist(), reverse=True)) for _ in range(12)})
        a = np.zeros((30, len(patterns)))
        for j, p in enumerate(patterns):
            for length in p:
                a[length, j] += 1
        h = a @ rnd.integers(0, 50, len(patterns)) if case % 2 else np.bincount(rnd.choice(sizes, 400), minlength=30)
        x = packing.least_squares(patterns, h, 5000)
        assert (x >= 0).all() and np.linalg.norm(a @ x - h) <= np.linalg.norm(a @ active_sets(a, h) - h) + 1e-3 * np.linalg.norm(h)


def active_sets(a, b):
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    while True:
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        if free.all() or w.max() <= 1e-9 * max(1, np.abs(b).max()):
            return x
        free[int(w.argmax())] = True
        while True:
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (s[free] > 1e-12).all():
                x = s
                break
            low = free & (s <= 1e-12)
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0


def test_centroids_against_plain_sums():
    """idf and centroids worked out entry by entry."""
    rnd = np.random.default_rng(2)
    counts = rnd.poisson(0.8, (40, 12))
    there = (counts > 0).sum(axis=0)
    idf = language.idf_of(40, there)
    for k in range(12):
        assert abs(idf[k] - (np.log(41 / (1 + sum(1 for row in counts if row[k]))) + 1)) < 1e-5
    c, accepts = language.centroids_of(counts, idf, 1)
    rows = []
    for row in counts:
        v = [np.sqrt(x) * w for x, w in zip(row, idf)]
        n = np.sqrt(sum(x * x for x in v))
        rows.append([x / max(n, 1e-12) for x in v])
    mean = [sum(r[k] for r in rows) / 40 for k in range(12)]
    mean = [x / np.sqrt(sum(y * y for y in mean)) for x in mean]
    assert np.allclose(c[0], mean, atol=1e-5)
    near = [sum(x * y for x, y in zip(r, mean)) for r in rows]
    assert abs(accepts[0] - 0.9 * np.quantile(near, language.REJECT)) < 1e-4
