"""Spelling variants beside all pairs by plain Python, on words of few letters, on long words and on awkward texts."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from quarrylight.llm import spelling

DOCS = "doc_id long, text string, word string, n long, key string, id int"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, ratio=2):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] is not None else None)
    return out


def found(spark, words, **kw):
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), **kw).collect()
    assert len({r["word"] for r in got}) == len(got)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


@pytest.mark.parametrize("letters, most", [("ab", 6), ("abcé", 5), ("abcdefgh", 4)])
def test_all_pairs(spark, letters, most):
    rnd = random.Random(letters)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, most))): rnd.choice([1, 2, 2, 4, 9, 40]) for _ in range(250)}
    assert found(spark, words) == plain(words)


def test_nodes_met_by_a_shuffle(spark, monkeypatch):
    """The same with no node hot enough for the broadcast, and with all nodes."""
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 6))): rnd.randint(1, 30) for _ in range(200)}
    for hot in (1, 10**9):
        monkeypatch.setattr(spelling, "HOT", hot)
        assert found(spark, words) == plain(words)


def test_terminals_are_n_log_n(spark):
    rnd = random.Random(1)
    words = list({"".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(5, 9))) for _ in range(2000)})
    rows = spelling.terminals(spark.createDataFrame([(w, 3) for w in words], "word string, n long"))
    assert rows.count() <= len(words) * (1 + 3 * (len(words).bit_length()))


def test_long_words_and_chains(spark):
    long = "x" * 50_000
    words = {long: 9, long[1:]: 3, long + "y": 4, "a" + long: 2, "abcde": 1, "abcdf": 2, "abcff": 4, "abfff": 8, "affff": 16, "fffff": 32, "fffffz": 80}
    got = found(spark, words)
    assert got["abcde"] == ("abcdf", "fffffz", 1, 1, 2) and got["fffff"][:2] == ("fffffz", "fffffz")
    assert got[long[1:]] == (long, long, 3, 1, 9) and got[long] == (None, long, 9, 3, None) and got["a" + long][0] == long


def counted(spark, rows, **kw):
    return {r["word"]: r["n"] for r in spelling.count_words(spark.createDataFrame(rows, DOCS), **kw).collect()}


def brute(rows, spoil=None):
    out = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def test_counted_words(spark, monkeypatch):
    rnd = random.Random(3)
    pieces = ["Straße", "STRASSE", "École", "ÉCOLE", "hello", "Hello", "it's", "naïve×", "abc", "a" * 300, "日本hello語", "x1hello"]
    rows = [(rnd.choice([None, 0, 1, 2, -5]), " ".join(rnd.choices(pieces, k=rnd.randrange(40))), "w", 1, "k", 2) for _ in range(60)]
    rows += [(7, None, "w", 1, "k", 2), (8, "", "w", 1, "k", 2), (9, "hello " * 20_000, "w", 1, "k", 2)]
    assert counted(spark, rows) == brute(rows)
    monkeypatch.setattr(spelling, "HELD", 10)
    assert counted(spark, rows, spoil=3) == brute(rows, 3)
    assert counted(spark, []) == {} and found(spark, {}) == {}
