"""Mixing beside plain targets, rates found by bisection, and what each source and document may take."""

import math
import random
import re
from collections import defaultdict

import pytest

from quarrylight.llm import mixing

DOCS = "doc_id long, text string, source string, size long, target string, rank int, n int, rows int"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        now = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if now[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else now[s] for s in names}
        capped |= over


def rate_of(sizes, target, most=3):
    """Rates by bisection of the tilt."""
    mean = sum(sizes) / len(sizes)
    f = lambda t: [0 if x == 0 else most / (1 + (most - 1) * math.exp(max(-700, min(700, -t * x / mean)))) for x in sizes]
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(x * r for x, r in zip(sizes, f(mid))) < target else (low, mid)
    return f(low)


def rows(spark, docs):
    return spark.createDataFrame([(i, t, s, 1, "x", 2, 3, 4) for i, t, s in docs], DOCS)


def sample(seed, n=300, names=("a", "B", "é", "z", None)):
    rnd = random.Random(seed)
    return [(i, " ".join(["w"] * int(rnd.paretovariate(0.9) * 5)), rnd.choice(names[: 1 + i % len(names)])) for i in range(n)]


@pytest.mark.parametrize("seed, most", [(1, 3), (3, 2)])
def test_targets_rates_and_copies(spark, seed, most):
    docs = sample(seed)
    plan = mixing.mixing_plan(rows(spark, docs), most=most).collect()
    by, own = defaultdict(int), defaultdict(list)
    for i, t, s in docs:
        by[s] += words(t)
    expected = targets(by, most=most)
    for r in plan:
        assert r["source_size"] == by[r["source"]] and r["target"] == pytest.approx(expected[r["source"]], rel=1e-9)
        assert 0 <= r["copies"] <= most and r["rows"] == 1
        own[r["source"]].append(r)
    for s, rs in own.items():
        for r, rate in zip(rs, rate_of([r["size"] for r in rs], expected[s], most)):
            assert r["rate"] == pytest.approx(rate, abs=1e-6)
        assert abs(sum(r["copies"] * r["size"] for r in rs) - expected[s]) <= max(10, 0.01 * expected[s])
    again = mixing.mixing_plan(rows(spark, docs[::-1]).repartition(7), most=most).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, plan))


def test_few_words_are_shared_anew(spark):
    """A source of three words takes nine at most; what it leaves is shared by weight, and so on until none is above."""
    docs = [(1, "a b c", "x"), (2, "w " * 1000, "a"), (3, "w " * 10, "m")] + [(10 + i, "w " * 7, "z") for i in range(40)]
    plan = {r["doc_id"]: r for r in mixing.mixing_plan(rows(spark, docs)).collect()}
    expected = targets({"x": 3, "a": 1000, "m": 10, "z": 280})
    assert (plan[1]["target"], plan[1]["copies"]) == (9, 3) and (plan[3]["target"], plan[3]["copies"]) == (30, 3)
    assert plan[10]["target"] == pytest.approx(expected["z"]) and sum(r["target"] for r in plan.values() if r["doc_id"] < 11) == pytest.approx(1293)


def test_mixed_rows(spark):
    docs = sample(7, 120) + [(500, "one two", "a"), (500, "one two", "a"), (500, "other", "a"), (None, "x y z", "a"), (None, None, None), (501, "", "z"), (502, " \t\n", "only blank")]
    df = rows(spark, docs)
    plan = mixing.mixing_plan(df).collect()
    twice = next(r for r in plan if r["doc_id"] == 500 and r["size"] == 2)
    assert twice["rows"] == 2 and next(r for r in plan if r["source"] == "only blank")["target"] == 0
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    got = defaultdict(int)
    for r in mixed.collect():
        got[r["source"]] += words(r["text"])
    for s in got:
        assert got[s] == sum(r["rows"] * r["copies"] * r["size"] for r in plan if r["source"] == s)
    assert mixing.mixing_plan(rows(spark, [])).count() == 0
    nothing = mixing.mixing_plan(rows(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in nothing] == [(0, 0, 0)] * 2


def test_many_sources_and_documents_beyond_the_broadcast(spark, monkeypatch):
    """Every table shuffled, documents of a size numbered by ranges."""
    docs = [(i, "w " * (1 + i % 3), f"s{i % 40}") for i in range(600)]
    plain = sorted(map(repr, mixing.mixing_plan(rows(spark, docs)).collect()))
    monkeypatch.setattr(mixing, "small", lambda df, n: df)
    monkeypatch.setattr(mixing, "NUMBERED", 3)
    assert sorted(map(repr, mixing.mixing_plan(rows(spark, docs)).collect())) == plain
