"""Nested schema inference beside plain Python, on awkward rows and on rows of random shape."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarrylight.llm.nested_schema import infer_schema

COLUMNS = "props string, path string, n long, parent string, u array<string>, l boolean"


def kind(v):
    return {dict: "object", list: "array", str: "string", int: "integer", float: "double", bool: "boolean", type(None): "null"}[type(v)]


def plain(rows, most=20):
    """path: (types, n_names, is_map, optional, min_len, max_len), whole values held at once, one depth after the other."""
    bad, nodes = 0, []
    for text, under, listed in rows:
        try:
            v = json.loads(text, parse_constant=lambda c: 1 / 0) if text else None
        except (ValueError, ZeroDivisionError):
            v = None
        if not isinstance(v, dict):
            bad += 1
            continue
        v = [v] if listed else v
        for name in reversed(under):
            v = {name: v}
        nodes.append(v)
    out = {"!": (f"bad:{bad}", 0, False, False, None, None)} if bad else {}
    level = {"$": nodes} if nodes else {}
    optional = {}
    while level:
        below = defaultdict(list)
        for path, values in level.items():
            objects = [v for v in values if isinstance(v, dict)]
            names = {k for v in objects for k in v}
            is_map = len(names) > most and path != "$"
            lens = [len(v) for v in values if isinstance(v, list)]
            types = "|".join(f"{k}:{n}" for k, n in sorted(Counter(map(kind, values)).items()))
            out[path] = (types, len(names), is_map, optional.get(path, False), min(lens, default=None), max(lens, default=None))
            for v in objects:
                for k, x in v.items():
                    below[f"{path}.{'*' if is_map else k}"].append(x)
            for k in set() if is_map else names - {"*"}:
                optional[f"{path}.{k}"] = any(v.get(k) is None for v in objects)
            for v in values:
                if isinstance(v, list):
                    below[path + "[]"].extend(v)
        level = {k: v for k, v in below.items() if v}
    return out


def found(spark, rows, **kw):
    df = spark.createDataFrame([(t, "x", 1, "y", u, listed) for t, u, listed in rows], COLUMNS)
    got = infer_schema(df, F.col("props"), F.col("u"), F.col("l"), **kw).collect()
    assert len({r["path"] for r in got}) == len(got)
    return {r["path"]: (r["types"], r["n_names"], r["is_map"], r["optional"], r["min_len"], r["max_len"]) for r in got}


def value(rnd, depth):
    pick = rnd.random()
    if depth and pick < 0.45:
        many = 30 if rnd.random() < 0.1 else 3
        return {rnd.choice("abcdé*") + (str(rnd.randrange(60)) if many == 30 else ""): value(rnd, depth - 1) for _ in range(rnd.randrange(many))}
    if depth and pick < 0.6:
        return [value(rnd, depth - 1) for _ in range(rnd.randrange(4))]
    return rnd.choice([None, True, 1, -3, 1.5, 1e30, "x", ""])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_values(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(400):
        text = json.dumps({"k": value(rnd, 5)}) if rnd.random() < 0.9 else rnd.choice(["", None, "{", "[1]", "1", "{} x", '{"a":NaN}', '{"a":1,}', "null", ' {"a" : 1E5} '])
        rows.append((text, rnd.choice([[], ["g"], ["g", f"x{rnd.randrange(25)}"]]), rnd.random() < 0.2))
    assert found(spark, rows) == plain(rows)


def test_maps_are_fixed_from_the_top(spark):
    """Names below a map are counted together, after the names above are replaced."""
    rows = [(json.dumps({"m": {f"k{i}": {f"a{i % 15}": 1, "b": {f"z{i % 22}": None}}}}), [], False) for i in range(40)]
    got = found(spark, rows)
    assert got == plain(rows)
    assert got["$.m"][1:3] == (40, True) and got["$.m.*"][1:3] == (16, False) and got["$.m.*.b"][1:3] == (22, True) and got["$.m.*.b.*"][0] == "null:40"


def test_twenty_names_are_no_map_and_the_root_never_is(spark):
    rows = [(json.dumps({f"r{i}": 1, "o": {f"k{i % 20}": 1}}), [], False) for i in range(100)]
    got = found(spark, rows)
    assert got == plain(rows) and got["$"][1:3] == (101, False) and got["$.o"][1:3] == (20, False) and got["$.o.k3"][3]


def test_maps_beyond_the_broadcast(spark, monkeypatch):
    from quarrylight.llm import nested_schema

    monkeypatch.setattr(nested_schema, "small", lambda df, n: df)
    rows = [(json.dumps({f"p{i % 7}": {f"k{i}": {"v": i}}}), [], False) for i in range(300)]
    assert found(spark, rows) == plain(rows)


def test_flushed_counts(spark, monkeypatch):
    rows = [(json.dumps({"a": {f"k{i}": "x" * 70_000}}), [], False) for i in range(80)]
    assert found(spark, rows) == plain(rows)


def test_awkward(spark):
    deep = '{"a":' * 60 + "1" + "}" * 60
    rows = [(t, [], False) for t in [None, "", "  ", deep, '{"a":1,"a":null}', '{"":{"":[]}}', '{"n":' + "9" * 5000 + "}", '{"n":1e999,"s":"\\ud800"}', '{"\\ud800":1}', '{"a.b":1,"a":{"b":2}}', "{}", "{}", "{}{}"]]
    got = infer_schema(spark.createDataFrame([(t, "x", 1, "y", u, listed) for t, u, listed in rows], COLUMNS), F.col("props")).collect()
    by = {tuple(r["steps"]): r for r in got}
    assert by["!",]["types"] == "bad:4" and by["$",]["types"] == "object:9"
    assert by["$", ".n"]["types"] == "double:1|integer:1" and by["$", ".?"]["types"] == "integer:1"
    assert by["$", ".a"]["types"] == "null:1|object:2" and by["$", ".a"]["optional"]
    assert by[("$", *[".a"] * 60)]["types"] == "integer:1"
    assert by["$", ".a.b"]["path"] == by["$", ".a", ".b"]["path"]
    assert by["$", ".", "."]["min_len"] == 0
    empty = spark.createDataFrame([], COLUMNS)
    assert infer_schema(empty, F.col("props"), F.col("u"), F.col("l")).count() == 0
    nothing = spark.createDataFrame([(None, "x", 1, "y", None, None)], COLUMNS)
    assert [r["types"] for r in infer_schema(nothing, F.col("props"), F.col("u"), F.col("l")).collect()] == ["bad:1"]
