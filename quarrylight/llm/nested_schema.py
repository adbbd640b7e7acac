"""11. Nested schema inference: a frontier that goes down by one depth a pass, with the maps above it broadcast."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import table
from quarrylight.shipping import ship
from quarrylight.storage import small, written

MOST_NAMES = 20  #: of one path's objects; beyond, it is a map
HELD = 100_000  #: paths that a task holds before it passes its counts on
KINDS = {dict: "object", list: "array", str: "string", int: "integer", float: "double", bool: "boolean", type(None): "null"}
PATHS = "steps array<string>, type string, n long, min_len long, max_len long"


class _Place:
    """What is counted at one path of a task's rows, and the paths below."""

    __slots__ = ("counts", "most", "least", "below")

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}
        self.least = self.most = None
        self.below: dict[str, _Place] = {}

    def add(self, kind: str) -> None:
        self.counts[kind] = self.counts.get(kind, 0) + 1

    def add_list(self, n: int) -> None:
        self.add("array")
        self.least = n if self.least is None else min(self.least, n)
        self.most = n if self.most is None else max(self.most, n)

    def under(self, step: str) -> _Place:
        place = self.below.get(step)
        if place is None:
            place = self.below[step] = _Place()
        return place


def _refused(constant: str):
    raise ValueError(constant)


#: Of numbers only the kind counts: len stands for the integer, which may have any number of digits.
_DECODER = json.JSONDecoder(parse_int=len, parse_constant=_refused)


def _walk(value, place: _Place) -> None:
    stack = [(value, place)]
    while stack:
        value, place = stack.pop()
        kind = type(value)
        if kind is dict:
            place.add("object")
            for name, x in value.items():
                stack.append((x, place.under("." + name)))
        elif kind is list:
            place.add_list(len(value))
            if value:
                item = place.under("[]")
                for x in value:
                    stack.append((x, item))
        else:
            place.add(KINDS[kind])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PATHS for (text, under, listed, broken), added up in the task before anything is shuffled."""
    roots: dict[str, _Place] = {}

    def flush() -> pa.RecordBatch:
        out: list[tuple] = []
        stack = [([name], place) for name, place in roots.items()]
        while stack:
            steps, place = stack.pop()
            for kind, n in place.counts.items():
                lens = (place.least, place.most) if kind == "array" else (None, None)
                out.append((steps, kind, n, *lens))
            for step, kid in place.below.items():
                stack.append(([*steps, step if step.isascii() else step.encode("utf-8", "replace").decode()], kid))
        roots.clear()
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["steps", "type", "n", "min_len", "max_len"])

    def places(place: _Place) -> int:
        n, stack = 0, [place]
        while stack:
            n += 1
            stack.extend(stack.pop().below.values())
        return n

    size = 0
    for batch in batches:
        for text, under, listed, broken in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                value = _DECODER.decode(text) if text else None
            except (ValueError, RecursionError):
                value = None
            if type(value) is not dict:
                roots.setdefault(broken, _Place()).add("bad")
                continue
            place = roots.setdefault("$", _Place())
            for name in under:
                place.add("object")
                place = place.under("." + name)
            if listed:
                place.add_list(1)
                place = place.under("[]")
            _walk(value, place)
            size += len(text)
        if size > 1 << 22:
            size = 0
            if sum(map(places, roots.values())) > HELD:
                yield flush()
    yield flush()


def _summed(paths: DataFrame) -> DataFrame:
    return paths.groupBy("steps", "type").agg(F.sum("n").alias("n"), F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"))


def infer_schema(rows: DataFrame, text: Column, under: Column | None = None, listed: Column | None = None, broken: Column | None = None, most_names: int = MOST_NAMES) -> DataFrame:
    """(path, types, n_names, is_map, optional, min_len, max_len, steps) for each path of the JSON objects in `text`.

    under: names of objects that a value lies in, from `$` down; listed: whether it is the element of a list there;
    broken: the path at which a text that is no whole object counts as `bad`. A path, other than `$`, whose objects show
    more than most_names names has all of them replaced by `*`, counted from the top down, after the names above it.

    One Arrow scan counts raw paths, added up in the tasks; then each pass counts different names one depth further by a
    shuffle, broadcasts the maps that it found (measured; shuffled beyond) and adds the paths up anew, so that a map of any
    number of names is one path for all later passes; the last one counts paths with all names fixed. Passes are as many as
    the deepest value has levels. Nothing but that number, and whether a pass found maps, reaches the driver.

    Nulls, empty texts, other values than objects, NaN and what is nested deeper than Python's parser follows (some
    thousand levels) are `bad`. Of equal names in one object the last counts. Repeated rows count each; an empty table has no
    paths; other columns are ignored. Half of a surrogate pair in a name reads `?`. Paths are told apart by `steps`: names
    that hold dots or brackets may read alike in `path`. A name `*` of the data is never optional.
    """
    ship(rows.sparkSession, 10_000)
    under = F.array().cast("array<string>") if under is None else under
    asked = rows.select(text.cast("string").alias("a"), under.alias("b"), (F.lit(False) if listed is None else listed).alias("c"), (F.lit("!") if broken is None else broken).alias("d"))
    now = written(_summed(asked.mapInArrow(_counted, PATHS)), "paths")
    deepest = now.agg(F.max(F.size("steps"))).first()[0] or 0
    named = []
    for depth in range(1, deepest):
        parent, step = F.slice("steps", 1, depth), F.get("steps", F.lit(depth))
        found = now.filter(step.startswith(".")).select(parent.alias("parent"), step.alias("step")).distinct()
        found = written(found.groupBy("parent").agg(F.count(F.lit(1)).alias("n_names")).withColumn("is_map", (F.col("n_names") > most_names) & (F.size("parent") > 1)), "names")
        named.append(found)
        maps = found.filter("is_map").select("parent")
        if not maps.isEmpty():
            name = F.when(F.col("parent").isNotNull() & step.startswith("."), F.concat(parent, F.array(F.lit(".*")), F.slice("steps", depth + 2, F.size("steps"))))
            joined = now.join(small(maps, 500_000), parent == F.col("parent"), "left")
            now = written(_summed(joined.withColumn("steps", F.coalesce(name, F.col("steps"))).drop("parent")), "paths")
    total = lambda kinds: F.sum(F.when(kinds, F.col("n")).otherwise(0))
    out = now.groupBy("steps").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "type", F.col("n").cast("string")))), "|").alias("types"),
        total(F.col("type") == "object").alias("objects"),
        total(F.col("type") != "null").alias("present"),
        F.min("min_len").alias("min_len"),
        F.max("max_len").alias("max_len"),
    )
    out = written(out, "schema")
    names = rows.sparkSession.createDataFrame([], T.StructType.fromDDL("parent array<string>, n_names long, is_map boolean"))
    for found in named:
        names = names.unionByName(found)
    last = F.element_at("steps", -1)
    above = out.filter("objects > 0").select(F.col("steps").alias("above"), F.col("objects").alias("of"))
    out = out.join(above, F.slice("steps", 1, F.size("steps") - 1) == F.col("above"), "left").join(names, F.col("steps") == F.col("parent"), "left")
    return out.select(
        F.array_join("steps", "").alias("path"),
        "types",
        F.coalesce("n_names", F.lit(0)).cast("long").alias("n_names"),
        F.coalesce("is_map", F.lit(False)).alias("is_map"),
        F.coalesce(last.startswith(".") & (last != ".*") & (F.col("present") < F.col("of")), F.lit(False)).alias("optional"),
        "min_len",
        "max_len",
        "steps",
    )


def op11(spark, sf_dir: str) -> DataFrame:
    g = F.coalesce(F.expr("pmod(client_id, 90)"), F.lit(0))
    x = F.expr("crc32(coalesce(cast(click_id as string), ''))") % (g % 37 + 1)
    number = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    listed = F.coalesce(F.expr("click_id % 7 = 0"), F.lit(False))
    clicks = table(spark, sf_dir, "clicks")
    return infer_schema(clicks, F.col("props"), F.array(number("g", g), number("x", x)), listed, number("!g", g)).drop("steps")


#: The table of CRC-32 by its rule, and the sum of the bytes of a hexadecimal string.
CRC_SQL = """crc_table as (select list(v order by k) as t from (select k, list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k) as v from range(256) as r(k)))"""


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a text, where crc_table is joined."""
    hexed = f"hex(encode({text}))"
    values = f"list_transform(range(1, length({hexed}) // 2 + 1), lambda i: cast('0x' || substr({hexed}, 2 * i - 1, 2) as bigint))"
    return f"xor(list_reduce({values}, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), cast(4294967295 as bigint)), 4294967295)"


def _op11_sql(depth: int = 12) -> str:
    """For values of up to `depth` levels: raw paths by a recursive walk, then the names of one depth after the other."""
    levels, names = [], []
    for d in range(1, depth):
        levels.append(f"m{d} as (select steps[1:{d}] as p, count(distinct steps[{d + 1}]) as n from r{d - 1} where len(steps) > {d} and starts_with(steps[{d + 1}], '.') group by 1)")
        levels.append(
            f"r{d} as (select case when m.p is not null and starts_with(steps[{d + 1}], '.') then list_concat(list_append(steps[1:{d}], '.*'), steps[{d + 2}:]) else steps end as steps, kind, len"
            f" from r{d - 1} left join (select p from m{d} where n > 20 and len(p) > 1) m on len(steps) > {d} and steps[1:{d}] = m.p)"
        )
        names.append(f"select p, n from m{d}")
    levels_sql, names_sql = ",\n".join(levels), " union all ".join(names)
    return f"""
with recursive {CRC_SQL},
c as (select click_id, coalesce(client_id % 90, 0) as g, coalesce(json_valid(props) and json_type(case when json_valid(props) then props end) = 'OBJECT', false) as whole, props from clicks),
d as (select *, {crc_sql("cast(click_id as varchar)")} % (g % 37 + 1) as x from c, crc_table),
wrapped as (select ['$'] as steps, json_object('g' || g, json_object('x' || x, case when click_id % 7 = 0 then json_array(cast(props as json)) else cast(props as json) end)) as v from d where whole),
walk as (select steps, v from wrapped
  union all select list_append(steps, case when json_type(walk.v) = 'OBJECT' then '.' || e.key else '[]' end), e.value from walk, json_each(walk.v) as e where json_type(walk.v) in ('OBJECT', 'ARRAY')),
r0 as (select steps, case json_type(v) when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' when 'DOUBLE' then 'double' else 'integer' end as kind,
  case when json_type(v) = 'ARRAY' then json_array_length(v)::bigint end as len from walk
  union all select ['!g' || g], 'bad', null from d where not whole),
{levels_sql},
kinds as (select steps, kind, count(*) as n, min(len) as least, max(len) as most from r{depth - 1} group by 1, 2),
paths as (select steps, string_agg(kind || ':' || n, '|' order by kind) as types, sum(case when kind = 'object' then n else 0 end) as objects, sum(case when kind <> 'null' then n else 0 end) as present,
  min(least) as min_len, max(most) as max_len from kinds group by 1),
names as ({names_sql})
select array_to_string(a.steps, '') as path, a.types, coalesce(names.n, 0)::bigint as n_names, coalesce(names.n > 20 and len(a.steps) > 1, false) as is_map,
  coalesce(starts_with(a.steps[-1], '.') and a.steps[-1] <> '.*' and a.present < b.objects, false) as optional, a.min_len, a.max_len
from paths a left join paths b on b.objects > 0 and a.steps[1:len(a.steps) - 1] = b.steps left join names on names.p = a.steps
"""


OP11_SQL = _op11_sql()
