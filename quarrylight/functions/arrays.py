"""Array expressions that no single built-in has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f) -> Column:
    """f(value), with value worked out once however often f looks at it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def first_of_each(rows: Column, key: str) -> Column:
    """Of an array of structs, in order, the first with each value of a field. By sorting: n rows cost n log n."""
    placed = F.transform(rows, lambda x, i: F.struct(x[key].alias("k"), i.alias("i"), x.alias("x")))

    def new(s: Column) -> Column:
        seen = F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), x["x"].alias("x"), (F.get(s, i - 1)["k"] == x["k"]).alias("again")))
        return F.transform(F.array_sort(F.filter(seen, lambda x: ~F.coalesce(x["again"], F.lit(False)))), lambda x: x["x"])

    return bound(F.array_sort(placed), new)
