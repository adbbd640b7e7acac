"""Boolean trigram queries of regular expressions: what a text must contain for the expression to match anywhere in it."""

from __future__ import annotations

from itertools import product
from re import _parser as parser

#: A query: None holds for every text; a str is a trigram; ("and"|"or", [queries]).
Query = None | str | tuple

MOST = 64  #: an alternative with more strings than this is no longer followed exactly


def _all(parts) -> Query:
    flat = [y for x in parts if x is not None for y in (x[1] if x[0] == "and" else (x,))]
    flat = list(dict.fromkeys(flat))
    return None if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _any(parts) -> Query:
    parts = list(dict.fromkeys(parts))
    if not parts or None in parts:
        return None
    # what asks for more than another alternative adds nothing
    sets = [frozenset(x[1]) if x[0] == "and" else frozenset((x,)) for x in parts]
    parts = [x for x, own in zip(parts, sets, strict=True) if not any(other < own for other in sets)]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _needs(strings: set[str]) -> Query:
    """One of the strings is in the text: the trigrams of each; a string under three characters says nothing."""
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings))


def _characters(op, value) -> set[str] | None:
    """The lower-cased characters that a node of one character matches; None if many."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()}
    if name == "IN" and str(value[0][0]) != "NEGATE":
        out: set[str] = set()
        for kind, x in value:
            if str(kind) == "LITERAL":
                out.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < 4:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    return None


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """(all strings that it can match, or None if not followed; what must hold anyway). Runs of exact strings are joined."""
    must: list[Query] = []
    run: set[str] | None = {""}
    exact = True
    for op, value in nodes:
        name = str(op)
        strings, query = None, None
        if name in ("LITERAL", "IN"):
            strings = _characters(op, value)
        elif name == "SUBPATTERN":
            strings, query = _walk(value[-1])
        elif name == "ATOMIC_GROUP":
            strings, query = _walk(value)
        elif name == "BRANCH":
            ways = [_walk(x) for x in value[1]]
            if all(s is not None for s, _ in ways):
                strings = set().union(*(s for s, _ in ways))
            else:
                query = _any(_all([q, _needs(s) if s else None]) for s, q in ways)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = value
            s, q = _walk(inner)
            if s is not None and most == 1:
                strings = s | ({""} if least == 0 else set())
            elif least > 0:
                query = _all([q, _needs(s) if s else None])
                if s is not None and least == most and len(s) ** least <= MOST:
                    strings = {"".join(x) for x in product(sorted(s), repeat=least)}
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            strings = {""}
        must.append(query)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a in run for b in strings}
        else:
            exact = False
            must.append(_needs(run))
            run = strings if strings is not None and len(strings) <= MOST else {""}
    return (run, _all(must)) if exact else (None, _all([*must, _needs(run)]))


def query(pattern: str) -> Query:
    """The query, over ASCII-lowered text, that holds for every text in which pattern matches. None: nothing is mandatory."""
    strings, must = _walk(parser.parse(pattern))
    return _all([must, _needs(strings) if strings is not None else None])


def trigrams(q: Query) -> list[str]:
    """The trigrams of a query, sorted."""
    if q is None:
        return []
    return [q] if isinstance(q, str) else sorted({t for x in q[1] for t in trigrams(x)})


def holds(q: Query, has) -> object:
    """q with each trigram t replaced by has(t) and joined with & and |; for Spark columns and for booleans."""
    if isinstance(q, str):
        return has(q)
    out = holds(q[1][0], has)
    for x in q[1][1:]:
        out = out & holds(x, has) if q[0] == "and" else out | holds(x, has)
    return out
