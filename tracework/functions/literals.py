"""Many patterns over one text: a pattern runs only on texts that hold a literal without which it can't match."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache, reduce
from itertools import product
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most literals that stand for a pattern, and most characters of a class that are written out.
MOST, CLASS = 24, 8
#: Letters beyond ASCII that a pattern without case takes for ASCII ones, and what they are taken for.
_FOLDED, _PLAIN = "ſKİı", "skii"


def _joined(runs: list[str], more: Iterable[str]) -> list[str]:
    return [a + b for a, b in product(runs, more)]


def _alternatives(node) -> list[str] | None:
    """All texts that a part of a pattern stands for, if they are few and plain."""
    op, value = str(node[0]), node[1]
    if op == "LITERAL":
        return [chr(value)]
    if op == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(value) <= CLASS:
        return [chr(c) for _, c in value]
    if op == "SUBPATTERN":
        return _whole(value[-1])
    if op == "BRANCH":
        parts = [_whole(b) for b in value[1]]
        return None if any(p is None for p in parts) else [x for p in parts for x in p]
    return None


def _whole(nodes) -> list[str] | None:
    runs = [""]
    for node in nodes:
        part = _alternatives(node)
        if part is None or len(runs) * len(part) > MOST:
            return None
        runs = _joined(runs, part)
    return runs


def _needed(nodes) -> list[str]:
    """Literals of which each match holds one; none if that can't be told."""
    best: list[str] = []
    runs = [""]

    def better(found: list[str]) -> None:
        nonlocal best
        if found and len(found) <= MOST and min(map(len, found)) > min(map(len, best), default=0):
            best = found

    for node in nodes:
        op, value = str(node[0]), node[1]
        if op in ("AT", "ASSERT", "ASSERT_NOT"):
            continue  # takes no room
        part = _alternatives(node)
        if part is not None and len(runs) * len(part) <= MOST:
            runs = _joined(runs, part)
            continue
        better(runs)
        runs = [""] if part is None else part
        if op == "SUBPATTERN":
            better(_needed(value[-1]))
        elif op == "BRANCH":
            each = [_needed(b) for b in value[1]]
            better([x for e in each for x in e] if all(each) else [])
        elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            better(_needed(value[2]))
    better(runs)
    return best


@lru_cache(maxsize=1024)
def needs(pattern: str) -> tuple[tuple[str, ...], bool]:
    """(literals, ignoring case) of a pattern in Java's dialect: each match holds one of the literals; no literals if that can't be told."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    body = pattern[flags.end() :] if flags else pattern
    if re.search(r"\(\?[a-zA-Z]", body) or (flags and "x" in flags[1]):
        return (), False
    try:
        # boundaries take no room, and an end of the text is one
        found = _needed(re._parser.parse(body.replace(r"\z", "")))
    except re.error:
        return (), False
    ignore = bool(flags and "i" in flags[1])
    if ignore and any(ord(c) > 127 for x in found for c in x):
        return (), False
    return tuple(sorted({x.lower() if ignore else x for x in found})), ignore


def folded(s: Column) -> Column:
    """``s`` in lower case, as a pattern without case sees ASCII letters."""
    return F.lower(F.translate(s, _FOLDED, _PLAIN))


def possible(s: Column, pattern: str) -> Column | None:
    """Whether ``s`` holds a literal that ``pattern`` needs; None if it needs none."""
    found, ignore = needs(pattern)
    where = folded(s) if ignore else s
    return reduce(or_, [F.contains(where, F.lit(x)) for x in found]) if found else None


def matches(s: Column, pattern: str) -> Column:
    """``s.rlike(pattern)``, tried only where it can match; null for null."""
    can = possible(s, pattern)
    return s.rlike(pattern) if can is None else can & s.rlike(pattern)


def count(s: Column, pattern: str) -> Column:
    """Matches of ``pattern`` in ``s``, counted only where there can be one; null for null."""
    can = possible(s, pattern)
    n = F.regexp_count(s, F.lit(pattern)).cast("long")
    return n if can is None else F.when(can, n).when(~can, F.lit(0).cast("long"))


def _replacing(pattern: str, mark: str):
    def step(x: Column) -> Column:
        can, new = possible(x, pattern), F.regexp_replace(x, pattern, mark)
        return new if can is None else F.when(can, new).otherwise(x)

    return step


def replaced(s: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """``s`` after each (pattern, replacement) in order; a rule runs only on what can hold a match of it."""
    for pattern, mark in rules:
        # a transform of one value: the text so far is named once, however often it is used
        s = F.transform(F.array(s), _replacing(pattern, mark))[0]
    return s
