"""Folds over the lines of one output: blocks, sections and capped lists as Column expressions.

An output is bounded (one capture), so its lines stay in one row and nothing shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bound


def none() -> Column:
    """No lines."""
    return F.array().cast("array<string>")


def begins(x: Column, *prefixes: str) -> Column:
    return x.rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")")


def has(x: Column, *parts: str) -> Column:
    return x.rlike("|".join(map(re.escape, parts)))


def fold(a: Column, start: dict[str, Column], step: Callable[..., dict[str, Column]], finish: Callable[[Column], Column] | None = None, see: tuple[Callable[..., Column], ...] = ()) -> Column:
    """Goes over an array with named fields of state; ``step`` gives the fields that change.

    Each of ``see`` tells something of an item that ``step`` and the following ones need more than once: it is worked out once an item and passed on after the state and the item.
    """

    def nxt(s: Column, x: Column, *seen: Column) -> Column:
        if len(seen) < len(see):
            return bound(see[len(seen)](s, x, *seen), lambda v: nxt(s, x, *seen, v))
        new = step(s, x, *seen)
        return F.struct(*[new.get(k, s[k]).alias(k) for k in start])

    zero = F.struct(*[v.alias(k) for k, v in start.items()])
    one = lambda s, x: nxt(s, x)
    return F.aggregate(a, zero, one, finish) if finish else F.aggregate(a, zero, one)


def blocks(a: Column, opens: Callable[[Column], Column], goes_on: Callable[[Column, Column], Column], skip: Callable[[Column], Column] | None = None) -> Column:
    """Blocks of lines, each joined by newlines: from a line that opens one as long as lines go on (given the block so far) or another opens."""
    closed = lambda s: F.when(F.size(s["block"]) > 0, F.concat(s["done"], F.array(F.array_join(s["block"], "\n")))).otherwise(s["done"])

    def step(s: Column, x: Column) -> dict[str, Column]:
        out = skip(x) if skip else F.lit(False)
        inside = F.size(s["block"]) > 0
        on = inside & goes_on(x, s["block"])
        done = F.when(out | (~opens(x) & (~inside | on)), s["done"]).otherwise(closed(s))
        block = F.when(out, s["block"]).when(opens(x), F.array(x)).when(on, F.concat(s["block"], F.array(x))).otherwise(none())
        return {"done": done, "block": block}

    return fold(a, {"done": none(), "block": none()}, step, closed)


def kept(a: Column, start: dict[str, Column], step: Callable[[Column, Column], tuple[Column, dict[str, Column]]]) -> Column:
    """Lines for which a stateful test is true. ``step`` gives the test and the fields that change."""

    def nxt(s: Column, x: Column) -> dict[str, Column]:
        keep, new = step(s, x)
        return new | {"out": F.when(keep, F.concat(s["out"], F.array(x))).otherwise(s["out"])}

    return fold(a, start | {"out": none()}, nxt, lambda s: s["out"])


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def more(n: Column, cap: int, what: str, mark: str = "… +", lead: str = "") -> Column:
    """How many of ``n`` a cap leaves out, as a line; empty if none."""
    return F.when(n > cap, text(lead + mark, n - cap, f" {what}")).otherwise("")


def listed(a: Column, cap: int, what: str, form: Callable[[Column, Column], Column] | None = None, sep: str = "\n", mark: str = "… +", lead: str = "\n") -> Column:
    """The first ``cap`` items, then how many were left out."""
    shown = F.slice(a, 1, cap)
    return F.concat(F.array_join(F.transform(shown, form) if form else shown, sep), more(F.size(a), cap, what, mark, lead))


def total(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(a, test))


def last(a: Column) -> Column:
    """The last item, or null."""
    return F.try_element_at(a, F.lit(-1))


def number(x: Column, pattern: str, group: int = 1) -> Column:
    """What a pattern captures, as a number; 0 where it doesn't fit."""
    return F.coalesce(F.nullif(F.regexp_extract(x, pattern, group), F.lit("")).cast("int"), F.lit(0))


def grouped(pairs: Column) -> Column:
    """(key, items) of an array of (key, item), keys in order and the items of each as they come. The pairs are sorted once, then gone over once."""
    kind = "array<struct<key:string,items:array<string>>>"
    placed = F.array_sort(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), p["item"].alias("item"))))
    closed = lambda s: F.when(F.size(s["items"]) > 0, F.concat(s["out"], F.array(F.struct(s["key"].alias("key"), s["items"].alias("items"))))).otherwise(s["out"])

    def step(s: Column, p: Column) -> dict[str, Column]:
        same = (F.size(s["items"]) > 0) & (s["key"] == p["key"])
        one = F.array(p["item"])
        return {"key": p["key"], "items": F.when(same, F.concat(s["items"], one)).otherwise(one), "out": F.when(same, s["out"]).otherwise(closed(s))}

    return fold(placed, {"key": F.lit(""), "items": none(), "out": F.array().cast(kind)}, step, closed)
