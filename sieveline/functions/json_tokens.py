"""JSON as a token stream: printers that keep number text, and the texts of single fields, as Column expressions.

A text is cut into tokens by one pattern. A fold goes over them with a stack of the containers that are open; a container is printed when it closes, from
the printed texts of its items, so that no tree is built. The fold also checks the grammar: a text that isn't JSON gives null. What
follows the first value is left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, c

STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
#: Strings, runs of what may be a number or a word, and single signs; blanks lie between.
_TOKEN = rf'{STRING}|[-+.0-9a-zA-Z]++|[^ \t\r\n]'

_ITEM = "key:string,text:string,simple:boolean"
_FRAME = f"kind:string,key:string,items:array<struct<{_ITEM}>>"


def tokens(x: Column | str) -> Column:
    return F.regexp_extract_all(c(x), F.lit(_TOKEN), F.lit(0))


def _sort(t: Column) -> Column:
    """string, number, word, a sign itself, or bad."""
    return F.when(t.isin("{", "}", "[", "]", ":", ","), t).when(t.rlike(f"^{STRING}\\z"), "string").when(t.rlike(f"^{NUMBER}\\z"), "number").when(t.isin("true", "false", "null"), "word").otherwise("bad")


def decoded(t: Column) -> Column:
    """The text of a string token."""
    inner = t.substr(F.lit(2), F.length(t) - 2)
    return F.when(t.contains("\\"), F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0]).otherwise(inner)


def _folded(x: Column | str, scalar: Callable[[Column, Column, Column, Column], Column], array: Callable[[Column, Column], Column], obj: Callable[[Column, Column], Column]) -> Column:
    """Prints the first value of a text: scalars by (token, sort, depth, whether in an object), containers by (items, depth)."""
    none = F.array().cast(f"array<struct<{_FRAME}>>")

    def frame(kind: Column, key: Column, items: Column) -> Column:
        return F.struct(kind.alias("kind"), key.alias("key"), items.alias("items"))

    def state(stack: Column, expect: Column, out: Column) -> Column:
        return F.struct(stack.alias("stack"), expect.alias("expect"), out.alias("out"))

    def added(stack: Column, text: Column, simple: Column) -> Column:
        """A finished value goes to the container on top, or is the whole."""
        top = F.element_at(stack, -1)
        item = F.struct(top["key"].alias("key"), text.alias("text"), simple.alias("simple"))
        onto = F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), F.array(frame(top["kind"], top["key"], F.concat(top["items"], F.array(item)))))
        return F.when(F.size(stack) == 0, state(none, F.lit("end"), text)).otherwise(state(onto, F.lit("next"), F.lit(None).cast("string")))

    def step(s: Column, t: Column) -> Column:
        return F.when(s["expect"].isin("end", "bad"), s).otherwise(bound(_sort(t), lambda kind: moved(s, t, kind)))

    def moved(s: Column, t: Column, kind: Column) -> Column:
        stack, expect = s["stack"], s["expect"]
        top, depth = F.try_element_at(stack, F.lit(-1)), F.size(stack)
        value = expect.isin("value", "first")
        keyed = F.concat(F.slice(stack, F.lit(1), F.greatest(depth - 1, F.lit(0))), F.array(frame(top["kind"], decoded(t), top["items"])))
        opened = F.concat(stack, F.array(frame(kind, F.lit(None).cast("string"), F.array().cast(f"array<struct<{_ITEM}>>"))))
        below = F.slice(stack, F.lit(1), F.greatest(depth - 1, F.lit(0)))
        closed = bound(F.when(kind == "]", array(top["items"], depth - 1)).otherwise(bound(_distinct(top["items"]), lambda items: obj(items, depth - 1))), lambda text: added(below, text, F.lit(False)))
        shut = ((kind == "]") & (top["kind"] == "[") & expect.isin("first", "next")) | ((kind == "}") & (top["kind"] == "{") & expect.isin("first key", "next"))
        to = lambda what, st=stack: state(st, F.lit(what), s["out"])
        return (
            F.when(value & kind.isin("string", "number", "word"), added(stack, scalar(t, kind, depth, top["kind"].eqNullSafe("{")), F.lit(True)))
            .when(value & (kind == "{"), to("first key", opened)).when(value & (kind == "["), to("first", opened)).when(expect.isin("first key", "key") & (kind == "string"), to("colon", keyed))
            .when((expect == "colon") & (kind == ":"), to("value")).when((expect == "next") & (kind == ",") & (top["kind"] == "{"), to("key")).when((expect == "next") & (kind == ","), to("value"))
            .when(shut, closed).otherwise(to("bad"))
        )

    return F.aggregate(tokens(x), state(none, F.lit("value"), F.lit(None).cast("string")), step, lambda s: F.when(s["expect"] == "end", s["out"]))


def _distinct(items: Column) -> Column:
    """Items of an object by key; of equal keys the last."""
    placed = F.transform(items, lambda x, i: F.struct(x["key"].alias("key"), (-i).alias("i"), x["text"].alias("text"), x["simple"].alias("simple")))
    return bound(F.array_sort(placed), lambda a: F.filter(a, lambda x, i: (i == 0) | (x["key"] != F.element_at(a, F.greatest(i, F.lit(1)))["key"])))


def _pad(depth: Column) -> Column:
    return F.repeat(F.lit("  "), depth)


def _line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _first_bytes(x: Column, n: int) -> Column:
    """As many whole characters as fit into ``n`` bytes."""
    return F.left(x, F.array_max(F.filter(F.sequence(F.lit(0), F.lit(n)), lambda k: F.octet_length(F.left(x, k)) <= n)))


def _capped(items: Column, cap: int, row: Callable[[Column, Column], Column], depth: Column) -> Column:
    """The rows of an object's items; from ``cap`` items on with a line that says how many are left out, even if it is none."""
    over = F.when(F.size(items) >= cap, _line(_pad(depth), "  ... +", F.size(items) - cap, " more keys\n")).otherwise("")
    return _line(_pad(depth), "{\n", F.array_join(F.transform(F.slice(items, 1, cap), row), ""), over, _pad(depth), "}")


def compact(x: Column | str, max_depth: int = 10) -> Column:
    """Values in short, null where a text isn't JSON: long strings cut at 77 bytes, arrays of more than five as the first and a count, keys sorted and capped at 21, what lies deeper than ``max_depth`` as dots."""

    def scalar(t: Column, kind: Column, depth: Column, in_object: Column) -> Column:
        text = F.when(kind == "string", bound(decoded(t), lambda v: _line('"', F.when(F.octet_length(v) > 80, _line(_first_bytes(v, 77), "...")).otherwise(v), '"'))).otherwise(t)
        return F.when(in_object, text).when(depth > max_depth, _line(_pad(depth), "...")).otherwise(_line(_pad(depth), text))

    def array(items: Column, depth: Column) -> Column:
        n, pad = F.size(items), _pad(depth)
        first = F.trim(F.try_element_at(items, F.lit(1))["text"])
        inline = _line(pad, "[", F.array_join(F.transform(items, lambda i: F.trim(i["text"])), ", "), "]")
        rows = _line(pad, "[\n", F.array_join(F.transform(items, lambda i: _line(i["text"], ",\n")), ""), pad, "]")
        return F.when(depth > max_depth, _line(pad, "...")).when(n == 0, _line(pad, "[]")).when(n > 5, _line(pad, "[", first, ", ... +", n - 1, " more]")).when(F.forall(items, lambda i: i["simple"]), inline).otherwise(rows)

    def obj(items: Column, depth: Column) -> Column:
        row = lambda i: F.when(i["simple"], _line(_pad(depth), "  ", i["key"], ": ", F.trim(i["text"]), "\n")).otherwise(_line(_pad(depth), "  ", i["key"], ":\n", i["text"], "\n"))
        return F.when(depth > max_depth, _line(_pad(depth), "...")).when(F.size(items) == 0, _line(_pad(depth), "{}")).otherwise(_capped(items, 21, row, depth))

    return _folded(x, scalar, array, obj)


def shape(x: Column | str, max_depth: int = 10) -> Column:
    """Types only, null where a text isn't JSON: arrays by their first element and a count, strings over 50 bytes with their length, addresses and dates told apart, keys sorted and capped at 16."""

    def scalar(t: Column, kind: Column, depth: Column, in_object: Column) -> Column:
        text = lambda v: F.when(F.octet_length(v) > 50, _line("string[", F.octet_length(v), "]")).when(v.startswith("http"), "url").when(v.contains("-") & (F.octet_length(v) == 10), "date?").otherwise("string")
        name = F.when(kind == "string", bound(decoded(t), text)).when(kind == "number", F.when(t.rlike("[.eE]"), "float").otherwise("int")).when(t == "null", "null").otherwise("bool")
        return F.when(depth > max_depth, _line(_pad(depth), "...")).otherwise(_line(_pad(depth), name))

    def array(items: Column, depth: Column) -> Column:
        n, pad, first = F.size(items), _pad(depth), F.try_element_at(items, F.lit(1))["text"]
        return F.when(depth > max_depth, _line(pad, "...")).when(n == 0, _line(pad, "[]")).when(n == 1, _line(pad, "[\n", first, "\n", pad, "]")).otherwise(_line(pad, "[", F.trim(first), "] (", n, ")"))

    def obj(items: Column, depth: Column) -> Column:
        comma = lambda k: F.when(k < F.size(items) - 1, ",").otherwise("")
        row = lambda i, k: F.when(i["simple"], _line(_pad(depth), "  ", i["key"], ": ", F.trim(i["text"]), comma(k), "\n")).otherwise(_line(_pad(depth), "  ", i["key"], ":\n", i["text"], "\n"))
        return F.when(depth > max_depth, _line(_pad(depth), "...")).when(F.size(items) == 0, _line(_pad(depth), "{}")).otherwise(_capped(items, 16, row, depth))

    return _folded(x, scalar, array, obj)


def is_object(x: Column | str) -> Column:
    """Whether a text's first value is a whole object; what follows it is left alone."""
    blank = lambda *a: F.lit("")
    return c(x).rlike(r"^[ \t\r\n]*\{") & _folded(x, blank, blank, blank).isNotNull()
