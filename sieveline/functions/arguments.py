"""Argument vectors of search commands as folds over an array of words: option tables, clustered short options, values in the next word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, c

#: Options that take a value, but for the patterns of ``-e`` and ``--regexp``.
SHORT = "ABCMTdfgjmt"
LONG = (
    "--after-context", "--before-context", "--color", "--colors", "--context", "--context-separator", "--encoding", "--engine", "--field-context-separator", "--field-match-separator", "--file", "--glob", "--iglob",
    "--ignore-file", "--max-columns", "--max-count", "--max-depth", "--max-filesize", "--path-separator", "--pre", "--pre-glob", "--replace", "--sort", "--sortr", "--threads", "--type", "--type-add", "--type-clear", "--type-not",
)
#: Caps where none is given.
LINE_LENGTH, RESULTS = 80, 200


def _none() -> Column:
    return F.array().cast("array<string>")


def _state(s: Column | None = None, **new: Column) -> Column:
    empty = {"wants": F.lit(""), "rest": F.lit(False), "patterns": _none(), "words": _none(), "flags": _none()}
    return F.struct(*[new.get(k, empty[k] if s is None else s[k]).alias(k) for k in empty])


def search(args: Column | str) -> Column:
    """(patterns, paths, flags) of a search's arguments.

    Clusters of short options are taken apart at the first that takes a value, whose value is what follows it or the next word; ``r`` and ``R`` before it
    go, and so does ``--recursive``. After ``--`` all are words. With a pattern given by option all words are paths, else the first is the pattern.
    """

    def clustered(s: Column, arg: Column) -> Column:
        plain = F.regexp_extract(arg, rf"^-([^e{SHORT}]*+)", 1)
        kept = F.regexp_replace(plain, "[rR]", "")
        option, inline = arg.substr(F.length(plain) + 2, F.lit(1)), arg.substr(F.length(plain) + 3, F.length(arg))
        flags = F.concat(s["flags"], F.when(kept != "", F.array(F.concat(F.lit("-"), kept))).otherwise(_none()))
        taken = F.concat(flags, F.array(F.concat(F.lit("-"), option)))
        return (
            F.when(option == "", _state(s, flags=flags)).when((option == "e") & (inline != ""), _state(s, flags=flags, patterns=F.concat(s["patterns"], F.array(inline))))
            .when(option == "e", _state(s, flags=flags, wants=F.lit("-e"))).when(inline != "", _state(s, flags=F.concat(taken, F.array(inline)))).otherwise(_state(s, flags=taken, wants=F.lit("value")))
        )

    def step(s: Column, arg: Column) -> Column:
        one = F.array(arg)
        return (
            F.when(s["wants"].isin("-e", "--regexp"), _state(s, wants=F.lit(""), patterns=F.concat(s["patterns"], one))).when(s["wants"] == "value", _state(s, wants=F.lit(""), flags=F.concat(s["flags"], one)))
            .when(s["rest"], _state(s, words=F.concat(s["words"], one))).when(arg == "--", _state(s, rest=F.lit(True))).when(arg == "--regexp", _state(s, wants=F.lit("--regexp")))
            .when(arg.isin(*LONG), _state(s, flags=F.concat(s["flags"], one), wants=F.lit("value"))).when(arg == "--recursive", s).when(arg.startswith("--"), _state(s, flags=F.concat(s["flags"], one)))
            .when(arg.startswith("-") & (arg != "-"), clustered(s, arg)).otherwise(_state(s, words=F.concat(s["words"], one)))
        )

    def told(s: Column) -> Column:
        given = F.size(s["patterns"]) > 0
        return F.struct(
            F.when(given, s["patterns"]).otherwise(F.slice(s["words"], 1, 1)).alias("patterns"), F.when(given, s["words"]).otherwise(F.slice(s["words"], F.lit(2), F.size(s["words"]))).alias("paths"),
            F.when(s["wants"] == "-e", F.concat(s["flags"], F.array(F.lit("-e")))).otherwise(s["flags"]).alias("flags"))

    return F.aggregate(c(args), _state(), step, told)


def own_options(args: Column | str, line_length: int = LINE_LENGTH, results: int = RESULTS) -> Column:
    """(line_length, results, context_only, file_type, rest): options of the search itself, up to the first word that is none of them."""
    fields = ("wants", "over", "line_length", "results", "context_only", "file_type", "rest")
    start = {"wants": F.lit(""), "over": F.lit(False), "line_length": F.lit(line_length).cast("long"), "results": F.lit(results).cast("long"), "context_only": F.lit(False), "file_type": F.lit(""), "rest": _none()}
    state = lambda s, **new: F.struct(*[new.get(k, s[k]).alias(k) for k in fields])
    number = lambda x, other: F.coalesce(F.when(x.rlike(r"^[+-]?[0-9]+\z"), x.try_cast("long")), other)
    after = lambda x, option: x.substr(F.lit(len(option) + 2), F.length(x))

    def step(s: Column, arg: Column) -> Column:
        off = F.lit("")
        return (
            F.when(s["over"], state(s, rest=F.concat(s["rest"], F.array(arg)))).when(s["wants"] == "length", state(s, wants=off, line_length=number(arg, s["line_length"])))
            .when(s["wants"] == "results", state(s, wants=off, results=number(arg, s["results"]))).when(s["wants"] == "type", state(s, wants=off, file_type=arg))
            .when(arg.isin("-l", "--max-len"), state(s, wants=F.lit("length"))).when(arg.isin("-m", "--max"), state(s, wants=F.lit("results"))).when(arg.isin("-t", "--file-type"), state(s, wants=F.lit("type")))
            .when(arg.startswith("--max-len="), state(s, line_length=number(after(arg, "--max-len"), s["line_length"]))).when(arg.startswith("--max="), state(s, results=number(after(arg, "--max"), s["results"])))
            .when(arg.startswith("--file-type="), state(s, file_type=after(arg, "--file-type"))).when(arg == "--context-only", state(s, context_only=F.lit(True))).otherwise(state(s, over=F.lit(True), rest=F.array(arg)))
        )

    return F.aggregate(c(args), F.struct(*[start[k].alias(k) for k in fields]), step, lambda s: F.struct(*[s[k].alias(k) for k in fields[2:]]))


def search_command(command: Column | str) -> Column:
    """(patterns, paths, flags, line_length, results, context_only, file_type) of a whole search command, its program left out; no path means the folder itself."""
    from .shell import tokenize

    words = lambda w: F.slice(w, F.lit(2), F.size(w))
    told = lambda own: bound(search(own["rest"]), lambda s: F.struct(s["patterns"].alias("patterns"), F.when(F.size(s["paths"]) == 0, F.array(F.lit("."))).otherwise(s["paths"]).alias("paths"), s["flags"].alias("flags"), *[own[k].alias(k) for k in ("line_length", "results", "context_only", "file_type")]))
    return bound(tokenize(command), lambda w: bound(own_options(words(w)), told))
