"""Declarative text filters: a definition becomes one projection over a text column.

Stages run in a fixed order: strip ANSI, replace, match output (which answers at once), strip or keep lines,
truncate lines, head and tail, max lines, on empty. Nothing shuffles; a filter on a hundred
terabytes of captures is one narrow pass. Definitions are checked when the plan is built.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

_FIELDS = {
    "description", "match_command", "strip_ansi", "replace", "match_output", "strip_lines_matching", "keep_lines_matching",
    "truncate_lines_at", "head_lines", "tail_lines", "max_lines", "on_empty", "filter_stderr",
}


@dataclass(frozen=True)
class FilterDef:
    name: str
    match_command: str = ""
    strip_ansi: bool = False
    replace: tuple[tuple[str, str], ...] = ()
    match_output: tuple[tuple[str, str, str | None], ...] = ()  # pattern, message, unless
    strip_lines_matching: tuple[str, ...] = ()
    keep_lines_matching: tuple[str, ...] = ()
    truncate_lines_at: int | None = None
    head_lines: int | None = None
    tail_lines: int | None = None
    max_lines: int | None = None
    on_empty: str | None = None
    filter_stderr: bool = False
    tests: tuple[tuple[str, str, str], ...] = field(default=(), compare=False)  # name, input, expected

    def __post_init__(self) -> None:
        if self.strip_lines_matching and self.keep_lines_matching:
            raise ValueError(f"{self.name}: strip_lines_matching and keep_lines_matching exclude each other")
        for p in (self.match_command, *(r[0] for r in self.replace), *(m[0] for m in self.match_output), *self.strip_lines_matching, *self.keep_lines_matching):
            re.compile(re.sub(r"\(\?[a-z]+\)", "", p))  # syntax only; Java's compiler has the last word


def load(source: str | Path) -> list[FilterDef]:
    """Definitions of a TOML file, or of all in a folder, by name."""
    path = Path(source)
    out: dict[str, FilterDef] = {}
    for p in sorted(path.glob("*.toml")) if path.is_dir() else [path]:
        data = tomllib.loads(p.read_text(encoding="utf-8"))
        tests = data.get("tests", {})
        for name, d in data.get("filters", {}).items():
            if unknown := d.keys() - _FIELDS:
                raise ValueError(f"{name}: unknown fields {sorted(unknown)}")
            out[name] = FilterDef(
                name, d.get("match_command", ""), d.get("strip_ansi", False), tuple((r["pattern"], r["replacement"]) for r in d.get("replace", [])),
                tuple((m["pattern"], m["message"], m.get("unless")) for m in d.get("match_output", [])), tuple(d.get("strip_lines_matching", [])), tuple(d.get("keep_lines_matching", [])),
                d.get("truncate_lines_at"), d.get("head_lines"), d.get("tail_lines"), d.get("max_lines"), d.get("on_empty"), d.get("filter_stderr", False),
                tuple((t["name"], t["input"], t["expected"]) for t in tests.get(name, [])),
            )
    return [out[n] for n in sorted(out)]


def _head_tail(a: Column, head: int | None, tail: int | None) -> Column:
    if head is None and tail is None:
        return a
    n, keep = F.size(a), (head or 0) + (tail or 0)
    mark = F.concat(F.lit("... ("), (n - keep).cast("string"), F.lit(" lines omitted)"))
    first = F.slice(a, 1, head) if head else F.array().cast("array<string>")
    last = F.slice(a, n - tail + 1, tail) if tail else F.array().cast("array<string>")
    return F.when(n > keep, F.concat(first, F.array(mark), last)).otherwise(a)


def apply(d: FilterDef, raw: Column | str) -> Column:
    """The filtered text; line ends of any kind count as newlines."""
    text = T.normalize_newlines(raw)
    if d.strip_ansi:
        text = T.strip_ansi(text)
    a = T.lines(text)
    if d.replace:
        a = F.transform(a, lambda s: reduce(lambda x, r: F.regexp_replace(x, "(?d)" + r[0], r[1]), d.replace, s))
    blob = T.unlines(a)
    if d.strip_lines_matching:
        a = F.filter(a, lambda s: ~T.any_of(s, list(d.strip_lines_matching)))
    elif d.keep_lines_matching:
        a = F.filter(a, lambda s: T.any_of(s, list(d.keep_lines_matching)))
    if d.truncate_lines_at is not None:
        a = F.transform(a, lambda s: T.truncate(s, d.truncate_lines_at))
    a = _head_tail(a, d.head_lines, d.tail_lines)
    if d.max_lines is not None:
        n = F.size(a)
        mark = F.concat(F.lit("... ("), (n - d.max_lines).cast("string"), F.lit(" lines truncated)"))
        a = F.when(n > d.max_lines, F.concat(F.slice(a, 1, d.max_lines), F.array(mark))).otherwise(a)
    out = T.unlines(a)
    if d.on_empty is not None:
        out = F.when(T.is_blank(out), d.on_empty).otherwise(out)
    for pattern, message, unless in reversed(d.match_output):
        hit = blob.rlike("(?d)" + pattern)
        out = F.when(hit & ~blob.rlike("(?d)" + unless) if unless else hit, message).otherwise(out)
    return out


def catalog(spark: SparkSession, defs: list[FilterDef]) -> DataFrame:
    """The definitions as a table of names, patterns and stages."""
    rows = [(d.name, d.match_command, d.strip_ansi, len(d.strip_lines_matching), len(d.keep_lines_matching), d.max_lines, d.on_empty) for d in defs]
    return spark.createDataFrame(rows, "name string, match_command string, strip_ansi boolean, n_strip int, n_keep int, max_lines int, on_empty string")


def _first_word(pattern: str) -> str | None:
    """The word that every matching command begins with, or None if a pattern doesn't say so plainly."""
    m = re.match(r"\^([A-Za-z0-9_]+)(?:\\b|\\s\+|\(\\s\|\$\))", pattern)
    return m[1] if m else None


def route(command: Column | str, defs: list[FilterDef]) -> Column:
    """The name of the first definition, by name, whose pattern matches the command; null where none.

    Definitions are looked up by the command's first word; only theirs and the few patterns that name no first word are tried.
    """
    by_name = sorted((d for d in defs if d.match_command), key=lambda d: d.name)
    if not by_name:
        return F.lit(None).cast("string")
    words: dict[str, list[FilterDef]] = {}
    anywhere = [d for d in by_name if not _first_word(d.match_command)]
    for d in by_name:
        if w := _first_word(d.match_command):
            words.setdefault(w, []).append(d)
    cmd = T.c(command)
    tried = lambda ds: F.coalesce(*[F.when(cmd.rlike("(?d)" + d.match_command), F.lit(d.name)) for d in ds], F.lit(None).cast("string")) if ds else F.lit(None).cast("string")
    # commands of a word with few definitions share one expression with column patterns; a literal table holds them
    kind = "array<struct<name:string,pattern:string>>"
    listed = F.create_map(*[x for w, ds in words.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(d.name).alias("name"), F.lit("(?d)" + d.match_command).alias("pattern")) for d in ds]).cast(kind))]) if words else None
    own = F.lit(None).cast("string")
    if words:
        fits = F.filter(F.try_element_at(listed, F.regexp_extract(cmd, r"^\w+", 0)), lambda d: F.regexp_instr(cmd, d["pattern"]) > 0)
        own = F.try_element_at(F.transform(fits, lambda d: d["name"]), F.lit(1))
    other = tried(anywhere)
    return T.bound(F.struct(own.alias("own"), other.alias("other")), lambda r: F.when(r["own"].isNull() | (r["other"] < r["own"]), r["other"]).otherwise(r["own"]))


_PLAN = (
    "filter string, strip_ansi boolean, replaced array<struct<pattern:string,by:string>>, answers array<struct<pattern:string,message:string,unless:string>>, strip string, keep string, "
    "truncate int, head int, tail int, most int, on_empty string"
)


def plans(spark: SparkSession, defs: list[FilterDef]) -> DataFrame:
    """The definitions' stages as a table, a row each, for ``applied``."""
    one = lambda ps: "(?d)" + "|".join(f"(?:{p})" for p in ps) if ps else None
    rows = [
        (d.name, d.strip_ansi, [("(?d)" + p, r) for p, r in d.replace], [("(?d)" + p, m, "(?d)" + u if u else None) for p, m, u in d.match_output], one(d.strip_lines_matching), one(d.keep_lines_matching),
         d.truncate_lines_at, d.head_lines, d.tail_lines, d.max_lines, d.on_empty)
        for d in defs
    ]
    return spark.createDataFrame(rows, _PLAN)


def applied(raw: Column | str, p: Column) -> Column:
    """``apply`` of the definition that the row's own plan ``p`` describes: one expression for all definitions. Patterns are columns, which functions that keep the last one compile once a row."""
    matches = lambda x, pattern: F.regexp_instr(x, pattern) > 0
    none = F.array().cast("array<string>")

    def cleaned(text: Column) -> Column:
        a = T.lines(F.when(p["strip_ansi"], T.strip_ansi(text)).otherwise(text))
        return F.when(F.size(p["replaced"]) > 0, F.transform(a, lambda s: F.aggregate(p["replaced"], s, lambda x, r: F.regexp_replace(x, r["pattern"], r["by"])))).otherwise(a)

    def marked(n: Column, what: str) -> Column:
        return F.array(F.concat(F.lit("... ("), n.cast("string"), F.lit(f" lines {what})")))

    def capped(a: Column) -> Column:
        n, keep = F.size(a), F.coalesce(p["head"], F.lit(0)) + F.coalesce(p["tail"], F.lit(0))
        first = F.when(p["head"] > 0, F.slice(a, F.lit(1), p["head"])).otherwise(none)
        last = F.when(p["tail"] > 0, F.slice(a, F.greatest(n - p["tail"] + 1, F.lit(1)), p["tail"])).otherwise(none)
        return F.when((p["head"].isNotNull() | p["tail"].isNotNull()) & (n > keep), F.concat(first, marked(n - keep, "omitted"), last)).otherwise(a)

    def most(a: Column) -> Column:
        return F.when(F.size(a) > p["most"], F.concat(F.slice(a, F.lit(1), p["most"]), marked(F.size(a) - p["most"], "truncated"))).otherwise(a)

    def kept(a: Column) -> Column:
        a = F.when(p["strip"].isNotNull(), F.filter(a, lambda s: ~matches(s, p["strip"]))).when(p["keep"].isNotNull(), F.filter(a, lambda s: matches(s, p["keep"]))).otherwise(a)
        return F.when(p["truncate"] > 0, F.transform(a, lambda s: F.left(s, p["truncate"]))).otherwise(a)

    def filtered(a: Column) -> Column:
        short = T.bound(T.bound(kept(a), capped), lambda b: T.unlines(most(b)))
        return T.bound(short, lambda out: F.when(p["on_empty"].isNotNull() & T.is_blank(out), p["on_empty"]).otherwise(out))

    def answered(a: Column) -> Column:
        hits = T.bound(T.unlines(a), lambda blob: F.filter(p["answers"], lambda m: matches(blob, m["pattern"]) & (m["unless"].isNull() | ~F.coalesce(matches(blob, m["unless"]), F.lit(False)))))
        answer = F.when(F.size(p["answers"]) > 0, F.try_element_at(hits, F.lit(1))["message"])
        return F.coalesce(answer, filtered(a))

    return T.bound(cleaned(T.normalize_newlines(raw)), answered)


def apply_routed(df: DataFrame, command: str, raw: str, defs: list[FilterDef], out: str = "filtered") -> DataFrame:
    """Each row filtered by the definition its command routes to; unrouted rows pass unchanged.

    The plan holds one filter, not one for each definition: a row's stages come from the definitions' table, which is bounded by their number and sent to the tasks.
    """
    table = plans(df.sparkSession, defs)
    table = table.select("filter", F.struct(*[c for c in table.columns if c != "filter"]).alias("_plan"))
    routed = df.withColumn("filter", route(command, defs)).join(F.broadcast(table), "filter", "left")
    return routed.select(*df.columns, "filter", F.when(F.col("_plan").isNull(), F.col(raw)).otherwise(T.bound(F.col("_plan"), lambda p: applied(raw, p))).alias(out))


def verify(spark: SparkSession, defs: list[FilterDef]) -> DataFrame:
    """(filter, total, passed, failed) over the definitions' own tests; trailing newlines don't count."""
    parts = []
    for d in defs:
        if d.tests:
            df = spark.createDataFrame([(d.name, i, e) for _, i, e in d.tests], "filter string, input string, expected string")
            cut = lambda x: F.regexp_replace(x, r"\n+\z", "")
            parts.append(df.select("filter", (cut(apply(d, "input")) == cut(F.col("expected"))).alias("ok")))
    if not parts:
        return spark.createDataFrame([], "filter string, total long, passed long, failed long")
    return reduce(DataFrame.unionByName, parts).groupBy("filter").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("ok").cast("long")).alias("passed"), F.sum((~F.col("ok")).cast("long")).alias("failed"))
