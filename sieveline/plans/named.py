"""Filters by name: a few reports under the names of the programs they read, then the definitions of the catalog."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.scan import grouped
from ..operators.tools import matches_by_file
from . import filters as P
from .catalog import DEFS


def paths_by_folder(x: Column | str, dirs: int = 20, files: int = 10) -> Column:
    """Paths grouped by folder, folders by name, the first files of each; as it is where there are none."""
    rows = F.filter(T.lines(x), lambda s: ~T.is_blank(s))
    pair = lambda p: F.struct(F.when(p.contains("/"), F.regexp_extract(p, r"^(.*)/[^/]*\z", 1)).otherwise(".").alias("key"), F.regexp_extract(p, r"([^/]*)\z", 1).alias("item"))

    def one(d: Column) -> Column:
        own = d["items"]
        more = F.when(F.size(own) > files, F.concat(F.lit("  +"), (F.size(own) - files).cast("string"), F.lit("\n"))).otherwise("")
        return F.concat(d["key"], F.lit("/  ("), F.size(own).cast("string"), F.lit(")\n"), F.array_join(F.transform(F.slice(own, 1, files), lambda n: F.concat(F.lit("  "), n, F.lit("\n"))), ""), more)

    def told(a: Column, folders: Column) -> Column:
        head = F.concat(F.size(a).cast("string"), F.lit(" files in "), F.size(folders).cast("string"), F.lit(" dirs:\n\n"))
        rest = F.when(F.size(folders) > dirs, F.concat(F.lit("\n+"), (F.size(folders) - dirs).cast("string"), F.lit(" more dirs\n"))).otherwise("")
        return F.concat(head, F.array_join(F.transform(F.slice(folders, 1, dirs), one), ""), rest)

    return T.bound(rows, lambda a: F.when(F.size(a) == 0, T.c(x)).otherwise(T.bound(grouped(F.transform(a, pair)), lambda folders: told(a, folders))))


#: Reports by name; these come before definitions of the same name.
NAMED: dict[str, Callable[[Column], Column]] = {"grep": matches_by_file, "rg": matches_by_file, "find": paths_by_folder, "fd": paths_by_folder}


def definition(name: str, defs: list[P.FilterDef] | None = None) -> P.FilterDef | None:
    return next((d for d in DEFS if d.name == name) if defs is None else (d for d in defs if d.name == name), None)


def apply_named(name: str, raw: Column | str) -> Column | None:
    """The output under a named filter; null where no filter has the name."""
    if f := NAMED.get(name):
        return f(T.normalize_newlines(raw))
    return P.apply(d, raw) if (d := definition(name)) else None


def names(spark: SparkSession) -> DataFrame:
    """All names, sorted."""
    return spark.createDataFrame([(n,) for n in sorted({*NAMED, *(d.name for d in DEFS)})], "name string")
