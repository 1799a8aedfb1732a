"""Package managers and nested test reports: trees of any depth become rows by a recursive query, and reports are made from the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .scan import begins, fold, has, more, text

LIST = 50


def _recursive(df: DataFrame, sql: str) -> DataFrame:
    """A recursive query over ``df`` (named {docs}); it ends with the depth of the data, so rows aren't capped."""
    spark = df.sparkSession
    name = f"nested_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(name)
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(sql.replace("{docs}", name))


_PACKAGE = "'version string, dependencies map<string,string>, devDependencies map<string,string>'"


def nested_packages(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, name, version, dev): packages of a dependency tree in JSON, each where it stands; those below a development dependency are that too."""
    children = lambda field, dev: f"transform(map_entries(coalesce(from_json(node, {_PACKAGE}).{field}, map())), k -> named_struct('name', k.key, 'dev', {dev}, 'node', k.value))"
    rows = _recursive(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), f"""
        WITH RECURSIVE t(id, name, dev, node) AS (
          SELECT id, get_json_object(node, '$.name'), false, node FROM (SELECT id, explode(from_json(text, 'array<string>')) AS node FROM {{docs}})
          UNION ALL
          SELECT id, e.name, dev OR e.dev, e.node FROM (SELECT id, dev, explode(concat({children('dependencies', 'false')}, {children('devDependencies', 'true')})) AS e FROM t))
        SELECT id, name, get_json_object(node, '$.version') AS version, dev FROM t""")
    return rows.where("version <> ''")


def text_packages(x: Column | str) -> Column:
    """(name, version, dev) of a plain listing with section headers."""
    def step(s: Column, line: Column) -> dict[str, Column]:
        t = T.utrim(line)
        head = t.isin("dependencies:", "devDependencies:")
        word = F.regexp_extract(t, r"^(\S+)", 1)
        name, version = F.regexp_extract(word, r"^(.*)@", 1), F.regexp_extract(word, r"@([^@]*)$", 1)
        hit = ~head & ~line.rlike("[│├└]") & ~line.contains("Legend:") & (name != "") & (version != "")
        row = F.array(F.struct(name.alias("name"), version.alias("version"), s["dev"].alias("dev")))
        return {"dev": F.when(head, t == "devDependencies:").otherwise(s["dev"]), "out": F.when(hit, F.concat(s["out"], row)).otherwise(s["out"])}

    return fold(T.lines(x), {"dev": F.lit(False), "out": F.array().cast("array<struct<name:string,version:string,dev:boolean>>")}, step, lambda s: s["out"])


def outdated(x: Column | str) -> Column:
    """(name, current, latest, wanted, dev) of a JSON object by package name, sorted by name."""
    m = F.from_json(T.c(x), "map<string,struct<current:string,latest:string,wanted:string,dependencyType:string>>")
    rows = F.transform(F.map_entries(m), lambda e: F.struct(
        e["key"].alias("name"), e["value"]["current"].alias("current"), e["value"]["latest"].alias("latest"), e["value"]["wanted"].alias("wanted"), (F.coalesce(e["value"]["dependencyType"], F.lit("")) == "devDependencies").alias("dev")))
    return F.array_sort(rows)


def listing(rows: Column, cap: int | None = LIST) -> Column:
    """Packages (name, version, dev) by section, each capped."""
    line = lambda p: text("\n  ", p["name"], " ", p["version"])

    def section(label: str, group: Column) -> Column:
        shown = group if cap is None else F.slice(group, 1, cap)
        rest = more(F.size(group), cap, "more", "\n  … +") if cap is not None else F.lit("")
        return F.when(F.size(group) > 0, text(f"\n[{label}]", F.array_join(F.transform(shown, line), ""), rest)).otherwise("")

    prod, dev = F.filter(rows, lambda p: ~p["dev"]), F.filter(rows, lambda p: p["dev"])
    return text(F.size(rows), " packages (", F.size(prod), " prod / ", F.size(dev), " dev)", section("prod", prod), section("dev", dev))


def install_report(x: Column | str) -> Column:
    """Errors and the summary of an installation; ``ok`` where there is neither."""
    rows = F.filter(T.lines(x), lambda s: ~has(s, "Progress", "│", "%"))
    shown = F.array_compact(F.transform(rows, lambda s: F.when(has(s, "ERR", "error", "ERROR"), s).when(has(s, "packages in", "dependencies") | begins(s, "+", "-"), T.utrim(s))))
    return F.when(F.size(shown) == 0, "ok").otherwise(F.array_join(shown, "\n"))


def script_report(x: Column | str) -> Column:
    """Output of a script without banners, warnings of the package manager, progress and blank lines; ``ok`` where nothing is left."""
    drop = lambda s: (s.startswith(">") & s.contains("@")) | begins(F.regexp_replace(s, r"^[ \t]+", ""), "npm WARN", "npm notice") | has(s, "⸩", "⸨") | (s.contains("...") & (F.octet_length(s) < 10)) | T.is_blank(s)
    rows = F.filter(T.lines(x), lambda s: ~drop(s))
    return F.when(F.size(rows) == 0, "ok").otherwise(F.array_join(rows, "\n"))


_SUITE = "'title string, file string, specs array<struct<title:string,ok:boolean,tests:array<struct<status:string,results:array<struct<status:string,errors:array<struct<message:string>>>>>>>>, suites array<string>'"


def nested_suites(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, file, title, ok, message): specs of nested suites; a failed one carries the first error of its first unexpected test."""
    rows = _recursive(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), f"""
        WITH RECURSIVE t(id, s, depth) AS (
          SELECT id, from_json(node, {_SUITE}), 0 FROM (SELECT id, explode(from_json(text, 'suites array<string>').suites) AS node FROM {{docs}})
          UNION ALL
          SELECT id, from_json(node, {_SUITE}), depth + 1 FROM (SELECT id, depth, explode(s.suites) AS node FROM t))
        SELECT id, coalesce(s.file, s.title) AS file, explode(s.specs) AS spec FROM t""")
    test = F.try_element_at(F.filter("spec.tests", lambda t: t["status"] == "unexpected"), F.lit(1))
    attempt = F.try_element_at(F.filter(test["results"], lambda r: r["status"].isin("failed", "timedOut")), F.lit(1))
    message = F.coalesce(F.try_element_at(attempt["errors"], F.lit(1))["message"], F.lit("Test failed"))
    ok = F.coalesce(F.col("spec.ok"), F.lit(False))
    return rows.select("id", "file", F.col("spec.title").alias("title"), ok.alias("ok"), F.when(~ok, message).alias("message"))


def text_suites(x: Column | str) -> Column:
    """(passed, failed, skipped, failures) of a plain report, where there is no JSON."""
    clean = T.strip_ansi(x)
    n = lambda w: F.coalesce(F.try_element_at(F.regexp_extract_all(clean, F.lit(rf"(\d+)\s+{w}"), F.lit(1)), F.lit(-1)).cast("int"), F.lit(0))
    return F.struct(n("passed").alias("passed"), n("failed").alias("failed"), n("skipped").alias("skipped"), F.regexp_extract_all(clean, F.lit(r"[×✗]\s+.*?›\s+([^›]+\.spec\.[tj]sx?)"), F.lit(1)).alias("failures"))


