"""Reports of linters, type checkers and test runners with JSON, one output to one text: rules by how often they were broken, files by their issues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .diagnostics import SEVERITY
from .runners import cargo_build
from .scan import begins, fold, has, kept, listed, more, none, number, text, total
from .tools import tool_path

# Caps, and the patterns of a mypy line, a tsc line and a result line of cargo test
LIST, SHORT = 20, 10
_MYPY = r"^(.+?):(\d+)(?::\d+)?: (error|warning|note): (.+?)(?:\s+\[(.+)\])?$"
_TSC = r"^(.+?)\((\d+),(\d+)\):\s+(error|warning)\s+(TS\d+):\s+(.+)$"
_RESULT = r"test result: (\w+)\.\s+(\d+) passed;\s+(\d+) failed;\s+(\d+) ignored;\s+(\d+) measured;\s+(\d+) filtered out(?:;\s+finished in ([\d.]+)s)?"


def counts(keys: Column) -> Column:
    """(n, key) for each key, n below zero, the most frequent first, then by key."""
    return F.array_sort(F.transform(F.array_distinct(keys), lambda k: F.struct((-F.size(F.filter(keys, lambda x: x == k))).alias("n"), k.alias("key"))))


def top_rules(keys: Column, label: str, cap: int = SHORT) -> Column:
    c = counts(keys)
    return F.when(F.size(c) > 0, text(f"{label}:\n", F.array_join(F.transform(F.slice(c, 1, cap), lambda r: text("  ", r["key"], " (", -r["n"], "x)\n")), ""), "\n")).otherwise("")


def top_files(rows: Column, tool: str, mark: str = "… +", detail: Callable[[Column, Column], Column] | None = None) -> Column:
    """rows: (file, code, ...). The files with most issues, each with its three most frequent codes."""
    files = counts(F.transform(rows, lambda r: r["file"]))

    def one(f: Column) -> Column:
        own = F.filter(rows, lambda r: r["file"] == f["key"])
        codes = F.slice(counts(F.array_compact(F.transform(own, lambda r: r["code"]))), 1, 3)
        line = lambda c: text("    ", c["key"], " (", -c["n"], ")\n", detail(own, c["key"]) if detail else F.lit(""))
        return text("  ", tool_path(f["key"], tool), " (", -f["n"], " issues)\n", F.array_join(F.transform(codes, line), ""))

    return text("Top files:\n", F.array_join(F.transform(F.slice(files, 1, SHORT), one), ""), more(F.size(files), SHORT, "more files\n", f"\n{mark}"))


def _files(rows: Column) -> Column:
    return F.size(F.array_distinct(F.transform(rows, lambda r: r["file"])))


def ruff_report(x: Column | str) -> Column:
    a = F.from_json(T.utrim(x), "array<struct<code:string,message:string,location:struct<row:int,column:int>,filename:string,fix:struct<applicability:string>>>")
    rows = F.transform(a, lambda d: F.struct(d["filename"].alias("file"), d["code"].alias("code")))
    fixable = total(a, lambda d: d["fix"].isNotNull())
    line = lambda d: text("  ", tool_path(d["filename"], "ruff"), ":", d["location"]["row"], ":", d["location"]["column"], " ", d["code"], " ", T.ellipsis(T.utrim(d["message"]), 100), "\n")
    out = text(
        "Ruff: ", F.size(a), " issues in ", _files(rows), " files", F.when(fixable > 0, text(" (", fixable, " fixable)")).otherwise(""), "\n", top_rules(F.transform(rows, lambda r: r["code"]), "Top rules"),
        top_files(rows, "ruff", "... +"), "\nViolations:\n", F.array_join(F.transform(F.slice(a, 1, 50), line), ""), more(F.size(a), 50, "more\n", "  … +"),
        F.when(fixable > 0, text("\n[hint] Run `ruff check --fix` to auto-fix ", fixable, " issues")).otherwise(""))
    return F.when(F.size(a) == 0, "Ruff: No issues found").otherwise(T.utrim(out))


def eslint_report(x: Column | str) -> Column:
    a = F.from_json(T.utrim(x), "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int>>,errorCount:int,warningCount:int>>")
    n = lambda k: F.aggregate(a, F.lit(0), lambda s, f: s + F.coalesce(f[k], F.lit(0)))
    some = F.filter(a, lambda f: F.size(f["messages"]) > 0)
    rows = F.flatten(F.transform(some, lambda f: F.transform(f["messages"], lambda m: F.struct(f["filePath"].alias("file"), m["ruleId"].alias("code")))))
    # files with as many messages stay in the order in which they came
    order = F.array_sort(F.transform(some, lambda f, i: F.struct((-F.size(f["messages"])).alias("n"), i.alias("i"), f["filePath"].alias("key"))))

    def one(f: Column) -> Column:
        codes = F.slice(counts(F.array_compact(F.transform(F.filter(rows, lambda r: r["file"] == f["key"]), lambda r: r["code"]))), 1, 3)
        return text("  ", tool_path(f["key"], "lint"), " (", -f["n"], " issues)\n", F.array_join(F.transform(codes, lambda c: text("    ", c["key"], " (", -c["n"], ")\n")), ""))

    files = text("Top files:\n", F.array_join(F.transform(F.slice(order, 1, SHORT), one), ""), more(F.size(order), SHORT, "more files\n", "\n… +"))
    out = text("ESLint: ", n("errorCount"), " errors, ", n("warningCount"), " warnings in ", F.size(some), " files\n", top_rules(F.array_compact(F.transform(rows, lambda r: r["code"])), "Top rules"), files)
    return F.when((n("errorCount") == 0) & (n("warningCount") == 0), "ESLint: No issues found").otherwise(T.utrim(out))


def pylint_report(x: Column | str) -> Column:
    a = F.from_json(T.utrim(x), "array<struct<type:string,path:string,symbol:string,`message-id`:string>>")
    rows = F.transform(a, lambda d: F.struct(d["path"].alias("file"), text(d["symbol"], " (", F.coalesce(d["message-id"], F.lit("")), ")").alias("code")))
    n = lambda k: total(a, lambda d: d["type"] == k)
    rest = F.when((n("convention") > 0) | (n("refactor") > 0), text(", ", n("convention"), " conventions, ", n("refactor"), " refactors")).otherwise("")
    kinds = F.when((n("error") > 0) | (n("warning") > 0), text("  ", n("error"), " errors, ", n("warning"), " warnings", rest, "\n")).otherwise("")
    out = text("Pylint: ", F.size(a), " issues in ", _files(rows), " files\n", kinds, top_rules(F.transform(rows, lambda r: r["code"]), "Top rules"), top_files(rows, "lint"))
    return F.when(F.size(a) == 0, "Pylint: No issues found").otherwise(T.utrim(out))


def golangci_report(x: Column | str, version: int = 1) -> Column:
    """From version 2 on with the first source line of each linter in a file."""
    a = F.coalesce(F.from_json(T.utrim(x), "Issues array<struct<FromLinter:string,Pos:struct<Filename:string>,SourceLines:array<string>>>")["Issues"], F.array().cast("array<struct<FromLinter:string,Pos:struct<Filename:string>,SourceLines:array<string>>>"))
    rows = F.transform(a, lambda i: F.struct(i["Pos"]["Filename"].alias("file"), i["FromLinter"].alias("code"), i["SourceLines"].alias("lines")))

    def source(own: Column, linter: Column) -> Column:
        line = F.try_element_at(F.try_element_at(F.filter(own, lambda r: r["code"] == linter), F.lit(1))["lines"], F.lit(1))
        return F.when(line.isNotNull(), text("      → ", T.truncate(T.utrim(line), 80), "\n")).otherwise("")

    out = text("golangci-lint: ", F.size(a), " issues in ", _files(rows), " files\n", top_rules(F.transform(rows, lambda r: r["code"]), "Top linters"), top_files(rows, "golangci", "... +", source if version >= 2 else None))
    return F.when(F.size(a) == 0, "golangci-lint: No issues found").otherwise(T.utrim(out))


def _grouped(rows: Column, files: Column, line: Callable[[Column], Column]) -> Column:
    """Every row (file, ...) below its file; files: (n, ..., key) in order."""
    one = lambda f: text(f["key"], " (", -f["n"], " errors)\n", F.array_join(F.transform(F.filter(rows, lambda r: r["file"] == f["key"]), line), ""), "\n")
    return F.array_join(F.transform(files, one), "")


def _codes(c: Column) -> Column:
    return F.when(F.size(c) > 1, text("Top codes: ", F.array_join(F.transform(F.slice(c, 1, 5), lambda r: text(r["key"], " (", -r["n"], "x)")), ", "), "\n\n")).otherwise("")


_ERROR = "array<struct<file:string,line:string,code:string,message:string,context:array<string>>>"


def _with_context(s: Column, line: Column) -> Column:
    """The errors so far, the last with one more line of context."""
    end = F.element_at(s, -1)
    grown = F.struct(end["file"].alias("file"), end["line"].alias("line"), end["code"].alias("code"), end["message"].alias("message"), F.concat(end["context"], F.array(line)).alias("context"))
    return F.concat(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.array(grown))


def mypy_report(x: Column | str) -> Column:
    """Errors by file, most first, with their notes; lines without a file come first."""
    g = lambda s, k: F.regexp_extract(s, _MYPY, k)

    def step(s: Column, line: Column) -> dict[str, Column]:
        hit = line.rlike(_MYPY) & ~(line.startswith("Found ") & line.contains(" error")) & ~line.startswith("Success:")
        note = hit & (g(line, 3) == "note")
        own = note & (F.size(s["errors"]) > 0) & (F.try_element_at(s["errors"], F.lit(-1))["file"] == g(line, 1))
        error = F.struct(g(line, 1).alias("file"), g(line, 2).alias("line"), g(line, 5).alias("code"), g(line, 4).alias("message"), none().alias("context"))
        other = (note & ~own) | (~hit & line.contains("error:") & ~(line.startswith("Found ") & line.contains(" error")) & ~line.startswith("Success:"))
        return {"errors": F.when(own, _with_context(s["errors"], g(line, 4))).when(hit & ~note, F.concat(s["errors"], F.array(error))).otherwise(s["errors"]), "other": F.when(other, F.concat(s["other"], F.array(line))).otherwise(s["other"])}

    got = fold(F.split(T.strip_ansi(x), "\n", -1), {"errors": F.array().cast(_ERROR), "other": none()}, step)
    e = got["errors"]
    line = lambda r: text("  L", r["line"], ":", F.when(r["code"] != "", text(" [", r["code"], "]")).otherwise(""), " ", T.ellipsis(r["message"], 120), "\n", F.array_join(F.transform(r["context"], lambda c: text("    ", T.ellipsis(c, 120), "\n")), ""))
    codes = counts(F.filter(F.transform(e, lambda r: r["code"]), lambda c: c != ""))
    files = counts(F.transform(e, lambda r: r["file"]))
    head = text(F.array_join(F.transform(got["other"], lambda s: F.concat(s, F.lit("\n"))), ""), F.when((F.size(got["other"]) > 0) & (F.size(e) > 0), "\n").otherwise(""))
    body = F.when(F.size(e) > 0, text("mypy: ", F.size(e), " errors in ", F.size(files), " files\n", _codes(codes), _grouped(e, files, line))).otherwise("")
    return F.when((F.size(e) == 0) & (F.size(got["other"]) == 0), "mypy: No issues found").otherwise(T.utrim(F.concat(head, body)))


def tsc_report(x: Column | str) -> Column:
    """Errors by file, most first, then as they came, with the indented lines below them."""
    g = lambda s, k: F.regexp_extract(s, _TSC, k)

    def step(s: Column, line: Column) -> dict[str, Column]:
        hit = line.rlike(_TSC)
        more_ = ~hit & s["on"] & begins(line, "  ", "\t")
        error = F.struct(g(line, 1).alias("file"), g(line, 2).alias("line"), g(line, 5).alias("code"), g(line, 6).alias("message"), none().alias("context"))
        return {"errors": F.when(hit, F.concat(s["errors"], F.array(error))).when(more_, _with_context(s["errors"], T.utrim(line))).otherwise(s["errors"]), "on": hit | more_}

    e = fold(T.lines(x), {"errors": F.array().cast(_ERROR), "on": F.lit(False)}, step, lambda s: s["errors"])

    def first_seen(keys: Column) -> Column:
        return F.array_sort(F.transform(F.array_distinct(keys), lambda k, i: F.struct((-F.size(F.filter(keys, lambda v: v == k))).alias("n"), i.alias("i"), k.alias("key"))))

    line = lambda r: text("  L", r["line"], ": ", r["code"], " ", T.ellipsis(r["message"], 120), "\n", F.array_join(F.transform(r["context"], lambda c: text("    ", T.ellipsis(c, 120), "\n")), ""))
    files = first_seen(F.transform(e, lambda r: r["file"]))
    out = text("TypeScript: ", F.size(e), " errors in ", F.size(files), " files\n", _codes(first_seen(F.transform(e, lambda r: r["code"]))), _grouped(e, files, line))
    return F.when(F.size(e) > 0, T.utrim(out)).when(T.c(x).contains("Found 0 errors"), "TypeScript: No errors found").otherwise("TypeScript compilation completed")


def vet_report(x: Column | str) -> Column:
    a = F.filter(F.transform(F.split(T.c(x), "\n"), T.utrim), lambda s: (s != "") & ~s.startswith("#") & s.contains(".go:"))
    shown = listed(a, SHORT * 2, "more issues", lambda s, i: text(i + 1, ". ", T.ellipsis(s, 120)), lead="\n\n")
    return F.when(F.size(a) == 0, "Go vet: No issues found").otherwise(T.utrim(text("Go vet: ", F.size(a), " issues\n", shown)))


def rubocop_report(x: Column | str) -> Column:
    """Ten files by their worst severity, then path; five offenses of each by severity, then line."""
    kind = "files array<struct<path:string,offenses:array<struct<cop_name:string,severity:string,message:string,correctable:boolean,location:struct<start_line:int>>>>>, summary struct<offense_count:int,inspected_file_count:int,correctable_offense_count:int>"
    j = F.from_json(T.c(x), kind)
    rank = lambda s: F.coalesce(*[F.when(s.isin(*names), F.lit(i)) for i, names in enumerate(SEVERITY)], F.lit(len(SEVERITY)))
    own = lambda f: F.array_sort(F.transform(f["offenses"], lambda o, i: F.struct(rank(o["severity"]).alias("rank"), F.coalesce(o["location"]["start_line"], F.lit(0)).alias("line"), i.alias("i"), o["cop_name"].alias("cop"), o["message"].alias("message"))))
    files = F.array_sort(F.transform(F.filter(j["files"], lambda f: F.size(f["offenses"]) > 0), lambda f: F.struct(F.array_min(F.transform(f["offenses"], lambda o: rank(o["severity"]))).alias("worst"), f["path"].alias("path"), own(f).alias("own"))))
    line = lambda o: text("  :", o["line"], " ", o["cop"], " — ", F.split(o["message"], "\n")[0], "\n")
    one = lambda f: text("\n", tool_path(f["path"], "rubocop"), "\n", F.array_join(F.transform(F.slice(f["own"], 1, 5), line), ""), more(F.size(f["own"]), 5, "more\n", "  … +"))
    told = F.coalesce(j["summary"]["correctable_offense_count"], F.lit(0))
    counted = F.aggregate(j["files"], F.lit(0), lambda s, f: s + F.size(F.filter(f["offenses"], lambda o: F.coalesce(o["correctable"], F.lit(False)))))
    fix = F.when(told > 0, told).otherwise(counted)
    n, seen = F.coalesce(j["summary"]["offense_count"], F.lit(0)), F.coalesce(j["summary"]["inspected_file_count"], F.lit(0))
    out = text(
        "rubocop: ", n, " offenses (", seen, " files)\n", F.array_join(F.transform(F.slice(files, 1, SHORT), one), ""), more(F.size(files), SHORT, "more files\n", "\n… +"),
        F.when(fix > 0, text("\n(", fix, " correctable, run `rubocop -A`)")).otherwise(""))
    return F.when(T.is_blank(x), "RuboCop: No output").when(n == 0, text("ok ✓ rubocop (", seen, " files)")).otherwise(T.utrim(out))


def rspec_report(x: Column | str, cap: int = SHORT - 5) -> Column:
    kind = "examples array<struct<full_description:string,status:string,file_path:string,line_number:int,exception:struct<class:string,message:string,backtrace:array<string>>>>, summary struct<duration:double,example_count:int,failure_count:int,pending_count:int,errors_outside_of_examples_count:int>"
    j = F.from_json(T.c(x), kind)
    s = lambda k: F.coalesce(j["summary"][k], F.lit(0))
    time = F.format_string("%.2f", F.coalesce(j["summary"]["duration"], F.lit(0.0)))
    n, bad, waits, outside = s("example_count"), s("failure_count"), s("pending_count"), s("errors_outside_of_examples_count")
    pending = F.when(waits > 0, text(", ", waits, " pending")).otherwise("")
    failed = F.filter(j["examples"], lambda e: e["status"] == "failed")

    def one(e: Column, i: Column) -> Column:
        c = e["exception"]
        frame = F.try_element_at(F.filter(c["backtrace"], lambda b: ~has(b, "/gems/", "lib/rspec")), F.lit(1))
        why = F.when(c.isNotNull(), text("\n   ", F.substring_index(c["class"], "::", -1), ": ", T.ellipsis(F.split(c["message"], "\n")[0], 120), F.coalesce(text("\n   ", T.ellipsis(frame, 120)), F.lit("")))).otherwise("")
        return text(i + 1, ". ✗ ", e["full_description"], "\n   ", e["file_path"], ":", e["line_number"], why)

    shown = F.when(F.size(failed) > 0, text("\n\nFailures:\n", listed(failed, cap, "more failures", one, sep="\n\n", mark="... +", lead="\n\n"))).otherwise("")
    return (
        F.when((n == 0) & (outside == 0), "RSpec: No examples found").when(n == 0, text("RSpec: ", outside, " errors outside of examples (", time, "s)"))
        .when((bad == 0) & (outside == 0), text("✓ RSpec: ", F.greatest(n - waits, F.lit(0)), " passed", pending, " (", time, "s)"))
        .otherwise(text("RSpec: ", F.greatest(n - bad - waits, F.lit(0)), " passed, ", bad, " failed", pending, " (", time, "s)", shown))
    )



def cargo_test(x: Column | str) -> Column:
    """The sums of all result lines if all went well, else the failures and the result lines; else errors of compiling, else the last five lines."""
    lead = lambda s: F.regexp_replace(s, r"^[ \t]+", "")
    drop = lambda s: begins(lead(s), "Compiling", "Downloading", "Downloaded", "Finished") | s.startswith("running ") | (s.startswith("test ") & s.endswith("... ok"))
    a = F.filter(T.lines(x), lambda s: ~drop(s))
    results = F.filter(a, lambda s: s.startswith("test result:"))
    section = kept(a, {"on": F.lit(False)}, lambda s, line: (s["on"] & (line != "failures:") & ~line.startswith("test result:"), {"on": F.when(line == "failures:", True).when(line.startswith("test result:"), False).otherwise(s["on"])}))
    # blank lines end a failure; the section's lines make the rest
    fails = fold(section, {"done": none(), "cur": none()}, lambda s, line: {
        "done": F.when(T.is_blank(line) & (F.size(s["cur"]) > 0), F.concat(s["done"], F.array(F.array_join(s["cur"], "\n")))).otherwise(s["done"]), "cur": F.when(T.is_blank(line), none()).otherwise(F.concat(s["cur"], F.array(line)))},
        lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["done"], F.array(F.array_join(s["cur"], "\n")))).otherwise(s["done"]))
    fine = F.forall(results, lambda s: F.regexp_extract(s, _RESULT, 1) == "ok") & (F.size(results) > 0)
    n = lambda k: F.aggregate(results, F.lit(0), lambda t, s: t + number(s, _RESULT, k))
    timed = F.forall(results, lambda s: F.regexp_extract(s, _RESULT, 7) != "")
    seconds = F.aggregate(results, F.lit(0.0), lambda t, s: t + F.coalesce(F.regexp_extract(s, _RESULT, 7).try_cast("double"), F.lit(0.0)))
    some = lambda k, what: F.when(n(k) > 0, text(", ", n(k), f" {what}")).otherwise("")
    suites = F.when(F.size(results) == 1, "1 suite").otherwise(text(F.size(results), " suites"))
    compact = text("cargo test: ", n(2), " passed", some(4, "ignored"), some(6, "filtered out"), " (", suites, F.when(timed, text(", ", F.format_string("%.2f", seconds), "s")).otherwise(""), ")")
    shown = listed(fails, SHORT, "more failures\n", lambda f, i: text(i + 1, ". ", T.ellipsis(f, 200)), lead="\n\n")
    lines = F.array_join(results, "\n")
    whole = T.lines(x)
    broken = F.exists(whole, lambda s: begins(lead(s), "error[", "error:"))
    built = cargo_build(x)
    rest = F.filter(whole, lambda s: ~T.is_blank(s) & ~lead(s).startswith("Compiling"))
    tail = T.utrim(T.unlines(F.when(F.size(rest) > 5, F.slice(rest, -5, 5)).otherwise(rest)))
    return (
        F.when((F.size(fails) == 0) & fine, compact).when((F.size(fails) == 0) & (F.size(results) > 0), lines).when(F.size(fails) > 0, T.utrim(text("FAILURES (", F.size(fails), "):\n", shown, "\n\n", lines)))
        .when(broken & built.startswith("cargo build:"), F.regexp_replace(built, "^cargo build:", "cargo test:")).otherwise(tail)
    )


POD = "items array<struct<metadata:struct<namespace:string,name:string>,status:struct<phase:string,containerStatuses:array<struct<restartCount:bigint,state:struct<waiting:struct<reason:string>>>>>>>"


def pods_report(x: Column | str) -> Column:
    """Pods by phase, restarts, and those in trouble."""
    items = F.from_json(T.c(x), POD)["items"]
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)
    name = lambda p: text(dash(p["metadata"]["namespace"]), "/", dash(p["metadata"]["name"]))
    phase = lambda p: F.when(F.coalesce(p["status"]["phase"], F.lit("")) == "", "Unknown").otherwise(p["status"]["phase"])
    boxes = lambda p: F.coalesce(p["status"]["containerStatuses"], F.array().cast("array<struct<restartCount:bigint,state:struct<waiting:struct<reason:string>>>>"))
    restarts = F.aggregate(items, F.lit(0).cast("bigint"), lambda t, p: t + F.aggregate(boxes(p), F.lit(0).cast("bigint"), lambda u, b: u + F.coalesce(b["restartCount"], F.lit(0))))
    waits = lambda p: F.filter(F.transform(boxes(p), lambda b: F.coalesce(b["state"]["waiting"]["reason"], F.lit(""))), lambda r: has(r, "CrashLoop", "Error"))
    n = lambda *names: total(items, lambda p: phase(p).isin(*names))
    odd = lambda p: ~phase(p).isin("Running", "Pending", "Failed", "Error")
    trouble = F.flatten(F.transform(items, lambda p: F.when(phase(p).isin("Pending", "Failed", "Error"), F.array(text(name(p), " ", phase(p)))).when(odd(p), F.transform(waits(p), lambda r: text(name(p), " ", r))).otherwise(none())))
    failed = n("Failed", "Error") + F.aggregate(F.filter(items, odd), F.lit(0), lambda t, p: t + F.size(waits(p)))
    parts = F.array_compact(F.array(
        F.when(n("Running") > 0, n("Running").cast("string")), F.when(n("Pending") > 0, text(n("Pending"), " pending")), F.when(failed > 0, text(failed, " [x]")), F.when(restarts > 0, text(restarts, " restarts"))))
    issues = F.when(F.size(trouble) > 0, text("[warn] Issues:\n", F.array_join(F.transform(F.slice(trouble, 1, SHORT), lambda s: text("  ", s, "\n")), ""), more(F.size(trouble), SHORT, "more", "  … +"))).otherwise("")
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "No pods found\n").otherwise(text(F.size(items), " pods: ", F.array_join(parts, ", "), "\n", issues))
