"""Text output of the .NET tools: builds, tests, restores and formatting, as structs and as short text.

Issues are told apart by code, place and message; the first of equals stays. Values of variables that may be secret are masked first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .scan import bound, begins, fold, more, none, number, text

#: Variables whose values are masked.
SENSITIVE = (
    "PATH", "HOME", "USERPROFILE", "USERNAME", "USER", "APPDATA", "LOCALAPPDATA", "TEMP", "TMP", "SSH_AUTH_SOCK", "SSH_AGENT_LAUNCHER", "GH_TOKEN", "GITHUB_TOKEN", "GITHUB_PAT", "NUGET_API_KEY",
    "NUGET_AUTH_TOKEN", "VSS_NUGET_EXTERNAL_FEED_ENDPOINTS", "AZURE_DEVOPS_TOKEN", "AZURE_CLIENT_SECRET", "AZURE_TENANT_ID", "AZURE_CLIENT_ID", "AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY",
    "AWS_SESSION_TOKEN", "API_TOKEN", "AUTH_TOKEN", "ACCESS_TOKEN", "BEARER_TOKEN", "PASSWORD", "CONNECTION_STRING", "DATABASE_URL", "DOCKER_CONFIG", "KUBECONFIG",
)
#: Lines of a build, a test run and a restore.
ISSUE = r"(?m)^\s*([^\r\n:(]+)\((\d+),(\d+)\):\s*(error|warning)\s*(?:([A-Za-z]+\d+)\s*:\s*)?(.*)$"
SUMMARY = r"(?mi)^\s*(\d+)\s+{}\(s\)"
COUNT = r"(?i)\b(\d+)\s+{}\(s\)"
ISSUE_LINE = r"(?mi)^.+\(\d+,\d+\):\s*{}(?:\s+[A-Za-z]{{2,}}\d{{3,}})?(?:\s*:.*)?$"
ELAPSED = r"(?m)^\s*Time Elapsed\s+([^\r\n]+)$"
RESULT = r"(?:Passed!|Failed!)\s*-\s*Failed:\s*(\d+),\s*Passed:\s*(\d+),\s*Skipped:\s*(\d+),\s*Total:\s*(\d+),\s*Duration:\s*([^\r\n-]+)"
TEST_SUMMARY = r"(?mi)^\s*Test summary:\s*total:\s*(\d+),\s*failed:\s*(\d+),\s*(?:succeeded|passed):\s*(\d+),\s*skipped:\s*(\d+),\s*duration:\s*([^\r\n]+)$"
FAILED = r"^\s*Failed\s+([^\r\n\[]+)\s+\[[^\]\r\n]+\]\s*$"
RESTORED = r"(?m)^\s*Restored\s+.+\.csproj\s*\("
RESTORE_ISSUE = r"(?mi)^\s*(?:(.+?)\s+:\s+)?(warning|error)\s+([A-Za-z]{2,}\d{3,})\s*:\s*(.+)$"
PROJECT = r"(?m)^\s*([A-Za-z]:)?[^\r\n]*\.csproj(?:\s|$)"
_ISSUE_TYPE = "array<struct<code:string,file:string,line:int,col:int,message:string>>"


def masked(x: Column | str) -> Column:
    """Without the values of sensitive variables."""
    return F.regexp_replace(T.c(x), r"(\b(?:" + "|".join(map(re.escape, SENSITIVE)) + r")\s*(?:=|:)\s*)([^\s;]+)", "$1[REDACTED]")


def clean(x: Column | str) -> Column:
    return masked(T.strip_ansi(F.regexp_replace(T.c(x), r"\r\n", "\n")))


def _all(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(group))


def projects(x: Column) -> Column:
    return F.size(_all(x, PROJECT))


def largest(x: Column, pattern: str) -> Column:
    """The largest number that a pattern captures; 0 where none."""
    return F.coalesce(F.array_max(F.transform(_all(x, pattern, 1), lambda n: n.try_cast("int"))), F.lit(0))


def _issue(code: Column, file: Column, line: Column, col: Column, message: Column) -> Column:
    return F.struct(code.alias("code"), file.alias("file"), line.cast("int").alias("line"), col.cast("int").alias("col"), message.alias("message"))


def issues(x: Column, kind: str) -> Column:
    g = lambda m, k: F.regexp_extract(m, ISSUE, k)
    found = F.transform(F.filter(_all(x, ISSUE), lambda m: g(m, 4) == kind), lambda m: _issue(g(m, 5), g(m, 1), g(m, 2), g(m, 3), F.when(T.is_blank(g(m, 6)), "diagnostic without message").otherwise(T.utrim(g(m, 6)))))
    return F.array_distinct(found)


def restore_issues(x: Column, kind: str) -> Column:
    g = lambda m, k: T.utrim(F.regexp_extract(m, RESTORE_ISSUE, k))
    return F.array_distinct(F.transform(F.filter(_all(x, RESTORE_ISSUE), lambda m: F.lower(g(m, 2)) == kind), lambda m: _issue(g(m, 3), g(m, 1), F.lit(0), F.lit(0), g(m, 4))))


def _counted(n: Column, kind: str) -> Column:
    made = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _issue(F.lit(""), F.lit(""), F.lit(0), F.lit(0), text(f"Build {kind} #", i, " (details omitted)")))
    return F.when(n > 0, made).otherwise(F.array().cast(_ISSUE_TYPE))


_CODE = r"^[A-Za-z]{2,}\d{3,}\z"


def best_of(first: Column, other: Column) -> Column:
    """The first list unless it is empty; where both are there, the one that tells more: a file that is no code, code, line, column and message count.

    A first list of nothing but codes that stand where the file belongs gives way to any list with a real file.
    """
    placed = lambda i: (i["file"] != "") & ~i["file"].rlike(_CODE)
    points = lambda i: F.when(placed(i), 4).otherwise(0) + F.when(i["code"].rlike(_CODE), 2).otherwise(0) + (i["line"] > 0).cast("int") + (i["col"] > 0).cast("int") + (~i["message"].isin("", "Build issue")).cast("int")
    score = lambda a: F.aggregate(a, F.lit(0), lambda s, i: s + points(i))
    misread = F.forall(first, lambda i: (i["code"] == "") & i["file"].rlike(_CODE)) & F.exists(other, placed)
    return F.when(F.size(first) == 0, other).when(F.size(other) == 0, first).when(misread | (score(other) > score(first)), other).otherwise(first)


def _listed(x: Column, kind: str) -> Column:
    """Issues as they are written, else as many as a count says, else as many as there are lines of the kind, else those of a restore."""
    told = lambda: F.greatest(largest(x, SUMMARY.format(kind)), largest(x, COUNT.format(kind)))
    options = [lambda: bound(told(), lambda n: _counted(n, kind)), lambda: bound(F.size(_all(x, ISSUE_LINE.format(kind))), lambda n: _counted(n, kind)), lambda: restore_issues(x, kind)]
    pick = lambda o, rest: bound(o, lambda v: F.when(F.size(v) > 0, v).otherwise(pick(rest[0](), rest[1:]))) if rest else o
    return pick(issues(x, kind), options)


def elapsed(x: Column) -> Column:
    return F.nullif(T.utrim(F.regexp_extract(x, ELAPSED, 1)), F.lit(""))


def build(raw: Column | str) -> Column:
    """(succeeded, projects, errors, warnings, duration)."""

    def told(x: Column) -> Column:
        seen = x.contains("Build succeeded") | x.contains("Build FAILED") | x.contains(" -> ")
        return F.struct(
            (x.contains("Build succeeded") & ~x.contains("Build FAILED")).alias("succeeded"), bound(projects(x), lambda n: F.when((n == 0) & seen, 1).otherwise(n)).alias("projects"), _listed(x, "error").alias("errors"), _listed(x, "warning").alias("warnings"),
            elapsed(x).alias("duration"))

    return bound(clean(raw), told)


def merged(first: Column, other: Column) -> Column:
    """Of two build structs the first, filled up from the other."""
    either = lambda k, empty: F.when(empty(first[k]), other[k]).otherwise(first[k]).alias(k)
    return F.struct(first["succeeded"].alias("succeeded"), either("projects", lambda c: c == 0), either("errors", lambda c: F.size(c) == 0), either("warnings", lambda c: F.size(c) == 0), F.coalesce(first["duration"], other["duration"]).alias("duration"))


def shown(i: Column, kind: str) -> Column:
    message = T.ellipsis(i["message"], 180)
    at = text("  ", i["file"], "(", i["line"], ",", i["col"], f") {kind}")
    return F.when(i["file"] == "", text(f"  {kind} ", message)).when(i["code"] == "", text(at, ": ", message)).otherwise(text(at, " ", i["code"], ": ", message))


def _section(a: Column, kind: str, cap: int) -> Column:
    rows = F.array_join(F.transform(F.slice(a, 1, cap), lambda i: F.concat(shown(i, kind), F.lit("\n"))), "")
    return F.when(F.size(a) > 0, text(f"{kind.capitalize()}s:\n", rows, more(F.size(a), cap, f"more {kind}s\n", "  … +")))


def _parts(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def build_report(raw: Column | str) -> Column:
    return bound(build(raw), _build_told)


def _build_told(b: Column) -> Column:
    verdict = text(F.when(b["succeeded"], "ok").otherwise("fail"), " dotnet build: ", b["projects"], " projects, ", F.size(b["errors"]), " errors, ", F.size(b["warnings"]), " warnings (", F.coalesce(b["duration"], F.lit("unknown")), ")")
    return _parts(_section(b["warnings"], "warning", 10), _section(b["errors"], "error", 20), verdict)


def tests(raw: Column | str) -> Column:
    """(passed, failed, skipped, total, projects, duration, failures): counts of all result lines, or of the last summary; failures with up to 20 lines each."""
    x = clean(raw)
    results = _all(x, RESULT)
    sums = lambda k: F.aggregate(F.transform(results, lambda m: number(m, RESULT, k)), F.lit(0), lambda a, b: a + b)
    final = F.try_element_at(_all(x, TEST_SUMMARY), F.lit(-1))
    of = lambda k, plain: F.when(final.isNotNull(), number(final, TEST_SUMMARY, k)).otherwise(plain)
    last_result = F.nullif(T.utrim(F.regexp_extract(F.try_element_at(results, F.lit(-1)), RESULT, 5)), F.lit(""))
    duration = F.coalesce(F.nullif(T.utrim(F.regexp_extract(final, TEST_SUMMARY, 5)), F.lit("")), elapsed(x), last_result)
    kind = "array<struct<name:string,details:array<string>>>"
    closed = lambda s: F.when(s["name"].isNotNull(), F.concat(s["out"], F.array(F.struct(s["name"].alias("name"), s["rows"].alias("details"))))).otherwise(s["out"])

    def step(s: Column, line: Column) -> dict[str, Column]:
        head, t = line.rlike(FAILED), T.utrim(line)
        ends = begins(F.regexp_replace(line, r"^[ \t]+", ""), "Failed!  -", "Passed!  -", "Test summary:", "Build ")
        full = F.size(s["rows"]) >= 20
        row = F.when(t != "", F.array(t)).when(F.size(s["rows"]) > 0, F.array(F.lit(""))).otherwise(none())
        return {
            "out": F.when(head | ends, closed(s)).otherwise(s["out"]), "name": F.when(head, T.utrim(F.regexp_extract(line, FAILED, 1))).when(ends, F.lit(None)).otherwise(s["name"]),
            "rows": F.when(head | ends, none()).when(s["name"].isNull() | full, s["rows"]).otherwise(F.concat(s["rows"], row)),
        }

    failures = fold(T.lines(x), {"out": F.array().cast(kind), "name": F.lit(None).cast("string"), "rows": none()}, step, closed)
    passed, skipped = of(3, sums(2)), of(4, sums(3))
    failed0, total0 = of(2, sums(1)), of(1, sums(4))
    failed = F.when(failed0 == 0, F.size(failures)).otherwise(failed0)
    return F.struct(
        passed.alias("passed"), failed.alias("failed"), skipped.alias("skipped"), F.when(total0 == 0, passed + failed + skipped).otherwise(total0).alias("total"), F.greatest(projects(x), F.lit(1)).alias("projects"),
        duration.alias("duration"), failures.alias("failures"))


def with_results(first: Column, results: Column) -> Column:
    """A test struct with what result files tell (same fields): their counts if they hold as many tests, failures where there are none, duration, more projects."""
    counts = (results["total"] > 0) & ((first["total"] == 0) | (results["total"] >= first["total"]))
    pick = lambda k: F.when(counts, results[k]).otherwise(first[k]).alias(k)
    return F.struct(
        pick("passed"), pick("failed"), pick("skipped"), pick("total"), F.greatest(first["projects"], results["projects"]).alias("projects"), F.coalesce(results["duration"], first["duration"]).alias("duration"),
        F.when(F.size(first["failures"]) == 0, results["failures"]).otherwise(first["failures"]).alias("failures"))


def test_report(raw: Column | str) -> Column:
    t, x = tests(raw), clean(raw)
    errors, warnings = _listed(x, "error"), _listed(x, "warning")
    bad = t["failed"] > 0
    time = F.coalesce(t["duration"], F.lit("unknown"))
    nothing = (t["passed"] == 0) & (t["failed"] == 0) & (t["skipped"] == 0) & (t["total"] == 0)
    where = text(F.size(warnings), " warnings in ", t["projects"], " projects (", time, ")")
    head = (
        F.when(nothing, text("ok dotnet test: completed (binlog-only mode, counts unavailable, ", F.size(warnings), " warnings) (", time, ")"))
        .when(bad, text("fail dotnet test: ", t["passed"], " passed, ", t["failed"], " failed, ", t["skipped"], " skipped, ", where)).otherwise(text("ok dotnet test: ", t["passed"], " tests passed, ", where))
    )
    one = lambda f: text("  ", f["name"], "\n", F.array_join(F.transform(f["details"], lambda d: text("    ", T.ellipsis(d, 320), "\n")), ""), "\n")
    failed = F.when(F.size(t["failures"]) > 0, text("Failed Tests:\n", F.array_join(F.transform(F.slice(t["failures"], 1, 10), one), ""), more(F.size(t["failures"]), 10, "more failed tests\n")))
    return _parts(failed, _section(warnings, "warning", 10), _section(errors, "error", 10), head)


def restore_report(raw: Column | str) -> Column:
    x = clean(raw)
    errors, warnings = restore_issues(x, "error"), restore_issues(x, "warning")
    verdict = text(F.when(F.size(errors) > 0, "fail").otherwise("ok"), " dotnet restore: ", F.size(_all(x, RESTORED)), " projects, ", F.size(errors), " errors, ", F.size(warnings), " warnings (", F.coalesce(elapsed(x), F.lit("unknown")), ")")
    return _parts(_section(warnings, "warning", 10), _section(errors, "error", 20), verdict)


FORMAT = "array<struct<FilePath:string,FileChanges:array<struct<LineNumber:int,CharNumber:int,DiagnosticId:string,FormatDescription:string>>>>"


def format_report(raw: Column | str, check: bool = True) -> Column:
    """Files to format with their first change, from the JSON report of a formatting run."""
    a = F.from_json(T.c(raw), FORMAT)
    changed = F.filter(a, lambda f: F.size(f["FileChanges"]) > 0)
    same = F.size(a) - F.size(changed)
    if not check:
        wrote = text("ok dotnet format: formatted ", F.size(changed), " files (", same, " already formatted)")
    else:
        line = lambda f, i: text("\n", i + 1, ". ", f["FilePath"], " (line ", f["FileChanges"][0]["LineNumber"], ", col ", f["FileChanges"][0]["CharNumber"], ", ", F.coalesce(F.nullif(f["FileChanges"][0]["DiagnosticId"], F.lit("")), f["FileChanges"][0]["FormatDescription"]), ")")
        wrote = text(
            "Format: ", F.size(changed), " files need formatting", F.array_join(F.transform(F.slice(changed, 1, 20), line), ""), more(F.size(changed), 20, "more files", "\n… +"), "\n\nok ", same,
            " files already formatted\nRun `dotnet format` to apply fixes")
    return F.when(F.size(changed) == 0, text("ok dotnet format: ", F.size(a), " files formatted correctly")).otherwise(wrote)


def span(start: Column | str, finish: Column | str) -> Column:
    """Between two times: ``1.5 s`` or ``20 ms``; null where one can't be read or no time has passed."""
    t = lambda x: F.unix_millis(F.try_to_timestamp(T.c(x)))
    ms = t(finish) - t(start)
    return F.when(ms >= 1000, F.concat(T.tenths(ms, 1000), F.lit(" s"))).when(ms > 0, text(ms, " ms"))


def ticks(n: Column | str) -> Column:
    """Ten-millionths of a second as hours, minutes, seconds and hundredths."""
    n = T.c(n).cast("long")
    s = F.floor(n / 10_000_000)
    return F.format_string("%02d:%02d:%02d.%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60, F.floor(F.pmod(n, F.lit(10_000_000)) / 100_000))
