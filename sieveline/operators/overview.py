"""What an output of unknown origin is about: its kind, and a short report for each kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .scan import begins, has, last, more, none, number, text, total
from .tools import summarize_json, summarize_list

KINDS = ("tests", "build", "logs", "json", "list", "generic")


def list_like(x: Column | str) -> Column:
    """Whether every line is short, has no tab and fewer than ten words."""
    words = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    return F.forall(T.lines(x), lambda s: (F.char_length(s) < 200) & ~s.contains("\t") & (words(s) < 10))


def kind(command: Column | str, x: Column | str) -> Column:
    """tests, build, logs, json, list or generic: by the command and words of the output, the first that fits."""
    cmd, raw = F.lower(T.c(command)), T.c(x)
    low = F.lower(raw)
    return (
        F.when(cmd.contains("test") | (low.contains("passed") & low.contains("failed")), "tests").when(has(cmd, "build", "compile") | low.contains("compiling"), "build")
        .when(has(low, "error:", "warn:", "[info]"), "logs").when(raw.rlike(r"^[ \t\r\n]*[{\[]"), "json").when(list_like(raw), "list").otherwise("generic")
    )


def tests(x: Column | str) -> Column:
    """Counts as the lines tell them (a line without a number counts one), and the first failures."""
    a = T.lines(x)
    low = F.lower
    good = F.filter(a, lambda s: has(low(s), "passed", "✓", "ok"))
    told = lambda s, w: F.nullif(F.regexp_extract(low(s), rf"(\d+)\s*{w}", 1), F.lit("")).cast("int")
    passed = F.aggregate(good, F.lit(0), lambda n, s: F.coalesce(told(s, "passed"), n + 1))
    bad = F.filter(a, lambda s: has(low(s), "fail", "[x]"))
    failed = F.aggregate(bad, F.lit(0), lambda n, s: F.coalesce(told(s, "failed"), n))
    skipped = F.aggregate(F.filter(a, lambda s: has(low(s), "skipped", "ignored")), F.lit(0), lambda n, s: F.coalesce(told(s, "skipped"), told(s, "ignored"), n))
    shown = F.filter(bad, lambda s: ~s.contains("0 failed"))
    return text(
        "Test Results:\n   [ok] ", passed, " passed", F.when(failed > 0, text("\n   [FAIL] ", failed, " failed")).otherwise(""), F.when(skipped > 0, text("\n   skip ", skipped, " skipped")).otherwise(""),
        F.when(F.size(shown) > 0, text("\n\n   Failures:", F.array_join(F.transform(F.slice(shown, 1, 5), lambda s: text("\n   • ", T.ellipsis(s, 70))), ""))).otherwise(""))


def build(x: Column | str) -> Column:
    a = T.lines(x)
    low = F.lower
    errors = F.filter(a, lambda s: low(s).contains("error") & ~low(s).contains("0 error"))
    warnings = total(a, lambda s: low(s).contains("warning") & ~low(s).contains("0 warning"))
    compiled = total(a, lambda s: has(low(s), "compiling", "compiled"))
    n = F.size(errors)
    return text(
        "Build Summary:", F.when(compiled > 0, text("\n   ", compiled, " crates/files compiled")).otherwise(""), F.when(n > 0, text("\n   [error] ", n, " errors")).otherwise(""),
        F.when(warnings > 0, text("\n   [warn] ", warnings, " warnings")).otherwise(""), F.when((n == 0) & (warnings == 0), "\n   [ok] Build successful").otherwise(""),
        F.when(n > 0, text("\n\n   Errors:", F.array_join(F.transform(F.slice(errors, 1, 5), lambda s: text("\n   • ", T.ellipsis(s, 70))), ""))).otherwise(""))


def logs(x: Column | str) -> Column:
    a = F.transform(T.lines(x), F.lower)
    level = F.transform(a, lambda s: F.when(has(s, "error", "fatal"), "error").when(s.contains("warn"), "warn").when(s.contains("info"), "info"))
    n = lambda k: total(level, lambda v: v.eqNullSafe(k))
    return text("Log Summary:\n   [error] ", n("error"), " errors\n   [warn] ", n("warn"), " warnings\n   [info] ", n("info"), " info")


def generic(x: Column | str) -> Column:
    """The first five lines, and of over ten the last three; blank ones aren't shown."""
    a = T.lines(x)
    shown = lambda rows: F.array_join(F.transform(F.filter(rows, lambda s: ~T.is_blank(s)), lambda s: text("\n   ", T.ellipsis(s, 75))), "")
    return text("Output:", shown(F.slice(a, 1, 5)), F.when(F.size(a) > 10, text("\n   ...", shown(F.slice(a, F.greatest(F.size(a) - 2, F.lit(1)), F.lit(3))))).otherwise(""))


def overview(command: Column | str, x: Column | str) -> Column:
    k = kind(command, x)
    made = {"tests": tests(x), "build": build(x), "logs": logs(x), "json": summarize_json(x), "list": summarize_list(x)}
    return F.coalesce(*[F.when(k == name, report) for name, report in made.items()], generic(x))


def runner_summary(x: Column | str, command: Column | str, failures: int = 10, lines: int = 20) -> Column:
    """Failures and summary lines of a test run, by the runner the command names; without a summary the last five lines."""
    a, cmd = T.lines(T.normalize_newlines(x)), T.c(command)
    cargo, pytest, go = cmd.contains("cargo test"), cmd.contains("pytest"), cmd.contains("go test")
    jest = has(cmd, "jest", "npm test", "yarn test")
    of = lambda test, rows: F.when(test, rows).otherwise(none())
    # a line may count for several runners, in this order
    each = lambda *picks: F.flatten(F.transform(a, lambda s: F.concat(*[F.when(test & hit(s), F.array(s)).otherwise(none()) for test, hit in picks])))
    result = each(
        (cargo, lambda s: s.contains("test result:")), (pytest, lambda s: has(s, " passed", " failed", " error")), (jest, lambda s: has(s, "Tests:", "Test Suites:")), (go, lambda s: begins(s, "ok", "FAIL", "---")))
    failed = each(
        (cargo, lambda s: s.contains("FAILED") & ~s.contains("test result")), (pytest, lambda s: s.contains("FAILED")), (jest, lambda s: has(s, "✕", "FAIL")), (go, lambda s: s.contains("FAIL")))
    start = F.array_position(F.transform(a, lambda s: s.startswith("failures:")), F.lit(True)).cast("int")
    details = of(cargo & (start > 0), F.filter(F.slice(a, F.greatest(start, F.lit(1)), F.size(a)), lambda s: s.startswith("    ")))
    rows = lambda b, form: F.array_join(F.transform(b, lambda s: text("  ", form(s), "\n")), "")
    head = F.when(F.size(failed) > 0, text(
        "[FAIL] FAILURES:\n", rows(F.slice(failed, 1, failures), lambda s: s), more(F.size(failed), failures, "more failures\n", "  ... +"), rows(F.slice(details, 1, lines), T.utrim), more(F.size(details), lines, "more\n", "  ... +"), "\n")).otherwise("")
    tail = F.filter(F.when(F.size(a) > 5, F.slice(a, -5, 5)).otherwise(a), lambda s: ~T.is_blank(s))
    return F.concat(head, F.when(F.size(result) > 0, text("SUMMARY:\n", rows(result, lambda s: s))).otherwise(text("OUTPUT (last 5 lines):\n", rows(tail, lambda s: s))))


def last_number(x: Column | str, word: str) -> Column:
    """The number before a word in the last line that has one; 0 where none."""
    pattern = rf"(\d+)\s*{word}"
    lines = F.filter(F.transform(T.lines(x), F.lower), lambda s: s.rlike(pattern))
    return F.coalesce(number(last(lines), pattern), F.lit(0))
