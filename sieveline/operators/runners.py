"""Reports of build tools and test runners: one output to one short text, as Column expressions.

Counts and failure blocks are what matters; progress goes. Caps: 20 errors, 10 failures, 20 items of a list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .scan import begins, blocks, bound, fold, has, kept, last, listed, more, none, number, text, total

ERRORS, FAILURES, LIST = 20, 10, 20
_lead = lambda x: F.regexp_replace(x, r"^[ \t]+", "")
_blank = T.is_blank


# cargo


def _cargo_noise(x: Column) -> Column:
    """Sums of warnings and errors at the end."""
    return (x.startswith("warning:") & x.contains("generated")) | (begins(x, "error:", "error[") & has(x, "aborting due to", "could not compile"))


def cargo_build(x: Column | str) -> Column:
    """Crates, errors and warnings, and the diagnostic blocks."""
    a = T.lines(x)
    crates = total(a, lambda s: begins(_lead(s), "Compiling", "Checking"))
    progress = lambda s: begins(_lead(s), "Compiling", "Checking", "Downloading", "Downloaded", "Finished") | _cargo_noise(s)
    is_error, is_warning = (lambda s: begins(s, "error[", "error:")), (lambda s: begins(s, "warning:", "warning["))
    errors, warnings = total(a, lambda s: is_error(s) & ~progress(s)), total(a, lambda s: is_warning(s) & ~progress(s))
    found = blocks(a, lambda s: is_error(s) | is_warning(s), lambda s, b: ~(_blank(s) & (F.size(b) > 3)), progress)
    finished = last(F.filter(F.transform(a, _lead), lambda s: s.startswith("Finished")))
    fine = text("cargo build (", crates, " crates compiled)", F.coalesce(F.concat(F.lit("\n"), finished), F.lit("")))
    bad = text("cargo build: ", errors, " errors, ", warnings, " warnings (", crates, " crates)\n", listed(found, ERRORS, "more issues", sep="\n\n", lead="\n\n\n"))
    return F.when((errors == 0) & (warnings == 0), fine).otherwise(T.utrim(bad))


def clippy_rule(line: Column, is_error: Column) -> Column:
    """The last bracketed code of a line, else its message."""
    inner = F.regexp_extract(line, r"\[([^\[]*)\][^\]]*$", 1)
    plain = F.when(is_error, F.regexp_replace(line, "^error: ", "")).otherwise(F.regexp_replace(line, "^warning: ", ""))
    return F.when(line.rlike(r"\[[^\[]*\][^\]]*$"), inner).when(line.contains("["), line).otherwise(plain)


def cargo_clippy(x: Column | str) -> Column:
    """Error blocks, then rules by how often they were broken, each with three places."""
    progress = lambda s: begins(_lead(s), "Compiling", "Checking", "Downloading", "Downloaded", "Finished")
    noise = lambda s: (s.contains("generated") & s.contains("warning")) | has(s, "aborting due to", "could not compile")
    is_error, is_warning = (lambda s: begins(s, "error:", "error[")), (lambda s: begins(s, "warning:", "warning["))
    closed = lambda s: F.when(F.size(s["block"]) > 0, F.concat(s["blocks"], F.array(F.array_join(s["block"], "\n")))).otherwise(s["blocks"])

    def see(s: Column, line: Column) -> Column:
        """What a line is: gone, noise, error, warning, place, blank or text."""
        return F.when(progress(line), "gone").when(noise(line), "noise").when(is_error(line), "error").when(is_warning(line), "warning").when(_lead(line).startswith("--> "), "place").when(_blank(line), "blank").otherwise("text")

    def step(s: Column, line: Column, kind: Column) -> dict[str, Column]:
        inside = F.size(s["block"]) > 0
        more_ = F.concat(s["block"], F.array(line))
        block = (
            F.when(kind.isin("gone", "warning"), none()).when(kind == "error", F.array(line)).when(inside & (kind == "blank"), none())
            .when(inside & ((kind == "place") | ((kind == "text") & (F.size(s["block"]) < 15))), more_).otherwise(s["block"])
        )
        at = F.when((kind == "place") & (s["rule"] != ""), F.concat(s["places"], F.array(F.struct(s["rule"].alias("rule"), F.regexp_replace(line, r"^[ \t]*--> ", "").alias("place"))))).otherwise(s["places"])
        return {
            "blocks": F.when(inside & kind.isin("gone", "error", "warning", "blank"), closed(s)).otherwise(s["blocks"]), "block": block, "places": at,
            "rule": F.when(kind.isin("error", "warning"), clippy_rule(line, kind == "error")).otherwise(s["rule"]),
            "errors": s["errors"] + F.when(kind == "error", 1).otherwise(0), "warnings": s["warnings"] + F.when(kind == "warning", 1).otherwise(0),
        }

    places = F.array().cast("array<struct<rule:string,place:string>>")
    start = {"blocks": none(), "block": none(), "places": places, "rule": F.lit(""), "errors": F.lit(0), "warnings": F.lit(0)}
    got = fold(T.lines(x), start, step, lambda s: F.struct(closed(s).alias("blocks"), s["places"].alias("places"), s["errors"].alias("errors"), s["warnings"].alias("warnings")), (see,))
    return bound(got, lambda g: bound(_by_rule(g["places"]), lambda rules: _clippy_told(g, rules)))


def _by_rule(places: Column) -> Column:
    """(n, i, rule, at) of rules, the most frequent first, then in order of their first place; n is negative. Places are sorted once, then gathered in one pass."""
    numbered = F.array_sort(F.transform(places, lambda p, i: F.struct(p["rule"].alias("rule"), i.alias("i"), p["place"].alias("place"))))
    kind = "array<struct<n:int,i:int,rule:string,at:array<string>>>"
    shut = lambda s: F.when(F.size(s["at"]) > 0, F.concat(s["out"], F.array(F.struct((-F.size(s["at"])).alias("n"), s["i"].alias("i"), s["rule"].alias("rule"), s["at"].alias("at"))))).otherwise(s["out"])

    def step(s: Column, p: Column) -> dict[str, Column]:
        same = (F.size(s["at"]) > 0) & (s["rule"] == p["rule"])
        one = F.array(p["place"])
        return {"rule": p["rule"], "i": F.when(same, s["i"]).otherwise(p["i"]), "at": F.when(same, F.concat(s["at"], one)).otherwise(one), "out": F.when(same, s["out"]).otherwise(shut(s))}

    return F.array_sort(fold(numbered, {"rule": F.lit(""), "i": F.lit(0), "at": none(), "out": F.array().cast(kind)}, step, shut))


def _clippy_told(g: Column, rules: Column) -> Column:
    in_error = lambda b: F.array_join(F.transform(F.split(b, "\n"), lambda line: text("  ", T.ellipsis(line, 160))), "\n")
    shown = F.when(F.size(g["blocks"]) > 0, text("\nErrors:\n", F.array_join(F.transform(F.slice(g["blocks"], 1, FAILURES), lambda b: F.concat(in_error(b), F.lit("\n\n"))), ""), more(F.size(g["blocks"]), FAILURES, "more errors\n", "  … +"))).otherwise("")
    line = lambda r: text("  ", r["rule"], " (", -r["n"], "x)\n", F.array_join(F.transform(F.slice(r["at"], 1, 3), lambda p: text("    ", p, "\n")), ""), more(-r["n"], 3, "more\n", "    … +"))
    by_rule = F.concat(F.array_join(F.transform(F.slice(rules, 1, LIST), line), ""), more(F.size(rules), LIST, "more rules\n", "\n… +"))
    return F.when((g["errors"] == 0) & (g["warnings"] == 0), "cargo clippy: No issues found").otherwise(T.utrim(text("cargo clippy: ", g["errors"], " errors, ", g["warnings"], " warnings\n", shown, by_rule)))


def cargo_install(x: Column | str) -> Column:
    """What was installed or replaced, or the error blocks."""
    a = T.lines(x)
    lead = F.transform(a, _lead)
    compiled = total(lead, lambda s: s.startswith("Compiling"))
    quiet = lambda s: begins(_lead(s), "Compiling", "Downloading", "Downloaded", "Locking", "Updating", "Adding", "Finished", "Blocking waiting for file lock", "Installing", "Installed", "Replacing", "Replaced", "Ignored package") | s.startswith("warning:") | _cargo_noise(s)
    is_error = lambda s: begins(s, "error[", "error:")
    errors = total(a, lambda s: is_error(s) & ~quiet(s))
    found = blocks(a, is_error, lambda s, b: ~(_blank(s) & (F.size(b) > 3)), quiet)
    rest = lambda word: F.filter(F.transform(F.filter(lead, lambda s: s.startswith(word)), lambda s: F.trim(F.substring(s, len(word) + 1, 1 << 30))), lambda s: s != "")
    going = F.filter(rest("Installing"), lambda s: ~s.startswith("/"))
    there = F.filter(rest("Installed"), lambda s: F.size(F.split(s, r"\s+")) >= 2)
    name = F.coalesce(F.regexp_extract(last(going), r"^([^ ]*)", 1), F.regexp_extract(F.try_element_at(there, F.lit(1)), r"^(\S+)", 1), F.lit(""))
    # a later "Installing" without a version leaves the version of an earlier one
    version = F.coalesce(F.regexp_extract(last(F.filter(going, lambda s: s.contains(" "))), r"^[^ ]* (.*)$", 1), F.when(F.size(going) == 0, F.regexp_extract(F.try_element_at(there, F.lit(1)), r"^\S+\s+(\S+)", 1)), F.lit(""))
    info = lambda other: F.when(name == "", other).when(version == "", name).otherwise(text(name, " ", version))
    ignored = last(F.filter(lead, lambda s: s.startswith("Ignored package")))
    ticked = F.try_element_at(F.split(ignored, "`"), F.lit(2))
    deps = F.when(compiled > 0, text(", ", compiled, " deps compiled")).otherwise("")
    head = text("cargo install: ", errors, F.when(errors > 1, " errors").otherwise(" error"), F.when(info("") == "", deps).otherwise(text(" (", info(""), deps, ")")))
    notes = F.filter(F.transform(a, lambda s: F.when(begins(_lead(s), "Replacing", "Replaced"), _lead(s)).when(s.startswith("warning:") & ~s.contains("generated"), s)), lambda s: s.isNotNull())
    fine = text("cargo install (", info("package"), ", ", compiled, " deps compiled)", F.array_join(F.transform(notes, lambda s: text("\n  ", s)), ""))
    bad = T.utrim(text(head, "\n", listed(found, ERRORS, "more issues", sep="\n\n", lead="\n\n\n")))
    return F.when(ignored.isNotNull(), text("cargo install: ", F.coalesce(ticked, ignored), " already installed")).when(errors > 0, bad).otherwise(fine)


#: Fixed value: the summary line of a run.
_NEXTEST = r"Summary \[\s*([\d.]+)s\]\s+(\d+) tests? run:\s+(\d+) passed(?:,\s+(\d+) failed)?(?:,\s+(\d+) skipped)?"


def cargo_nextest(x: Column | str) -> Column:
    """Failure blocks and the summary; passed tests go."""
    a = F.filter(T.lines(x), lambda s: ~begins(T.utrim(s), "Compiling", "Downloading", "Downloaded", "Finished", "Locking", "Updating", "────"))
    end = F.array_position(F.transform(a, lambda s: T.utrim(s).startswith("Summary")), F.lit(True)).cast("int")
    before = F.when(end > 0, F.slice(a, F.lit(1), F.when(end > 0, end - 1).otherwise(0))).otherwise(a)
    summary = F.when(end > 0, T.utrim(F.try_element_at(a, F.when(end > 0, end).otherwise(1)))).otherwise("")
    binaries = F.coalesce(last(F.filter(F.transform(before, lambda s: number(T.utrim(s), r"^Starting \d+ tests? across (\d+) binar(?:y|ies)")), lambda n: n > 0)), F.lit(0))
    silent = lambda s: begins(T.utrim(s), "Starting", "Cancelling", "Canceling", "Nextest run ID")
    fails = blocks(F.transform(before, lambda s: F.when(T.utrim(s).startswith("FAIL"), T.utrim(s)).otherwise(s)), lambda s: s.startswith("FAIL"), lambda s, b: ~T.utrim(s).startswith("PASS"), silent)
    n = lambda g: number(summary, _NEXTEST, g)
    which = F.when(binaries > 1, text(binaries, " binaries, ")).when(binaries == 1, "1 binary, ").otherwise("")
    meta = text(" (", which, F.regexp_extract(summary, _NEXTEST, 1), "s)")
    parts = text("cargo nextest: ", n(3), " passed", F.when(n(4) > 0, text(", ", n(4), " failed")).otherwise(""), F.when(n(5) > 0, text(", ", n(5), " skipped")).otherwise(""), meta)
    cancelled = F.exists(before, lambda s: begins(T.utrim(s), "Cancelling", "Canceling"))
    body = F.array_join(F.transform(fails, lambda f: F.concat(f, F.lit("\n"))), "")
    full = T.utrim(text(body, F.when(cancelled, "Cancelling due to test failure\n").otherwise(""), parts))
    known = summary.rlike(_NEXTEST)
    return F.when(known & (n(4) == 0), parts).when(known, full).when(F.size(fails) > 0, T.utrim(F.concat(body, summary))).otherwise(summary)


# go

#: How errors without a place in a file begin.
_GO_ERRORS = (
    "undefined: ", "cannot use ", "cannot find package ", "no required module provides package ", "missing go.sum entry for module providing package ", "found packages ",
    "go: go.mod file not found in current directory or any parent directory", "go: cannot load module ", "go: build failed", "go: error ", "error: ", "pattern ",
    "go: updates to go.mod needed", "go: inconsistent vendoring", "no go files in ",
)


def go_build_error(x: Column) -> Column:
    """Whether a line is a compiler or configuration error, rather than progress or a package header."""
    s = T.utrim(x)
    low = F.lower(s)
    progress = begins(low, "go: downloading ", "go: finding ", "go: extracting ") | s.startswith("#") | (s == "")
    config = ~low.startswith("go: ") & has(low, "go.mod:", "go.work:", "go.sum:")
    other = begins(low, *_GO_ERRORS) | has(low, "import cycle not allowed", "build constraints exclude all go files", "function main is undeclared in the main package")
    return ~progress & (s.contains(".go:") | config | other)


def go_build(x: Column | str, exit_code: Column | int = 0) -> Column:
    """Numbered errors; a failure without known errors shows what there is, and never reports success."""
    code = exit_code if isinstance(exit_code, Column) else F.lit(exit_code)
    a = F.transform(F.split(T.c(x), "\n", -1), T.utrim)
    numbered = lambda items, what: listed(items, ERRORS, what, lambda s, i: text(i + 1, ". ", T.ellipsis(s, 120)), lead="\n\n")
    errors, some = F.filter(a, go_build_error), F.filter(a, lambda s: s != "")
    failed = text("Go build: failed (exit ", code, ")")
    opaque = F.when(F.size(some) == 0, failed).otherwise(T.utrim(text(failed, "\n", "═" * 39, "\n", numbered(some, "more output lines"))))
    return F.when(F.size(errors) > 0, T.utrim(text("Go build: ", F.size(errors), " errors\n", numbered(errors, "more errors")))).when(code == 0, "Go build: Success").otherwise(opaque)


def go_failure_lines(a: Column) -> Column:
    """Of a failed test's output lines at most five: places, failure words, and the line after a place; else the first line."""
    quiet = lambda s: (s == "") | begins(s, "=== RUN", "--- FAIL", "--- PASS")
    place = lambda s: s.rlike(r"^(?:(?!\.go:).)*\.go:[0-9]")
    low = F.lower
    failure = lambda s: begins(low(s), "panic:", "error:") | has(low(s), " error:", "expected", "got", "want", "actual", "assert", "mismatch", "unexpected", "fatal") | s.startswith("at ")
    lines = F.transform(a, T.utrim)
    found = kept(lines, {"next": F.lit(False)}, lambda s, x: (~quiet(x) & (place(x) | failure(x) | s["next"]), {"next": ~quiet(x) & place(x)}))
    first = F.slice(F.filter(lines, lambda s: ~quiet(s)), 1, 1)
    return F.when(F.size(found) > 0, F.slice(found, 1, 5)).otherwise(first)


# pytest


def pytest_counts(summary: Column) -> Column:
    """Counters of a summary line, the last of each kind."""
    n = lambda word: F.coalesce(last(F.regexp_extract_all(summary, F.lit(rf"(?:^|[\s,])(\d+)\s+[^\s,]*?(?<![a-z]){word}"), F.lit(1))).cast("int"), F.lit(0))
    return F.struct(*[n(w).alias(w) for w in ("passed", "failed", "skipped", "xfailed", "xpassed")])


def pytest_sections(x: Column | str) -> Column:
    """(summary, failures, expected): what the sections of an output hold. Failures are blocks between rules, then the lines of the short summary."""
    start = {"at": F.lit("header"), "summary": F.lit(""), "failures": none(), "block": none(), "expected": none()}
    joined = lambda s: F.when(F.size(s["block"]) > 0, F.concat(s["failures"], F.array(F.array_join(s["block"], "\n")))).otherwise(s["failures"])

    def see(s: Column, line: Column) -> Column:
        t = T.utrim(line)
        rule = t.startswith("===")
        to = F.when(rule & t.contains("test session starts"), "header").when(rule & t.contains("FAILURES"), "failures").when(rule & t.contains("short test summary"), "summary")
        bare = (s["summary"] == "") & ~begins(t, "===", "FAILED", "ERROR") & has(t, " passed", " failed", " skipped") & t.contains(" in ")
        return F.struct(t.alias("t"), rule.alias("rule"), to.alias("to"), (to.isNull() & ((rule & has(t, "passed", "failed", "skipped")) | bare)).alias("summed"))

    def step(s: Column, line: Column, v: Column) -> dict[str, Column]:
        t, rule, to, summed = v["t"], v["rule"], v["to"], v["summed"]
        plain = to.isNull() & ~summed
        in_failures, in_summary = plain & (s["at"] == "failures"), plain & (s["at"] == "summary")
        opens = in_failures & t.startswith("___")
        block = F.when((to == "summary") & F.lit(True), none()).when(opens, F.array(t)).when(in_failures & (t != "") & ~rule, F.concat(s["block"], F.array(t))).otherwise(s["block"])
        failures = F.when((to == "summary") | opens, joined(s)).when(in_summary & begins(t, "FAILED", "ERROR"), F.concat(s["failures"], F.array(t))).otherwise(s["failures"])
        return {
            "at": F.coalesce(to, F.when(plain & (s["at"] == "header") & t.startswith("collected"), "progress"), s["at"]), "summary": F.when(summed, t).otherwise(s["summary"]),
            "block": F.coalesce(block, s["block"]), "failures": F.coalesce(failures, s["failures"]),
            "expected": F.when(in_summary & begins(t, "XFAIL", "XPASS"), F.concat(s["expected"], F.array(t))).otherwise(s["expected"]),
        }

    return fold(T.lines(x), start, step, lambda s: F.struct(s["summary"].alias("summary"), joined(s).alias("failures"), s["expected"].alias("expected")), (see,))


def _pytest_failure(block: Column, i: Column, n: Column) -> Column:
    rows = F.split(block, "\n")
    first = rows[0]
    relevant = F.slice(F.filter(F.slice(rows, F.lit(2), F.size(rows)), lambda s: begins(T.utrim(s), ">", "E") | has(F.lower(s), "assert", "error") | s.contains(".py:")), 1, 3)
    name = F.when(first.startswith("___"), T.utrim(F.regexp_replace(first, "^_+|_+$", "")))
    parts = F.split(first, " - ")
    short = text(i + 1, ". [FAIL] ", F.regexp_replace(parts[0], "^FAILED ", ""), "\n", F.when(F.size(parts) > 1, text("     ", T.ellipsis(F.try_element_at(parts, F.lit(2)), 100), "\n")).otherwise(""))
    shown = text(F.when(name.isNotNull(), text(i + 1, ". [FAIL] ", name, "\n")).otherwise(""), F.array_join(F.transform(relevant, lambda s: text("     ", T.ellipsis(s, 100), "\n")), ""), F.when(i < n - 1, "\n").otherwise(""))
    return F.when(first.startswith("FAILED"), short).otherwise(shown)


def pytest_report(x: Column | str) -> Column:
    """The counts, expected failures, and of each failure its name and three lines that matter."""
    return bound(pytest_sections(x), lambda got: bound(pytest_counts(got["summary"]), lambda k: _pytest_told(k, got["failures"], got["expected"])))


def _pytest_told(k: Column, fails: Column, expected: Column) -> Column:
    extra = lambda w: F.when(k[w] > 0, text(", ", k[w], f" {w}")).otherwise("")
    head = text("Pytest: ", k["passed"], " passed, ", k["failed"], " failed", extra("skipped"), extra("xfailed"), extra("xpassed"), "\n")
    known = F.when(F.size(expected) > 0, text("\nExpected-failure outcomes:\n", F.array_join(F.transform(F.slice(expected, 1, FAILURES), lambda s: text("  ", T.ellipsis(s, 120), "\n")), ""), more(F.size(expected), FAILURES, "more\n", "  … +"))).otherwise("")
    n = F.size(fails)
    shown = F.when(n > 0, text("\nFailures:\n", F.array_join(F.transform(F.slice(fails, 1, FAILURES), lambda b, i: _pytest_failure(b, i, n)), ""), more(n, FAILURES, "more failures\n", "\n… +"))).otherwise("")
    none_at_all = (k["passed"] == 0) & (k["failed"] == 0) & (k["skipped"] == 0) & (k["xfailed"] == 0) & (k["xpassed"] == 0)
    plain = (k["failed"] == 0) & (k["passed"] > 0) & (k["skipped"] == 0) & (k["xfailed"] == 0) & (k["xpassed"] == 0) & (F.size(expected) == 0)
    return F.when(none_at_all, "Pytest: No tests collected").when(plain, text("Pytest: ", k["passed"], " passed")).otherwise(T.utrim(text(head, known, shown)))


# Ruby


def _ruby_block(block: Column) -> Column:
    """A failure's lines without those of installed packages, then its place in the specs."""
    a = F.filter(F.split(block, "\n"), lambda s: ~_blank(s))
    spec = lambda s: begins(s, "# ./spec/", "# ./test/")
    rows = F.filter(a, lambda s: ~spec(s) & ~(s.startswith("#") & has(s, "/gems/", "lib/rspec")))
    at = F.regexp_replace(last(F.filter(a, spec)), "^# ", "")
    return F.concat(F.array_join(rows, "\n   "), F.coalesce(F.concat(F.lit("\n   "), at), F.lit("")))


def tail_of(x: Column | str, n: int) -> Column:
    a = T.lines(x)
    return T.unlines(F.when(F.size(a) > n, F.slice(a, -n, n)).otherwise(a))


def rspec_text(x: Column | str, cap: int = FAILURES - 5) -> Column:
    """The summary line and failure blocks of a run without JSON; else a line that looks like a summary, else the last five lines."""
    summed = r"(\d+) examples?, (\d+) failures?"

    def told(trimmed: Column, at: Column) -> Column:
        summary = F.when(at > 0, F.try_element_at(trimmed, F.when(at > 0, at).otherwise(1)))
        guess = last(F.filter(trimmed, lambda s: s.contains("example") & has(s, "failure", "pending")))
        body = F.when(at > 0, F.slice(trimmed, F.lit(1), at - 1)).otherwise(trimmed)
        shown = lambda fails: F.when(F.size(fails) == 0, text("RSpec: ", summary)).otherwise(T.utrim(text("RSpec: ", summary, "\n", listed(fails, cap, "more failures", lambda f, i: text(i + 1, ". ✗ ", f), sep="\n\n", mark="... +", lead="\n\n"))))
        return F.when(at > 0, bound(bound(body, _rspec_failures), shown)).when(guess.isNotNull(), text("RSpec: ", guess)).otherwise(tail_of(x, 5))

    found = lambda trimmed: F.array_position(F.transform(trimmed, lambda s: s.rlike(summed)), F.lit(True)).cast("int")
    return bound(F.transform(T.lines(x), T.utrim), lambda trimmed: bound(found(trimmed), lambda at: told(trimmed, at)))


def _rspec_failures(body: Column) -> Column:
    """Failure blocks between their header and the list of failed examples."""
    gem = lambda s: has(s, "/gems/", "lib/rspec", "lib/ruby/", "vendor/bundle")
    opens = lambda s: s.rlike(r"^[0-9]+\)")
    start, again = F.array_position(body, "Failures:").cast("int"), F.array_position(body, "Failed examples:").cast("int")
    from_ = F.slice(body, start + 1, F.size(body))
    own = F.when((start == 0) | ((again > 0) & (again < start)), none()).otherwise(F.slice(from_, F.lit(1), F.when(again > start, again - start - 1).otherwise(F.size(body))))
    # lines before the first number make a block of their own
    rows = F.filter(own, lambda s: (s != "") & (opens(s) | ~gem(s)))
    return F.transform(blocks(rows, lambda s: opens(s), lambda s, b: F.lit(True)), _ruby_block)


def minitest_counts(summary: Column) -> Column:
    n = lambda *words: F.coalesce(last(F.regexp_extract_all(summary, F.lit(rf"(?:^|,)\s*(\d+)\s+(?:{'|'.join(words)})(?=\s|,|$)"), F.lit(1))).cast("int"), F.lit(0))
    return F.struct(n("runs?", "tests?").alias("runs"), n("assertions?").alias("assertions"), n("failures?").alias("failures"), n("errors?").alias("errors"), n("skips?").alias("skips"))


def minitest_report(x: Column | str) -> Column:
    """The counts, and of each failure its header and the four lines after it."""
    a = T.lines(T.normalize_newlines(T.strip_ansi(x)))
    is_sum = lambda s: has(s, " runs,", " tests,") & s.contains(" assertions,")
    summary = F.coalesce(T.utrim(last(F.filter(a, lambda s: is_sum(s)))), F.lit(""))
    head = r"^\s*\d+\) (?:Failure|Error):?"
    starts = lambda s: (T.utrim(s) == "# Running:") | T.utrim(s).startswith("Started with run options")
    section = kept(a, {"on": F.lit(False)}, lambda s, x: (s["on"] & ~is_sum(x) & ~starts(x) & ~T.utrim(x).startswith("Finished in "), {"on": F.when(starts(x), False).when(T.utrim(x).startswith("Finished in "), True).otherwise(s["on"])}))
    fails = fold(
        section, {"done": none(), "block": none()},
        lambda s, x: {
            "done": F.when((x.rlike(head) | _blank(x)) & (F.size(s["block"]) > 0), F.concat(s["done"], F.array(F.array_join(s["block"], "\n")))).otherwise(s["done"]),
            "block": F.when(x.rlike(head), F.array(T.utrim(x))).when(_blank(x), none()).otherwise(F.concat(s["block"], F.array(x))),
        }, lambda s: F.when(F.size(s["block"]) > 0, F.concat(s["done"], F.array(F.array_join(s["block"], "\n")))).otherwise(s["done"]))
    k = minitest_counts(summary)
    skips = F.when(k["skips"] > 0, text(", ", k["skips"], " skips")).otherwise("")
    after = lambda r: F.filter(F.transform(F.slice(r, 2, 4), T.utrim), lambda s: s != "")
    one = lambda f, i: text(i + 1, ". ", T.utrim(F.split(f, "\n")[0]), "\n", F.array_join(F.transform(after(F.split(f, "\n")), lambda s: text("   ", T.ellipsis(s, 120), "\n")), ""))
    shown = F.when(F.size(fails) > 0, text("\n", listed(fails, FAILURES, "more failures\n", one, sep="\n", mark="... +", lead="\n"))).otherwise("")
    fine = text("ok rake test: ", k["runs"], " runs, 0 failures", skips)
    bad = T.utrim(text("rake test: ", k["runs"], " runs, ", k["failures"], " failures, ", k["errors"], " errors", skips, "\n", shown))
    return F.when((k["runs"] == 0) & (summary == ""), "rake test: no tests ran").when((k["failures"] == 0) & (k["errors"] == 0), fine).otherwise(bad)


def rubocop_text(x: Column | str) -> Column:
    """Errors of the setup, else the summary line, else the last five lines."""
    a = F.transform(T.lines(x), T.utrim)
    broken = F.exists(a, lambda s: has(s, "cannot load such file", "Bundler::GemNotFound", "Gem::MissingSpecError") | begins(s, "rubocop: command not found", "rubocop: No such file"))
    whole = T.lines(T.utrim(x))
    error = text("RuboCop error:\n", T.unlines(F.slice(whole, 1, 20)), F.when(F.size(whole) > 20, text("\n... (", F.size(whole) - 20, " more lines)")).otherwise(""))
    line = last(F.filter(a, lambda s: s.contains("inspected") & has(s, "autocorrected", "offense")))
    files = number(line, r"^(\d+)(?:\s|$)")
    corrected = number(last(F.filter(F.transform(F.split(line, ","), T.utrim), lambda s: s.contains("autocorrected"))), r"^(\d+)(?:\s|$)")
    summed = (
        F.when(line.contains("autocorrected"), F.when((files > 0) & (corrected > 0), text("ok ✓ rubocop -A (", files, " files, ", corrected, " autocorrected)")).otherwise(text("RuboCop: ", line)))
        .when(line.contains("no offenses"), F.when(files > 0, text("ok ✓ rubocop (", files, " files)")).otherwise("ok ✓ rubocop (no offenses)")).otherwise(text("RuboCop: ", line))
    )
    return F.when(broken, error).when(line.isNotNull(), summed).otherwise(tail_of(x, 5))


# gradle

#: Lines of builds and tests.
_TASK = r"^> Task :"
_TRY = r"^\* Try:|^> Run with --|^> Get more help at"
_STATUS = r"^BUILD (SUCCESSFUL|FAILED)"
_ACTIONABLE = r"^\d+ actionable tasks?"
_TESTS = r"\d+ tests? completed|\d+ tests? failed|There were failing tests|See the report at"
_FRAMES = ("at org.junit.", "at junit.", "at java.lang.reflect.", "at sun.reflect.", "at org.gradle.")


def _or_whole(filtered: Column, raw: Column, fine: str) -> Column:
    return F.when(~_blank(filtered), filtered).when(raw.contains("BUILD SUCCESSFUL"), fine).otherwise(T.utrim(raw))


def _gradle_lines(a: Column) -> Column:
    def step(s: Column, x: Column) -> tuple[Column, dict[str, Column]]:
        t = T.utrim(x)
        noise, summary = x.rlike(f"{_TASK}|{_TRY}"), x.rlike(f"{_STATUS}|{_ACTIONABLE}|{_TESTS}")
        quiet, failed = x.rlike(" PASSED$| SKIPPED$"), x.rlike("FAILED$| FAILED ")
        named, frame = begins(t, "java.", "kotlin."), t.startswith("at ")
        user = frame & ~begins(t, *_FRAMES)
        keep = ~noise & (summary | (~quiet & (failed | (s["on"] & (named | user)))))
        on = F.when(noise | summary, s["on"]).when(quiet, False).when(failed, True).when(s["on"] & (user | (~named & ~frame & (t != ""))), False).otherwise(s["on"])
        return keep, {"on": on}

    return T.unlines(kept(a, {"on": F.lit(False)}, step))


def gradle_test(x: Column | str) -> Column:
    """Failed tests with their exception and first frame of own code, and the summary."""
    raw = T.c(x)
    return F.when(raw == "", "").otherwise(_or_whole(_gradle_lines(T.lines(raw)), raw, "ok ✓ (no test output — add testLogging to build.gradle for details)"))


def gradle_connected(x: Column | str) -> Column:
    """The same for tests on a device, without the device's own lines."""
    raw = T.c(x)
    noise = rf"^INSTRUMENTATION_STATUS[_CODE]*:|^INSTRUMENTATION_RESULT:|^INSTRUMENTATION_CODE:|^Starting \d+ tests? on |^Installing APK|{_TASK}|{_TRY}"
    rest = T.unlines(F.filter(T.lines(raw), lambda s: ~s.rlike(noise)))
    got = gradle_test(rest)
    return F.when(raw == "", "").when(raw.contains("No connected devices!"), "connectedAndroidTest failed: No connected devices! Start an emulator or connect a device.").when(_blank(got), "ok ✓ (connected tests passed)").otherwise(got)


def gradle_lint(x: Column | str) -> Column:
    """Violations, those of the platform's lint with up to three lines of context, and the summary."""
    raw = T.c(x)

    def step(s: Column, line: Column) -> tuple[Column, dict[str, Column]]:
        noise = line.rlike(rf"{_TASK}|{_TRY}|Wrote (HTML|XML|text) report|file://|/build/reports/lint")
        android = line.rlike(r"[^:]+:\d+:.*[Ee]rror:.*\[|[^:]+:\d+:.*[Ww]arning:.*\[")
        hit = android | line.rlike(rf"{_STATUS}|{_ACTIONABLE}|\d+ (issues?|errors?|warnings?)|[^:]+:\d+:\d+:.*[Ll]int|[^:]+:\d+:\d+:.*error")
        context = (s["left"] > 0) & ~_blank(line)
        return ~noise & (hit | context), {"left": F.when(noise, 0).when(android, 3).when(hit, 0).when(context, s["left"] - 1).otherwise(0)}

    got = T.unlines(kept(T.lines(raw), {"left": F.lit(0)}, step))
    return F.when(raw == "", "").otherwise(_or_whole(got, raw, "ok ✓ lint passed"))


def gradle_dependencies(x: Column | str) -> Column:
    """First-level dependencies by configuration, 20 of each."""
    raw = T.c(x)
    noise = lambda t: (t == "") | t.rlike(f"{_TASK}|{_TRY}|{_STATUS}|{_ACTIONABLE}") | begins(t, "Downloading", "Download ", "Starting a Gradle") | t.isin("No dependencies", "(n)")
    rows = F.filter(T.lines(raw), lambda s: ~noise(T.utrim(s)))
    header = lambda t: ~begins(t, "+", "|", "\\", " ") & t.contains(" - ")
    start = {"name": F.lit(""), "rows": F.array().cast("array<struct<at:int,name:string,dep:string>>"), "at": F.lit(0)}

    def step(s: Column, line: Column) -> dict[str, Column]:
        t = T.utrim(line)
        top = ~header(t) & begins(line, "+---", "\\---") & (s["name"] != "")
        dep = F.regexp_replace(F.regexp_replace(t, r"^\+--- ", ""), r"^\\--- ", "")
        return {
            "name": F.when(header(t), F.regexp_extract(t, r"^(.*?) - ", 1)).otherwise(s["name"]), "at": s["at"] + header(t).cast("int"),
            "rows": F.when(top, F.concat(s["rows"], F.array(F.struct(s["at"].alias("at"), s["name"].alias("name"), dep.alias("dep"))))).otherwise(s["rows"]),
        }

    got = fold(rows, start, step, lambda s: s["rows"])
    places = F.array_distinct(F.transform(got, lambda r: F.struct(r["at"].alias("at"), r["name"].alias("name"))))

    def shown(p: Column) -> Column:
        deps = F.transform(F.filter(got, lambda r: r["at"] == p["at"]), lambda r: r["dep"])
        return text("\n", p["name"], " (", F.size(deps), "):\n", F.array_join(F.transform(F.slice(deps, 1, LIST), lambda d: text("  ", d, "\n")), ""), more(F.size(deps), LIST, "more\n", "  ... +"))

    out = text(F.size(got), " top-level dependencies across ", F.size(places), " configurations\n", F.array_join(F.transform(places, shown), ""))
    return F.when(raw == "", "").when(F.size(places) > 0, F.regexp_replace(out, r"[\n\r\t ]+\z", "")).when(raw.contains("BUILD SUCCESSFUL"), "ok ✓ no dependencies").otherwise(T.utrim(raw))


def _last_argument(a: Column, skip: tuple[str, ...] = ()) -> Column:
    return F.coalesce(last(F.filter(a, lambda s: ~s.startswith("-") & ~F.lower(s).isin(*skip, ""))), F.lit(""))


def gradle_task(arguments: Column) -> Column:
    """connected, test, build, lint, dependencies or other, by the last argument that is no option and not ``clean``."""
    t = F.lower(_last_argument(arguments, ("clean",)))
    return (
        F.when(t.contains("connected"), "connected").when(t.contains("test"), "test").when(has(t, "assemble", "build", "bundle", "install"), "build").when(has(t, "lint", "detekt"), "lint")
        .when(t == "check", "test").when(t.contains("dependencies"), "dependencies").when(t == "", "build").otherwise("other")
    )


# Maven

_PHASES = {"test": ("test", "integration-test"), "compile": ("compile", "test-compile"), "package": ("package", "install", "verify", "deploy")}
_BANNER = r"^\[INFO\] --- .* @ .* ---$"
_MODULE = r"^\[INFO\] -+< .+ >-+$"
_FOOT = r"^\[(?:INFO|ERROR)\] BUILD (?:SUCCESS|FAILURE)$"
_BOILER = ("[ERROR] See ", "[ERROR] -> [Help", "[ERROR] To see the full stack trace", "[ERROR] Re-run Maven", "[ERROR] For more information", "[ERROR] [Help")
_MVN_FRAMES = ("at org.junit.", "at junit.", "at org.apache.maven.surefire.", "at sun.reflect.", "at jdk.internal.reflect.", "at jdk.proxy", "at java.base/", "at java.lang.reflect.", "at java.util.")
_COORD = r"/[^:]+\.java:\[\d+,\d+\]"


def mvn_phase(arguments: Column) -> Column:
    """test, compile, package or passthrough, by the last argument that is no option."""
    t = _last_argument(arguments)
    return F.coalesce(*[F.when(t.isin(*names), F.lit(k)) for k, names in _PHASES.items()], F.lit("passthrough"))


def _boiler(x: Column) -> Column:
    return begins(x, *_BOILER) | (F.regexp_replace(x, r"[ \t]+$", "") == "[ERROR]")


def _english(a: Column) -> Column:
    return F.exists(a, lambda s: T.utrim(s).rlike(r" BUILD (?:SUCCESS|FAILURE)\z"))


def _ended(a: Column) -> Column:
    """Lines, each with its end."""
    return F.array_join(F.transform(a, lambda s: F.concat(s, F.lit("\n"))), "")


def mvn_compile(x: Column | str) -> Column:
    """Modules, errors with what follows, each warning once whatever its place, and the footer."""
    raw = T.strip_ansi(x)
    a = T.lines(raw)

    def step(s: Column, line: Column) -> tuple[Column, dict[str, Column]]:
        frame = line.rlike(f"{_MODULE}|{_FOOT}") | begins(line, "[INFO] Building ", "[INFO] Total time:", "[INFO] Finished at:", "[INFO] Scanning ")
        error = ~frame & ~_boiler(line) & line.startswith("[ERROR]")
        goes_on = ~frame & ~_boiler(line) & ~error & s["on"] & line.rlike(r"^[ \t]")
        norm = F.regexp_replace(F.regexp_replace(line, r"^\[WARNING\] ", ""), _COORD, "")
        warning = ~frame & ~_boiler(line) & ~error & ~goes_on & line.startswith("[WARNING]")
        new = warning & ~F.array_contains(s["seen"], norm)
        return frame | error | goes_on | new, {"on": error | goes_on, "seen": F.when(new, F.concat(s["seen"], F.array(norm))).otherwise(s["seen"])}

    return F.when(_english(a), _ended(kept(a, {"on": F.lit(False), "seen": none()}, step))).otherwise(raw)


def mvn_quiet(x: Column | str) -> Column:
    """Output of a quiet run: without help texts and frames of the test framework."""
    raw = T.strip_ansi(x)

    def step(s: Column, line: Column) -> tuple[Column, dict[str, Column]]:
        close = line.rlike(_CLOSE)
        marked = has(line, "<<< FAILURE!", "<<< ERROR!")
        sub = line.startswith("[ERROR] ") & marked
        frame = begins(F.regexp_replace(line, r"^[ \t]+", ""), *_MVN_FRAMES)
        trail = s["on"] & ~close & ~sub
        keep = close | sub | (trail & ~frame) | (~trail & (begins(line, "[ERROR] Tests run:", "[ERROR] Failures:", "[ERROR] Errors:", "[ERROR]   ", "[ERROR] Failed to execute goal") | ~_boiler(line)))
        return keep, {"on": F.when(close, marked).when(sub, True).when(trail & _blank(line), False).otherwise(s["on"])}

    rows = kept(T.lines(raw), {"on": F.lit(False)}, step)
    return F.when(_blank(raw), "").otherwise(_ended(rows))


#: A class's closing line (failures and errors are captured), the counts of all, and what else stays.
_CLOSE = r"^\[(?:INFO|ERROR|WARNING)\] Tests run: \d+, Failures: (\d+), Errors: (\d+), Skipped: \d+, Time elapsed: [^ ]+ s(?:\s+<<<\s*(?:FAILURE|ERROR)!)?\s+--?\s+in (.+)$"
_ALL = r"^\[(?:INFO|ERROR)\] Tests run: \d+, Failures: \d+, Errors: \d+, Skipped: \d+\s*$"
_OUTSIDE = rf"^\[INFO\] Results:\s*$|{_ALL}|{_FOOT}|{_MODULE}"
_OUTSIDE_BEGINS = ("[INFO] Total time:", "[INFO] Finished at:", "[INFO] Building ", "[INFO] Scanning ", "[INFO] Installing ", "[ERROR] Failures:", "[ERROR] Errors:")


def mvn_tests(x: Column | str, package: bool = False, cap: int = FAILURES) -> Column:
    """Failing classes with their traces (``cap`` of them), results, reactor summary and footer; with ``package`` also modules and each warning once.

    A class's lines are held back until its closing line says whether it failed. After a failing class its tests' traces follow,
    which share its fate.
    """
    raw = T.strip_ansi(x)
    a = T.lines(raw)
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    start = {
        "out": none(), "block": none(), "name": F.lit(None).cast("string"), "open": no, "trail": no, "drop": no, "armed": F.lit(None).cast("boolean"), "on": no, "reactor": no,
        "seen": none(), "failing": zero, "dropped": zero, "summing": no, "summed": zero, "left": zero,
    }
    head = lambda s: F.when(s["name"].isNotNull(), F.array(s["name"])).otherwise(none())
    is_frame = lambda line: begins(F.regexp_replace(line, r"^[ \t]+", ""), *_MVN_FRAMES)
    unless = lambda test, items: F.when(test, none()).otherwise(items)

    def place(s: Column, line: Column) -> Column:
        opens, close = line.startswith("[INFO] Running "), line.rlike(_CLOSE)
        bad = close & ((F.regexp_extract(line, _CLOSE, 1) != "0") | (F.regexp_extract(line, _CLOSE, 2) != "0"))
        sub = line.startswith("[ERROR] ") & has(line, "<<< FAILURE!", "<<< ERROR!")
        return (
            F.when(line.rlike(_BANNER), "banner").when(opens, "opens").when(s["open"], F.when(bad & (s["failing"] < cap), "fails").when(bad, "too many").when(close, "passes").otherwise("inside"))
            .when(s["trail"], F.when(line == "", "trail ends").when(is_frame(line) | s["drop"], "trail gone").otherwise("trail"))
            .when(s["armed"].isNotNull() & (line != "") & sub, F.when(s["armed"], "next dropped").otherwise("next"))
        )

    def sort(s: Column, line: Column, where: Column) -> Column:
        """(kind, reactor, foot, early, entry) of a line that is in no class's part."""
        passing = where.isNull()
        goes_on = s["on"] & line.rlike(r"^[ \t]")
        entry = s["summing"] & line.startswith("[ERROR]   ")
        reactor, foot = line.startswith("[INFO] Reactor Summary for "), line.rlike(_FOOT)
        stays = reactor | (s["reactor"] & ~foot) | (~_boiler(line) & (line.rlike(_OUTSIDE) | begins(line, *_OUTSIDE_BEGINS) | (line.startswith("[ERROR]") & ~line.startswith("[ERROR] Tests run:"))))
        if package:
            stays = stays | line.rlike(_MODULE)
        early = no if package else goes_on
        kind = F.when(passing & early, "goes on").when(passing & entry, "entry").when(passing & stays, "stays").when(passing & goes_on, "goes on").when(passing, "other")
        return F.struct(kind.alias("kind"), reactor.alias("reactor"), foot.alias("foot"), early.alias("early"), entry.alias("entry"))

    def step(s: Column, line: Column, where: Column, v: Column) -> dict[str, Column]:
        passing, kind, reactor, foot, early, entry = where.isNull(), v["kind"], v["reactor"], v["foot"], v["early"], v["entry"]
        norm = F.regexp_replace(F.regexp_replace(line, r"^\[WARNING\] ", ""), _COORD, "")
        new = (kind == "other") & line.startswith("[WARNING]") & ~F.array_contains(s["seen"], norm) if package else no
        counted = (kind == "stays") & s["summing"] & line.rlike(_ALL)
        header = (kind == "stays") & line.startswith("[ERROR] Failures:")
        note = F.when(counted & (s["left"] > 0), F.array(F.lit(""), text("… +", s["left"], " more failures"))).otherwise(none())
        one = F.array(line)
        added = (
            F.when(where == "opens", unless(~s["open"], F.concat(head(s), s["block"]))).when(where == "fails", F.concat(head(s), F.filter(s["block"], lambda b: ~is_frame(b)), one))
            .when(where == "trail ends", unless(s["drop"], one)).when(where.isin("trail", "next"), one).when(kind == "goes on", one).when((kind == "entry") & (s["summed"] < cap), one)
            .when(kind == "stays", F.concat(note, one)).when(new, one).otherwise(none())
        )
        over = where.isin("fails", "too many", "passes")
        return {
            "out": F.concat(s["out"], added),
            "block": F.when(where.isin("opens") | over, none()).when(where == "inside", F.concat(s["block"], one)).otherwise(s["block"]),
            "name": F.when(where == "opens", line).when(over, F.lit(None)).otherwise(s["name"]),
            "open": F.when(where == "opens", yes).when(over, no).otherwise(s["open"]),
            "trail": F.when(where.isin("fails", "too many", "next", "next dropped"), yes).when(where.isin("opens", "trail ends"), no).otherwise(s["trail"]),
            "drop": F.when(where.isin("too many", "next dropped"), yes).when(where.isin("trail ends", "next"), no).otherwise(s["drop"]),
            "armed": F.when(where == "trail ends", s["drop"]).when(where.isin("opens", "fails", "too many", "next", "next dropped") | (passing & (line != "")), F.lit(None)).otherwise(s["armed"]),
            "on": F.when(where.isin("fails", "too many") | (kind == "other"), no).when(kind == "stays", line.startswith("[ERROR]") & ~begins(line, "[ERROR] Tests run:", "[ERROR] Failures:", "[ERROR] Errors:")).otherwise(s["on"]),
            "reactor": F.when(passing & ~early & ~entry, (s["reactor"] | reactor) & ~foot).otherwise(s["reactor"]),
            "seen": F.when(new, F.concat(s["seen"], F.array(norm))).otherwise(s["seen"]),
            "failing": s["failing"] + F.when(where == "fails", 1).otherwise(0), "dropped": s["dropped"] + F.when(where == "too many", 1).otherwise(0),
            "summing": F.when(header, yes).when(counted, no).otherwise(s["summing"]),
            "summed": F.when(header | counted, 0).when((kind == "entry") & (s["summed"] < cap), s["summed"] + 1).otherwise(s["summed"]),
            "left": F.when(header | counted, 0).when((kind == "entry") & (s["summed"] >= cap), s["left"] + 1).otherwise(s["left"]),
        }

    def finish(s: Column) -> Column:
        rows = F.concat(s["out"], unless(~s["open"], F.concat(head(s), s["block"])))
        notes = lambda n, what: F.when(n > 0, text("\n… +", n, f" more {what}\n")).otherwise("")
        return F.concat(_ended(rows), F.when(s["summing"], notes(s["left"], "failures")).otherwise(""), notes(s["dropped"], "failing test classes"))

    return F.when(_english(a), fold(a, start, step, finish, (place, sort))).otherwise(raw)
