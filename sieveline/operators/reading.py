"""Reading source files, markup and unknown output: comments dropped, long texts thinned, kinds told apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .overview import kind
from .scan import begins, fold, kept, none
from .test_results import generic_counts

#: Line comment, block comment start and end, what a documentation block begins with, and a documentation line, by language.
_SLASHES = ("//", "/*", "*/", "/**", None)
COMMENTS = {
    "rust": ("//", "/*", "*/", "/**", "///"), "python": ("#", '"""', '"""', '"""', None), "javascript": _SLASHES, "typescript": _SLASHES, "go": _SLASHES, "c": _SLASHES, "cpp": _SLASHES, "java": _SLASHES,
    "ruby": ("#", "=begin", "=end", "###", None), "shell": ("#", None, None, None, None), "data": (None, None, None, None, None),
}
_OTHER = ("//", "/*", "*/", "###", None)
#: Lines that bring in other code, and those that open a definition.
IMPORTS = r"^(use |import |from |require\(|#include)"
SIGNATURES = r"^(pub\s+)?(async\s+)?(fn|def|function|func|class|struct|enum|trait|interface|type)\s+\w+"
#: Languages by file extension.
LANGUAGES = {
    "rust": ("rs",), "python": ("py", "pyw"), "javascript": ("js", "mjs", "cjs"), "typescript": ("ts", "tsx"), "go": ("go",), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hh"), "java": ("java",), "ruby": ("rb",),
    "shell": ("sh", "bash", "zsh"), "data": ("json", "jsonc", "json5", "yaml", "yml", "toml", "xml", "csv", "tsv", "graphql", "gql", "sql", "md", "markdown", "txt", "env", "lock"),
}


def language(extension: Column | str) -> Column:
    ext = F.lower(T.c(extension))
    return F.coalesce(*[F.when(ext.isin(*names), F.lit(k)) for k, names in LANGUAGES.items()], F.lit("unknown"))


def _language_case(lang: Column, pick) -> Column:
    return F.coalesce(*[F.when(lang == k, pick(v, k)) for k, v in COMMENTS.items()], pick(_OTHER, "unknown"))


def minimal_source(text: Column | str, lang: Column | str) -> Column:
    """Without comments (documentation stays), with blank runs of one line at most, trimmed."""

    def one(marks: tuple, name: str) -> Column:
        line_mark, start, end, doc, doc_line = marks

        def step(s: Column, line: Column) -> tuple[Column, dict[str, Column]]:
            t = T.utrim(line)
            inside = (s["block"] | (~s["doc"] & t.contains(start) & ~t.startswith(doc))) if start else F.lit(False)
            fence = ~inside & t.startswith('"""') if name == "python" else F.lit(False)
            in_doc = ~inside & ~fence & s["doc"]
            comment = (t.startswith(line_mark) & ~(t.startswith(doc_line) if doc_line else F.lit(False))) if line_mark else F.lit(False)
            return ~inside & (fence | in_doc | ~comment), {"block": inside & ~(t.contains(end) if end else F.lit(True)), "doc": F.when(fence, ~s["doc"]).otherwise(s["doc"])}

        kept_ = kept(F.split(T.c(text), "\n", -1), {"block": F.lit(False), "doc": F.lit(False)}, step)
        return T.utrim(F.regexp_replace(T.unlines(F.transform(kept_, lambda x: F.when(T.is_blank(x), "").otherwise(x))), r"\n{3,}", "\n\n"))

    return _language_case(T.c(lang), one)


def aggressive_source(text: Column | str, lang: Column | str) -> Column:
    """Imports, signatures with a mark for what they hold, and constants outside of definitions."""
    minimal = minimal_source(text, lang)
    count = lambda t, ch: F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))

    def step(s: Column, line: Column) -> dict[str, Column]:
        t = T.utrim(line)
        brought, opens = t.rlike(IMPORTS), t.rlike(SIGNATURES)
        body = s["body"] & ~brought & ~opens
        depth = s["depth"] + count(t, "{") - count(t, "}")
        ends = body & (depth <= 0)
        brace = body & (depth <= 1) & (t.isin("{", "}") | t.endswith("{"))
        mark = ends & ~t.isin("", "}")
        const = ~s["body"] & begins(t, "const ", "static ", "let ", "pub const ", "pub static ")
        here = F.when(brought | opens | brace | const, F.array(line)).otherwise(none())
        return {
            "body": F.when(opens, True).when(ends, False).otherwise(s["body"]), "depth": F.when(opens, 0).when(body, depth).otherwise(s["depth"]),
            "out": F.concat(s["out"], here, F.when(mark, F.array(F.lit("    // ... implementation"))).otherwise(none())),
        }

    got = T.utrim(T.unlines(fold(F.split(minimal, "\n", -1), {"body": F.lit(False), "depth": F.lit(0), "out": none()}, step, lambda s: s["out"])))
    return F.when(T.c(lang) == "data", minimal).otherwise(got)


def smart_truncate(text: Column | str, limit: int) -> Column:
    """Important lines and the first half of the window, up to the limit, and how many lines there are more."""
    a = F.split(T.c(text), "\n", -1)

    def step(s: Column, line: Column) -> tuple[Column, dict[str, Column]]:
        t = T.utrim(line)
        keep = (s["n"] < max(limit - 1, 1)) & (t.rlike(f"{SIGNATURES}|{IMPORTS}") | begins(t, "pub ", "export ") | t.isin("{", "}") | (s["n"] < limit // 2))
        return keep, {"n": s["n"] + keep.cast("int")}

    rows = kept(a, {"n": F.lit(0)}, step)
    more_ = F.concat(F.lit("["), (F.size(a) - F.size(rows)).cast("string"), F.lit(" more lines]"))
    return F.when(F.size(a) <= limit, T.c(text)).otherwise(T.unlines(F.concat(rows, F.array(more_))))


def read_source(text: Column | str, lang: Column | str, level: str = "minimal", limit: int | None = None, tail: int | None = None, numbers: bool = False) -> Column:
    """A source file at a level (none, minimal, aggressive); as it is where the filter leaves nothing of it; then its last or its important lines, then numbered."""
    raw = T.c(text)
    got = {"none": raw, "minimal": minimal_source(raw, lang), "aggressive": aggressive_source(raw, lang)}[level]
    got = F.when(T.is_blank(got) & ~T.is_blank(raw), raw).otherwise(got)
    if tail is not None:
        got = tail_window(got, tail)
    elif limit is not None:
        got = smart_truncate(got, limit)
    return T.number_lines(got) if numbers else got


def tail_window(text: Column | str, n: int) -> Column:
    """The last lines; a newline at the end stays."""
    raw, a = T.c(text), T.lines(text)
    rows = T.unlines(F.when(F.size(a) > n, F.slice(a, F.size(a) - n + 1, n)).otherwise(a)) if n > 0 else F.lit("")
    return F.concat(rows, F.when(raw.endswith("\n"), "\n").otherwise("")) if n > 0 else F.lit("")


def markdown_body(text: Column | str) -> Column:
    """Without comments, badge and image lines and rules, blank runs collapsed; fenced code stays as it is."""
    parts = F.split(T.c(text), "```", -1)

    def prose(s: Column) -> Column:
        for pattern, new in ((r"(?s)<!--.*?-->", ""), (r"(?m)^\s*\[?!\[[^\]]*\]\([^)]*\)\]?(?:\([^)]*\))?\s*$", ""), (r"(?m)^\s*(?:-{3,}|\*{3,}|_{3,})\s*$", ""), (r"\n{3,}", "\n\n")):
            s = F.regexp_replace(s, pattern, new)
        return s

    return T.utrim(F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 0, prose(s)).otherwise(s)), "```"))


def summarize(command: Column | str, text: Column | str) -> Column:
    """A struct: kind, lines, and the counts that the kind calls for."""
    a = T.lines(text)
    n = lambda p: F.size(F.filter(a, lambda s: F.lower(s).rlike(p)))
    return F.struct(
        kind(command, text).alias("kind"), F.size(a).alias("lines"), n("error|fatal").alias("errors"), n("warn").alias("warnings"),
        generic_counts(text).alias("tests"), F.slice(a, 1, 5).alias("first"), F.when(F.size(a) > 8, F.slice(a, -3, 3)).alias("last"),
    )


def code_profile(text: Column | str) -> Column:
    """Counts of functions, types and imports."""
    a = T.lines(text)
    n = lambda p: F.size(F.filter(a, lambda s: s.rlike(p)))
    return F.struct(n(r"^\s*(?:pub\s+)?(?:async\s+)?(?:fn|def|function|func)\b").alias("functions"), n(r"^\s*(?:pub\s+|export\s+)?(?:class|struct|enum|trait|interface)\b").alias("types"), n(r"^\s*(?:use|import|from|require|#include)\b").alias("imports"))


def wc_row(line: Column | str) -> Column:
    """Counts and name of a word-count line."""
    parts = F.split(F.trim(T.c(line)), r"\s+")
    return F.struct(*[F.try_element_at(parts, F.lit(i)).try_cast("bigint").alias(n) for i, n in ((1, "lines"), (2, "words"), (3, "bytes"))], F.try_element_at(parts, F.lit(4)).alias("name"))


#: How runners name the phases that decide.
REACTOR = r"^\[(?:INFO|ERROR)\] (.+?) \.{3,} (SUCCESS|FAILURE|SKIPPED)"


def surefire(text: Column | str) -> Column:
    """Totals of the last summary line of Java tests and the names of failing ones."""
    from .test_results import _n

    a = T.lines(T.strip_ansi(text))
    line = F.coalesce(F.try_element_at(F.filter(a, lambda s: s.rlike(r"Tests run: \d+, Failures: \d+")), F.lit(-1)), F.lit(""))
    failing = F.transform(F.filter(a, lambda s: s.rlike(r"^\[ERROR\]\s+\S+.*<<< (?:FAILURE|ERROR)!")), lambda s: F.regexp_extract(s, r"^\[ERROR\]\s+(\S+)", 1))
    return F.struct(_n(line, r"Tests run: (\d+)").alias("run"), _n(line, r"Failures: (\d+)").alias("failures"), _n(line, r"Errors: (\d+)").alias("errors"), _n(line, r"Skipped: (\d+)").alias("skipped"), failing.alias("failing"))


#: Lines of a build that always go, and those that stay.
BUILD_NOISE = (
    r"^> Task :", r"^(Starting a Gradle Daemon|Daemon will be stopped|Reusing configuration cache|Calculating task graph|> Configure project|Deprecated Gradle features|You can use|For more on this|Configuration cache entry)",
    r"^\s*\d+%|^Downloading|^Configuring|^Resolving|^\[Incubating\]|^Wrote HTML report|^class \S+ could not|^\[android-", r"^\* Try:|^> Run with --|^> Get more help at",
)
BUILD_KEPT = (
    r"^BUILD (SUCCESSFUL|FAILED)", r"^\d+ actionable tasks?", r"(?i:(^FAILURE:|^\* What went wrong:|^\* Where:|> Could not|e: |error:|^Execution failed|Lint found \d+ error))", r"^(w: |warning:|Warning:|WARNING:)",
    r"gradle\.com/s/|Publishing build scan",
)


def gradle_build(text: Column | str) -> Column:
    """Errors, warnings and the outcome of a build; blank lines stay, tasks and progress go."""
    rows = F.filter(T.lines(text), lambda s: ~T.any_of(s, list(BUILD_NOISE)) & (T.any_of(s, list(BUILD_KEPT)) | T.is_blank(s)))
    return F.array_join(F.transform(rows, lambda s: F.concat(s, F.lit("\n"))), "")
