"""Version control output as short text: diffs, logs, status, branches and checks, one output to one text as Column expressions.

The tables that the texts are made from, for questions over many outputs, are in ``vcs``; diffs too long for a row in ``ordered``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import bound
from .scan import begins, fold, has, listed, none, text

#: Lines shown of a hunk, body lines shown of a commit, branches shown that only a remote has.
HUNK, BODY, REMOTE = 100, 3, 10
#: What is under way in a working tree, the first line that says so; and lines from which on nothing says so.
STATES = (
    ("merge in progress. no conflicts", "All conflicts fixed but you are still merging"), ("merge in progress. unresolved conflicts", "You have unmerged paths"), ("cherry-pick in progress", "You are currently cherry-picking"),
    ("revert in progress", "You are currently reverting"), ("bisect in progress", "You are currently bisecting"), ("am session in progress", "You are in the middle of an am session"), ("sparse checkout enabled", "You are in a sparse checkout"),
    *(("rebase in progress", s) for s in ("rebase in progress", "You are currently rebasing", "You are currently editing", "You are currently splitting", "Last command done", "Next command to do", "No commands remaining")),
)
SECTIONS = ("Changes to be committed:", "Changes not staged for commit:", "Untracked files:", "Unmerged paths:", "no changes added to commit", "nothing to commit", "nothing added to commit")


def diff(x: Column | str, most: int = 500, program: str = "sieveline") -> Column:
    """Each file with its hunks: headers whole, the first hundred lines from the first change on, how many changes were left out, and the sums; ``most`` lines in all."""
    start = {"out": none(), "file": F.lit(""), "added": F.lit(0), "removed": F.lit(0), "inside": F.lit(False), "shown": F.lit(0), "skipped": F.lit(0), "cut": F.lit(False), "over": F.lit(False)}
    skipped = lambda s: F.when(s["skipped"] > 0, F.array(text("  ... (", s["skipped"], " lines truncated)"))).otherwise(none())
    sums = lambda s: F.when((s["file"] != "") & ((s["added"] > 0) | (s["removed"] > 0)), F.array(text("  +", s["added"], " -", s["removed"]))).otherwise(none())

    def kind(s: Column, line: Column) -> Column:
        change = F.when(line.startswith("+") & ~line.startswith("+++"), "added").when(line.startswith("-") & ~line.startswith("---"), "removed").when((s["shown"] > 0) & (s["shown"] < HUNK) & ~line.startswith("\\"), "context")
        return F.when(s["over"], "over").when(line.startswith("diff --git"), "file").when(line.startswith("@@"), "hunk").when(s["inside"], change)

    def lines(s: Column, line: Column, k: Column) -> Column:
        """What a line adds to the text."""
        own = F.array(F.concat(F.lit("  "), line))
        name = F.when(line.contains(" b/"), line.substr(F.instr(line, " b/") + 3, F.length(line))).otherwise("unknown")
        return (
            F.when(k == "file", F.concat(skipped(s), sums(s), F.array(F.concat(F.lit("\n"), name)))).when(k == "hunk", F.concat(skipped(s), own))
            .when(k.isin("added", "removed") & (s["shown"] < HUNK), own).when(k == "context", own).otherwise(none())
        )

    def step(s: Column, line: Column, k: Column, new: Column) -> dict[str, Column]:
        opens, change = k.isin("file", "hunk"), k.isin("added", "removed")
        out = F.concat(s["out"], new)
        full = (F.size(out) >= most) & (F.coalesce(k, F.lit("")) != "over")
        return {
            "out": F.when(full, F.concat(out, F.array(F.lit("\n... (more changes truncated)")))).otherwise(out), "over": s["over"] | full, "cut": s["cut"] | full | F.coalesce(opens & (s["skipped"] > 0), F.lit(False)),
            "file": F.when(k == "file", F.substring(new[F.size(new) - 1], 2, 1 << 30)).otherwise(s["file"]), "inside": F.when(k == "file", False).when(k == "hunk", True).otherwise(s["inside"]),
            "added": F.when(k == "file", 0).when(k == "added", s["added"] + 1).otherwise(s["added"]), "removed": F.when(k == "file", 0).when(k == "removed", s["removed"] + 1).otherwise(s["removed"]),
            "shown": F.when(opens, 0).when((change | (k == "context")) & (s["shown"] < HUNK), s["shown"] + 1).otherwise(s["shown"]), "skipped": F.when(opens, 0).when(change & (s["shown"] >= HUNK), s["skipped"] + 1).otherwise(s["skipped"]),
        }

    def told(s: Column) -> Column:
        hint = F.when(s["cut"] | (s["skipped"] > 0), F.array(F.lit(f"[full diff: {program} git diff --no-compact]"))).otherwise(none())
        return F.array_join(F.concat(s["out"], skipped(s), sums(s), hint), "\n")

    return fold(T.lines(x), start, step, told, (kind, lines))


def log(x: Column | str, limit: int = 10, asked: bool = False, own_format: bool = False) -> Column:
    """The first ``limit`` commits (between ``---END---`` marks): header and three body lines without sign-offs, cut to 80 characters. With ``asked`` all, cut to 120; with ``own_format`` lines of any form."""
    width = 120 if asked else 80
    first = lambda a: a if asked else F.slice(a, 1, limit)
    short = lambda s: T.ellipsis(s, width)
    if own_format:
        return T.unlines(F.transform(first(T.lines(x)), short))

    def one(block: Column) -> Column:
        told = lambda body: F.concat(
            F.array_join(F.transform(F.slice(body, 1, BODY), lambda s: F.concat(F.lit("\n  "), short(s))), ""), F.when(F.size(body) > BODY, text("\n  [+", F.size(body) - BODY, " lines omitted]")).otherwise(""))
        rest = lambda a: F.filter(F.transform(F.slice(a, F.lit(2), F.size(a)), T.utrim), lambda s: (s != "") & ~begins(s, "Signed-off-by:", "Co-authored-by:"))
        return bound(T.lines(block), lambda a: F.concat(short(T.utrim(a[0])), bound(rest(a), told)))

    blocks = F.filter(F.transform(first(F.split(T.c(x), "---END---", -1)), T.utrim), lambda b: b != "")
    return T.utrim(F.array_join(F.transform(blocks, one), "\n"))


def status(x: Column | str, detached: Column | str = "") -> Column:
    """Porcelain status with its branch (or what ``detached`` says) first."""
    head = F.lit(detached) if isinstance(detached, str) else F.coalesce(detached, F.lit(""))

    def told(a: Column) -> Column:
        on = a[0].startswith("##")
        first = F.when(on, F.concat(F.lit("* "), F.when(head != "", head).otherwise(F.regexp_replace(a[0], "^## ", "")))).otherwise(a[0])
        return F.concat(F.array_join(F.concat(F.array(first), F.slice(a, F.lit(2), F.size(a))), "\n"), F.when((F.size(a) == 1) & on, "\nclean — nothing to commit").otherwise(""))

    return bound(F.filter(T.lines(x), lambda s: ~T.is_blank(s)), lambda a: F.when(F.size(a) == 0, "Clean working tree").otherwise(told(a)))


def under_way(x: Column | str) -> Column:
    """What a plain status says is under way before its sections; null where nothing is."""
    state = lambda s: F.coalesce(*[F.when(s.contains(mark), F.lit(name)) for name, mark in STATES])
    found = F.filter(F.transform(T.lines(x), T.utrim), lambda s: begins(s, *SECTIONS) | has(s, *(m for _, m in STATES)))
    return bound(F.try_element_at(found, F.lit(1)), lambda s: F.when(~begins(s, *SECTIONS), state(s)))


def detached_head(x: Column | str) -> Column:
    """The line that says where a detached head is; null where it is on a branch."""
    return F.try_element_at(F.filter(F.transform(T.lines(x), T.utrim), lambda s: s.startswith("HEAD detached ")), F.lit(1))


def plain_status(x: Column | str) -> Column:
    """A plain status without blank lines and hints; a clean tree ends it."""

    def told(a: Column) -> Column:
        clean = F.array_position(F.transform(a, lambda s: s.contains("nothing to commit") & s.contains("working tree clean")), F.lit(True)).cast("int")
        upto = bound(clean, lambda k: F.when(k > 0, F.concat(F.slice(a, F.lit(1), F.greatest(k - 1, F.lit(0))), F.array(T.utrim(F.element_at(a, F.greatest(k, F.lit(1))))))).otherwise(a))
        return F.when(F.size(a) == 0, "ok").otherwise(F.array_join(upto, "\n"))

    hint = lambda t: begins(t, '(use "git', "(create/copy files") | has(t, '(use "git add', '(use "git restore')
    return bound(F.filter(T.lines(x), lambda s: ~T.is_blank(s) & ~hint(T.utrim(s))), told)


def branches(x: Column | str) -> Column:
    """The current branch, the local ones, and the first ten that only a remote has."""
    a = F.filter(F.transform(T.lines(x), T.utrim), lambda s: s != "")
    remote = r"^remotes/[^/]*/(.*)\z"

    def told(a: Column) -> Column:
        current = F.coalesce(F.regexp_extract(F.element_at(F.concat(F.array(F.lit("* ")), F.filter(a, lambda s: s.startswith("* "))), -1), r"^\* (.*)\z", 1), F.lit(""))
        local = F.filter(a, lambda s: ~s.startswith("* ") & ~s.startswith("remotes/"))
        names = F.filter(F.transform(F.filter(a, lambda s: s.rlike(remote)), lambda s: F.regexp_extract(s, remote, 1)), lambda s: ~s.startswith("HEAD "))
        return bound(F.struct(current.alias("current"), local.alias("local"), names.alias("names")), lambda b: bound(F.array_except(F.array_distinct(b["names"]), F.concat(b["local"], F.array(b["current"]))), lambda only: shown(b, only)))

    def shown(b: Column, only: Column) -> Column:
        rest = F.when(F.size(only) > 0, text("\n  remote-only (", F.size(only), "):\n", listed(only, REMOTE, "more", lambda s, i: F.concat(F.lit("    "), s), lead="\n    ", mark="... +"))).otherwise("")
        return F.concat(F.lit("* "), b["current"], F.array_join(F.transform(b["local"], lambda s: F.concat(F.lit("\n  "), s)), ""), rest)

    return bound(a, told)


def checks(x: Column | str) -> Column:
    """How many checks passed, failed and wait, and the failed ones."""
    kind = lambda s: F.when(has(s, "[ok]", "pass"), "ok").when(has(s, "[x]", "fail"), "fail").when(has(s, "*", "pending"), "wait")

    def told(k: Column) -> Column:
        n = lambda what: F.size(F.filter(k, lambda c: c["kind"] == what))
        bad = F.transform(F.filter(k, lambda c: c["kind"] == "fail"), lambda c: F.concat(F.lit("    "), T.utrim(c["line"]), F.lit("\n")))
        wait = bound(n("wait"), lambda w: F.when(w > 0, text("  [pending] Pending: ", w, "\n")).otherwise(""))
        return F.concat(text("CI Checks Summary:\n  [ok] Passed: ", n("ok"), "\n  [FAIL] Failed: ", n("fail"), "\n"), wait, F.when(F.size(bad) > 0, F.concat(F.lit("\n  Failed checks:\n"), F.array_join(bad, ""))).otherwise(""))

    return bound(F.transform(T.lines(x), lambda s: F.struct(kind(s).alias("kind"), s.alias("line"))), told)
