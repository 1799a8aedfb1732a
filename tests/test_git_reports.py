"""Short texts of version control output."""

import random

from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.operators import git_reports as G


def made(spark, f, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f("t").alias("r")).orderBy("i").collect()
    return [r.r for r in rows] if len(rows) > 1 else rows[0].r


def plain_diff(diff, most=500):
    out, file, added, removed, inside, shown, skipped, cut = [], "", 0, 0, False, 0, 0, False
    lines = diff.split("\n")
    for line in lines[:-1] if lines[-1] == "" else lines:
        if line.startswith(("diff --git", "@@")):
            if skipped:
                out, cut, skipped = [*out, f"  ... ({skipped} lines truncated)"], True, 0
            shown = 0
            if line.startswith("@@"):
                inside, out = True, [*out, "  " + line]
            else:
                if file and added + removed:
                    out.append(f"  +{added} -{removed}")
                file, added, removed, inside = (line.split(" b/", 1)[1] if " b/" in line else "unknown"), 0, 0, False
                out.append("\n" + file)
        elif inside:
            plus, minus = line.startswith("+") and not line.startswith("+++"), line.startswith("-") and not line.startswith("---")
            added, removed = added + plus, removed + minus
            if plus or minus:
                out, shown, skipped = ([*out, "  " + line], shown + 1, skipped) if shown < 100 else (out, shown, skipped + 1)
            elif 0 < shown < 100 and not line.startswith("\\"):
                out, shown = [*out, "  " + line], shown + 1
        if len(out) >= most:
            out, cut = [*out, "\n... (more changes truncated)"], True
            break
    if skipped:
        out, cut = [*out, f"  ... ({skipped} lines truncated)"], True
    if file and added + removed:
        out.append(f"  +{added} -{removed}")
    return "\n".join(out + ["[full diff: sieveline git diff --no-compact]"] * cut)


def test_diff(spark):
    rng = random.Random(4)
    kinds = ["+a", "-b", " c", "\\ No newline", "+++ x", "--- y", "@@ -1,2 +3 @@ def f", "diff --git a/x b/y z", "diff --git odd", "plain"]
    some = ["\n".join(rng.choices(kinds, [9, 9, 9, 1, 1, 1, w, 1, 1, 2], k=n)) + rng.choice(["", "\n"]) for n, w in ((0, 1), (1, 1), (30, 3), (400, 1), (900, 1), (300, 0.1))]
    assert made(spark, G.diff, *some) == [plain_diff(t) for t in some]
    assert made(spark, lambda t: G.diff(t, 20), *some) == [plain_diff(t, 20) for t in some]


def test_log(spark):
    text = "abc123 Fix (1 day ago) <me>\n\n  body one\nSigned-off-by: x\nbody two\n" + "b" * 90 + "\nfour\nCo-authored-by: y\nfive\n---END---\n\n---END---\ndef456 Second\n---END---\n"
    want = "abc123 Fix (1 day ago) <me>\n  body one\n  body two\n  " + "b" * 77 + "...\n  [+2 lines omitted]\ndef456 Second"
    assert made(spark, G.log, text, "", "x" * 81) == [want, "", "x" * 77 + "..."]
    assert made(spark, lambda t: G.log(t, 2), text) == want.removesuffix("\ndef456 Second") and "b" * 90 in made(spark, lambda t: G.log(t, 1, asked=True), text) and made(spark, lambda t: G.log(t, 1, asked=True), text).endswith("Second")
    assert made(spark, lambda t: G.log(t, 2, own_format=True), "a\n" + "b" * 90 + "\nc") == "a\n" + "b" * 77 + "..." and made(spark, lambda t: G.log(t, 1, True, True), "a\nb") == "a\nb"


def test_log_saves_tokens(spark):
    """Three fifths of the words of twenty long commits are saved."""
    raw = "\n".join(f"commit abc123{i}\nAuthor: User Name <user@example.com>\nDate:   Mon Mar 10 10:00:00 2026 +0000\n\n    fix: commit message number {i}\n\n    Extended body with details about the change.\n" for i in range(20))
    out = made(spark, lambda t: G.log(t, 10), raw)
    assert 100 - 100 * len(out.split()) / len(raw.split()) >= 60


def test_status(spark):
    assert made(spark, G.status, "", "## main\n", "## main...origin/main [ahead 1]\n M a.py\n\n?? b\n", " M a\n M b") == ["Clean working tree", "* main\nclean — nothing to commit", "* main...origin/main [ahead 1]\n M a.py\n?? b", " M a\n M b"]
    assert made(spark, lambda t: G.status(t, "HEAD detached at abc"), "## HEAD (no branch)\n M a") == "* HEAD detached at abc\n M a"
    plain = 'On branch main\nYou have unmerged paths.\n  (fix conflicts)\n\nUnmerged paths:\n  (use "git add <file>..." to mark)\n\tboth modified: a\n'
    assert made(spark, G.under_way, plain, "On branch x\nChanges to be committed:\nYou are currently bisecting", "interactive rebase in progress; onto abc\nLast command done", "On branch x", "HEAD detached at 1\nYou are in a sparse checkout with 3%") == ["merge in progress. unresolved conflicts", None, "rebase in progress", None, "sparse checkout enabled"]
    assert made(spark, G.detached_head, "x\n  HEAD detached at abc123\nnothing", "On branch main") == ["HEAD detached at abc123", None]
    assert made(spark, G.plain_status, plain, "On branch main\n\n  nothing to commit, working tree clean\nrest", "\n \n") == ["On branch main\nYou have unmerged paths.\n  (fix conflicts)\nUnmerged paths:\n\tboth modified: a", "On branch main\nnothing to commit, working tree clean", "ok"]


def test_branches(spark):
    some = "  a\n* main\n  remotes/origin/HEAD -> origin/main\n  remotes/origin/main\n  remotes/origin/x/y\n  remotes/up/x/y\n  remotes/up/a\n  remotes/odd\n"
    assert made(spark, G.branches, some, "", "* (HEAD detached at 1)\n") == ["* main\n  a\n  remote-only (1):\n    x/y", "* ", "* (HEAD detached at 1)"]
    many = "* main\n" + "".join(f"  remotes/o/b{i:02}\n" for i in range(25))
    assert made(spark, G.branches, many) == "* main\n  remote-only (25):\n" + "\n".join(f"    b{i:02}" for i in range(G.REMOTE)) + "\n    ... +15 more"


def test_checks(spark):
    assert made(spark, G.checks, "build\tpass\n lint fail 1m \n* slow\nother\n[x] e2e\n", "all pass") == ["CI Checks Summary:\n  [ok] Passed: 1\n  [FAIL] Failed: 2\n  [pending] Pending: 1\n\n  Failed checks:\n    lint fail 1m\n    [x] e2e\n", "CI Checks Summary:\n  [ok] Passed: 1\n  [FAIL] Failed: 0\n"]


def test_null(spark):
    assert all(v is None or isinstance(v, str) for v in spark.range(1).select(*[f(F.lit(None).cast("string")).alias(f.__name__) for f in (G.diff, G.log, G.status, G.branches, G.checks, G.plain_status)]).first()) and T.lines is not None
