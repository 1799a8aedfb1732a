"""The token stream of shell commands and what is rewritten by it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sieveline.functions import shell
from sieveline.plans.catalog import DEFS

HANDLED = ("git", "cargo", "go", "ls", "grep", "find", "curl")
REWRITTEN = {
    "git status": "px git status", "px git status": "px git status", "px git add . && cargo test": "px git add . && px cargo test", "GIT_PAGER=cat git status": "GIT_PAGER=cat px git status",
    'GIT_SSH_COMMAND="ssh -o A=no" git push': 'GIT_SSH_COMMAND="ssh -o A=no" px git push', "A='b c' env git x": "A='b c' env px git x", "sudo git status": "sudo px git status",
    "cargo build --all && cargo build && cargo test": "px cargo build --all && px cargo build && px cargo test", "git add . ; cargo test": "px git add .; px cargo test", "git a;": "px git a;",
    "git status || cargo test": "px git status || px cargo test", "cargo test & git status": "px cargo test & px git status", "cargo test & htop": "px cargo test & htop", "git add a&& ls": "px git add a && px ls",
    "git log -10 | grep feat": "px git log -10 | grep feat", "htop && cargo test": "htop && px cargo test", "git status 2>&1": "px git status 2>&1", "cargo test 2>&1 && git status": "px cargo test 2>&1 && px git status",
    "git status 2>/dev/null": "px git status 2>/dev/null", "git log 2> /dev/null": "px git log 2> /dev/null", "git x &> /dev/null | git y": "px git x &> /dev/null | git y", "git \\\n status": "px git status",
    "/usr/bin/git status": "px /usr/bin/git status", "git.exe st": "px git.exe st", 'git commit -m "a && git b"': 'px git commit -m "a && git b"', "git log '`x` $(y)'": "px git log '`x` $(y)'", 'git "a\\"b" ; ls': 'px git "a\\"b"; px ls',
}
LEFT_ALONE = (
    "htop -d 10", "", "   ", "htop && less foo", "find . -name '*.rs' | xargs grep fn", "find . -name '*.rs'", "git status `rm x`", "git status $(rm x)", 'git log --pretty="$(rm x)"', "git diff <(cat s)", "git log > /tmp/out.txt",
    "git log >> f", "cat <<'EOF'\nfoo\nEOF", "git diff <<EOF\nhi\nEOF", "git log $((1+1))", "git x >& file", "git x < in", "GIT='x'y git z", "curlfoo", None,
)


def test_rewriting(spark):
    rows = spark.createDataFrame([*REWRITTEN.items(), *((x, None) for x in LEFT_ALONE)], "command string, want string")
    for r in rows.withColumn("got", shell.rewrite("command", "px", HANDLED)).collect():
        assert r.got == r.want, r


def test_excluded_and_routed(spark):
    made = {f"{e}|{c}": shell.rewrite(F.lit(c), "px", ("git", "curl"), excluded=[e]) for e in ("git", "^git", "gi", "", "curl") for c in ("git status", "curl https://x", "git")}
    got = spark.range(1).select(*[v.alias(str(i)) for i, v in enumerate(made.values())]).first()
    for (k, _), v in zip(made.items(), got, strict=True):
        e, c = k.split("|")
        assert (v is None) == (e.lstrip("^") == c.split()[0]), k
    routed = spark.range(1).select(shell.rewrite(F.lit("/usr/bin/make all && htop"), "px", (), DEFS), shell.rewrite(F.lit("htop"), "px", (), DEFS)).first()
    assert tuple(routed) == ("px /usr/bin/make all && htop", None)


def test_tokens_cover_the_command(spark):
    rng = random.Random(1)
    parts = ["git", " ", "  ", "&&", "||", "|", "&", ";", "2>&1", "&>", ">", "<<", "'a b'", '"c;d\\""', "\\ ", "\n", "12", "é", "'", '"', "\\"]
    cmds = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300)]
    for r in spark.createDataFrame([(x,) for x in cmds], "x string").select("x", shell.lex("x").alias("t")).collect():
        assert "".join(t.value for t in r.t) == r.x
        assert all(r.x[t.at : t.at + len(t.value)] == t.value for t in r.t)
        assert all((t.kind == "blank") == (not t.value.strip()) for t in r.t)


def test_long_quotes_and_words(spark):
    long = "x y\\\"" * 50_000
    got = spark.createDataFrame([(f'git commit -m "{long}"',), ("git " + "a1" * 100_000,)], "x string").select(shell.rewrite("x", "px", ("git",)).alias("y"), "x").collect()
    assert all(r.y == "px " + r.x for r in got)


@pytest.mark.parametrize(("command", "words"), [("a 'b c' \"d\\\"e\" f\\ g ''", ["a", "b c", 'd"e', "f g", ""]), ('"x\\\\" it\\\'s', ["x\\", "it's"]), ("'op en", ["op en"]), ('a"b"c\\', ["abc\\"]), ("", []), ("  ", [])])
def test_words(spark, command, words):
    assert spark.range(1).select(shell.tokenize(F.lit(command))).first()[0] == words


def test_no_python_worker(spark):
    plan = spark.createDataFrame([("git x",)], "x string").select(shell.rewrite("x", "px", ("git",)), shell.tokenize("x"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow", plan.replace("ExistingRDD", ""))
