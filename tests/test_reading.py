"""Source, markup and unknown output."""

import pytest
from pyspark.sql import functions as F

from sieveline.operators import overview as OV
from sieveline.operators import packages as PK
from sieveline.operators import reading as R


@pytest.mark.parametrize(
    ("made", "want"),
    [
        (lambda: R.minimal_source(F.lit("// a\nfn x() {}\n\n\n/* b\n c */\nlet y;\n"), F.lit("rust")), "fn x() {}\n\nlet y;"), (lambda: R.minimal_source(F.lit('#!/bin/x\n# c\n"""doc"""\nx = 1'), F.lit("python")), '"""doc"""\nx = 1'),
        (lambda: R.minimal_source(F.lit("a\n\n\n\nb"), F.lit("unknown")), "a\n\nb"), (lambda: R.smart_truncate(F.lit("a\nb\nc\nd\nfn z()\ne"), 4), "a\nb\nfn z()\n[3 more lines]"), (lambda: R.smart_truncate(F.lit("a\nb"), 4), "a\nb"),
        (lambda: R.tail_window(F.lit("a\nb\nc\n"), 2), "b\nc\n"), (lambda: R.aggressive_source(F.lit("use a;\nconst X: i = 1;\nfn f() {\n    let y = 1;\n}\nlet z = 2;"), F.lit("rust")), "use a;\nconst X: i = 1;\nfn f() {\n    // ... implementation\nlet z = 2;"), (lambda: R.read_source(F.lit("// only"), F.lit("go"), numbers=True), "1 │ // only"), (lambda: R.markdown_body(F.lit("# T\n<!-- x -->\n![b](u)\n---\n\n\n\ntext\n```\n<!-- stays -->\n\n\n\nx\n```")), "# T\n\ntext\n```\n<!-- stays -->\n\n\n\nx\n```"),
        (lambda: OV.kind(F.lit("cargo test"), F.lit("x")), "tests"), (lambda: OV.kind(F.lit("x"), F.lit('{"a": 1}')), "json"), (lambda: OV.kind(F.lit("x"), F.lit("Error: a")), "logs"), (lambda: OV.kind(F.lit("x"), F.lit("\n".join("abcdefghijkl"))), "list"), (lambda: OV.kind(F.lit("x"), F.lit("a\tb")), "generic"),
        (lambda: R.summarize(F.lit("x"), F.lit("error a\nwarn b\n3 failed")).getField("errors"), 1), (lambda: R.code_profile(F.lit("import a\ndef f():\nclass B:")).getField("types"), 1), (lambda: R.wc_row(F.lit("  3 4 5 f.txt")).getField("bytes"), 5),
        (lambda: R.surefire(F.lit("[ERROR] T.a  Time: 1 <<< FAILURE!\nTests run: 4, Failures: 1, Errors: 0, Skipped: 2")).getField("failing"), ["T.a"]), (lambda: R.gradle_build(F.lit("> Task :a UP-TO-DATE\n> Task :b FAILED\ne: x\nplain\nBUILD FAILED\n3 actionable tasks")), "e: x\nBUILD FAILED\n3 actionable tasks\n"),
        (lambda: PK.script_report(F.lit("> x@1\nnpm WARN a\n\n")), "ok"), (lambda: PK.install_report(F.lit("Progress: 1\n+ a 1\nx")), "+ a 1"),
    ],
)
def test_column(spark, made, want):
    assert spark.range(1).select(made().alias("x")).first().x == want
