"""Text functions, shell, JSON printers, sources, parsers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from sieveline.functions import json_shape, json_tokens, shell
from sieveline.functions import text as T
from sieveline.operators import analytics, cloud, diagnostics, joins, listings, ranking, test_results, transcripts, vcs
from sieveline.sources import readers
from sieveline import streaming


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize(
    ("made", "want"),
    [
        (lambda: T.utrim(F.lit(" \t a\u0085\n")), "a"), (lambda: T.est_tokens(F.lit("é" * 3)), 2), (lambda: T.count_lines(F.lit("a\nb\n")), 2), (lambda: T.count_lines(F.lit("")), 0),
        (lambda: T.normalize_newlines(F.lit("a\r\nb\rc")), "a\nb\nc"), (lambda: T.ellipsis(F.lit("abcdef"), 5), "ab..."), (lambda: T.ellipsis(F.lit("abcdef"), 2), "..."), (lambda: T.ellipsis(F.lit("abcdef"), 5, ".."), "abc.."),
        (lambda: T.byte_gated(F.lit("é" * 60)), "é" * 60), (lambda: T.byte_gated(F.lit("é" * 98)), "é" * 97 + "..."), (lambda: T.format_count(F.lit(1234)), "1.2K"), (lambda: T.format_count(F.lit(999)), "999"), (lambda: T.format_count(F.lit(2_500_000)), "2.5M"),
        (lambda: T.human_size(F.lit(2048)), "2.0K"), (lambda: T.human_bytes(F.lit(3 << 30)), "3.0 GB"), (lambda: T.mask_value(F.lit("abcd")), "****"), (lambda: T.mask_value(F.lit("abcdefg")), "ab****fg"),
        (lambda: T.extension(F.lit("a/b.tar.gz")), "gz"), (lambda: T.extension(F.lit(".bashrc")), "none"), (lambda: T.extension(F.lit("Makefile")), "none"), (lambda: T.basename(F.lit("x\\y/z.py")), "z.py"),
        (lambda: T.compact_path(F.lit("a/bb/cccccccccccccccccccccccccccccccc/dddddddddddddddd/e.py")), "a/.../dddddddddddddddd/e.py"), (lambda: T.anchored_path(F.lit("/x/src/a/b.py"), ["src", "lib"]), "src/a/b.py"),
        (lambda: T.short_arn(F.lit("arn:aws:iam::1:role/x")), "x"), (lambda: T.short_arn(F.lit("arn:a:b")), "b"), (lambda: T.perms_to_octal(F.lit("-rwxr-xr-x")), "755"), (lambda: T.perms_to_octal(F.lit("-rwsr-xr-t")), "5755"),
        (lambda: T.normalize_log(F.lit("2024-01-02 03:04:05.678 failed 0xAF at /usr/x id 12345")), "failed <HEX> at <PATH> id <NUM>"), (lambda: T.log_severity(F.lit("Warning: ERROR")), "error"),
        (lambda: T.progress_bar(F.lit(45.0)), "@@@@@....."), (lambda: T.number_lines(F.lit("a\nb")), "1 │ a\n2 │ b"), (lambda: T.char_similarity(F.lit(""), F.lit("")), 1.0),
        (lambda: shell.command_name(F.lit("FOO=1 sudo /usr/bin/git.exe log")), "git"), (lambda: shell.base_command(F.lit("git log -3")), "git log"), (lambda: shell.base_command(F.lit("git -C x")), "git"), (lambda: shell.base_command(F.lit("ls a/b")), "ls"),
        (lambda: shell.split_chain(F.lit("a && b 'x;y' || c; d & e | f")), ["a", "b 'x;y'", "c", "d & e", "f"]), (lambda: shell.split_chain(F.lit("cat <<E; x")), ["cat <<E; x"]),
        (lambda: shell.tokenize(F.lit("a 'b c' \"d\\\"e\" f\\ g ''")), ["a", "b c", 'd"e', "f g", ""]), (lambda: shell.rewrite(F.lit("cd x && sudo git log | ls; ls"), "px", ("git", "ls")), "cd x && sudo px git log | ls; ls"),
        (lambda: shell.redirects_to_file(F.lit("a > b")), True), (lambda: shell.redirects_to_file(F.lit("a 2>&1")), False), (lambda: shell.encode_project(F.lit("/a b/c.d")), "-a-b-c-d"),
        (lambda: json_tokens.compact(F.lit('{"b": 1.50, "a": [1,2,3,4,5,6]}')), "{\n  a:\n  [1, ... +5 more]\n  b: 1.50\n}"), (lambda: json_tokens.compact(F.lit("no")), None),
        (lambda: json_tokens.shape(F.lit('{"a": 1e3, "b": "2024-01-02", "c": null, "d": [true, 1]}')), "{\n  a: float,\n  b: date?,\n  c: null,\n  d:\n  [bool] (2)\n}"),
        (lambda: json_shape.typed_item(F.lit('{"i": {"N": "1.0"}, "l": {"L": [{"S": "x"}, {"NULL": true}]}}')), '{"i":1.0,"l":["x",null]}'), (lambda: json_shape.extract_object(F.lit('noise { x {"a": "}"} tail')), '{"a": "}"}'),
        (lambda: ranking.overflow(F.array(*map(F.lit, "abc")), 2), "a\nb\n... +1 more"), (lambda: vcs.parse_commit(F.lit("[main 0123456789] msg")), "ok 0123456"), (lambda: vcs.parse_commit(F.lit("x")), "ok"),
        (lambda: test_results.cargo_lines(F.lit("test result: ok. 3 passed; 1 failed; 0 ignored; 0 measured; 2 filtered out\ntest result: ok. 4 passed; 0 failed; 1 ignored; 0 measured; 0 filtered out")).getField("passed"), 7),
        (lambda: test_results.pytest_summary(F.lit("== 2 failed, 5 passed, 1 error in 0.3s ==")).getField("errors"), 1), (lambda: test_results.error_blocks(F.lit("ok\nerror: x\n  at y\n\n  z\n\n\nok")), "error: x\n  at y\n\n  z\n"),
        (lambda: transcripts.error_kind(F.lit("bash: foo: command not found")), "not_found"), (lambda: cloud.transfers(F.lit("upload: a to b\nupload: c\nfailed x")).getField("upload"), 2), (lambda: readers.language(F.lit("a/b.PY")), "python"),
        (lambda: analytics.period(F.timestamp_seconds(F.lit(1_700_000_000)), "week"), "2023-11-13"), (lambda: analytics.period(F.lit(None).cast("timestamp"), "day"), "unknown"),
    ],
)
def test_column(spark, made, want):
    assert one(spark, made()) == want


def test_sources(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"ts": "2024-01-01T00:00:00Z", "cmd": "a", "raw_tokens": 10, "out_tokens": 4}\n{bad\n{"cmd": "b", "passthrough": true}\n')
    assert readers.tracker(spark, str(tmp_path / "t.jsonl")).count() == 2 and [r.cmd for r in readers.tracker_until_malformed(spark, str(tmp_path / "t.jsonl")).collect()] == ["a"]
    g = analytics.gain(readers.tracker(spark, str(tmp_path / "t.jsonl"))).first()
    assert (g.total_commands, g.passthrough_commands, g.tokens_saved, g.saved_pct) == (2, 1, 6, 60.0)
    readers.write_tracker(readers.tracker(spark, str(tmp_path / "t.jsonl")), str(tmp_path / "out"))
    assert readers.tracker(spark, str(tmp_path / "out")).count() == 2
    use = lambda i, c: {"type": "assistant", "message": {"model": "m", "usage": {"input_tokens": 3}, "content": [{"type": "tool_use", "name": "Bash", "id": i, "input": {"command": c}}]}}
    res = lambda i, c, **k: {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": i, "content": c, **k}]}}
    lines = [use("1", "git log && ls"), res("1", "old"), res("1", [{"type": "text", "text": "ab"}, {"type": "text", "text": "c"}], is_error=True), use("2", "make"), {"type": "user", "message": {"content": "plain"}}, "bad"]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    entries = readers.transcripts(spark, str(tmp_path / "s"))
    cmds = readers.commands(entries)
    assert sorted((r.command, r.output, r.output_len, r.is_error) for r in cmds.collect()) == [("git log && ls", "abc", 3, True), ("make", "", -1, False)]
    assert [r.input for r in readers.usage(entries).collect()] == [3, 3]
    segs = transcripts.segments(cmds, ["git"], [])
    good, rest = transcripts.discover(segs)
    assert [(r.command, r.n, r.saved_tokens) for r in good.collect()] == [("git", 1, 0)] and [(r.command, r.n) for r in rest.collect()] == [("ls", 1), ("make", 1)]
    cov = transcripts.coverage(segs, "git").first()
    assert (cov.total, cov.covered, cov.output_bytes) == (3, 1, 3)
    (tmp_path / "c.txt").write_bytes(b"a\r\nb")
    assert readers.captures(spark, str(tmp_path / "c.txt"), cap=3).select("text", "over_cap").first() == ("a\nb", True)
    assert readers.captures(spark, str(tmp_path / "c.txt"), most=3).select("text", "over_cap").collect() == [(None, True)]
    files = readers.walk(readers.file_rows(spark, str(tmp_path)), "*.jsonl")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.collect()) == ["t.jsonl", "x.jsonl"]


def test_corrections(spark):
    c = spark.createDataFrame([(1, "git commit --ammend -m x", True, "unknown option"), (0, "git commit --amnd -m x", True, "user rejected: error"), (2, "ls", False, "y"), (3, "git commit --amend -m x", False, "ok"), (4, "git comit --amend -m x", True, "z")], "seq int, command string, is_error boolean, output string").withColumn("file", F.lit("f"))
    got = analytics.corrections(c, ["file"], ["seq"]).collect()
    assert [(r.command, r.correction, round(r.confidence, 3)) for r in got] == [("git commit --ammend -m x", "git commit --amend -m x", 0.95)]


def test_diff_and_notes(spark):
    d = spark.createDataFrame([("a\nhello\nc", "a\nhallo\nzzz\nnew")], "x string, y string").select(joins.positional_diff(F.col("x"), F.col("y")).alias("d")).first().d
    assert [(r.pos, r.kind) for r in d] == [(2, "modified"), (3, "replaced"), (4, "added")]
    text = "m.py:1: error: bad [code]\nm.py:1: note: hint\nn.py:2:3: warning: w\nFound 1"
    diags = diagnostics.from_text(spark.createDataFrame([(1, text)], "id int, text string"), "mypy")
    got = {r.file: (r.line, r.col, r.severity, r.code, r.notes) for r in diagnostics.attach_notes(diags).collect()}
    assert got == {"m.py": (1, None, "error", "code", ["hint"]), "n.py": (2, 3, "warning", None, None)}


@pytest.mark.parametrize(
    ("tool", "text", "want"),
    [
        ("tsc", "a.ts(1,2): error TS1: m", ("a.ts", 1, "TS1")), ("go", "vet: ./a.go:3:1: m", ("./a.go", 3, None)), ("gcc", "a.c:1:2: warning: m [-Wx]", ("a.c", 1, "-Wx")), ("msbuild", "  A.cs(3,4): error CS1: m [p]", ("A.cs", 3, "CS1")),
        ("eslint", '[{"filePath":"a.js","messages":[{"ruleId":"r","severity":2,"message":"m","line":4,"column":1}]}]', ("a.js", 4, "r")), ("golangci", '{"Issues":[{"FromLinter":"l","Text":"m","Pos":{"Filename":"a.go","Line":2,"Column":1}}]}', ("a.go", 2, "l")),
        ("pylint", '[{"type":"error","path":"a.py","line":1,"column":0,"symbol":"s","message":"m"}]', ("a.py", 1, "s")), ("rubocop", '{"files":[{"path":"a.rb","offenses":[{"cop_name":"c","severity":"error","message":"m","location":{"start_line":9,"start_column":1}}]}]}', ("a.rb", 9, "c")),
        ("dotnet-format", '[{"FilePath":"a.cs","FileChanges":[{"LineNumber":1,"CharNumber":2,"DiagnosticId":"d","FormatDescription":"m"}]}]', ("a.cs", 1, "d")),
    ],
)
def test_diagnostics(spark, tool, text, want):
    df = spark.createDataFrame([(1, text), (2, "nothing")], "id int, text string")
    got = (diagnostics.from_text if tool in diagnostics.FORMATS else diagnostics.from_json)(df, tool).collect()
    assert [(r.file, r.line, r.code) for r in got] == [want] and got[0].message == "m"


def test_test_runners(spark):
    j = '{"testResults":[{"name":"s","assertionResults":[{"fullName":"a","status":"passed","failureMessages":[]},{"fullName":"b","status":"failed","failureMessages":["x","y"]}]}]}'
    r = '{"examples":[{"full_description":"d","status":"pending","file_path":"f","line_number":1,"run_time":0.5,"exception":null}]}'
    assert [(x.test, x.status, x.message) for x in test_results.jest_json(spark.createDataFrame([(1, j)], "id int, text string")).collect()] == [("a", "pass", ""), ("b", "fail", "x\ny")]
    t = test_results.totals(test_results.rspec_json(spark.createDataFrame([(1, r)], "id int, text string"))).first()
    assert (t.passed, t.failed, t.skipped, t.seconds) == (0, 0, 1, 0.5)
    g = "\n".join(json.dumps(x) for x in [{"Action": "output", "Package": "p", "Test": "T", "Output": "boom\n"}, {"Action": "fail", "Package": "p", "Test": "T", "Elapsed": 1.0}, {"Action": "pass", "Package": "p"}]) + "\nnoise"
    assert [(x.test, x.status, x.message) for x in test_results.go_events(spark.createDataFrame([(1, g)], "id int, text string")).collect()] == [("T", "fail", "boom\n")]


def test_listings_and_vcs(spark):
    df = lambda text: spark.createDataFrame([(1, text)], "id int, text string")
    ls = listings.ls_rows(df("total 8\ndrwxr-xr-x  2 u g 64 Jan  1 12:00 .\n-rw-r--r--  1 u g 12 Jan  1 12:00 a b.txt\nlrwxr-xr-x  1 u g 1 Jan  1 12:00 l -> x")).collect()
    assert [(r.name, r.kind, r.size, r.mode, r.ext) for r in ls] == [("a b.txt", "file", 12, "644", "txt"), ("l", "link", 1, "755", None)]
    assert [(r.dir, r.name, r.depth) for r in listings.path_rows(df("./a/b/c.py\nd")).collect()] == [("a/b", "c.py", 3), (".", "d", 1)]
    assert [(r.dir, r.names, r.n) for r in listings.grouped_paths(listings.path_rows(df("a/1\na/2\na/3\nb/1")), dirs=1, files=2).collect()] == [("a", ["1", "2"], 3)]
    env = {r.name: (r.group, r.shown) for r in listings.env_rows(df("PATH=/a\nUSER_KEY=abcdefgh\nAWS_REGION=x\nZ=1\nMY_GO=" + "v" * 101)).collect()}
    assert env == {"PATH": ("path", "/a"), "USER_KEY": ("other", "ab****gh"), "AWS_REGION": ("cloud", "x"), "MY_GO": ("language", "v" * 50 + "... (101 chars)")}
    assert [r.cells for r in listings.psql_rows(df(" a | b \n---+---\n 1 | x \n(1 row)")).collect()] == [["a", "b"], ["1", "x"]]
    assert [(r.kind, r.name) for r in vcs.branches(df("* main\n  dev\n  remotes/origin/dev\n  remotes/origin/new\n  remotes/origin/HEAD -> x")).orderBy("kind", "name").collect()] == [("current", "main"), ("local", "dev"), ("remote", "new")]
    c = vcs.commits(df("commit abcdef1234\nAuthor: A <a>\n\n    subj\n\n    b1\n    b2\n    b3\n    b4\ncommit 1234567\nAuthor: B\n\n    s2"), body=3).orderBy("commit_at").collect()
    assert [(r.hash, r.subject, r.body, r.omitted) for r in c] == [("abcdef1", "subj", ["b1", "b2", "b3"], 1), ("1234567", "s2", [], 0)]
    assert [(r.kind, r.path) for r in vcs.status_rows(df("## main\nM  a\n M b\n?? c\nUU d")).collect()] == [("branch", "main"), ("staged", "a"), ("modified", "b"), ("untracked", "c"), ("conflict", "d")]
    assert [(r.stash, r.message) for r in vcs.stashes(df("stash@{0}: WIP on main: 123 x")).collect()] == [("stash@{0}", "123 x")]
    k = vcs.checks(df("build pass 1m\nlint fail\ndeploy pending\nerrors passed")).first()
    assert (k.passed, k.failed, k.pending) == (2, 1, 1)
    ev = '{"events":[{"timestamp":0,"message":"a"},{"timestamp":1000,"message":"a "},{"timestamp":3661000,"message":"b"}]}'
    assert [(r.clock, r.message) for r in cloud.log_events(df(ev)).orderBy("at").collect()] == [("??:??:??", "a"), ("01:01:01", "b")]
    pr = '[{"number":1,"title":"t","state":"OPEN","author":{"login":"u"},"updatedAt":"2024-01-02T00"},{"number":2,"title":"x","state":"OPEN","author":null,"updatedAt":null}]'
    assert cloud.listing(cloud.rows(df(pr), "pull-requests"), ["id", "title", "author", "day"], cap=1).first().text == "#1 t u 2024-01-02\n... +1 more"
    assert all(cloud.rows(df("{}"), kind).count() == 0 for kind in cloud.ANSWERS)


def test_streams(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:05:00", 10, 4, False), ("2024-01-01 00:50:00", 8, 8, True), ("2024-01-01 03:00:00", 6, 1, False)], "ts string, raw_tokens long, out_tokens long, passthrough boolean").select(F.to_timestamp("ts").alias("ts"), "raw_tokens", "out_tokens", "passthrough").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, raw_tokens long, out_tokens long, passthrough boolean").parquet(str(tmp_path / "in"))
    q = streaming.windowed_gain(stream).writeStream.outputMode("complete").format("memory").queryName("gain").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.commands, r.tokens_saved) for r in spark.table("gain").collect())
    assert got == [(1, 5), (2, 6)]
