"""Queries over packages, overviews, version control, linters in JSON, listings, transcripts and shell commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import json_shape as JS
from .functions import arguments as AR
from .functions import shell as S
from .functions import text as T
from .operators import cloud, diagnostics, joins, listings, ranking, vcs
from .operators import overview as OV
from .operators import packages as PK
from .operators import reading as RD
from .operators import runners as RU
from .operators import test_results as TR
from .operators import tools as TO
from .answer_queries import _items, _st
from .parser_queries import _k, _s, blob
from .queries import query, table
from .report_queries import NL, _each, _first, _pick, _report, _rows, _sql

# packages and nested reports


@query("SELECT p_partkey // 100 AS id, count(*) + 1 + count(*) FILTER (p_partkey % 3 = 0) AS packages, count(*) FILTER (p_partkey % 2 = 0) + count(*) FILTER (p_partkey % 6 = 0) AS dev, max(CASE WHEN p_partkey % 3 = 0 THEN 'deep' || p_partkey END) AS deepest FROM part GROUP BY 1")
def package_trees(spark, sf_dir):
    """A package for each part, every third with one below it, every second for development."""
    deep = F.when(_k() % 3 == 0, F.concat(F.lit(',"dependencies":{"deep'), _s(_k()), F.lit('":{"version":"2"}}'))).otherwise("")
    node = _s('"p', _k(), '":{"version":"1"', deep, "}")
    g = table(spark, sf_dir, "part").groupBy(F.floor(_k() / 100).alias("id")).agg(F.array_join(F.collect_list(F.when(_k() % 2 == 1, node)), ",").alias("a"), F.array_join(F.collect_list(F.when(_k() % 2 == 0, node)), ",").alias("b"))
    rows = PK.nested_packages(g.select("id", _s('[{"name":"root","version":"0","dependencies":{', F.col("a"), '},"devDependencies":{', F.col("b"), "}}]").alias("text")))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("packages"), F.count_if("dev").alias("dev"), F.max(F.when(F.col("name").startswith("deep"), F.col("name"))).alias("deepest"))


@query(_sql("list('  p' || k || ' 1.' || k ORDER BY k) FILTER (k % 4 <> 0) AS a, list('  @s/d' || k || ' 2' ORDER BY k) FILTER (k % 4 = 0) AS b, count(*) AS n", f"n || ' packages (' || len(a) || ' prod / ' || len(b) || ' dev)' || {NL} || '[prod]' || {NL} || " + _first("a", 50, NL, f"{NL} || '  … +' || # || ' more'") + f" || {NL} || '[dev]' || {NL} || " + _first("b", 50, NL, f"{NL} || '  … +' || # || ' more'")))
def package_listing(spark, sf_dir):
    # sections take turns, as a listing of several projects does
    line = F.when(_k() % 4 == 0, _s("devDependencies:\n@s/d", _k(), "@2 extra\ndependencies:")).otherwise(_s("p", _k(), "@1.", _k()))
    return _report(spark, sf_dir, lambda x: PK.listing(PK.text_packages(x)), line, "Legend: production dependency\n\ndependencies:\n")


@query(_each("'a|1|2|true;p' || k || '|1|1|false'"))
def outdated_packages(spark, sf_dir):
    raw = _s('{"p', _k(), '":{"current":"1","latest":"1","wanted":"1"},"a":{"current":"1","latest":"2","dependencyType":"devDependencies"}}')
    return _rows(spark, sf_dir, F.array_join(F.transform(PK.outdated(raw), lambda p: F.concat_ws("|", p["name"], p["current"], p["latest"], p["dev"].cast("string"))), ";"))


@query(_sql("list(CASE WHEN k % 3 = 0 THEN 'ERR ' || k ELSE '+ p ' || k END ORDER BY k) FILTER (k % 3 <= 1) AS l", f"array_to_string(l, {NL}) || {NL} || 'Done, 3 packages in 2s'"))
def install_reports(spark, sf_dir):
    return _report(spark, sf_dir, PK.install_report, _pick(3, _s("ERR ", _k()), _s("  + p ", _k()).substr(3, 1000), F.lit("Progress: 3\n")), "", "\n  Done, 3 packages in 2s")


@query(_sql("list('out ' || k ORDER BY k) FILTER (k % 3 = 0) AS l", f"array_to_string(l, {NL})"))
def script_reports(spark, sf_dir):
    return _report(spark, sf_dir, PK.script_report, _pick(3, _s("out ", _k()), F.lit("  npm WARN x"), F.lit("...")), "> a@1.0.0 build\n\n")


@query("SELECT p_partkey // 100 AS id, count(*) AS specs, count(*) FILTER (p_partkey % 5 = 0) AS failed, min(CASE WHEN p_partkey % 5 = 0 THEN p_partkey END)::VARCHAR AS first_message FROM part GROUP BY 1")
def nested_suites(spark, sf_dir):
    """Specs in suites three deep."""
    tests = F.array(_st(status="expected", results=F.array().cast("array<struct<status:string,errors:array<struct<message:string>>>>")), _st(status="unexpected", results=F.array(_st(status="passed", errors=F.array().cast("array<struct<message:string>>")), _st(status="failed", errors=F.array(_st(message=_s(_k())))))))
    spec = _st(title=_s("t", _k()), ok=_k() % 5 != 0, tests=tests)
    d = _items(spark, sf_dir, spec)
    part = lambda k: F.filter("items", lambda s, i: i % 3 == k)
    suite = lambda k, **more: _st(title=f"s{k}", specs=part(k), **more)
    text = F.to_json(F.struct(F.array(suite(0, file="a.spec.ts", suites=F.array(suite(1, suites=F.array(suite(2)))))).alias("suites")))
    rows = PK.nested_suites(d.select("id", text.alias("text")))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("specs"), F.count_if(~F.col("ok")).alias("failed"), F.min(F.col("message").cast("long")).cast("string").alias("first_message"))


@query(_each("k || ' ' || s || ' 0 a.spec.ts'"))
def text_suites(spark, sf_dir):
    r = PK.text_suites(_s("  \x1b[31m× 1 [x] › a.spec.ts:3 › t\x1b[0m\n  ", F.col("p_size"), " failed\n  ", _k(), " passed (3s)\n"))
    return _rows(spark, sf_dir, _s(r["passed"], " ", r["failed"], " ", r["skipped"], " ", F.array_join(r["failures"], ",")))


# overviews


@query(_sql("list_append(flatten(list(['test ' || k || ' FAILED', 'test ' || k || ' FAILED'] ORDER BY k) FILTER (k % 4 = 0)), 'test result: FAILED. 3 failed') AS f", f"'[FAIL] FAILURES:' || {NL} || array_to_string(list_transform(f[1:10], lambda x: '  ' || x || {NL}), '') || CASE WHEN len(f) > 10 THEN '  ... +' || (len(f) - 10) || ' more failures' || {NL} ELSE '' END || '  a::b' || {NL} || {NL} || 'SUMMARY:' || {NL} || '  test result: FAILED. 3 failed' || {NL}"))
def runner_summaries(spark, sf_dir):
    """``cargo test`` ends in ``go test`` too, so failures count for both runners."""
    line = F.when(_k() % 4 == 0, _s("test ", _k(), " FAILED")).otherwise("test x ... ok")
    return _report(spark, sf_dir, lambda x: OV.runner_summary(x, F.lit("cargo test --all")), line, "", "\nfailures:\n    a::b\ntest result: FAILED. 3 failed")


@query(_each(f"CASE k % 6 WHEN 0 THEN 'Test Results:' || {NL} || '   [ok] ' || k || ' passed' || CASE WHEN s > 0 THEN {NL} || '   [FAIL] ' || s || ' failed' ELSE '' END || {NL} || {NL} || '   Failures:' || {NL} || '   • ' || k || ' passed, ' || s || ' failed' WHEN 1 THEN 'Build Summary:' || {NL} || '   1 crates/files compiled' || {NL} || '   [error] 1 errors' || {NL} || {NL} || '   Errors:' || {NL} || '   • error ' || k WHEN 2 THEN 'Log Summary:' || {NL} || '   [error] 1 errors' || {NL} || '   [warn] 1 warnings' || {NL} || '   [info] 1 info' WHEN 3 THEN 'JSON Output:' || {NL} || '   Array with 1 items' WHEN 4 THEN 'List (2 items):' || {NL} || '   • a' || k || {NL} || '   • b' ELSE 'Output:' || array_to_string(list_transform(range(1, 6), lambda i: {NL} || '   x\t' || i), '') || {NL} || '   ...' || array_to_string(list_transform(range(10, 13), lambda i: {NL} || '   x\t' || i), '') END").replace("p_size AS s", "p_size % 9 + 21 AS s"))
def overviews(spark, sf_dir):
    size = F.col("p_size") % 9 + 21
    raw = _pick(6, _s(_k(), " passed, ", size, " failed"), _s("Compiling a\nerror ", _k()), F.lit("Error: a\nWARN b\ninfo c"), _s("[", _k(), "]"), _s("a", _k(), "\n\nb"), F.lit("\n".join(f"x\t{i}" for i in range(1, 13))))
    return _rows(spark, sf_dir, OV.overview(_pick(6, F.lit("run"), F.lit("go build"), F.lit("run"), F.lit("run"), F.lit("run"), F.lit("run")), raw))


@query(_each("CASE k % 5 WHEN 0 THEN 'tests' WHEN 1 THEN 'build' WHEN 2 THEN 'logs' WHEN 3 THEN 'json' ELSE 'generic' END || ' ' || CASE k % 4 WHEN 0 THEN 'connected' WHEN 1 THEN 'test' WHEN 2 THEN 'lint' ELSE 'other' END || ' ' || CASE k % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'package' WHEN 2 THEN 'compile' ELSE 'passthrough' END"))
def kinds_and_phases(spark, sf_dir):
    kind = OV.kind(_pick(5, F.lit("npm test"), F.lit("make build"), F.lit("x"), F.lit("x"), F.lit("x")), _pick(5, F.lit("a"), F.lit("a"), _s("error: ", _k()), _s(" {", _k()), F.lit("a b c d e f g h i j k")))
    task = RU.gradle_task(F.array(_pick(4, F.lit("connectedCheck"), F.lit("check"), F.lit("detektMain"), F.lit("tasks")), F.lit("--info"), F.lit("clean")))
    return _rows(spark, sf_dir, _s(kind, " ", task, " ", RU.mvn_phase(F.array(F.lit("clean"), _pick(4, F.lit("test"), F.lit("verify"), F.lit("test-compile"), F.lit("a:b")), F.lit("-q")))))


@query(_each(f"CASE k % 2 WHEN 0 THEN 'a_test.go:3: bad ' || k || {NL} || 'context' || {NL} || 'got 1' ELSE 'plain ' || k END"))
def go_failures(spark, sf_dir):
    a = F.when(_k() % 2 == 0, F.array(F.lit("=== RUN T"), F.lit("noise"), _s("    a_test.go:3: bad ", _k()), F.lit("   context"), F.lit("more"), F.lit("got 1"), F.lit("--- FAIL: T"))).otherwise(F.array(F.lit("=== RUN x"), _s(" plain ", _k()), F.lit("other")))
    return _rows(spark, sf_dir, F.array_join(RU.go_failure_lines(a), "\n"))


@query(_sql("count(*) FILTER (k % 2 = 0) AS p, count(*) FILTER (k % 2 = 1) AS f, count(*) AS n", "p || '|' || f || '|' || n || '|' || (3 * n)"))
def cargo_totals(spark, sf_dir):
    line = _s("test result: x. ", F.when(_k() % 2 == 0, "1").otherwise("0"), " passed; ", F.when(_k() % 2 == 1, "1").otherwise("0"), " failed; 3 ignored; 0 measured; 0 filtered out")
    return _report(spark, sf_dir, lambda x: _s(TR.cargo_lines(x)["passed"], "|", TR.cargo_lines(x)["failed"], "|", TR.cargo_lines(x)["suites"], "|", TR.cargo_lines(x)["ignored"]), line)


# version control


@query(_each("'b' || k || ' current|b local|r' || k || ' remote'"))
def branch_rows(spark, sf_dir):
    raw = _s("* b", _k(), "\n  b\n  remotes/origin/b\n  remotes/origin/r", _k(), "\n  remotes/origin/HEAD -> origin/b")
    rows = vcs.branches(table(spark, sf_dir, "part").select(_k().alias("id"), raw.alias("text")))
    return rows.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "name"))), lambda r: _s(r["name"], " ", r["kind"])), "|").alias("report"))


@query(_each("'stash@{0} work ' || k || '|ok abc1234|branch:main,staged:a,modified:b,untracked:c' || k || ',conflict:d'"))
def stash_and_status(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    stash = vcs.stashes(p.select(_k().alias("id"), _s("stash@{0}: WIP on main: work ", _k(), "\n").alias("text"))).select("id", _s(F.col("stash"), " ", F.col("message")).alias("a"))
    rows = vcs.status_rows(p.select(_k().alias("id"), _s("## main\nM  a\n M b\n?? c", _k(), "\nUU d").alias("text")))
    st = rows.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "kind", "path"))), lambda r: _s(r["kind"], ":", r["path"])), ",").alias("b"))
    return stash.join(st, "id").select("id", F.concat_ws("|", "a", vcs.parse_commit(_s("[main abc1234def] msg ", F.col("id"))), "b").alias("report"))


@query("SELECT p_partkey // 100 AS id, '0' || lpad(p_partkey::VARCHAR, 6, '0') AS hash, 'me' AS author, 'subject ' || p_partkey AS subject, ['one', 'two', 'three']::VARCHAR[] AS body, 1 AS omitted FROM part")
def commit_rows(spark, sf_dir):
    line = _s("commit 0", F.lpad(_k().cast("string"), 6, "0"), "fffff\nAuthor: me\nDate: x\n\n    subject ", _k(), "\n\n    one\n    two\n    three\n    four\n")
    return vcs.commits(blob(table(spark, sf_dir, "part"), F.floor(_k() / 100), "p_partkey", line)).drop("commit_at")


@query("SELECT l_orderkey AS id, 'f' AS file, count(*) AS lines, max(nth) AS last FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth FROM lineitem) WHERE nth <= 3 GROUP BY 1")
def compact_diffs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    body = blob(li, F.col("l_orderkey"), "l_linenumber", _s("+new ", F.col("l_linenumber"), "\n same"))
    lines = vcs.diff_lines(body.select("id", F.concat(F.lit("diff --git a/f b/f\n@@ -1 +1 @@\n"), "text").alias("text")))
    return vcs.compact_diff(lines, 5, 3).groupBy("id", "file").agg(F.count(F.lit(1)).alias("lines"), F.max("nth").alias("last"))


@query("SELECT p_partkey AS id, 2::BIGINT AS modified, 1::BIGINT AS replaced, 1::BIGINT AS removed FROM part")
def line_differences(spark, sf_dir):
    """Lines more alike than half by their characters are modified, others replaced."""
    a, b = _s("same\nabcdef", _k(), "\nhello\nxyz\ngone"), _s("same\nabcdefg", _k(), "\nhellp\n123")
    d = table(spark, sf_dir, "part").select(_k().alias("id"), joins.positional_diff(a, b).alias("d"))
    n = lambda kind: F.size(F.filter("d", lambda r: r["kind"] == kind)).cast("long").alias(kind)
    return d.select("id", n("modified"), n("replaced"), n("removed"))


# linters and listings


@query("SELECT p_partkey // 100 AS id, count(*) AS issues, count(DISTINCT p_partkey % 5) AS files, count(*) FILTER (p_partkey % 3 = 0) AS errors, count(*) FILTER (p_partkey % 3 <> 0) AS warnings FROM part GROUP BY 1")
def eslint_summary(spark, sf_dir):
    item = _st(filePath=_s("src/f", _k() % 5, ".ts"), messages=F.array(_st(ruleId="r", severity=F.when(_k() % 3 == 0, 2).otherwise(1), message="m", line=_k(), column=1)))
    d = _items(spark, sf_dir, item)
    return diagnostics.summary(diagnostics.from_json(d.select("id", F.to_json("items").alias("text")), "eslint"))


@query("SELECT id, file, code, n, rank FROM (SELECT p_partkey // 100 AS id, 'p' || (p_partkey % 3) || '.py' AS file, 'sym' || (p_partkey % 7) AS code, count(*) AS n, row_number() OVER (PARTITION BY p_partkey // 100, p_partkey % 3 ORDER BY count(*) DESC, p_partkey % 7) AS rank FROM part GROUP BY p_partkey // 100, p_partkey % 3, p_partkey % 7) WHERE rank <= 3")
def pylint_codes(spark, sf_dir):
    item = _st(type="error", path=_s("p", _k() % 3, ".py"), line=_k(), column=1, symbol=_s("sym", _k() % 7), message="m")
    return diagnostics.top_codes(diagnostics.from_json(_items(spark, sf_dir, item).select("id", F.to_json("items").alias("text")), "pylint"))


@query("SELECT p_partkey // 100 AS id, 'g' || (p_partkey % 4) || '.go' AS file, count(*) AS n FROM part GROUP BY 1, 2")
def golangci_files(spark, sf_dir):
    item = _st(FromLinter="vet", Text="t", Pos=_st(Filename=_s("g", _k() % 4, ".go"), Line=_k(), Column=1))
    return diagnostics.by_file(diagnostics.from_json(_items(spark, sf_dir, item).select("id", F.to_json(F.struct(F.col("items").alias("Issues"))).alias("text")), "golangci"))


@query("SELECT p_partkey // 100 AS id, p_partkey AS line, 'hint ' || p_partkey AS note FROM part WHERE p_partkey % 3 = 0")
def attached_notes(spark, sf_dir):
    line = _s("m", _k(), ".py:", _k(), ": error: bad [c]\n", F.when(_k() % 3 == 0, _s("m", _k(), ".py:", _k(), ": note: hint ", _k())).otherwise("x"))
    got = diagnostics.attach_notes(diagnostics.from_text(blob(table(spark, sf_dir, "part"), F.floor(_k() / 100), "p_partkey", line), "mypy"))
    return got.where("notes IS NOT NULL").select("id", "line", F.element_at("notes", 1).alias("note"))


@query("SELECT p_partkey // 100 AS id, count(*) AS issues, count(DISTINCT p_partkey % 4) AS files, count(*) AS errors, 0::BIGINT AS warnings FROM part WHERE p_partkey % 2 = 0 GROUP BY 1")
def go_vet_summary(spark, sf_dir):
    line = F.when(_k() % 2 == 0, _s("vet: a", _k() % 4, ".go:", _k(), ":2: bad")).otherwise("# pkg")
    return diagnostics.summary(diagnostics.from_text(blob(table(spark, sf_dir, "part"), F.floor(_k() / 100), "p_partkey", line), "go"))


@query("SELECT p_partkey // 100 AS id, count(*) FILTER (p_partkey % 3 = 0) AS passed, count(*) FILTER (p_partkey % 3 = 1) AS failed, count(*) FILTER (p_partkey % 3 = 2) AS skipped FROM part GROUP BY 1")
def jest_totals(spark, sf_dir):
    t = _st(fullName=_s("t", _k()), status=_pick(3, F.lit("passed"), F.lit("failed"), F.lit("pending")), failureMessages=F.array(F.lit("m")))
    d = _items(spark, sf_dir, t).select("id", F.to_json(F.struct(F.array(_st(name="a.test.ts", assertionResults=F.col("items"))).alias("testResults"))).alias("text"))
    return TR.totals(TR.jest_json(d)).drop("seconds")


@query("SELECT p_partkey // 100 AS id, count(*) FILTER (p_partkey % 3 = 0) AS passed, count(*) FILTER (p_partkey % 3 = 1) AS failed, count(*) FILTER (p_partkey % 3 = 2) AS skipped, count(*) * 0.5::DOUBLE AS seconds FROM part GROUP BY 1")
def rspec_totals(spark, sf_dir):
    t = _st(full_description=_s("t", _k()), status=_pick(3, F.lit("passed"), F.lit("failed"), F.lit("pending")), file_path="a_spec.rb", line_number=1, run_time=0.5)
    return TR.totals(TR.rspec_json(_items(spark, sf_dir, t).select("id", F.to_json(F.struct(F.col("items").alias("examples"))).alias("text"))))


@query("SELECT p_partkey // 100 AS id, 'd' || (p_partkey % 25) AS dir, count(*) AS n FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY 'd' || (p_partkey % 25)) <= 20")
def grouped_paths(spark, sf_dir):
    rows = listings.path_rows(blob(table(spark, sf_dir, "part"), F.floor(_k() / 100), "p_partkey", _s("./d", _k() % 25, "/n", _k(), ".txt")))
    return listings.grouped_paths(rows).select("id", "dir", "n")


@query("SELECT p_partkey // 100 AS id, round(sum(CASE p_partkey % 3 WHEN 0 THEN 1024.0 * 2 WHEN 1 THEN 20.0 ELSE 300.0 / 1024 END), 6)::DOUBLE AS megabytes, count(*) AS images FROM part GROUP BY 1")
def image_sizes(spark, sf_dir):
    rows = listings.docker_rows(blob(table(spark, sf_dir, "part"), F.floor(_k() / 100), "p_partkey", _s("repo/x:", _k(), "\t", _pick(3, F.lit("2GB"), F.lit("20MB"), F.lit("300kB")))), ["name", "size"])
    return rows.groupBy("id").agg(F.round(F.sum(listings.size_mb(F.col("size"))), 6).alias("megabytes"), F.count(F.lit(1)).alias("images"))


@query("SELECT p_partkey // 100 AS id, chr(97 + (p_partkey % 3)::INT) AS letter, count(*) AS n FROM part GROUP BY 1, 2")
def packages_by_letter(spark, sf_dir):
    item = _st(name=_s(_pick(3, F.lit("Ab"), F.lit("bc"), F.lit("Cd")), _k()), version="1")
    rows = listings.packages(_items(spark, sf_dir, item).select("id", F.to_json("items").alias("text")))
    return ranking.count_by(rows, "id", "letter")


@query(_each("k || ' ' || (k + 1) || ' ' || (k + 2) || ' f' || k"))
def wc_rows(spark, sf_dir):
    r = RD.wc_row(_s("  ", _k(), "   ", _k() + 1, " ", _k() + 2, " f", _k()))
    return _rows(spark, sf_dir, _s(r["lines"], " ", r["words"], " ", r["bytes"], " ", r["name"]))


@query(_each(f"'# T' || k || {NL} || {NL} || 'text' || {NL} || '```' || {NL} || '<!-- stays -->' || {NL} || '```'"))
def markdown_bodies(spark, sf_dir):
    return _rows(spark, sf_dir, RD.markdown_body(_s("# T", _k(), "\n<!-- x -->\n![b](u)\n---\n\n\n\ntext\n```\n<!-- stays -->\n```\n")))


@query(_sql("list(k ORDER BY k) FILTER (k % 4 = 0) AS e", f"coalesce(array_to_string(list_transform(e, lambda x: 'e: ' || x || {NL}), ''), '') || 'BUILD FAILED in 1s' || {NL}"))
def gradle_builds(spark, sf_dir):
    return _report(spark, sf_dir, RD.gradle_build, F.when(_k() % 4 == 0, _s("e: ", _k())).otherwise(_s("> Task :t", _k(), "\nplain")), "> Configure project :a\n", "\nBUILD FAILED in 1s\n* Try:")


# JSON and shell


@query(_sql("list('{\"a\":' || k || ',\"b\":{\"c\":[\"x\",null]}}' ORDER BY k) AS l, count(*) AS n",
            f"'Count: ' || n || '/' || (n + 5) || {NL} || 'Capacity: 2.5 RCU' || {NL} || '(paginated — more results available)' || {NL} || " + _first("l", 20, NL, f"{NL} || '… +' || # || ' more items'")))
def typed_tables(spark, sf_dir):
    """The answer of a scan: items with typed values, capacity and a key to go on from."""
    g = _items(spark, sf_dir, _s('{"a":{"N":"', _k(), '"},"b":{"M":{"c":{"L":[{"S":"x"},{"NULL":true}]}}}}'))
    n = F.size("items")
    return g.select("id", JS.items_report(_s('{"Items":[', F.array_join("items", ","), '],"Count":', n, ',"ScannedCount":', n + 5, ',"ConsumedCapacity":{"CapacityUnits":2.5},"LastEvaluatedKey":{}}')).alias("report"))


@query(_each(f"'PATH Variables:' || {NL} || '  PATH (12 entries):' || {NL} || array_to_string(list_transform(range(1, 11), lambda i: '    /p' || i || {NL}), '') || '    ... +2 more' || {NL} || {NL} || 'Language/Runtime:' || {NL} || '  GOROOT=/g' || k || {NL} || {NL} || 'Cloud/Services:' || {NL} || '  AWS_SECRET=ab****yz' || {NL} || {NL} || 'Other:' || {NL} || '  HOME=' || repeat('h', 50) || '... (' || (101 + s) || ' chars)' || {NL} || array_to_string(list_transform(range(11, 30), lambda i: '  LC_' || i || '=' || k || {NL}), '') || '  ... +1 more' || {NL} || {NL} || 'Total: 25 vars (showing 23 relevant)' || {NL}"))
def environment_reports(spark, sf_dir):
    lines = F.concat_ws("\n", F.lit("ZZ=1"), F.transform(F.sequence(F.lit(30), F.lit(11), F.lit(-1)), lambda i: F.concat(F.lit("LC_"), i.cast("string"), F.lit("="), _s(_k()))), _s("GOROOT=/g", _k()), F.lit("PATH=" + ":".join(f"/p{i}" for i in range(1, 13))), F.lit("AWS_SECRET=ab12345yz"), F.concat(F.lit("HOME="), F.expr("repeat('h', cast(101 + p_size as int))")))
    # a small file is few tasks, but each row is a report of 25 variables
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)
    return part.select(_k().alias("id"), listings.env_report(lines).alias("report"))


@query(_each("'{\"a\":' || k || ',\"b\":\"x\",\"c\":[1,\"y\"],\"d\":{\"e\":true},\"f\":null}'"))
def typed_items(spark, sf_dir):
    raw = _s('{"a":{"N":"', _k(), '"},"b":{"S":"x"},"c":{"L":[{"N":"1"},{"S":"y"}]},"d":{"M":{"e":{"BOOL":true}}},"f":{"NULL":true}}')
    return _rows(spark, sf_dir, JS.typed_item(raw))


@query(_each("'{\"k\": ' || k || '}'"))
def embedded_objects(spark, sf_dir):
    return _rows(spark, sf_dir, JS.extract_object(_s("noise {not json} ", '{"k": ', _k(), "} more }")))


@query(_each("'a=1 b=' || k"))
def query_result_rows(spark, sf_dir):
    raw = _s('{"results":[[{"field":"a","value":"1"},{"field":"@ptr","value":"zz"},{"field":"b","value":"', _k(), '"}]]}')
    return cloud.query_results(table(spark, sf_dir, "part").select(_k().alias("id"), raw.alias("text"))).select(F.col("answer").alias("id"), F.col("text").alias("report"))


@query("SELECT p_partkey AS id, '00:00:0' || (p_partkey % 10) AS clock, 'm' || p_partkey AS message FROM part WHERE p_partkey % 10 > 0 UNION ALL SELECT p_partkey, '??:??:??', 'last' FROM part")
def log_event_rows(spark, sf_dir):
    at = (_k() % 10) * 1000
    raw = F.when(_k() % 10 > 0, _s('{"events":[{"timestamp":', at, ',"message":"m', _k(), '"},{"timestamp":9,"message":"m', _k(), ' \\n"},{"timestamp":0,"message":"last"}]}')).otherwise('{"events":[{"timestamp":0,"message":"last"}]}')
    return cloud.log_events(table(spark, sf_dir, "part").select(_k().alias("id"), raw.alias("text"))).select(F.col("answer").alias("id"), "clock", "message")


@query(_each("(k % 5 = 0)::VARCHAR || (k % 5 = 1)::VARCHAR || (k % 5 = 2)::VARCHAR || '|' || CASE WHEN k % 5 = 4 THEN 'a b' ELSE 'x' END"))
def shell_traits(spark, sf_dir):
    cmd = _pick(5, F.lit("echo $(date)"), F.lit("cat <<E"), F.lit("ls > out"), F.lit("ls 2>&1"), F.lit("a \\\n  b"))
    return _rows(spark, sf_dir, _s(S.has_substitution(cmd), S.has_heredoc(cmd), S.redirects_to_file(cmd), "|", F.when(_k() % 5 == 4, S.join_continuations(cmd)).otherwise("x")))


@query(_each("CASE k % 3 WHEN 0 THEN 'sl git log ' || k || ' && cd x' WHEN 1 THEN 'A=1 sl git x | git y' ELSE 'none' END || '|' || CASE k % 2 WHEN 0 THEN 'a b;c ' || k ELSE 'it''s' END"))
def rewritten_commands(spark, sf_dir):
    cmd = _pick(3, _s("git log ", _k(), " && cd x"), F.lit("A=1 git x | git y"), F.lit("echo `git z`"))
    words = S.tokenize(F.when(_k() % 2 == 0, _s('"a b" c\\ ', _k())).otherwise("it\\'s"))
    return _rows(spark, sf_dir, _s(F.coalesce(S.rewrite(cmd, "sl", ("git",)), F.lit("none")), "|", F.array_join(words, ";")))


_COMMANDS_SQL = r"""
SELECT doc_id AS id, CASE doc_id % 5
  WHEN 0 THEN 'sl git commit -m "' || t || '" && htop' WHEN 1 THEN 'M="' || t || '" sl cargo test 2>&1 | git log' WHEN 2 THEN 'echo "' || t || '"; sl git add .; sl ls -l'
  WHEN 3 THEN NULL ELSE 'sl git log --grep="' || t || '" & find . || sl /usr/bin/ls' END AS rewritten
FROM (SELECT doc_id, regexp_replace(text, '["\\$`]', '', 'g') AS t FROM documents)
"""


@query(_COMMANDS_SQL)
def rewritten_text_commands(spark, sf_dir):
    """Commands that hold a document's text in quotes, with whatever signs stand in it."""
    t, n = F.regexp_replace("text", r'["\\$`]', ""), F.col("doc_id") % 5
    cmd = (
        F.when(n == 0, _s('git commit -m "', t, '" && htop')).when(n == 1, _s('M="', t, '" cargo test 2>&1 | git log')).when(n == 2, _s('echo "', t, '" ; git add . ;ls -l'))
        .when(n == 3, _s('git log > "', t, '"')).otherwise(_s('git log --grep="', t, '"&find . ||/usr/bin/ls'))
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), S.rewrite(cmd, "sl", ("git", "cargo", "ls", "find")).alias("rewritten"))


@query("SELECT doc_id AS id, length(t) + 5 AS place, 'arg,blank,operator,arg,blank,redirect' AS kinds, t AS word FROM (SELECT doc_id, regexp_replace(text, '''', '', 'g') AS t FROM documents)")
def lexed_texts(spark, sf_dir):
    """Tokens of a command that begins with a whole text in quotes: where the operator's right side stands, and the text as a word."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), _s("'", F.regexp_replace("text", "'", ""), "' &&cat 2>&1").alias("cmd"))
    rows = rows.select("id", S.lex("cmd").alias("tokens"), S.tokenize("cmd").alias("words"))
    return rows.select("id", F.col("tokens")[3]["at"].cast("long").alias("place"), F.array_join(F.transform("tokens", lambda k: k["kind"]), ",").alias("kinds"), F.col("words")[0].alias("word"))


@query(_sql("list('p' || k ORDER BY k) AS l", _first("l", 7, NL, f"{NL} || '... +' || # || ' more'")))
def overflowing_lists(spark, sf_dir):
    return _report(spark, sf_dir, lambda x: ranking.overflow(T.lines(x), ranking.reduced(10, 3)), _s("p", _k()))


@query(_sql("sum(k % 5)::BIGINT AS f", "f || ' of ' || (7 * f)"))
def surefire_totals(spark, sf_dir):
    n = table(spark, sf_dir, "part").groupBy(F.floor(_k() / 100).alias("id")).agg(F.sum(_k() % 5).alias("f"))
    r = RD.surefire(_s("Tests run: 1, Failures: 1, Errors: 0, Skipped: 0\nTests run: ", F.col("f") * 7, ", Failures: ", F.col("f"), ", Errors: 0, Skipped: 0"))
    return n.select("id", _s(r["failures"], " of ", r["run"]).alias("report"))




@query(_sql("list('u' || k || ' 2024-01-02' ORDER BY k) AS l", _first("l", 20, NL, f"{NL} || '... +' || # || ' more'")))
def cloud_listings(spark, sf_dir):
    d = _items(spark, sf_dir, _st(UserName=_s("u", _k()), CreateDate="2024-01-02T00:00:00Z")).select("id", F.to_json(F.struct(F.col("items").alias("Users"))).alias("text"))
    return cloud.listing(cloud.rows(d, "users"), ["id", "day"]).select(F.col("answer").alias("id"), F.col("text").alias("report"))


@query(_each("'src/a' || k || '.ts|lib/b.py|tests/c.py|pkg/d.go|d.go|app/models/u' || k || '.rb|x.rb'"))
def tool_paths(spark, sf_dir):
    n = _s(_k())
    parts = [
        TO.tool_path(_s("/w/src/x/src/a", n, ".ts"), "lint"), TO.tool_path(F.lit("C:\\w\\lib\\b.py"), "ruff"), TO.tool_path(F.lit("/w/tests/c.py"), "format"), TO.tool_path(F.lit("/w/cmd/x/pkg/d.go"), "golangci"), TO.tool_path(F.lit("/w/d.go"), "golangci"),
        TO.tool_path(_s("/r/app/models/u", n, ".rb"), "rubocop"), TO.tool_path(F.lit("/r/other/x.rb"), "rubocop"),
    ]
    return _rows(spark, sf_dir, F.concat_ws("|", *parts))


@query(_sql("list(k || 'L ' || (k + 1) || 'W ' || (k + 2) || 'B f' || k || '.txt' ORDER BY k) AS l", f"array_to_string(l, {NL}) || {NL} || 'Σ 9L 8W 7B'"))
def wc_reports(spark, sf_dir):
    return _report(spark, sf_dir, TO.wc_report, _s("  ", _k(), "  ", _k() + 1, " ", _k() + 2, " dir/sub/f", _k(), ".txt"), "", "\n  9 8 7 total\n")


@query(_each("k || '|' || k || 'L 2W 3B|' || k || ' 2'"))
def wc_single(spark, sf_dir):
    return _rows(spark, sf_dir, F.concat_ws("|", TO.wc_report(_s(" ", _k(), " a"), "one"), TO.wc_report(_s(_k(), " 2 3 a")), TO.wc_report(_s(_k(), " 2 a"), "mixed")))


@query(_sql("list('  ' || k || ' c' || k || ' (img:1) Up [80]' ORDER BY k) FILTER (k % 4 > 0) AS a", f"'[docker] ' || len(a) || ' containers:' || {NL} || " + _first("a", 20, NL, f"{NL} || '  … +' || # || ' more'") + f" || {NL}"))
def docker_ps_report(spark, sf_dir):
    return _report(spark, sf_dir, TO.docker_ps, F.when(_k() % 4 > 0, _s(_k(), "\tc", _k(), "\tUp\tr/img:1\t0.0.0.0:80->80/tcp")).otherwise("bad\tline"))


@query(_sql("list('  r:' || k || ' [' || CASE WHEN k % 2 = 0 THEN '2GB' ELSE '30MB' END || ']' ORDER BY k) AS a, count(*) FILTER (k % 2 = 0) AS g, count(*) FILTER (k % 2 = 1) AS m", f"'[docker] ' || len(a) || ' images (' || printf('%.1f', g * 2 + m * 30 / 1024.0) || 'GB)' || {NL} || " + _first("a", 50, NL, f"{NL} || '  … +' || # || ' more'") + f" || {NL}"))
def docker_images_report(spark, sf_dir):
    return _report(spark, sf_dir, TO.docker_images, _s("r:", _k(), "\t", F.when(_k() % 2 == 0, "2GB").otherwise("30MB")))


@query(_sql("list('  a' || k || ' (1)' ORDER BY k) FILTER (k % 5 > 0) AS a, list('  B' || k || ' (1)' ORDER BY k) FILTER (k % 5 = 0) AS b, count(*) AS n", f"'pip list: ' || n || ' packages' || {NL} || {NL} || '[A]' || {NL} || " + _first("a", 50, NL, f"{NL} || '  ... +' || # || ' more'") + f" || {NL} || {NL} || '[B]' || {NL} || " + _first("b", 50, NL, f"{NL} || '  ... +' || # || ' more'")))
def pip_lists(spark, sf_dir):
    d = _items(spark, sf_dir, _st(name=_s(F.when(_k() % 5 > 0, "a").otherwise("B"), _k()), version="1"))
    return d.select("id", TO.pip_list(F.to_json("items")).alias("report"))


@query(_sql("list(k ORDER BY k) AS l", f"'pip outdated: ' || len(l) || ' packages' || {NL} || " + _first("list_transform(l, lambda x, i: i || '. p' || x || ' (1 → ' || CASE WHEN x % 2 = 0 THEN 'unknown' ELSE '2' END || ')')", 20, NL, f"{NL} || {NL} || '... +' || # || ' more packages'") + f" || {NL} || {NL} || '[hint] Run `pip install --upgrade <package>` to update'"))
def pip_outdated_lists(spark, sf_dir):
    d = _items(spark, sf_dir, _st(name=_s("p", _k()), version="1", latest_version=F.when(_k() % 2 == 1, "2")))
    return d.select("id", TO.pip_outdated(F.to_json("items")).alias("report"))


@query("""
SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN ['x', t] ELSE [t] END AS patterns, CASE WHEN doc_id % 3 = 1 THEN ['.'] ELSE ['my dir'] END AS paths, CASE doc_id % 3 WHEN 0 THEN ['-n'] WHEN 1 THEN ['-i', '-A', '2'] ELSE ['--glob', '*.md'] END AS flags,
       CASE WHEN doc_id % 3 = 2 THEN 7 ELSE 200 END::BIGINT AS results
FROM (SELECT doc_id, regexp_replace(text, '''', '', 'g') AS t FROM documents)
""")
def search_arguments(spark, sf_dir):
    """Search commands with a document's text as their pattern."""
    t, n = _s("'", F.regexp_replace("text", "'", ""), "'"), F.col("doc_id") % 3
    cmd = F.when(n == 0, _s("grep -rne x -e ", t, " 'my dir'")).when(n == 1, _s("grep -iA2 ", t)).otherwise(_s("rg -m 7 ", t, ' "my dir" --glob *.md --recursive'))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), AR.search_command(cmd).alias("s")).select("id", "s.patterns", "s.paths", "s.flags", "s.results")
