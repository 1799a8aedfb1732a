"""Queries over reports of linters, type checkers and test runners as text, held against reports made from the same parts in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .answer_queries import _items, _odd, _st
from .operators import linters as LN
from .parser_queries import _k, _s
from .queries import query
from .report_queries import NL, _each, _first, _pick, _report, _rows, _sql


def _tops(head: str, label: str, file: str, code: str, mark: str, after: str = "''", line: str = "''") -> str:
    """head, after: over n (issues), files and k (a list of parts) of an id; line: below a code of a file."""
    return f"""WITH p AS (SELECT p_partkey // 100 AS id, p_partkey AS k, {file} AS file, {code} AS code FROM part),
        r AS (SELECT id, array_to_string(list('  ' || code || ' (' || n || 'x)' || {NL} ORDER BY n DESC, code)[1:10], '') AS rules FROM (SELECT id, code, count(*) AS n FROM p GROUP BY ALL) GROUP BY 1),
        c AS (SELECT id, file, sum(n)::BIGINT AS n, array_to_string(list('    ' || code || ' (' || n || ')' || {NL} || {line} ORDER BY n DESC, code)[1:3], '') AS codes FROM (SELECT id, file, code, count(*) AS n, min(k) AS first FROM p GROUP BY ALL) GROUP BY ALL),
        f AS (SELECT id, count(*) AS files, sum(n)::BIGINT AS n, array_to_string(list('  ' || file || ' (' || n || ' issues)' || {NL} || codes ORDER BY n DESC, file)[1:10], '') || CASE WHEN count(*) > 10 THEN {NL} || '{mark}' || (count(*) - 10) || ' more files' || {NL} ELSE '' END AS top FROM c GROUP BY 1),
        l AS (SELECT id, list(k ORDER BY k) AS k FROM p GROUP BY 1)
        SELECT id, rtrim({head} || {NL} || '{label}:' || {NL} || rules || {NL} || 'Top files:' || {NL} || top || {after}, {NL}) AS report FROM f JOIN r USING (id) JOIN l USING (id)"""


def _json(spark, sf_dir, report, item, name: str | None = None):
    d = _items(spark, sf_dir, item)
    return d.select("id", report(F.to_json(F.struct(F.col("items").alias(name))) if name else F.to_json("items")).alias("report"))


@query(_tops("'Ruff: ' || n || ' issues in ' || files || ' files (' || len(list_filter(k, lambda x: x % 2 = 1)) || ' fixable)'", "Top rules", "'f' || (k % 13) || '.py'", "'C' || (k % 11)", "... +",
             f"{NL} || 'Violations:' || {NL} || array_to_string(list_transform(k[1:50], lambda x: '  f' || (x % 13) || '.py:' || x || ':2 C' || (x % 11) || ' bad ' || x || {NL}), '') || CASE WHEN n > 50 THEN '  … +' || (n - 50) || ' more' || {NL} ELSE '' END || {NL} || '[hint] Run `ruff check --fix` to auto-fix ' || len(list_filter(k, lambda x: x % 2 = 1)) || ' issues'"))
def ruff_text(spark, sf_dir):
    fix = _odd(_st(applicability="safe"))
    return _json(spark, sf_dir, LN.ruff_report, _st(code=_s("C", _k() % 11), message=_s(" bad ", _k()), location=_st(row=_k(), column=2), filename=_s("f", _k() % 13, ".py"), fix=fix))


@query(_sql(f"list('  f' || k || '.ts (1 issues)' || {NL} || '    r' || {NL} ORDER BY k) FILTER (k % 2 = 1) AS f, count(*) FILTER (k % 2 = 1) AS n",
            f"'ESLint: ' || n || ' errors, 0 warnings in ' || n || ' files' || {NL} || 'Top rules:' || {NL} || '  r (' || n || 'x)' || {NL} || {NL} || 'Top files:' || {NL} || rtrim(array_to_string(list_transform(f[1:10], lambda x: replace(x, '    r', '    r (1)')), '') || CASE WHEN n > 10 THEN {NL} || '… +' || (n - 10) || ' more files' ELSE '' END, {NL})"))
def eslint_text(spark, sf_dir):
    """Files with as many messages stay in the order in which they came."""
    found = F.when(_k() % 2 == 1, F.array(_st(ruleId="r", severity=2))).otherwise(F.array().cast("array<struct<ruleId:string,severity:int>>"))
    return _json(spark, sf_dir, LN.eslint_report, _st(filePath=_s("f", _k(), ".ts"), messages=found, errorCount=_k() % 2, warningCount=0))


@query(_tops(f"'Pylint: ' || n || ' issues in ' || files || ' files' || {NL} || '  ' || len(list_filter(k, lambda x: x % 3 = 0)) || ' errors, ' || len(list_filter(k, lambda x: x % 3 = 1)) || ' warnings, ' || len(list_filter(k, lambda x: x % 3 = 2)) || ' conventions, 0 refactors'",
             "Top rules", "'f' || (k % 4) || '.py'", "'sym' || (k % 5) || ' (E' || (k % 5) || ')'", "… +"))
def pylint_text(spark, sf_dir):
    item = F.struct(_pick(3, F.lit("error"), F.lit("warning"), F.lit("convention")).alias("type"), _s("f", _k() % 4, ".py").alias("path"), _s("sym", _k() % 5).alias("symbol"), _s("E", _k() % 5).alias("message-id"))
    return _json(spark, sf_dir, LN.pylint_report, item)


@query(_tops("'golangci-lint: ' || n || ' issues in ' || files || ' files'", "Top linters", "'g' || (k % 12) || '.go'", "'lint' || (k % 5)", "... +", line=f"'      → x := ' || first || {NL}"))
def golangci_text(spark, sf_dir):
    """With the first source line of each linter in a file."""
    item = _st(FromLinter=_s("lint", _k() % 5), Pos=_st(Filename=_s("g", _k() % 12, ".go")), SourceLines=F.array(_s("\tx := ", _k())))
    return _json(spark, sf_dir, lambda x: LN.golangci_report(x, 2), item, "Issues")


_FILES = f"""WITH p AS (SELECT p_partkey // 100 AS id, p_partkey AS k, p_partkey % 7 AS f, p_partkey % 3 AS c FROM part),
    c AS (SELECT id, array_to_string(list('#' || c || ' (' || n || 'x)' ORDER BY n DESC, @)[1:5], ', ') AS codes, count(*) AS m FROM (SELECT id, c, count(*) AS n, min(k) AS first FROM p GROUP BY ALL) GROUP BY 1),
    f AS (SELECT id, count(*) AS files, sum(n)::BIGINT AS n, array_to_string(list('f' || f || '.x (' || n || ' errors)' || {NL} || body || {NL} ORDER BY n DESC, @), '') AS body FROM
        (SELECT id, f, count(*) AS n, min(k) AS first, array_to_string(list($ ORDER BY k), '') AS body FROM p GROUP BY ALL) GROUP BY 1)
    SELECT id, rtrim('~: ' || n || ' errors in ' || files || ' files' || {NL} || CASE WHEN m > 1 THEN 'Top codes: ' || codes || {NL} || {NL} ELSE '' END || body, {NL}) AS report FROM f JOIN c USING (id)"""


@query(_FILES.replace("~", "mypy").replace("#", "c").replace("ORDER BY n DESC, @)[1:5]", "ORDER BY n DESC, c)[1:5]").replace("@", "f").replace("$", f"'  L' || k || ': [c' || c || '] bad ' || k || {NL} || CASE WHEN k % 4 = 0 THEN '    note ' || k || {NL} ELSE '' END"))
def mypy_text(spark, sf_dir):
    """Every fourth error has a note."""
    file = _s("f", _k() % 7, ".x:", _k())
    line = F.concat(file, F.lit(":9: error: bad "), _s(_k()), F.lit("  [c"), _s(_k() % 3), F.lit("]"), F.when(_k() % 4 == 0, F.concat(F.lit("\n"), file, F.lit(": note: note "), _s(_k()))).otherwise(""))
    return _report(spark, sf_dir, LN.mypy_report, line, "", "\nFound 9 errors in 7 files")


@query(_FILES.replace("~", "TypeScript").replace("#", "TS").replace("@", "first").replace("$", f"'  L' || k || ': TS' || c || ' bad ' || k || {NL} || CASE WHEN k % 4 = 0 THEN '    deeper ' || k || {NL} ELSE '' END"))
def tsc_text(spark, sf_dir):
    """Files and codes with as many errors in the order in which they came."""
    line = F.concat(_s("f", _k() % 7, ".x(", _k(), ",9): error TS", _k() % 3, ": bad ", _k()), F.when(_k() % 4 == 0, _s("\n  deeper ", _k())).otherwise(""))
    return _report(spark, sf_dir, LN.tsc_report, line, "", "\n\nFound 9 errors")


@query(_sql("list('./a.go:' || k || ':1: bad ' || k ORDER BY k) FILTER (k % 3 = 0) AS l", f"'Go vet: ' || len(l) || ' issues' || {NL} || array_to_string(list_transform(l[1:20], lambda x, i: i || '. ' || x), {NL}) || CASE WHEN len(l) > 20 THEN {NL} || {NL} || '… +' || (len(l) - 20) || ' more issues' ELSE '' END"))
def go_vet_text(spark, sf_dir):
    return _report(spark, sf_dir, LN.vet_report, _pick(3, _s("./a.go:", _k(), ":1: bad ", _k()), F.lit("# pkg/a.go:1"), F.lit("exit status 1")))


@query(_each(f"CASE WHEN k % 2 = 0 THEN 'ok ✓ rubocop (' || k || ' files)' ELSE 'rubocop: 6 offenses (' || k || ' files)' || {NL} || {NL} || 'b.rb' || {NL} || '  :' || k || ' C — m' || {NL} || {NL} || 'a.rb' || {NL} || '  :1 D — x' || {NL} || '  :2 D — x' || {NL} || '  :3 D — x' || {NL} || '  :4 D — x' || {NL} || '  :5 D — x' || {NL} || '  … +1 more' || {NL} || {NL} || '(7 correctable, run `rubocop -A`)' END"))
def rubocop_text_from_json(spark, sf_dir):
    """The file with the worst severity first; six offenses of the other, of which five are shown."""
    one = lambda cop, sev, msg, line: _st(cop_name=cop, severity=sev, message=msg, correctable=True, location=_st(start_line=line))
    files = F.array(_st(path="a.rb", offenses=F.transform(F.sequence(F.lit(6), F.lit(1), F.lit(-1)), lambda i: one("D", "convention", "x", i))), _st(path="b.rb", offenses=F.array(one("C", "error", "m\nz", _k().cast("int")))), _st(path="c.rb", offenses=F.array().cast("array<struct<cop_name:string,severity:string,message:string,correctable:boolean,location:struct<start_line:int>>>")))
    return _rows(spark, sf_dir, LN.rubocop_report(F.to_json(_st(files=files, summary=_st(offense_count=F.when(_k() % 2 == 0, 0).otherwise(6), inspected_file_count=_k())))))


@query(_sql("list('✗ t' || k || chr(10) || '   ./s.rb:' || k || chr(10) || '   Err: m' || k || chr(10) || '   ./s.rb:9' ORDER BY k) FILTER (k % 3 = 0) AS l, count(*) AS n, count(*) FILTER (k % 3 = 0) AS bad",
            f"'RSpec: ' || (n - bad - 1) || ' passed, ' || bad || ' failed, 1 pending (2.50s)' || {NL} || {NL} || 'Failures:' || {NL} || array_to_string(list_transform(l[1:5], lambda x, i: i || '. ' || x), {NL} || {NL}) || CASE WHEN len(l) > 5 THEN {NL} || {NL} || '... +' || (len(l) - 5) || ' more failures' ELSE '' END"))
def rspec_text(spark, sf_dir):
    """A third of the examples fail, one is pending."""
    cause = F.struct(F.lit("A::B::Err").alias("class"), _s("m", _k(), "\nmore").alias("message"), F.array(F.lit("/x/gems/y.rb:1"), F.lit("./s.rb:9")).alias("backtrace"))
    item = F.struct(_s("t", _k()).alias("full_description"), F.when(_k() % 3 == 0, "failed").otherwise("passed").alias("status"), F.lit("./s.rb").alias("file_path"), _k().alias("line_number"), F.when(_k() % 3 == 0, cause).alias("exception"))
    d = _items(spark, sf_dir, item)
    total = _st(duration=2.5, example_count=F.size("items"), failure_count=F.size(F.filter("items", lambda e: e["status"] == "failed")), pending_count=1, errors_outside_of_examples_count=0)
    return d.select("id", LN.rspec_report(F.to_json(F.struct(F.col("items").alias("examples"), total.alias("summary")))).alias("report"))


@query(_each(f"CASE k % 3 WHEN 0 THEN 'cargo test: ' || (k + 2) || ' passed, 1 ignored (2 suites, 0.75s)' WHEN 1 THEN 'FAILURES (1):' || {NL} || '1. ---- t' || k || ' stdout ----' || {NL} || 'panicked' || {NL} || {NL} || 'test result: FAILED. 1 passed; 1 failed; 0 ignored; 0 measured; 0 filtered out' ELSE 'b' || k || {NL} || 'c' || {NL} || 'd' || {NL} || 'e' || {NL} || 'f' END"))
def cargo_test_text(spark, sf_dir):
    """Two suites that pass; one that fails; an output without results."""
    tail = lambda word, *n: "test result: {}. {} passed; {} failed; {} ignored; 0 measured; 0 filtered out".format(word, *n)
    fine = F.concat(F.lit("   Compiling a\nrunning 2 tests\ntest x ... ok\n\ntest result: ok. "), _s(_k()), F.lit(" passed; 0 failed; 1 ignored; 0 measured; 0 filtered out; finished in 0.50s\n\n" + tail("ok", 2, 0, 0) + "; finished in 0.25s\n"))
    bad = _s("test x ... ok\n\nfailures:\n\n---- t", _k(), " stdout ----\npanicked\n\n" + tail("FAILED", 1, 1, 0) + "\n")
    return _rows(spark, sf_dir, LN.cargo_test(_pick(3, fine, bad, _s("a\nb", _k(), "\nc\nd\n   Compiling z\ne\nf\n"))))


@query(_sql("list(CASE k % 4 WHEN 1 THEN 'n/p' || k || ' Pending' WHEN 2 THEN '-/p' || k || ' Failed' ELSE 'n/p' || k || ' CrashLoopBackOff' END ORDER BY k) FILTER (k % 4 > 0) AS l, count(*) AS n, count(*) FILTER (k % 4 = 0) AS up, count(*) FILTER (k % 4 = 1) AS w, count(*) FILTER (k % 4 >= 2) AS bad, sum(k % 3)::BIGINT AS re",
            f"n || ' pods: ' || concat_ws(', ', up::VARCHAR, w || ' pending', bad || ' [x]', re || ' restarts') || {NL} || '[warn] Issues:' || {NL} || array_to_string(list_transform(l[1:10], lambda x: '  ' || x || {NL}), '') || CASE WHEN len(l) > 10 THEN '  … +' || (len(l) - 10) || ' more' ELSE '' END"))
def pod_text(spark, sf_dir):
    box = F.struct((_k() % 3).alias("restartCount"), _st(waiting=_st(reason="CrashLoopBackOff")).alias("state"))
    item = _st(metadata=_st(namespace=F.when(_k() % 4 != 2, F.lit("n")), name=_s("p", _k())), status=_st(phase=_pick(4, F.lit("Running"), F.lit("Pending"), F.lit("Failed"), F.lit("")), containerStatuses=F.array(box)))
    return _json(spark, sf_dir, LN.pods_report, item, "items")
