"""Reports of containers, stacked branches, version control, web builds, schema tools, formatters, database shells and downloads, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from .scan import begins, bound, fold, grouped, has, kept, last, listed, more, none, number, text, total

LIST, SHORT = 20, 10


def _some(x: Column | str) -> Column:
    """Lines that aren't blank."""
    return F.filter(T.lines(x), lambda s: ~T.is_blank(s))


def _rtrim(x: Column) -> Column:
    return F.regexp_replace(x, r"\n+\z", "")


# containers


def compact_ports(ports: Column | str) -> Column:
    """Published ports, the first two and a count if there are over three."""
    left = F.transform(F.split(T.c(ports), ","), lambda p: F.regexp_extract(F.split(p, "->")[0], r"([^:]*)\z", 1))
    few = F.array_join(left, ", ")
    return F.when(T.c(ports) == "", "-").when(F.size(left) <= 3, few).otherwise(text(F.array_join(F.slice(left, 1, 2), ", "), ", … +", F.size(left) - 2))


SERVICES = "struct<items:array<struct<metadata:struct<namespace:string,name:string>,spec:struct<type:string,ports:array<struct<port:bigint,targetPort:string>>>>>>"


def services(x: Column | str) -> Column:
    """A service a line: name, type and ports, those that go elsewhere with an arrow."""
    items = F.from_json(T.c(x), SERVICES)["items"]
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "-").otherwise(c)

    def port(p: Column) -> Column:
        here = F.coalesce(p["port"], F.lit(0))
        target = F.coalesce(p["targetPort"].try_cast("bigint"), here)
        return F.when(here == target, here.cast("string")).otherwise(text(here, "→", target))

    line = lambda s: text("  ", dash(s["metadata"]["namespace"]), "/", dash(s["metadata"]["name"]), " ", dash(s["spec"]["type"]), " [", F.array_join(F.transform(F.coalesce(s["spec"]["ports"], F.array().cast("array<struct<port:bigint,targetPort:string>>")), port), ","), "]\n")
    shown = text(F.size(items), " services:\n", F.array_join(F.transform(F.slice(items, 1, LIST), line), ""), more(F.size(items), LIST, "more\n", "  … +"))
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "No services found\n").otherwise(shown)


def _container(parts: Column, ports: bool) -> Column:
    """id, name, image and state of [id, name, state, image, ports]; null for fewer than four."""
    p = compact_ports(F.coalesce(F.try_element_at(parts, F.lit(5)), F.lit("")))
    suffix = F.when(p != "-", text(" [", p, "]")).otherwise("") if ports else F.lit("")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    return F.when(F.size(parts) >= 4, text("  ", F.left(at(1), F.lit(12)), " ", at(2), " (", T.last_segment(at(4)), ") ", T.utrim(at(3)), suffix, "\n"))


def docker_ps_all(x: Column | str) -> Column:
    """Running containers with their ports, then the others, 20 of each."""
    rows = F.transform(_some(x), lambda s: F.split(s, "\t", -1))
    on = lambda r: r[0].isin("running", "restarting")
    rest = lambda r: F.slice(r, F.lit(2), F.size(r))
    made = lambda test, ports: F.array_compact(F.transform(F.filter(rows, test), lambda r: _container(rest(r), ports)))
    running, stopped = made(on, True), made(lambda r: ~on(r), False)
    part = lambda a, what: text("[docker] ", F.size(a), f" {what}:\n", F.array_join(F.slice(a, 1, LIST), ""), more(F.size(a), LIST, "more\n", "  … +"))
    return F.concat(part(running, "running"), F.when(F.size(stopped) > 0, part(stopped, "stopped/exited")).otherwise(""))


def compose_ps(x: Column | str) -> Column:
    rows = _some(x)
    parts = F.filter(F.transform(rows, lambda s: F.split(s, "\t", -1)), lambda r: F.size(r) >= 4)

    def line(r: Column) -> Column:
        ports = compact_ports(T.utrim(r[3]))
        return text("  ", r[0], " (", T.last_segment(r[1]), ") ", r[2], F.when(T.is_blank(r[3]) | (ports == "-"), "").otherwise(text(" [", ports, "]")), "\n")

    shown = text("[compose] ", F.size(rows), " services:\n", F.array_join(F.transform(F.slice(parts, 1, LIST), line), ""), more(F.size(parts), LIST, "more\n", "  … +"))
    return F.when(F.size(rows) == 0, "[compose] 0 services").otherwise(_rtrim(shown))


def compose_logs(x: Column | str) -> Column:
    return F.when(T.is_blank(x), "[compose] No logs").otherwise(text("[compose] Logs:\n", T.c(x)))


def compose_build(x: Column | str) -> Column:
    """The closing line, the services built, and the number of steps."""
    a = T.lines(x)
    first = lambda *words: F.try_element_at(F.filter(a, lambda s: s.contains(words[0]) & s.contains(words[-1])), F.lit(1))
    line = F.coalesce(first("Building", "FINISHED"), first("Building"))
    names = F.transform(F.filter(a, lambda s: s.rlike(r"^[^\[]*\[[^\]]*\]")), lambda s: F.regexp_extract(s, r"^[^\[]*\[\s*([^\s\]]*)", 1))
    services_ = F.array_distinct(F.filter(names, lambda n: ~n.isin("", "+")))
    steps = total(a, lambda s: s.rlike(r"^[ \t]*=> "))
    out = text(
        F.coalesce(text("[compose] ", T.utrim(line), "\n"), F.lit("[compose] Build:\n")), F.when(F.size(services_) > 0, text("  Services: ", F.array_join(services_, ", "), "\n")).otherwise(""),
        F.when(steps > 0, text("  Steps: ", steps)).otherwise(""))
    return F.when(T.is_blank(x), "[compose] Build: no output").otherwise(_rtrim(out))


# stacked branches

#: How branches, pull requests and mail addresses look.
_BRANCH = r"(?:Created|Pushed|pushed|Deleted|deleted)\s+branch\s+[\"'`]?([a-zA-Z0-9/_.\-+@]+)"
_PULL = r"(Created|Updated)\s+pull\s+request\s+#(\d+)\s+for\s+([^\s:]+)(?::\s*(\S+))?"
_MAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


def branch_name(line: Column | str) -> Column:
    return F.regexp_extract(T.c(line), _BRANCH, 1)


def _done(action: str, detail: Column) -> Column:
    return F.when(detail == "", f"ok {action}").otherwise(text(f"ok {action} ", detail))


def _unless_blank(x: Column | str, out: Column) -> Column:
    return F.when(T.is_blank(x), "").otherwise(out)


def stack_log(x: Column | str, cap: int = LIST - 5) -> Column:
    """Lines without mail addresses, up to the entry that reaches the cap, then how many entries follow."""
    a = T.lines(T.utrim(x))
    node = lambda s: F.regexp_replace(s, r"^[│|]*[ \t]*", "").rlike("^[◉○◯◆●@*]")
    numbered = fold(a, {"n": F.lit(0), "out": F.array().cast("array<int>")}, lambda s, line: {"n": s["n"] + node(line).cast("int"), "out": F.concat(s["out"], F.array(s["n"] + node(line).cast("int")))}, lambda s: s["out"])
    end = F.array_position(F.transform(numbered, lambda n: n >= cap), F.lit(True)).cast("int")
    shown = F.when(end > 0, F.slice(a, F.lit(1), F.when(end > 0, end).otherwise(1))).otherwise(a)
    rest = total(a, node) - cap
    lines = F.transform(shown, lambda s: T.ellipsis(F.regexp_replace(F.regexp_replace(s, _MAIL, ""), r"[ \t]+$", ""), 120))
    return _unless_blank(x, F.concat(F.array_join(lines, "\n"), F.when((end > 0) & (rest > 0), text("\n... +", rest, " more entries")).otherwise("")))


def stack_submit(x: Column | str) -> Column:
    """Pushed branches and pull requests; else the beginning of the output."""
    a = F.filter(F.transform(T.lines(T.utrim(x)), T.utrim), lambda s: s != "")
    is_push = lambda s: has(s, "pushed", "Pushed")
    pushed = F.transform(F.filter(a, is_push), lambda s: branch_name(s))
    g = lambda s, k: F.regexp_extract(s, _PULL, k)
    pulls = F.transform(F.filter(a, lambda s: ~is_push(s) & s.rlike(_PULL)), lambda s: text(F.lower(g(s, 1)), " PR #", g(s, 2), " ", g(s, 3), F.when(g(s, 4) != "", text(" ", g(s, 4))).otherwise("")))
    names = F.filter(pushed, lambda n: n != "")
    head = F.when(F.size(names) > 0, F.array(text("pushed ", F.array_join(names, ", ")))).when(F.size(pushed) > 0, F.array(text("pushed ", F.size(pushed), " branches"))).otherwise(none())
    rows = F.concat(head, pulls)
    return _unless_blank(x, F.when(F.size(rows) > 0, F.array_join(rows, "\n")).otherwise(T.ellipsis(T.utrim(x), 200)))


def stack_sync(x: Column | str) -> Column:
    a = F.transform(T.lines(T.utrim(x)), T.utrim)
    synced = total(a, lambda s: (s.contains("Synced") & s.contains("branch")) | s.startswith("Synced with remote"))
    gone = F.filter(a, lambda s: has(s, "deleted", "Deleted"))
    names = F.filter(F.transform(gone, branch_name), lambda n: n != "")
    deleted = F.when(F.size(gone) > 0, text(F.size(gone), " deleted", F.when(F.size(names) > 0, text(" (", F.array_join(names, ", "), ")")).otherwise("")))
    parts = F.array_compact(F.array(F.when(synced > 0, text(synced, " synced")), deleted))
    return _unless_blank(x, F.when(F.size(parts) > 0, text("ok sync: ", F.array_join(parts, ", "))).otherwise("ok synced"))


def stack_restack(x: Column | str) -> Column:
    n = total(T.lines(x), lambda s: has(s, "Restacked", "Rebased") & s.contains("branch"))
    return _unless_blank(x, F.when(n > 0, text("ok restacked ", n, " branches")).otherwise("ok restacked"))


def stack_create(x: Column | str) -> Column:
    a = T.lines(T.utrim(x))
    name = F.coalesce(branch_name(F.try_element_at(F.filter(a, lambda s: has(s, "Created", "created")), F.lit(1))), F.lit(""))
    return _unless_blank(x, F.when(name != "", _done("created", name)).otherwise(_done("created", T.utrim(a[0]))))


# version control

#: Progress of a push.
_PUSH = ("Enumerating objects:", "Counting objects:", "Compressing objects:", "Writing objects:", "Delta compression using", "Total ")


def push_report(x: Column | str, exit_code: Column | int = 0) -> Column:
    """A push without progress, then where it went if it ended well."""
    code = exit_code if isinstance(exit_code, Column) else F.lit(exit_code)
    a = F.filter(T.lines(x), lambda s: (s != "") & ~begins(F.regexp_replace(s, r"^[ \t]+", ""), *_PUSH))
    dest = F.try_element_at(F.filter(F.transform(a, lambda s: F.regexp_extract(s, r"^.*? -> \s*(\S+)", 1)), lambda d: d != ""), F.lit(1))
    end = F.when(F.exists(a, lambda s: s.contains("Everything up-to-date")), "ok (up-to-date)\n").otherwise(F.coalesce(text("ok ", dest, "\n"), F.lit("ok\n")))
    return F.concat(F.array_join(F.transform(a, lambda s: F.concat(s, F.lit("\n"))), ""), F.when(code == 0, end).otherwise(""))


def worktrees(x: Column | str, home: str = "") -> Column:
    def line(s: Column) -> Column:
        p = F.split(T.utrim(s), r"\s+")
        path = F.when(F.lit(home != "") & p[0].startswith(home), F.concat(F.lit("~"), F.substring(p[0], len(home) + 1, 1 << 30))).otherwise(p[0])
        return F.when(F.size(p) >= 3, text(path, " ", p[1], " ", F.array_join(F.slice(p, F.lit(3), F.size(p)), " "))).otherwise(s)

    return F.array_join(F.transform(_some(x), line), "\n")


def status_lines(x: Column | str) -> Column:
    """Status with arguments: without hints and blank lines, to the line that says the tree is clean."""
    hint = lambda t: begins(t, '(use "git', "(create/copy files") | has(t, '(use "git add', '(use "git restore')
    a = F.filter(_some(x), lambda s: ~hint(T.utrim(s)))
    clean = lambda s: s.contains("nothing to commit") & s.contains("working tree clean")
    end = F.array_position(F.transform(a, clean), F.lit(True)).cast("int")
    cut = F.when(end > 0, F.slice(a, F.lit(1), F.when(end > 0, end).otherwise(1))).otherwise(a)
    out = F.array_join(F.transform(cut, lambda s: F.when(clean(s), T.utrim(s)).otherwise(s)), "\n")
    return F.when(F.size(cut) == 0, "ok").otherwise(out)


def user_limit(arguments: Column) -> Column:
    """The number of entries that a log's arguments ask for: -20, -n 20, --max-count=20 or --max-count 20; null where none."""
    after = F.transform(arguments, lambda a, i: F.struct(a.alias("a"), F.try_element_at(arguments, i + 2).alias("next")))
    n = lambda s: F.when(s.rlike(r"^[+-]?\d+$"), s.try_cast("int"))
    found = F.transform(after, lambda p: F.coalesce(F.when(p["a"].rlike(r"^-\d+$"), n(F.substring(p["a"], 2, 1 << 30))), F.when(p["a"].isin("-n", "--max-count"), n(p["next"])), F.when(p["a"].startswith("--max-count="), n(F.regexp_replace(p["a"], "^--max-count=", "")))))
    return F.try_element_at(F.array_compact(found), F.lit(1))


# web builds

_BUNDLE = r"^[○●◐λ✓]\s+([\w/\-.]+)\s+(\d+(?:\.\d+)?)\s*(kB|B)\s+(\d+(?:\.\d+)?)\s*(kB|B)"


def build_time(line: Column | str) -> Column:
    """A duration like 34.2s or 1250ms; null where none."""
    found = F.regexp_extract(T.c(line), r"(\d+(?:\.\d+)?)\s*(s|ms)", 1)
    return F.when(found != "", F.concat(found, F.regexp_extract(T.c(line), r"(\d+(?:\.\d+)?)\s*(s|ms)", 2)))


def next_build(x: Column | str) -> Column:
    """Routes by kind, the largest bundles, build time, errors and warnings."""
    clean = T.strip_ansi(x)
    a = T.lines(clean)
    n = lambda *marks: total(a, lambda s: begins(s, *marks))
    static, dynamic, routes = n("○"), n("●", "◐"), n("○", "●", "◐", "λ")
    warnings = total(a, lambda s: F.lower(s).contains("warning"))
    errors = total(a, lambda s: F.lower(s).contains("error") & ~s.contains("0 error"))
    time = last(F.array_compact(F.transform(F.filter(a, lambda s: has(s, "Compiled", "in")), build_time)))
    g = lambda s, k: F.regexp_extract(s, _BUNDLE, k)
    rows = F.transform(F.filter(a, lambda s: s.rlike(_BUNDLE)), lambda s, i: F.struct((-g(s, 4).try_cast("double")).alias("order"), i.alias("i"), g(s, 1).alias("route"), g(s, 2).try_cast("double").alias("size"), g(s, 4).try_cast("double").alias("all")))
    pct = lambda r: (r["all"] - r["size"]) / r["size"] * 100
    line = lambda r: text("  ", F.rpad(T.ellipsis(r["route"], 30), 30, " "), " ", F.format_string("%6.0f kB", F.bround(r["all"], 0)), F.when((r["all"] > 0) & (pct(r) > 10), F.format_string(" [warn] (+%.0f%%)", F.bround(pct(r), 0))).otherwise(""), "\n")
    bundles = F.when(F.size(rows) > 0, text("Bundles:\n", F.array_join(F.transform(F.slice(F.array_sort(rows), 1, SHORT), line), ""), more(F.size(rows), SHORT, "more routes\n", "\n  ... +"), "\n")).otherwise("")
    built = has(clean, "already optimized", "Cache") | ((routes == 0) & clean.contains("Ready"))
    head = F.when(built & (routes == 0), "Already built (using cache)\n\n").when(routes > 0, text(routes, " routes (", static, " static, ", dynamic, " dynamic)\n\n")).otherwise("")
    return T.utrim(text("Next.js Build\n", head, bundles, F.coalesce(text("Time: ", time, " | "), F.lit("")), "Errors: ", errors, " | Warnings: ", warnings))


# schema tools


def _word_number(s: Column) -> Column:
    """The first word that is a number; null where none."""
    return F.try_element_at(F.filter(F.split(s, r"\s+"), lambda w: w.rlike(r"^[0-9]+$")), F.lit(1)).cast("int")


def prisma_generate(x: Column | str) -> Column:
    a = F.filter(T.lines(x), lambda s: ~s.rlike("[█▀▄┌└│]"))
    n = lambda test: F.coalesce(last(F.array_compact(F.transform(F.filter(a, test), _word_number))), F.lit(0))
    models, enums, types = n(lambda s: s.contains("model") & s.contains("generated")), n(lambda s: s.contains("enum")), n(lambda s: s.contains("type"))
    where = F.exists(a, lambda s: s.contains("node_modules") & s.contains("@prisma"))
    counts = F.when((models > 0) | (enums > 0) | (types > 0), text("  • ", models, " models, ", enums, " enums, ", types, " types\n")).otherwise("")
    return T.utrim(text("Prisma Client generated\n", counts, F.when(where, "  • Output: node_modules/@prisma/client\n").otherwise("")))


def prisma_migrate_dev(x: Column | str) -> Column:
    a = T.lines(x)
    name = last(F.filter(F.transform(F.filter(a, lambda s: s.contains("migration") & s.contains("_")), lambda s: F.regexp_extract(s, r"(202\S*)", 1)), lambda m: m != ""))
    after = lambda s, word: s.rlike(rf"(?:^|\s){word}\s+\S")
    tables, altered = total(a, lambda s: s.contains("CREATE TABLE")), total(a, lambda s: s.contains("ALTER TABLE"))
    relations = total(a, lambda s: has(s, "FOREIGN KEY", "REFERENCES") & after(s, "TABLE"))
    indexes = total(a, lambda s: has(s, "CREATE INDEX", "CREATE UNIQUE INDEX") & after(s, "INDEX"))
    applied = F.exists(a, lambda s: has(s, "applied", "✓"))
    row = lambda n, sign, what: F.when(n > 0, text(f"  {sign} ", n, f" {what}\n")).otherwise("")
    changes = text(row(tables, "+", "table(s)"), row(altered, "~", "table(s) modified"), row(relations, "+", "relation(s)"), row(indexes, "~", "index(es)"))
    return T.utrim(text(F.coalesce(text("Migration: ", name, "\n"), F.lit("")), "Changes:\n", changes, "\n", F.when(applied, "Applied | Pending: 0").otherwise("")))


def prisma_migrate_status(x: Column | str) -> Column:
    a = T.lines(x)
    done, waiting = F.filter(a, lambda s: s.contains("applied")), total(a, lambda s: has(s, "pending", "unapplied"))
    stamp = F.try_element_at(F.filter(done, lambda s: s.contains("202")), F.lit(1))
    latest = F.coalesce(F.nullif(F.regexp_extract(stamp, r"(202\S*)\s", 1), F.lit("")), F.left(F.regexp_extract(stamp, r"(202\S*)\z", 1), F.lit(20)))
    return text("Migrations: ", F.size(done), " applied, ", waiting, " pending", F.coalesce(text("\nLatest: ", F.nullif(latest, F.lit(""))), F.lit("")))


def prisma_migrate_deploy(x: Column | str) -> Column:
    a = T.lines(x)
    errors = F.transform(F.filter(a, lambda s: has(s, "error", "ERROR")), T.utrim)
    done = total(a, lambda s: has(s, "applied", "✓"))
    failed = T.utrim(text("[FAIL] Deployment failed:\n", F.array_join(F.transform(F.slice(errors, 1, 5), lambda e: text("  ", e)), "\n")))
    return F.when(F.size(errors) == 0, text(done, " migration(s) deployed")).otherwise(failed)


def prisma_db_push(x: Column | str) -> Column:
    a = T.lines(x)
    n = lambda *words: total(a, lambda s: has(s, *words))
    tables, columns, dropped = n("CREATE TABLE"), n("ALTER", "ADD COLUMN"), n("DROP")
    return F.concat(F.lit("Schema pushed to database"), F.when((tables > 0) | (columns > 0) | (dropped > 0), text("\n  + ", tables, " tables, ~ ", columns, " columns, - ", dropped, " dropped")).otherwise(""))


# formatters


def _numbered(a: Column, form=None) -> Column:
    return text(F.array_join(F.transform(F.slice(a, 1, SHORT), lambda s, i: text(i + 1, ". ", form(s) if form else s, "\n")), ""), more(F.size(a), SHORT, "more files\n", "\n... +"))


def prettier_report(x: Column | str) -> Column:
    """Files to format, or that all are fine."""
    raw = T.normalize_newlines(x)
    a = F.transform(T.lines(raw), T.utrim)
    files = F.filter(a, lambda s: s.rlike(r"\.(?:tsx?|jsx?|json|md|s?css)\z") & ~begins(s, "Checking", "All matched", "Code style") & ~has(s, "[warn]", "[error]"))
    matched = last(F.filter(a, lambda s: s.contains("All matched files use Prettier")))
    checked = number(matched, r"^(\d+)(?:\s|\z)")
    need = text("Prettier: ", F.size(files), " files need formatting\n", _numbered(files), F.when(checked > 0, text("\n", checked - F.size(files), " files already formatted")).otherwise(""))
    fine = "Prettier: All files formatted correctly"
    return (
        F.when(T.is_blank(x), "Error: prettier produced no output").when((F.size(files) == 0) & matched.isNotNull(), fine)
        .when(has(raw, "modified", "formatted"), text("Prettier: ", F.size(files), " files formatted")).when(F.size(files) == 0, fine).otherwise(T.utrim(need))
    )


def _before_file(s: Column) -> Column:
    """The number before the first word ``file`` or ``files`` that has one."""
    return F.nullif(F.regexp_extract(s, r"(?:^|\s)(\d+)\s+files?(?=\s|\z)", 1), F.lit("")).cast("int")


def _python_path(x: Column) -> Column:
    return T.anchored_path(F.replace(x, F.lit("\\"), F.lit("/")), ["src", "lib", "tests"])


def _would_reformat(a: Column) -> Column:
    return F.transform(F.filter(a, lambda s: F.lower(s).startswith("would reformat:")), lambda s: T.utrim(F.regexp_replace(s, "^[^:]*:", "")))


def black_report(x: Column | str) -> Column:
    a = F.transform(F.split(T.c(x), "\n", -1), T.utrim)
    low = lambda s: F.lower(s)
    files = _would_reformat(a)
    parts = F.flatten(F.transform(F.filter(a, lambda s: has(low(s), "would be reformatted", "would be left unchanged")), lambda s: F.split(s, ",")))
    n = lambda rows: last(F.array_compact(F.transform(rows, _before_file)))
    would = F.coalesce(n(F.filter(parts, lambda p: low(p).contains("would be reformatted"))), F.lit(0))
    left = F.coalesce(n(F.filter(a, lambda s: low(s).contains("left unchanged") & ~low(s).contains("would be"))), n(F.filter(parts, lambda p: low(p).contains("would be left unchanged"))), F.lit(0))
    done, bad = F.exists(a, lambda s: has(low(s), "all done!", "all done ✨")), F.exists(a, lambda s: low(s).contains("oh no!"))
    needs = (F.size(files) > 0) | (would > 0) | bad
    count = F.when(F.size(files) > 0, F.size(files)).otherwise(would)
    need = text(
        "Format (black): ", count, " files need formatting\n", _numbered(files, _python_path), F.when(left > 0, text("\n", left, " files already formatted\n")).otherwise(""),
        "\n[hint] Run `black .` to format these files")
    fine = text("Format (black): All files formatted", F.when(left > 0, text(" (", left, " files checked)")).otherwise(""))
    return F.when(~needs & (done | (left > 0)), fine).when(needs, T.utrim(need)).otherwise(T.utrim(x))


def ruff_format_report(x: Column | str) -> Column:
    raw = T.c(x)
    a = F.transform(F.split(raw, "\n", -1), T.utrim)
    files = F.transform(F.filter(a, lambda s: F.lower(s).contains("would reformat:")), lambda s: T.utrim(F.regexp_replace(s, "^[^:]*:", "")))
    left = F.transform(F.filter(a, lambda s: F.lower(s).contains("left unchanged")), lambda s: F.try_element_at(F.filter(F.split(s, ","), lambda p: F.lower(p).contains("left unchanged")), F.lit(1)))
    checked = F.coalesce(last(F.array_compact(F.transform(left, _before_file))), F.lit(0))
    need = text(
        "Ruff format: ", F.size(files), " files need formatting\n", _numbered(files, _python_path), F.when(checked > 0, text("\n", checked, " files already formatted\n")).otherwise(""),
        "\n[hint] Run `ruff format` to format these files")
    fine = "Ruff format: All files formatted correctly"
    low = F.lower(raw)
    return F.when((F.size(files) == 0) & (low.contains("left unchanged") | low.contains("would reformat")), fine).when(F.size(files) > 0, T.utrim(need)).otherwise(T.utrim(raw))


# database shells


def is_table(x: Column | str) -> Column:
    return F.exists(T.lines(x), lambda s: s.contains("-+-"))


def is_expanded(x: Column | str) -> Column:
    return T.c(x).rlike(r"-\[ RECORD \d+ \]-")


_ROWS = r"^\(\d+ rows?\)$"


def table_report(x: Column | str) -> Column:
    """Cells of a table by tabs, 20 rows below the header, without rules and the row count."""
    a = F.filter(F.transform(T.lines(x), T.utrim), lambda s: (s != "") & ~s.rlike(r"^[-+]+$") & ~s.rlike(_ROWS))
    n = total(a, lambda s: s.contains("|")) - 1

    def step(s: Column, line: Column) -> tuple[Column, dict[str, Column]]:
        row = line.contains("|")
        return ~row | (s["n"] <= LIST), {"n": s["n"] + row.cast("int")}

    rows = F.transform(kept(a, {"n": F.lit(0)}, step), lambda s: F.when(s.contains("|"), F.array_join(F.transform(F.split(s, r"\|", -1), T.utrim), "\t")).otherwise(s))
    return F.array_join(F.concat(rows, F.when(n > LIST, F.array(text("... +", n - LIST, " more rows"))).otherwise(none())), "\n")


def expanded_report(x: Column | str) -> Column:
    """Records as one line of key=value each, the first 20."""
    a = F.filter(F.transform(T.lines(x), T.utrim), lambda s: (s != "") & ~s.rlike(_ROWS))
    head = r"^-\[ RECORD (\d+) \]-"

    def step(s: Column, line: Column) -> dict[str, Column]:
        h, pair = line.rlike(head), line.contains("|")
        on = F.size(s["recs"]) > 0
        value = text(" ", T.utrim(F.regexp_extract(line, r"^([^|]*)\|", 1)), "=", T.utrim(F.regexp_extract(line, r"^[^|]*\|(.*)$", 1)))
        grown = F.concat(F.slice(s["recs"], F.lit(1), F.greatest(F.size(s["recs"]) - 1, F.lit(0))), F.array(F.concat(F.coalesce(last(s["recs"]), F.lit("")), value)))
        return {
            "recs": F.when(h, F.concat(s["recs"], F.array(text("[", F.regexp_extract(line, head, 1), "]")))).when(pair & on, grown).otherwise(s["recs"]),
            "before": F.when(~h & ~on, F.concat(s["before"], F.array(line))).otherwise(s["before"]),
        }

    got = fold(a, {"recs": none(), "before": none()}, step)
    recs = F.transform(got["recs"], lambda r: F.when(r.rlike(r"^\[\d+\]$"), F.concat(r, F.lit(" "))).otherwise(r))
    return F.array_join(F.concat(got["before"], F.slice(recs, 1, LIST), F.when(F.size(recs) > LIST, F.array(text("... +", F.size(recs) - LIST, " more records"))).otherwise(none())), "\n")


def psql_report(x: Column | str) -> Column:
    return F.when(T.is_blank(x), "").when(is_expanded(x), expanded_report(x)).when(is_table(x), table_report(x)).otherwise(T.c(x))


# downloads, trees, summaries


def tree_report(x: Column | str) -> Column:
    """A tree without its counts and blank lines around it."""
    a = F.filter(T.lines(x), lambda s: ~(s.contains("director") & s.contains("file")))
    return F.concat(F.regexp_replace(F.regexp_replace(T.unlines(a), r"^(?:[ \t]*\n)+", ""), r"(?:\n\s*)+\z", ""), F.lit("\n"))


def curl_report(x: Column | str, terminal: bool, limit: int = 500) -> Column:
    """A response as it is unless it is long, no JSON and for a terminal: then its first bytes, whole characters only, and its size."""
    t = T.utrim(x)
    json = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]")) | (t.startswith('"') & t.endswith('"') & (F.octet_length(t) >= 2))
    if not terminal:
        return t
    raw = F.encode(t, "UTF-8")
    # a byte that begins with 10 goes on with the character before it, of which there are three at most
    inside = lambda at: F.hex(F.substring(raw, at, 1)).rlike("^[89AB]")
    whole = F.coalesce(*[F.when(~inside(limit + 1 - k), limit - k) for k in range(4)], F.lit(limit))
    cut = F.decode(F.substring(raw, F.lit(1), whole), "UTF-8")
    return F.when(json | (F.octet_length(t) < limit), t).otherwise(text(cut, "... (", F.octet_length(t), " bytes total)"))


#: What tells a failed download's cause. A status is a number of its own, not digits of a longer one.
_CAUSES = (
    *[(f"(?<![0-9]){code}(?![0-9])", f"{code} {said}") for code, said in (("404", "Not Found"), ("403", "Forbidden"), ("401", "Unauthorized"), ("500", "Server Error"))], ("Connection refused", "Connection refused"),
    ("unable to resolve|Name or service not known", "DNS lookup failed"), ("timed out", "Connection timed out"), ("SSL|certificate", "SSL/TLS error"),
)


def download_error(stderr: Column | str, stdout: Column | str) -> Column:
    both = F.concat_ws("\n", T.c(stderr), T.c(stdout))
    line = F.try_element_at(F.filter(F.transform(T.lines(stderr), T.utrim), lambda s: (s != "") & ~s.startswith("--")), F.lit(1))
    short = F.when(F.char_length(line) > 60, F.concat(F.left(line, F.lit(60)), F.lit("..."))).otherwise(line)
    return F.coalesce(*[F.when(both.rlike(p), F.lit(said)) for p, said in _CAUSES], short, F.lit("Unknown error"))


def download_size(n: Column | str, largest: str = "GB") -> Column:
    """largest: the unit that sizes aren't told beyond: KB, MB or GB."""
    n = T.c(n)
    unit = lambda k, name: F.concat(T.tenths(n, 1 << k), F.lit(name))
    units = [(10, "KB"), (20, "MB"), (30, "GB")]
    units = units[: [name for _, name in units].index(largest) + 1]
    out = F.when(n == 0, "?").when(n < 1 << 10, F.concat(n.cast("string"), F.lit("B")))
    for (k, name), (above, _) in zip(units, units[1:]):
        out = out.when(n < 1 << above, unit(k, name))
    return out.otherwise(unit(*units[-1]))


def common_folder(paths: Column) -> Column:
    """The longest folder, with its slash, that all paths begin with; empty for one path or none in common."""
    def of(paths: Column, parts: Column) -> Column:
        folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
        fits = F.filter(F.when(F.size(parts) > 1, folders).otherwise(none()), lambda f: F.forall(paths, lambda p: p.startswith(f)))
        return F.when(F.size(paths) <= 1, "").otherwise(F.coalesce(last(fits), F.lit("")))

    return bound(paths, lambda a: bound(F.split(a[0], "/", -1), lambda parts: of(a, parts)))


def summarize_list(x: Column | str) -> Column:
    a = _some(x)
    return text("List (", F.size(a), " items):\n", listed(a, SHORT, "more", lambda s, i: text("   • ", T.ellipsis(s, 70)), mark="   ... +"))


def summarize_json(x: Column | str) -> Column:
    """What a JSON text is: items of an array, keys of an object, or the value."""
    raw = T.c(x)
    kind = F.schema_of_variant(F.try_parse_json(raw))
    keys = F.json_object_keys(raw)
    n = F.json_array_length(raw)
    scalar = F.coalesce(F.try_parse_json(raw).cast("string"), F.lit("null"))
    shape = (
        F.when(kind.isNull(), "   (Invalid JSON)").when(kind.startswith("ARRAY"), text("   Array with ", n, " items"))
        .when(kind.startswith("OBJECT"), text("   Object with ", F.size(keys), " keys:", F.array_join(F.transform(F.slice(keys, 1, SHORT), lambda k: text("\n   • ", k)), ""), more(F.size(keys), SHORT, "more keys", "\n   ... +")))
        .otherwise(text("   ", T.ellipsis(scalar, 100)))
    )
    return text("JSON Output:\n", shape)


def mask_token(x: Column | str) -> Column:
    """The first and last two characters of a token, stars between."""
    t = T.c(x)
    n = F.length(t)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(t, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(t, F.lit(2))))


def passthrough(x: Column | str, limit: int, program: str = "SIEVELINE") -> Column:
    """Output nothing is known about: as it is, or its beginning with a note."""
    t = T.c(x)
    n = F.char_length(t)
    return F.when(n > limit, text(F.left(t, F.lit(limit)), f"\n\n[{program}:PASSTHROUGH] Output truncated (", n, f" chars → {limit} chars)")).otherwise(t)


def around(line: Column | str, pattern: str, limit: int) -> Column:
    """A line cut to ``limit`` characters around a match, a third of them before it; a line of at most so many bytes stays."""
    t = T.utrim(line)
    n = F.char_length(t)
    at = F.instr(F.lower(t), pattern.lower()) - 1
    low = F.greatest(at - limit // 3, F.lit(0))
    end = F.least(low + limit, n)
    start = F.when(end == n, F.greatest(end - limit, F.lit(0))).otherwise(low)
    piece = F.substring(t, start + 1, end - start)
    cut = F.when((start > 0) & (end < n), text("...", piece, "...")).when(start > 0, text("...", piece)).otherwise(text(piece, "..."))
    return F.when(F.octet_length(t) <= limit, t).when(at >= 0, cut).otherwise(F.concat(F.left(t, F.lit(max(limit - 3, 0))), F.lit("...")))


def errors_or_outcome(x: Column | str, exit_code: Column) -> Column:
    """Error lines; without any, that all went well, or the last ten lines of what failed."""
    from .test_results import error_blocks

    found = error_blocks(x)
    tail = T.lines(x)
    end = F.transform(F.when(F.size(tail) > 10, F.slice(tail, -10, 10)).otherwise(tail), lambda s: text("  ", s, "\n"))
    failed = text("[FAIL] Command failed (exit code: ", exit_code, ")\n", F.array_join(end, ""))
    return F.when(found != "", found).when(exit_code == 0, "[ok] Command completed successfully (no errors)").otherwise(failed)


def matches_by_file(x: Column | str, cap: int = SHORT) -> Column:
    """Search output grouped by file, files by name, the first matches of each; as it is where nothing looks like a match."""
    pattern = r"^([^:]*):([0-9]+):(.*)$"
    g = lambda s, k: F.regexp_extract(s, pattern, k)
    rows = F.filter(T.lines(x), lambda s: s.rlike(pattern))
    line = lambda s: text("  ", F.when(F.length(g(s, 2)) >= 4, g(s, 2)).otherwise(F.lpad(g(s, 2), 4, " ")), ": ", T.utrim(g(s, 3)), "\n")
    one = lambda f: text("[file] ", f["key"], " (", F.size(f["items"]), "):\n", F.array_join(F.transform(F.slice(f["items"], 1, cap), line), ""), F.when(F.size(f["items"]) > cap, text("  +", F.size(f["items"]) - cap, "\n")).otherwise(""), "\n")
    told = lambda a: bound(grouped(F.transform(a, lambda s: F.struct(g(s, 1).alias("key"), s.alias("item")))), lambda files: text(F.size(a), " matches in ", F.size(files), "F:\n\n", F.array_join(F.transform(files, one), "")))
    return bound(rows, lambda a: F.when(F.size(a) == 0, T.c(x)).otherwise(told(a)))


def lint_lines(x: Column | str) -> Column:
    """Lines of a linter of no known format that say warning or error, counted and shown; a line with both counts for both."""
    a = T.lines(x)
    low = lambda s: F.lower(s)
    is_warning, is_error = (lambda s: low(s).contains("warning")), (lambda s: low(s).contains("error") & ~low(s).contains("0 error"))
    warnings, errors = total(a, is_warning), total(a, is_error)
    rows = F.flatten(F.transform(a, lambda s: F.concat(F.when(is_warning(s), F.array(s)).otherwise(none()), F.when(is_error(s), F.array(s)).otherwise(none()))))
    shown = T.utrim(text("Lint: ", errors, " errors, ", warnings, " warnings\n", listed(rows, LIST, "more issues", lambda s, i: T.ellipsis(s, 100), lead="\n\n")))
    return F.when((errors == 0) & (warnings == 0), "Lint: No issues found").otherwise(shown)


def ignore_patterns(x: Column | str) -> Column:
    """Patterns of an ignore file: lines that are neither blank nor comments."""
    return F.filter(F.transform(T.lines(x), T.utrim), lambda s: (s != "") & ~s.startswith("#"))


def is_binary(x: Column | str) -> Column:
    """Whether bytes are no UTF-8."""
    return ~F.is_valid_utf8(T.c(x).cast("string"))


#: Formats that aren't JSON, by file extension.
NOT_JSON = {"toml": "TOML", "yaml": "YAML", "yml": "YAML", "xml": "XML", "csv": "CSV", "ini": "INI", "env": "env", "txt": "plain text"}


def not_json(path: Column | str) -> Column:
    """Why a file is no JSON file, by its extension; null where nothing is against it."""
    ext = F.regexp_extract(T.c(path), r"\.([^./]*)\z", 1)
    return F.coalesce(*[F.when(ext == k, text(T.c(path), f" is not a JSON file (detected {v}).")) for k, v in NOT_JSON.items()])


#: Folders that paths are shown from, by tool, the first that a path holds.
ANCHORS = {"lint": ("src", "lib"), "ruff": ("src", "lib", "tests"), "format": ("src", "lib", "tests"), "golangci": ("pkg", "cmd", "internal")}
RUBY_ANCHORS = ("app/models/", "app/controllers/", "app/views/", "app/helpers/", "app/services/", "app/jobs/", "app/mailers/", "lib/", "spec/", "test/", "config/")


def tool_path(x: Column | str, tool: str) -> Column:
    """A path from a folder that the tool's projects are laid out by, else the file's name."""
    path = F.replace(T.c(x), F.lit("\\"), F.lit("/"))
    if tool != "rubocop":
        return T.anchored_path(path, list(ANCHORS[tool]))
    found = [F.when(F.instr(path, a) > 0, F.substring(path, F.instr(path, a), F.length(path))) for a in RUBY_ANCHORS]
    return F.coalesce(*found, F.when(path.contains("/app/"), F.concat(F.lit("app/"), F.substring_index(path, "/app/", -1))), T.last_segment(path))


def wc_report(x: Column | str, mode: str = "full") -> Column:
    """Word counts without the folder that all files share. mode: full (lines, words, bytes), one (a single count) or mixed (several counts)."""
    rows = F.filter(F.transform(T.lines(T.utrim(x)), lambda s: F.split(T.utrim(s), r"\s+")), lambda p: p[0] != "")
    is_total = lambda p: F.element_at(p, -1) == "total"
    at = lambda p, k: F.coalesce(F.try_element_at(p, F.lit(k)), F.lit(""))
    counts = lambda p: text(at(p, 1), "L ", at(p, 2), "W ", at(p, 3), "B")
    whole = lambda p: F.array_join(p, " ")
    path_last = lambda p: ~F.element_at(p, -1).rlike(r"^[0-9]+$")
    numbers = lambda p: F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), " ")

    def shown(a: Column, folder: Column) -> Column:
        bare = lambda name: F.when((folder != "") & name.startswith(folder), F.substring(name, F.length(folder) + 1, F.length(name))).otherwise(name)
        if mode == "one":
            single, many = a[0][0], lambda p: F.when(is_total(p), text("Σ ", p[0])).otherwise(text(p[0], " ", bare(F.element_at(p, -1))))
        elif mode == "full":
            single, many = F.when(F.size(a[0]) >= 3, counts(a[0])).otherwise(whole(a[0])), lambda p: F.when(is_total(p), text("Σ ", counts(p))).when(F.size(p) >= 4, text(counts(p), " ", bare(at(p, 4)))).otherwise(whole(p))
        else:
            single = F.when((F.size(a[0]) >= 2) & path_last(a[0]), numbers(a[0])).otherwise(whole(a[0]))
            many = lambda p: F.when(is_total(p), text("Σ ", numbers(p))).when((F.size(p) >= 2) & path_last(p), text(numbers(p), " ", bare(F.element_at(p, -1)))).otherwise(whole(p))
        return F.when(F.size(a) == 0, "").when(F.size(a) == 1, single).otherwise(F.array_join(F.transform(a, many), "\n"))

    # the folder is the same for all lines: found once, not once a line
    folder = lambda a: common_folder(F.transform(F.filter(a, lambda p: ~is_total(p)), lambda p: F.element_at(p, -1)))
    return bound(rows, lambda a: bound(folder(a), lambda f: shown(a, f)))


def docker_ps(x: Column | str) -> Column:
    rows = F.array_compact(F.transform(_some(x), lambda s: _container(F.split(s, "\t", -1), True)))
    shown = text("[docker] ", F.size(rows), " containers:\n", F.array_join(F.slice(rows, 1, LIST), ""), more(F.size(rows), LIST, "more\n", "  … +"))
    return F.when(T.is_blank(x), "[docker] 0 containers").otherwise(shown)


def docker_images(x: Column | str) -> Column:
    """Images with their sizes, 50 of them, and the size of all."""
    a = F.transform(T.lines(x), lambda s: F.split(s, "\t", -1))
    size = lambda r: F.coalesce(F.try_element_at(r, F.lit(2)), F.lit(""))
    number_of = lambda r, unit: F.coalesce(F.trim(F.replace(size(r), F.lit(unit), F.lit(""))).try_cast("double"), F.lit(0.0))
    mb = F.aggregate(a, F.lit(0.0), lambda t, r: t + F.when(size(r).contains("GB"), number_of(r, "GB") * 1024).when(size(r).contains("MB"), number_of(r, "MB")).otherwise(0.0))
    all_ = F.when(mb > 1024, F.format_string("%.1fGB", mb / 1024)).otherwise(F.format_string("%.0fMB", F.bround(mb, 0)))
    line = lambda r: text("  ", r[0], " [", size(r), "]\n")
    shown = text("[docker] ", F.size(a), " images (", all_, ")\n", F.array_join(F.transform(F.slice(a, 1, 50), line), ""), more(F.size(a), 50, "more\n", "  … +"))
    return F.when((F.size(a) == 0) | (T.c(x) == ""), "[docker] 0 images").otherwise(shown)


_PIP = "array<struct<name:string,version:string,latest_version:string>>"


def pip_list(x: Column | str) -> Column:
    """Packages by first letter, letters sorted, 50 of each."""
    a = F.from_json(T.c(x), _PIP)
    letter = lambda p: F.when(p["name"] == "", "?").otherwise(F.translate(F.left(p["name"], F.lit(1)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    letters = F.array_sort(F.array_distinct(F.transform(a, letter)))

    def group(k: Column) -> Column:
        own = F.filter(a, lambda p: letter(p) == k)
        return text("\n[", F.upper(k), "]\n", F.array_join(F.transform(F.slice(own, 1, 50), lambda p: text("  ", p["name"], " (", p["version"], ")\n")), ""), more(F.size(own), 50, "more\n", "  ... +"))

    return F.when(F.size(a) == 0, "pip list: No packages installed").otherwise(T.utrim(text("pip list: ", F.size(a), " packages\n", F.array_join(F.transform(letters, group), ""))))


def pip_outdated(x: Column | str) -> Column:
    a = F.from_json(T.c(x), _PIP)
    line = lambda p, i: text(i + 1, ". ", p["name"], " (", p["version"], " → ", F.when(F.coalesce(p["latest_version"], F.lit("")) == "", "unknown").otherwise(p["latest_version"]), ")\n")
    rows = text(F.array_join(F.transform(F.slice(a, 1, LIST), line), ""), more(F.size(a), LIST, "more packages\n", "\n... +"))
    return F.when(F.size(a) == 0, "pip outdated: All packages up to date").otherwise(text("pip outdated: ", F.size(a), " packages\n", rows, "\n[hint] Run `pip install --upgrade <package>` to update"))
