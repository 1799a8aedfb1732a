"""Directory, search, container and package listings: typed rows, groups with caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import count_by, top_k
from .scan import grouped

_LS = r"^([bcdlps-][rwxsStT-]{9})[.+@]?\s+\d+\s+\S+\s+\S+\s+(\d+)\s+(\S+\s+\S+\s+\S+)\s+(.+)$"


def _lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.posexplode(T.lines(text_col)).alias("at", "raw"))


def ls_rows(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Entries of a long listing without the two dot folders: name, kind, size, mode, extension."""
    g = lambda k: F.regexp_extract("raw", _LS, k)
    name = F.regexp_replace(g(4), r" -> .*$", "")
    kind = F.when(g(1).startswith("d"), "dir").when(g(1).startswith("l"), "link").otherwise("file")
    rows = _lines(df, id_col, text_col).where(F.col("raw").rlike(_LS)).select("id", "at", name.alias("name"), kind.alias("kind"), g(2).cast("long").alias("size"), T.perms_to_octal(g(1)).alias("mode"))
    return rows.where("name NOT IN ('.', '..')").withColumn("ext", F.when(F.col("kind") == "file", T.extension("name")))


def top_extensions(rows: DataFrame, k: int = 5) -> DataFrame:
    return top_k(count_by(rows.where("ext IS NOT NULL"), "id", "ext"), k, [F.desc("n"), F.col("ext")], ["id"])


def path_rows(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One path a line: folder (``.`` for bare names), name, extension, depth."""
    p = _lines(df, id_col, text_col).where("raw <> ''").withColumn("path", F.regexp_replace("raw", r"^\./", ""))
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).otherwise(".")
    return p.select("id", "at", "path", folder.alias("dir"), T.basename("path").alias("name"), T.extension("path").alias("ext"), (F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"))) + 1).alias("depth"))


def grouped_paths(rows: DataFrame, dirs: int = 20, files: int = 10) -> DataFrame:
    """Folders by name, of each the first files; both capped, with totals before the caps."""
    per = top_k(rows, files, [F.col("name")], ["id", "dir"])
    g = per.groupBy("id", "dir").agg(F.array_sort(F.collect_list("name")).alias("names")).join(count_by(rows, "id", "dir"), ["id", "dir"])
    return top_k(g, dirs, [F.col("dir")], ["id"])


def grep_rows(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """file:line:content matches; lines with fewer parts or no line number are dropped."""
    pattern = r"^([^:]+):(\d+):(.*)$"
    g = lambda k: F.regexp_extract("raw", pattern, k)
    return _lines(df, id_col, text_col).where(F.col("raw").rlike(pattern)).select("id", "at", g(1).alias("file"), g(2).cast("int").alias("line"), g(3).alias("content"))


def docker_rows(df: DataFrame, columns: list[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Tab-separated rows by the given column names."""
    parts = F.split("raw", "\t", -1)
    return _lines(df, id_col, text_col).where("raw <> ''").select("id", "at", *[F.try_element_at(parts, F.lit(i + 1)).alias(c) for i, c in enumerate(columns)])


def size_mb(x) -> object:
    """Sizes like 1.5GB, 20MB, 300kB in megabytes."""
    n, unit = F.regexp_extract(x, r"([0-9.]+)", 1).try_cast("double"), F.upper(F.regexp_extract(x, r"([a-zA-Z]+)$", 1))
    return n * F.when(unit == "GB", 1024.0).when(unit == "MB", 1.0).when(unit == "KB", 1 / 1024).otherwise(1 / 1048576)


POD = "struct<items:array<struct<metadata:struct<namespace:string,name:string>,status:struct<phase:string,containerStatuses:array<struct<restartCount:bigint,state:struct<waiting:struct<reason:string>>>>>>>>"


def pods(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """namespace, name, phase, restarts and the reason for waiting of each pod."""
    p = df.select(F.col(id_col).alias("id"), F.explode(F.from_json(F.col(text_col), POD)["items"]).alias("p"))
    status = F.coalesce("p.status.containerStatuses", F.array().cast("array<struct<restartCount:bigint,state:struct<waiting:struct<reason:string>>>>"))
    restarts = F.aggregate(F.transform(status, lambda s: F.coalesce(s["restartCount"], F.lit(0))), F.lit(0).cast("bigint"), lambda a, b: a + b)
    reason = F.try_element_at(F.filter(F.transform(status, lambda s: s["state"]["waiting"]["reason"]), lambda r: r.isNotNull()), F.lit(1))
    return p.select("id", F.col("p.metadata.namespace").alias("namespace"), F.col("p.metadata.name").alias("name"), F.col("p.status.phase").alias("phase"), restarts.alias("restarts"), reason.alias("reason"))


def pod_report(rows: DataFrame) -> DataFrame:
    n = lambda *ph: F.sum(F.col("phase").isin(*ph).cast("long"))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("pods"), n("Running").alias("running"), n("Pending").alias("pending"), n("Failed").alias("failed"), n("Succeeded").alias("succeeded"), F.sum("restarts").alias("restarts"), F.sum(F.col("reason").isNotNull().cast("long")).alias("waiting"))


def packages(df: DataFrame, id_col: str = "id", text_col: str = "text", cap: int = 50) -> DataFrame:
    """A package list as JSON, grouped by its first letter, capped per letter."""
    p = df.select(F.col(id_col).alias("id"), F.explode(F.from_json(F.col(text_col), "array<struct<name:string,version:string,latest_version:string>>")).alias("p")).select("id", "p.*")
    return top_k(p.withColumn("letter", F.lower(F.left("name", F.lit(1)))), cap, [F.lower("name")], ["id", "letter"])


#: Which variables go into which group, the first that fits: a part of the name (in upper case but for PATH), or its beginning.
ENV_GROUPS = (
    ("language", ("RUST", "CARGO", "PYTHON", "PIP", "NODE", "NPM", "YARN", "DENO", "BUN", "JAVA", "MAVEN", "GRADLE", "GO", "GOPATH", "GOROOT", "RUBY", "GEM", "PERL", "PHP", "DOTNET", "NUGET")),
    ("cloud", ("AWS", "AZURE", "GCP", "GOOGLE_CLOUD", "DOCKER", "KUBERNETES", "K8S", "HELM", "TERRAFORM", "VAULT", "CONSUL", "NOMAD")),
    ("tool", ("EDITOR", "VISUAL", "SHELL", "TERM", "GIT", "SSH", "GPG", "BREW", "HOMEBREW", "XDG", "CLAUDE", "ANTHROPIC")),
)
ENV_OTHER = ("HOME", "USER", "LANG", "LC_", "TZ", "PWD", "OLDPWD")


def env_group(name: Column | str, filtered: bool = False) -> Column:
    """The group of a variable, null if it isn't shown; with a filter by name every variable that passes it is."""
    name = T.c(name)
    other = lambda up: F.lit("other") if filtered else F.when(up.rlike("^(?:" + "|".join(ENV_OTHER) + ")"), "other")
    found = lambda up: F.coalesce(*[F.when(up.rlike("|".join(parts)), F.lit(g)) for g, parts in ENV_GROUPS], other(up))
    return F.when(name.contains("PATH"), "path").otherwise(T.bound(F.upper(name), found))


def _env_value(name: Column, value: Column, show_all: bool) -> Column:
    long = F.concat(F.left(value, F.lit(50)), F.lit("... ("), F.char_length(value).cast("string"), F.lit(" chars)"))
    return F.when(T.is_sensitive(name) & F.lit(not show_all), T.mask_value(value)).when(F.char_length(value) > 100, long).otherwise(value)


def env_rows(df: DataFrame, id_col: str = "id", text_col: str = "text", contains: str | None = None, show_all: bool = False) -> DataFrame:
    """NAME=value lines by group; sensitive values masked, those over 100 characters cut to 50 with their length.

    contains: shows variables whose name has this part, in any case, and no others.
    """
    name, value = F.regexp_extract("raw", r"^([^=]+)=", 1), F.regexp_extract("raw", r"^[^=]+=(.*)$", 1)
    rows = _lines(df, id_col, text_col).where(F.col("raw").contains("=")).select("id", "at", name.alias("name"), env_group(name, contains is not None).alias("group"), _env_value(name, value, show_all).alias("shown"))
    return rows.where(F.col("group").isNotNull() & (F.lower("name").contains(contains.lower()) if contains else F.lit(True)))


#: The headings of the groups.
ENV_HEADS = {"path": "PATH Variables:\n", "language": "\nLanguage/Runtime:\n", "cloud": "\nCloud/Services:\n", "tool": "\nTools:\n", "other": "\nOther:\n"}


def env_report(x: Column | str, contains: str | None = None, show_all: bool = False, paths: int = 10, others: int = 20) -> Column:
    """NAME=value lines as one text: groups by name, the entries of PATH one by one, at most 20 other variables."""
    return T.bound(T.c(x), lambda t: T.bound(F.filter(T.lines(t), lambda s: s != ""), lambda raw: _env_report(raw, contains, show_all, paths, others)))


def _env_report(raw: Column, contains: str | None, show_all: bool, paths: int, others: int) -> Column:
    def row(s: Column, i: Column) -> Column:
        value = lambda name: s.substr(F.length(name) + 2, F.length(s))
        made = lambda name, v: F.struct(name.alias("name"), i.alias("i"), _env_value(name, v, show_all).alias("shown"), env_group(name, contains is not None).alias("group"))
        return T.bound(F.regexp_extract(s, "^[^=]*", 0), lambda name: T.bound(value(name), lambda v: made(name, v)))

    rows = F.sort_array(F.transform(raw, row))  # by their own order: array_sort would call a comparator for each pair
    some = F.filter(rows, lambda r: F.lower(r["name"]).contains(contains.lower())) if contains is not None else rows
    left = lambda n, cap, pad: F.when(n > cap, F.concat(F.lit(f"{pad}... +"), (n - cap).cast("string"), F.lit(" more\n"))).otherwise("")

    def listed(entries: Column) -> Column:
        each = F.array_join(F.transform(F.slice(entries, 1, paths), lambda e: F.concat(F.lit("    "), e, F.lit("\n"))), "")
        return F.concat(F.lit("  PATH ("), F.size(entries).cast("string"), F.lit(" entries):\n"), each, left(F.size(entries), paths, "    "))

    def line(r: Column) -> Column:
        return F.when(r["name"] == "PATH", T.bound(F.split(r["shown"], ":"), listed)).otherwise(F.concat(F.lit("  "), r["name"], F.lit("="), r["shown"], F.lit("\n")))

    def report(of: Column) -> Column:
        def part(g: str) -> Column:
            a = F.slice(of[g], 1, others) if g == "other" else of[g]
            return F.when(F.size(of[g]) > 0, F.concat(F.lit(ENV_HEADS[g]), F.array_join(F.transform(a, line), ""), left(F.size(of[g]), others, "  ") if g == "other" else F.lit(""))).otherwise("")

        shown = sum((F.size(of[g]) for g in ENV_HEADS if g != "other"), F.least(F.size(of["other"]), F.lit(others)))
        total = F.lit("") if contains is not None else F.concat(F.lit("\nTotal: "), F.size(raw).cast("string"), F.lit(" vars (showing "), shown.cast("string"), F.lit(" relevant)\n"))
        return F.concat(*map(part, ENV_HEADS), total)

    among = lambda a, g: F.filter(a, lambda r: r["group"] == g)
    return T.bound(some, lambda a: T.bound(F.struct(*[among(a, g).alias(g) for g in ENV_HEADS]), report))


def psql_rows(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Cells of an ASCII table, trimmed, without rules and the row count."""
    rows = _lines(df, id_col, text_col).where(~F.col("raw").rlike(r"^[\s|+-]*$|^\(\d+ rows?\)"))
    return rows.select("id", "at", F.transform(F.split("raw", r"\|"), lambda x: F.trim(x)).alias("cells"))


#: Fixed value: the date of a long listing, with the blanks around it.
_LS_DATE = r"\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+[0-9]{1,2}\s+(?:[0-9]{4}|[0-9]{2}:[0-9]{2})\s+"
#: Extensions told of a listing.
EXTENSIONS = 5


def ls_report(x: Column | str, show_all: bool = False, modes: bool = False, noise: tuple[str, ...] = ()) -> Column:
    """(entries, summary, parsed) of a long listing: folders, then files with their sizes, with ``modes`` as octals; counts by extension, the most frequent five.

    Folders and files of ``noise`` are left out unless all are asked for. Without any entry the text is ``(empty)``, and nothing at all where no line could be read.
    """
    dots = lambda s: F.rtrim(s).endswith(".")

    def entry(s: Column) -> Column:
        before = F.filter(F.split(F.regexp_extract(s, rf"^((?:(?!{_LS_DATE}).)*+){_LS_DATE}", 1), r"\s+"), lambda p: p != "")
        sizes = F.filter(before, lambda p: p.rlike(r"^[0-9]+\z"))
        name = F.regexp_extract(s, rf"^(?:(?!{_LS_DATE}).)*+{_LS_DATE}(.*)\z", 1)
        return F.when(~dots(s) & s.rlike(_LS_DATE) & (F.size(before) >= 4), F.struct(before[0].alias("perms"), F.coalesce(F.try_element_at(sizes, F.lit(-1)).cast("long"), F.lit(0)).alias("size"), name.alias("name")))

    def told(lines: Column, found: Column) -> Column:
        shown = found if show_all or not noise else F.filter(found, lambda e: ~e["name"].isin(*noise))
        folder = lambda e: e["perms"].startswith("d")
        mode = lambda e: F.when((F.length(e["perms"]) >= 10) & ~e["perms"].rlike(r"[^\x00-\x7f]"), F.concat(T.perms_to_octal(e["perms"]), F.lit("  "))).otherwise("") if modes else F.lit("")
        return T.bound(F.struct(F.filter(shown, folder).alias("dirs"), F.filter(shown, lambda e: ~folder(e)).alias("files")), lambda k: F.struct(
            F.when((F.size(k["dirs"]) == 0) & (F.size(k["files"]) == 0), F.when((F.size(found) > 0) | (F.size(lines) == 0) | F.forall(lines, dots), "(empty)\n").otherwise("")).otherwise(F.concat(
                F.array_join(F.transform(k["dirs"], lambda e: F.concat(mode(e), e["name"], F.lit("/\n"))), ""), F.array_join(F.transform(k["files"], lambda e: F.concat(mode(e), e["name"], F.lit("  "), T.human_size(e["size"]), F.lit("\n"))), ""))).alias("entries"),
            F.when((F.size(k["dirs"]) > 0) | (F.size(k["files"]) > 0), F.concat(F.lit("\nSummary: "), F.size(k["files"]).cast("string"), F.lit(" files, "), F.size(k["dirs"]).cast("string"), F.lit(" dirs"), _by_extension(k["files"]), F.lit("\n"))).otherwise("").alias("summary"),
            F.when((F.size(k["dirs"]) > 0) | (F.size(k["files"]) > 0), F.size(found)).otherwise(0).alias("parsed")))

    kept = F.filter(T.lines(x), lambda s: (s != "") & ~s.startswith("total "))
    return T.bound(kept, lambda lines: T.bound(F.filter(F.transform(lines, entry), lambda e: e.isNotNull()), lambda found: told(lines, found)))


def _by_extension(files: Column) -> Column:
    ext = lambda e: F.when(e["name"].contains("."), F.regexp_extract(e["name"], r"(\.[^.]*)\z", 1)).otherwise("no ext")
    counts = F.array_sort(F.transform(grouped(F.transform(files, lambda e: F.struct(ext(e).alias("key"), e["name"].alias("item")))), lambda g: F.struct((-F.size(g["items"])).alias("n"), g["key"].alias("ext"))))
    more = lambda a: F.when(F.size(a) > EXTENSIONS, F.concat(F.lit(", +"), (F.size(a) - EXTENSIONS).cast("string"), F.lit(" more"))).otherwise("")
    return T.bound(counts, lambda a: F.when(F.size(a) > 0, F.concat(F.lit(" ("), F.array_join(F.transform(F.slice(a, 1, EXTENSIONS), lambda c: F.concat((-c["n"]).cast("string"), F.lit(" "), c["ext"])), ", "), more(a), F.lit(")"))).otherwise(""))
