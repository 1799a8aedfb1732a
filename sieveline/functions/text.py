"""Column functions over text blobs and their lines. All stay in generated code; none shuffles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the wide sense, for trimming at the ends.
_WIDE = r"[\s\x{85}\p{Z}]"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out once, however often ``f`` names it."""
    return F.transform(F.array(x), f)[0]


def utrim(x: Column | str) -> Column:
    """Trims Unicode white space, where ``trim`` takes spaces only."""
    return F.regexp_replace(c(x), rf"^{_WIDE}+|{_WIDE}+\z", "")


def is_blank(x: Column | str) -> Column:
    return c(x).rlike(rf"^{_WIDE}*\z")


def normalize_newlines(x: Column | str) -> Column:
    """Line ends of other systems as \\n. Most texts have none and are only searched for \\r, which is far cheaper than a pattern."""
    return F.when(c(x).contains("\r"), F.regexp_replace(c(x), r"\r\n?", "\n")).otherwise(c(x))


def strip_ansi(x: Column | str) -> Column:
    return F.regexp_replace(c(x), r"\x1b\[[0-9;]*[a-zA-Z]", "")


def lines(x: Column | str) -> Column:
    """Lines of a text; one empty line after the last newline isn't one."""
    a = F.split(c(x), "\n", -1)
    return F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a)


def unlines(a: Column) -> Column:
    return F.array_join(a, "\n")


def count_lines(x: Column | str) -> Column:
    return F.when(c(x) == "", 0).otherwise(F.size(lines(x)))


def est_tokens(x: Column | str) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.floor((F.octet_length(c(x)) + 3) / 4).cast("long")


def saved_pct(raw: Column, out: Column) -> Column:
    return F.when(raw > 0, (raw - out) * 100.0 / raw).otherwise(0.0)


def truncate(x: Column | str, n: int) -> Column:
    """The first n characters, without a mark; n <= 0 leaves the text."""
    return c(x) if n <= 0 else F.left(c(x), F.lit(n))


def ellipsis(x: Column | str, n: int, mark: str = "...") -> Column:
    """At most n characters with the mark included; below the mark's length the mark alone."""
    if n < len(mark):
        return F.when(F.char_length(c(x)) > n, mark).otherwise(c(x))
    return F.when(F.char_length(c(x)) > n, F.concat(F.left(c(x), F.lit(n - len(mark))), F.lit(mark))).otherwise(c(x))


def byte_gated(x: Column | str, limit: int = 100, keep: int = 97) -> Column:
    """Texts over ``limit`` bytes and ``keep`` characters are cut to as many characters and marked."""
    return F.when((F.octet_length(c(x)) > limit) & (F.char_length(c(x)) > keep), F.concat(F.left(c(x), F.lit(keep)), F.lit("..."))).otherwise(c(x))


def any_of(x: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches; dot excludes newlines only."""
    return x.rlike("(?d)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def tenths(n: Column | str, unit: int) -> Column:
    """A whole number of units to one decimal, as a double nearest to the quotient is printed: where the quotient lies halfway, the double's error decides, and of two equally near ones the even."""
    n = c(n).cast("long")
    whole = F.floor(n / unit)
    rest = (n - whole * unit) * 10  # tenths of what is left, in units
    down = whole * 10 + F.floor(rest / unit)
    over = F.pmod(rest, F.lit(unit)) * 2
    # the quotient times the unit, exactly, as a sum of two doubles: its distance from n is the error
    x = n / float(unit)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    product = x * float(unit)
    error = (product - n) + ((high * float(unit) - product) + (x - high) * float(unit))
    up = (over > unit) | ((over == unit) & ((error > 0) | ((error == 0) & (down % 2 == 1))))
    t = down + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def format_count(n: Column | str) -> Column:
    """1234 as 1.2K, 1500000 as 1.5M."""
    n = c(n)
    return F.when(n >= 1_000_000, F.concat(tenths(n, 1_000_000), F.lit("M"))).when(n >= 1000, F.concat(tenths(n, 1000), F.lit("K"))).otherwise(n.cast("string"))


def human_size(n: Column | str) -> Column:
    n = c(n)
    return F.when(n >= 1 << 20, F.concat(tenths(n, 1 << 20), F.lit("M"))).when(n >= 1024, F.concat(tenths(n, 1024), F.lit("K"))).otherwise(F.concat(n.cast("string"), F.lit("B")))


def human_bytes(n: Column | str) -> Column:
    n = c(n)
    units = [("TB", 1 << 40), ("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)]
    return reduce(lambda a, u: a.when(n >= u[1], F.concat(tenths(n, u[1]), F.lit(" " + u[0]))), units[1:], F.when(n >= units[0][1], F.concat(tenths(n, units[0][1]), F.lit(" TB")))).otherwise(
        F.concat(n.cast("string"), F.lit(" B"))
    )


def mask_value(x: Column | str) -> Column:
    """Two characters at each end; short values not at all."""
    x = c(x)
    return F.when(F.char_length(x) <= 4, "****").otherwise(F.concat(F.left(x, F.lit(2)), F.lit("****"), F.right(x, F.lit(2))))


#: What marks a variable's name as sensitive.
SENSITIVE = ("key", "secret", "password", "token", "credential", "auth", "private", "api_key", "apikey", "access_key", "jwt")


def is_sensitive(name: Column | str) -> Column:
    return F.lower(c(name)).rlike("|".join(SENSITIVE))


def basename(x: Column | str) -> Column:
    return F.regexp_extract(c(x), r"([^/\\]*)\z", 1)


def last_segment(x: Column | str, sep: str = "/") -> Column:
    return F.substring_index(c(x), sep, -1)


def extension(name: Column | str) -> Column:
    """The part after the last dot of a name; names without, or that begin with their only dot, have none."""
    return F.coalesce(F.nullif(F.regexp_extract(basename(name), r"^[^.]?.*[^.]\.([^.]+)\z|^.+\.([^.]+)\z", 1), F.lit("")), F.lit("none"))


def anchored_path(x: Column | str, anchors: list[str]) -> Column:
    """From the first of the anchor folders on, in the order of the list; else the name alone."""
    x = c(x)
    found = [F.when(F.instr(x, f"/{a}/") > 0, F.concat(F.lit(f"{a}/"), F.substring_index(x, f"/{a}/", -1))) for a in anchors]
    return F.coalesce(*found, basename(x))


def compact_path(x: Column | str, limit: int = 50) -> Column:
    """Long paths as first/.../parent/name."""
    x = c(x)
    p = F.split(x, "/")
    return F.when((F.octet_length(x) > limit) & (F.size(p) > 3), F.concat(p[0], F.lit("/.../"), F.element_at(p, -2), F.lit("/"), F.element_at(p, -1))).otherwise(x)


def compact_url(x: Column | str) -> Column:
    bare = F.regexp_replace(c(x), r"^https?://", "")
    return F.when(F.char_length(bare) > 50, F.concat(F.left(bare, F.lit(25)), F.lit("..."), F.right(bare, F.lit(20)))).otherwise(bare)


def short_arn(x: Column | str) -> Column:
    x = c(x)
    return F.when(F.instr(x, "/") > 0, F.substring_index(x, "/", -1)).when(F.instr(x, ":") > 0, F.substring_index(x, ":", -1)).otherwise(x)


def perms_to_octal(perms: Column | str) -> Column:
    """drwxr-xr-x as 755; set-user, set-group and sticky bits give a leading digit."""
    p = c(perms)
    ch = lambda k: F.substring(p, k, 1)
    bit = lambda k, yes, v: F.when(ch(k).isin(*yes), v).otherwise(0)
    group = lambda k, x: bit(k, ("r",), 4) + bit(k + 1, ("w",), 2) + bit(k + 2, ("x", x), 1)
    special = bit(4, ("s", "S"), 4) + bit(7, ("s", "S"), 2) + bit(10, ("t", "T"), 1)
    plain = F.concat(group(2, "s").cast("string"), group(5, "s").cast("string"), group(8, "t").cast("string"))
    return F.when(special > 0, F.concat(special.cast("string"), plain)).otherwise(plain)


#: What a log line is normalised by before it is counted, in this order.
LOG_STEPS = (
    (r"^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]?\d*\s*", ""),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<UUID>"),
    (r"0x[0-9a-fA-F]+", "<HEX>"),
    (r"\b\d{4,}\b", "<NUM>"),
    (r"/[\w./\-]+", "<PATH>"),
)


def normalize_log(x: Column | str) -> Column:
    return utrim(reduce(lambda a, s: F.regexp_replace(a, s[0], s[1]), LOG_STEPS, c(x)))


def log_severity(x: Column | str) -> Column:
    """error before warn before info, on the lower-cased raw line; null where none."""
    low = F.lower(c(x))
    return F.when(low.rlike("error|fatal|panic|critical|alert|emerg|severe"), "error").when(low.rlike("warn|notice"), "warn").when(low.rlike("info"), "info")


def char_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters; two empty texts are alike."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    x, y = F.filter(x, lambda ch: ch != ""), F.filter(y, lambda ch: ch != "")
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def progress_bar(pct: Column, width: int = 10) -> Column:
    full = F.floor(pct * width / 100 + 0.5).cast("int")
    return F.concat(F.repeat(F.lit("@"), full), F.repeat(F.lit("."), F.lit(width) - full))


def number_lines(x: Column | str) -> Column:
    a = lines(x)
    width = F.length(F.size(a).cast("string"))
    return unlines(F.transform(a, lambda s, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit(" │ "), s)))
