"""Shell command lines: a token stream with offsets, splitting, base commands, classification and rewriting.

All are Column expressions. A command is cut into tokens by one pattern whose matches cover it without gaps, so that offsets are sums of
lengths and any part of it can be put together again from a run of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, c, utrim

#: An escaped character, a quoted part, or a part that stays open to the end.
_QUOTED = r"\\[\s\S]|'[^']*+(?:'|\z)|\"(?:\\[\s\S]|[^\"\\]|\\\z)*+(?:\"|\z)|\\\z"
_BLANK = r"[ \t\n\r\x0B\f]"
#: Digits right before a redirection belong to it.
_WORD = rf"(?:{_QUOTED}|[^ \t\n\r\x0B\f&|;<>'\"\\\d]++|\d++(?![<>]))++"
_TOKEN = rf"{_BLANK}++|&&|\|\||[;|]|&>++|&|\d*[<>][<>&-]*+(?:(?<=&)\d++)?|{_WORD}"


def token_kind(value: Column) -> Column:
    """blank, operator (&&, ||, ;), pipe, background, redirect or arg."""
    return (
        F.when(value.rlike(rf"^{_BLANK}"), "blank").when(value.isin("&&", "||", ";"), "operator").when(value == "|", "pipe").when(value == "&", "background")
        .when(value.rlike(r"^(?:\d*[<>]|&>)"), "redirect").otherwise("arg")
    )


def lex(x: Column | str) -> Column:
    """The tokens of a command: array of (kind, value, at), blanks included; ``at`` is the number of characters before a token. Values joined give the command."""

    def step(s: Column, v: Column) -> Column:
        return F.struct((s["at"] + F.length(v)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    def placed(values: Column) -> Column:
        at = F.aggregate(values, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])
        return F.zip_with(values, at, lambda v, a: F.struct(token_kind(v).alias("kind"), v.alias("value"), a.alias("at")))

    return bound(F.regexp_extract_all(c(x), F.lit(_TOKEN), F.lit(0)), placed)


def _solid(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t["kind"] != "blank")


def _to_file(tokens: Column, sign: str = "") -> Column:
    """Whether a redirection (with ``sign`` in it) among tokens that aren't blank writes to or reads from a file: no copy of a descriptor, and not the null device."""

    def one(t: Column, i: Column) -> Column:
        target = F.try_element_at(tokens, (i + 2).cast("int"))
        return F.when((t["kind"] != "redirect") | t["value"].rlike(r">&[0-9-]+\z") | ~t["value"].contains(sign), False).otherwise(~(target["kind"].eqNullSafe("arg") & target["value"].eqNullSafe("/dev/null")))

    return F.exists(F.transform(tokens, one), lambda hit: hit)


def split_chain(x: Column | str) -> Column:
    """Segments between ``&&``, ``||``, ``;``, ``|`` and newlines outside quotes. A single ``&`` is text, a quote that stays open goes to the end; a here-document isn't split."""
    whole = c(x)
    tokens = F.regexp_extract_all(whole, F.lit(r"(?s)'[^']*+(?:'|\z)|\"[^\"]*+(?:\"|\z)|&&|\|\||[;|\n]|&|[^'\"&;|\n]++"), F.lit(0))
    cut = F.array_join(F.transform(tokens, lambda t: F.when(t.isin("&&", "||", ";", "|", "\n"), "\0").otherwise(t)), "")
    return F.filter(F.transform(F.when(whole.contains("<<"), F.array(whole)).otherwise(F.split(cut, "\0")), utrim), lambda p: p != "")


def tokenize(x: Column | str) -> Column:
    """Words with quotes and backslashes resolved; an open quote ends with the text, a backslash at the end stays."""

    def resolved(word: Column) -> Column:
        parts = F.regexp_extract_all(word, F.lit(rf"{_QUOTED}|[^'\"\\]++"), F.lit(0))
        plain = lambda t: F.regexp_replace(t, r"\\([\s\S])", "$1")
        inner = lambda t, q: F.regexp_replace(t, rf"^{q}|(?<=[\s\S]){q}\z", "")
        return F.array_join(F.transform(parts, lambda t: F.when(t.startswith("'"), inner(t, "'")).when(t.startswith('"'), plain(F.regexp_replace(F.regexp_replace(t, '^"', ""), r'(?<!\\)((?:\\\\)*)"\z', "$1"))).otherwise(plain(t))), "")

    wide = r"\s\x1c-\x1f\x{85}\p{Z}"
    return F.transform(F.regexp_extract_all(c(x), F.lit(rf"(?:{_QUOTED}|[^{wide}'\"\\])++"), F.lit(0)), resolved)


def strip_prefix(segment: Column | str) -> Column:
    """Without leading ``sudo``, ``env`` and variable assignments."""
    return F.regexp_replace(c(segment), r"^\s*(?:(?:sudo|env)\s+|[A-Za-z_][A-Za-z0-9_]*=\S*\s+)*", "")


def command_name(segment: Column | str) -> Column:
    """The program: first word without folders, quotes and Windows suffixes."""
    word = F.regexp_replace(F.regexp_extract(strip_prefix(segment), r"^(\S+)", 1), "[\"']", "")
    return F.regexp_replace(F.regexp_extract(word, r"([^/\\]*)$", 1), r"(?i)\.(exe|cmd|bat|ps1)$", "")


def base_command(segment: Column | str) -> Column:
    """The program and, unless it looks like an option or a path, its first argument."""
    second = F.regexp_extract(strip_prefix(segment), r"^\S+\s+(\S+)", 1)
    plain = (second != "") & ~second.startswith("-") & ~second.contains("/") & ~second.contains(".")
    return F.when(plain, F.concat(command_name(segment), F.lit(" "), second)).otherwise(command_name(segment))


def base_words(segment: Column | str) -> Column:
    """The same with the program as it is written, folders and all."""
    bare = strip_prefix(segment)
    first, second = F.regexp_extract(bare, r"^(\S+)", 1), F.regexp_extract(bare, r"^\S+\s+(\S+)", 1)
    plain = (second != "") & ~second.startswith("-") & ~second.contains("/") & ~second.contains(".")
    return F.when(plain, F.concat(first, F.lit(" "), second)).otherwise(first)


#: Programs whose output is never worth filtering, unless one of them is a command of its own.
IGNORED = (
    "cd", "pwd", "echo", "export", "set", "unset", "source", "alias", "clear", "exit", "true", "false", "test", "read", "wait", "sleep", "exec", "eval", "trap", "return",
    "mkdir", "rmdir", "touch", "rm", "cp", "mv", "ln", "chmod", "chown", "kill", "pushd", "popd", "umask",
)


def classify(segment: Column | str, commands: list[str], defs: list, program: str = "sieveline") -> Column:
    """covered (already run through ``program``), ignored, command, filter or unsupported."""
    from ..plans.filters import route

    name, whole = command_name(segment), F.trim(c(segment))
    skipped = [x for x in IGNORED if x not in commands]
    return F.when((whole == program) | whole.startswith(program + " "), "covered").when(name.isin(*skipped) | (name == ""), "ignored").when(name.isin(*commands), "command").when(route(strip_prefix(segment), defs).isNotNull(), "filter").otherwise("unsupported")


def has_heredoc(x: Column | str) -> Column:
    """Whether a here-document or here-string begins outside quotes."""
    return F.exists(lex(x), lambda t: (t["kind"] == "redirect") & t["value"].startswith("<<"))


def redirects_to_file(x: Column | str) -> Column:
    """Whether a command writes to a file by a redirection, not to a descriptor or the null device."""
    return bound(_solid(lex(x)), lambda tokens: _to_file(tokens, ">"))


def join_continuations(x: Column | str) -> Column:
    return F.regexp_replace(c(x), r"[ \t\x0B\f]*\\\r?\n[ \t\x0B\f]*", " ")


def program_name(segment: Column | str) -> Column:
    """The first word without folders and the suffix of a Windows program, quotes and all."""
    word = F.regexp_extract(c(segment), r"^[ \t]*([^ \t]*)", 1)
    return F.regexp_replace(F.regexp_extract(word, r"([^/\\]*)\z", 1), r"(?i)\.(?:exe|cmd|bat|ps1|com)\z", "")


#: What stands before a command: wrappers and assignments, of which a quoted value ends with its quote.
_LEAD = r"""^(?:(?:sudo|env)[ \t]+|[A-Z_][A-Z0-9_]*=(?:"(?:\\[\s\S]|[^"\\])*+"|'(?:\\[\s\S]|[^'\\])*+'|(?!["'])[^ \t]*+)[ \t]+)*+"""


def _unattestable(command: Column, tokens: Column) -> Column:
    """Whether a command holds what can't be taken apart safely: a here-document, arithmetic, substitution, or a redirection to a file."""
    here = F.exists(tokens, lambda t: (t["kind"] == "redirect") & t["value"].startswith("<<"))
    return here | command.contains("$((") | has_substitution(command) | _to_file(tokens)


def has_substitution(x: Column | str) -> Column:
    """Whether a command runs another for its text: a backtick or ``$(`` outside single quotes, ``<(`` or ``>(`` outside all quotes."""
    parts = F.regexp_extract_all(c(x), F.lit(rf"{_QUOTED}|[^'\"\\]++"), F.lit(0))
    bare = lambda t: F.regexp_replace(t, r"\\[\s\S]", "")
    return F.exists(parts, lambda t: F.when(t.startswith("'") | t.startswith("\\"), False).when(t.startswith('"'), bare(t).rlike(r"`|\$\(")).otherwise(t.rlike(r"`|\$\(|[<>]\(")))


def _segments(tokens: Column) -> Column:
    """(text, op) of the commands before the first pipe, joined again from their tokens; ``op`` is the sign that ends a command, as it is written again."""
    ends = F.transform(F.filter(F.transform(tokens, lambda t, i: F.struct(t["kind"].alias("kind"), i.alias("i"))), lambda t: t["kind"].isin("operator", "background")), lambda t: t["i"])

    def one(bounds: Column) -> Column:
        def segment(k: Column) -> Column:
            a, b = F.element_at(bounds, k.cast("int")), F.element_at(bounds, (k + 1).cast("int"))
            sign = F.try_element_at(tokens, (b + 1).cast("int"))
            last = b + 1 >= F.size(tokens)
            op = F.when(sign.isNull(), "").when(sign["value"] == ";", F.when(last, ";").otherwise("; ")).otherwise(F.concat(F.lit(" "), sign["value"], F.lit(" ")))
            return F.struct(utrim(F.array_join(F.transform(F.slice(tokens, a + 2, b - a - 1), lambda t: t["value"]), "")).alias("text"), op.alias("op"))

        return F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), segment)

    return bound(F.concat(F.array(F.lit(-1)), ends, F.array(F.size(tokens))), one)


def excluded_by(command: Column, excluded: tuple[str, ...] | list[str]) -> Column:
    """Whether a command is one of a list, or begins with one and a blank; a leading ``^`` of a list's item is ignored."""
    out = F.lit(False)
    for p in (e.strip().removeprefix("^") for e in excluded):
        if p:
            out = out | (command == p) | command.startswith(p + " ") | command.startswith(p + "\t")
    return out


def rewrite(x: Column | str, program: str, commands: list[str] | tuple[str, ...], defs: list | tuple = (), excluded: list[str] | tuple[str, ...] = ()) -> Column:
    """A command with ``program`` put before each of its parts that it handles; null where nothing changes or the command isn't to be touched.

    A part is handled if its program is one of ``commands`` or its line, with the program's bare name, routes to one of ``defs``. Wrappers and
    assignments stay before ``program``, redirections of descriptors after the command; what follows a pipe stays as it is, and so do ``find`` and ``fd``, whose output others read.
    Commands with here-documents, substitution, arithmetic or redirections to files give null, those that are run by ``program`` already themselves.
    """
    from ..plans.filters import route

    def segment(text: Column) -> Column:
        lead = F.regexp_extract(text, _LEAD, 0)
        parts = split_redirects(utrim(text.substr(F.length(lead) + 1, F.length(text))))

        def made(p: Column) -> Column:
            head, name = p["head"], program_name(p["head"])
            line = F.regexp_replace(F.concat(name, F.lit(" "), utrim(F.regexp_replace(head, r"^[ \t]*[^ \t]*", ""))), r" \z", "")
            handled = name.isin(*commands) if commands else F.lit(False)
            handled = handled | route(line, list(defs)).isNotNull() if defs else handled
            stays = (text == "") | program_name(text).isin("find", "fd") | (head == "") | (name == "") | (utrim(head) == program) | utrim(head).startswith(program + " ") | excluded_by(head, excluded) | ~handled
            return F.when(stays, text).otherwise(F.concat(lead, F.lit(program + " "), head, F.when(p["tail"] == "", "").otherwise(F.concat(F.lit(" "), p["tail"]))))

        return bound(parts, made)

    def whole(command: Column, tokens: Column) -> Column:
        pipe = F.array_position(F.transform(tokens, lambda t: t["kind"]), "pipe").cast("int")
        before = F.when(pipe > 0, F.slice(tokens, 1, F.greatest(pipe - 1, F.lit(0)))).otherwise(tokens)
        after = F.when(pipe > 0, F.concat(F.lit(" "), utrim(F.array_join(F.transform(F.slice(tokens, F.greatest(pipe, F.lit(1)), F.size(tokens)), lambda t: t["value"]), "")))).otherwise("")
        put = lambda segs: bound(F.transform(segs, lambda g: F.struct(segment(g["text"]).alias("new"), g["text"].alias("old"), g["op"].alias("op"))), lambda made: F.when(F.exists(made, lambda g: g["new"] != g["old"]), F.concat(F.array_join(F.transform(made, lambda g: F.concat(g["new"], g["op"])), ""), after)))
        done = ~command.rlike(r"&&|\|\||[;|]| & ") & ((command == program) | command.startswith(program + " "))
        return F.when((command == "") | _unattestable(command, _solid(tokens)), None).when(done, command).otherwise(bound(_segments(before), put))

    return bound(utrim(join_continuations(x)), lambda command: bound(lex(command), lambda tokens: whole(command, tokens)))


def encode_project(path: Column | str) -> Column:
    return F.regexp_replace(c(path), r"[^\x00-\x7F]|[/._\\ \[\]]", "-")


def split_redirects(x: Column | str) -> Column:
    """(head, tail): a command and the redirections at its end; nothing is split off where there are quotes or the command is nothing else."""
    whole = c(x)
    words = F.filter(F.split(whole, r"\s+"), lambda w: w != "")
    redirect = r"^[0-9]*(?:>|&>)"
    # a word at the end goes with the redirection before it
    tail = rf"(?:\s+(?:[0-9]*(?:>|&>)\S*(?:\s+(?![0-9]*(?:>|&>))\S+(?=\s*\z|\s+[0-9]*(?:>|&>)))?))+\s*\z"
    joined = F.array_join(words, " ")
    head = F.regexp_replace(joined, tail, "")
    none = whole.rlike("[\"']") | (head == joined) | words[0].rlike(redirect)
    return F.struct(F.when(none, whole).otherwise(head).alias("head"), F.when(none, "").otherwise(F.trim(F.substring(joined, F.length(head) + 1, F.length(joined)))).alias("tail"))
