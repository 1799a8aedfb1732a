"""Surrogates for personal data, in DataFrame operations only.

Entities are found by one pattern per type. A surrogate is drawn from a keyed hash of the type and the entity's
canonical form, so the same person, number or address gets the same replacement in every document and
spelling (coreference). It keeps the type and form: digits become digits, letters letters of the same script
and case, separators stay; card numbers pass the Luhn check, address octets stay in range, names
keep their title and get an ending of its gender. Distinct entities get distinct surrogates, and no
surrogate equals a real entity: both are checked over the whole table, and those that fail are
drawn again until none is left. Documents without a match aren't shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch, with_row

#: Titles by gender (f, m, n), in the languages at hand.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Sra", "Señora", "Srta"), "m": ("Mr", "Herr", "Monsieur", "Sr", "Señor"), "n": ("Dr", "Prof")}
#: A capitalised word, or one of a script without case.
_NAME = r"(?:\p{Lu}[\p{L}\p{M}'’-]+|\p{Lo}[\p{L}\p{M}'’-]*)"
#: Words after which a name without a title stands. Other names without a title aren't found: no pattern tells them from other capitalised words.
CUES = ("my name is ", "My name is ", "name: ", "Name: ", "signed by ", "Signed by ", "Dear ", "Regards, ", "Sincerely, ", "ich heiße ", "Ich heiße ", "me llamo ", "Me llamo ", "je m'appelle ", "Je m'appelle ")
_ANY_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=lambda t: (-len(t), t)))
#: Patterns by type; the first type that matches a mention whole gives its type.
#: A secret's mention begins with its key word; ``_body`` takes that off again.
_SECRET_KEY = r"(?i:password|passwd|token|secret|api_key|apikey)"
_SECRET_LEAD = _SECRET_KEY + r"(?:\\?[\"'])?\s*+[=:]\s*+"
#: To the closing quote; else a bare JSON value; else to white space, without the punctuation of a sentence or bracket.
_SECRET_BODY = (
    r"(?:\\\"[^\"\r\n]{8,}?(?=\\\")|\"(?=(?:[^\"\r\n]|(?<=\\)\"){8})[^\"\r\n]*+(?:(?<=\\)\"[^\"\r\n]*+)*+(?=\")"
    r"|'(?=(?:[^'\r\n]|(?<=\\)'){8})[^'\r\n]*+(?:(?<=\\)'[^'\r\n]*+)*+(?=')"
    r"|(?<=[\"']\s{0,9}[=:]\s{0,9})(?![\"'\\])[^\s,}\]\"']{8,}(?=\s*[,}\]])"
    r"|(?!\\?\"[^\"\r\n]*\"|\\?'[^'\r\n]*')(?:\\?[\"'])?\S{7,}[^\s.,;:)\]}>\"'])"
)
TYPES = {
    "email": r"(?<![\p{L}\d._%+-])[\p{L}\d_%+-](?:[\p{L}\d._%+-]{0,62}[\p{L}\d_%+-])?@(?:[\p{L}\d](?:[\p{L}\d-]{0,61}[\p{L}\d])?\.)+\p{L}{2,24}",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": _SECRET_LEAD + _SECRET_BODY,
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "phone": r"(?<![\p{L}\d+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]\d{3,4}(?![\p{L}\d])|(?<![\p{L}\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![\p{L}\d])",
    "name": rf"(?<![\p{{L}}])(?:{_ANY_TITLE})\.? {_NAME}(?: {_NAME})*+|(?<={'|'.join(CUES)}){_NAME}(?: {_NAME})++",
}
#: A key word before an entity of another type that ends where the value ends leaves it to that type.
TYPES["secret"] = _SECRET_LEAD + r"(?!(?:\\?[\"'])?(?:" + "|".join(f"(?:{TYPES[k]})" for k in ("email", "access_key", "ssn", "card", "ip", "phone", "iban")) + r")(?:[\s\"'.,;:)\]}>\\]|$))" + _SECRET_BODY
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())
#: A cheap test that every match passes.
HINT = rf"[@\d]|AKIA|ASIA|(?<![\p{{L}}])(?:{_ANY_TITLE})\b|(?i:password|passwd|token|secret|api_?key)|{'|'.join(CUES)}"


def _kind(mention: Column) -> Column:
    shapes = {k: f"^(?:{p})$" for k, p in TYPES.items() if k != "secret"}
    shapes["name"] = rf"^(?:(?:{_ANY_TITLE})\.? )?{_NAME}(?: {_NAME})*+$"  # the cue before a mention isn't seen here
    order = ("email", "access_key", "ssn", "card", "ip", "phone", "name", "iban")
    return reduce(lambda acc, k: acc.when(mention.rlike(shapes[k]), F.lit(k)), order[1:], F.when(mention.rlike(shapes[order[0]]), F.lit(order[0]))).otherwise("secret")


def _lead(kind: Column, mention: Column) -> Column:
    """What of a mention stays as it is: a secret's key word, sign and opening quote."""
    return F.when(kind == "secret", F.regexp_extract(mention, rf"^{_SECRET_LEAD}(?:\\?[\"'])?", 0)).otherwise("")


def _body(kind: Column, mention: Column) -> Column:
    return mention.substr(F.length(_lead(kind, mention)) + 1, F.length(mention))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def canonical(kind: Column, mention: Column) -> Column:
    """What two spellings of one entity share."""
    d = _digits(mention)
    national = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return (
        F.when(kind == "email", F.lower(mention)).when(kind.isin("card", "ssn"), d).when(kind == "phone", national)
        .when(kind == "iban", F.regexp_replace(mention, " ", "")).when(kind == "name", F.regexp_replace(mention, rf"^((?:{_ANY_TITLE}))\.? ", "$1 ")).otherwise(mention)
    )


def _bytes(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """An array of 128 numbers 0..255 from the keyed hash."""
    hexes = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(k)), kind, attempt.cast("string"), value), 256) for k in range(4)])
    return F.transform(F.regexp_extract_all(hexes, F.lit("(..)")), lambda h: F.conv(h, 16, 10).cast("int"))


#: Letters and digits by class, ASCII first; what belongs to a script's class but isn't listed is replaced by what is.
ALPHABETS = {
    r"\d": "0123456789", "[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    r"[\p{IsCyrillic}&&\p{Ll}]": "абвгдежзийклмнопрстуфхцчшщъыьэюя", r"[\p{IsCyrillic}&&\p{Lu}]": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    r"[\p{IsGreek}&&\p{Ll}]": "αβγδεζηθικλμνξοπρστυφχψω", r"[\p{IsGreek}&&\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    r"[\p{IsLatin}&&\p{Lu}]": "ÀÁÂÄÈÉÊËÍÎÏÑÓÔÖÚÜ", r"[\p{IsLatin}&&\p{L}]": "àáâäèéêëíîïñóôöúü",
}
#: Letters of other scripts, first and last. Letters of scripts that aren't listed get Latin ones.
RANGES = {
    "IsHebrew": (0x05D0, 0x05EA), "IsArabic": (0x0628, 0x063A), "IsDevanagari": (0x0915, 0x0939), "IsBengali": (0x0995, 0x09A8), "IsThai": (0x0E01, 0x0E2E), "IsGeorgian": (0x10D0, 0x10F0),
    "IsHiragana": (0x3041, 0x3096), "IsKatakana": (0x30A1, 0x30FA), "IsHan": (0x4E00, 0x9FA5), "IsHangul": (0xAC00, 0xD7A3),
}


def _like(value: Column, noise: Column, hexes: bool = False) -> Column:
    """Each letter or digit replaced by one of its class; other characters stay. ``noise`` holds 128 numbers.

    ASCII, most of what there is, is told apart by comparing characters; patterns are for the rest only.
    """

    def one(ch: Column, i: Column) -> Column:
        n = F.element_at(noise, (i % 128 + 1).cast("int"))
        n = n + 7 * F.floor(i / 128).cast("int")
        if hexes:
            return F.element_at(F.split(F.lit("0123456789abcdef"), ""), (n % 16 + 1).cast("int"))
        taken = lambda letters: F.element_at(F.split(F.lit(letters), ""), (n % len(letters) + 1).cast("int"))
        between = lambda r: ch.between(r[0], r[-1])
        ascii_, others = list(ALPHABETS.values())[:3], list(ALPHABETS.items())[3:]
        pick = reduce(lambda acc, r: acc.when(between(r), taken(r)), ascii_[1:], F.when(between(ascii_[0]), taken(ascii_[0])))
        pick = pick.when((ch < "\x80") | ch.rlike(r"^[^\p{L}\d]$"), ch)
        for cls, letters in others:
            pick = pick.when(ch.rlike(f"^{cls}$"), taken(letters))
        wide = n * 251 + F.element_at(noise, ((i + 61) % 128 + 1).cast("int"))
        for script, (first, last) in RANGES.items():
            code = F.lpad(F.hex((F.lit(first) + wide % (last - first + 1)).cast("long")), 4, "0")
            pick = pick.when(ch.rlike(rf"^[\p{{{script}}}&&\p{{L}}]$"), F.decode(F.unhex(code), "UTF-16BE"))
        return pick.when(ch.rlike(r"^\p{L}$"), taken("àáâäèéêëíîïñóôöúü")).otherwise(ch)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(body: Column) -> Column:
    """The digits with the check digit that makes their Luhn sum a multiple of ten."""
    ds = F.reverse(F.transform(F.split(body, ""), lambda c: c.cast("int")))
    doubled = F.transform(ds, lambda d, i: F.when(i % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


_SYLLABLES = [c + v for c in "bdfglmnprstv" for v in "aeiou"]  # 60
_ENDINGS = {"f": ("la", "na", "ra", "sia", "lia", "tia", "via", "da"), "m": ("ron", "las", "mar", "ton", "ber", "dor", "vik", "lan"), "n": ("le", "re", "ne", "se", "ve", "te", "be", "de")}


def _name(value: Column, noise: Column, attempt: Column) -> Column:
    """Title, if there is one, then invented names of as many words: gender by the title, script by the letters. Later attempts make longer names, so names don't run out."""
    title = F.regexp_extract(value, rf"^(?:{_ANY_TITLE})", 0)
    words = F.slice(F.split(value, " "), F.when(title == "", 1).otherwise(2), F.size(F.split(value, " ")))
    gender = reduce(lambda acc, g: acc.when(title.isin(*TITLES[g]), F.lit(g)), ("m",), F.when(title.isin(*TITLES["f"]), F.lit("f"))).otherwise("n")
    syllables = F.array(*[F.lit(s) for s in _SYLLABLES])
    ends = reduce(lambda acc, g: acc.when(gender == g, F.array(*[F.lit(e) for e in _ENDINGS[g]])), ("m",), F.when(gender == "f", F.array(*[F.lit(e) for e in _ENDINGS["f"]]))).otherwise(F.array(*[F.lit(e) for e in _ENDINGS["n"]]))

    def made(word: Column, i: Column) -> Column:
        at = lambda k: F.element_at(noise, ((i * 8 + k - 1) % 128 + 1).cast("int"))
        more = F.array_join(F.transform(F.when(attempt > 3, F.sequence(F.lit(4), F.least(attempt, F.lit(7)))).otherwise(F.array().cast("array<int>")), lambda k: F.element_at(syllables, F.element_at(noise, ((i * 8 + k) % 128 + 1).cast("int")) % 60 + 1)), "")
        latin = F.initcap(F.concat(F.element_at(syllables, at(1) % 60 + 1), F.element_at(syllables, at(2) % 60 + 1), more, F.element_at(ends, at(3) % 8 + 1)))
        return F.when(word.rlike(r"^[\p{IsLatin}\p{M}'’-]+$"), latin).otherwise(_like(word, F.slice(F.concat(noise, noise), (i * 8 % 128 + 4).cast("int"), F.lit(128))))

    return F.concat(title, F.when(title == "", "").otherwise(" "), F.array_join(F.transform(words, made), " "))


#: Attempts after which the space of a form counts as crowded.
CROWDED = 20


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The canonical surrogate of a canonical entity."""
    # the hash is bound to a name, else it would be worked out again for every character
    return F.element_at(F.transform(F.array(_bytes(key, kind, value, attempt)), lambda b: _drawn(b, kind, value, attempt)), 1)


def _drawn(b: Column, kind: Column, value: Column, attempt: Column) -> Column:
    at = lambda k: F.element_at(b, k)
    # secrets of which there are too many of a form are lengthened after some attempts, by a letter or digit of their last kind for each further one
    digits = _like(F.when((kind == "secret") & (attempt >= CROWDED), F.concat(value, F.repeat(F.right(value, F.lit(1)), attempt - CROWDED + 1))).otherwise(value), b)
    email = F.concat(_like(F.substring_index(value, "@", 1), b), F.lit("@"), _like(F.regexp_replace(F.substring_index(value, "@", -1), r"\.[^.]+$", ""), F.concat(F.slice(b, 65, 64), F.slice(b, 1, 64))), F.regexp_extract(value, r"\.[^.]+$", 0))
    octet = lambda k: (at(k) % 254 + 1).cast("string")
    card = _luhn(F.concat(F.substring(value, 1, 1), digits.substr(F.lit(2), F.length(value) - 2)))
    phone = F.concat((at(100) % 8 + 2).cast("string"), digits.substr(F.lit(2), F.length(value)))
    return (
        F.when(kind == "email", email).when(kind == "ip", F.concat_ws(".", octet(1), octet(2), octet(3), octet(4))).when(kind == "card", card).when(kind == "phone", phone)
        .when(kind == "name", _name(value, b, attempt)).when(kind == "access_key", F.concat(F.substring(value, 1, 4), _like(value.substr(F.lit(5), F.length(value)), b)))
        .when(kind == "iban", F.concat(F.substring(value, 1, 2), _like(value.substr(F.lit(3), F.length(value)), b)))
        .when((kind == "secret") & value.rlike("^[0-9a-f]+$"), _like(value, b, hexes=True)).otherwise(digits)
    )


def rendered(kind: Column, mention: Column, form: Column) -> Column:
    """A canonical surrogate in the mention's own format: separators, country code, case and title as they stand."""
    d, width = F.length(_digits(mention)), F.length(form)
    chars, letters = F.split(mention, ""), F.split(form, "")
    # digits of the mention are filled from the right; those beyond the canonical form (a country code) stay
    filled = F.aggregate(
        chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("i")),
        lambda s, ch: F.struct(
            F.concat(s["out"], F.when(ch.rlike(r"^\d$") & (s["i"] >= d - width), F.element_at(letters, (s["i"] - (d - width) + 1).cast("int"))).otherwise(ch)).alias("out"),
            (s["i"] + F.when(ch.rlike(r"^\d$"), 1).otherwise(0)).alias("i")),
        lambda s: s["out"])
    spaced = F.aggregate(
        chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("i")),
        lambda s, ch: F.struct(F.concat(s["out"], F.when(ch == " ", ch).otherwise(F.element_at(letters, s["i"] + 1))).alias("out"), (s["i"] + F.when(ch == " ", 0).otherwise(1)).alias("i")),
        lambda s: s["out"])
    # a letter that lower case makes longer shifts all behind it, then the case isn't known any more
    cased = F.when(F.size(letters) == F.size(chars), F.array_join(F.zip_with(letters, chars, lambda c, m: F.when(m.rlike(r"^\p{Lu}$"), F.upper(c)).otherwise(c)), "")).otherwise(form)
    named = F.concat(F.regexp_extract(mention, rf"^(?:{_ANY_TITLE})\.? ", 0), F.regexp_replace(form, rf"^(?:{_ANY_TITLE}) ", ""))
    return F.when(kind.isin("phone", "card", "ssn"), filled).when(kind == "email", cased).when(kind == "iban", spaced).when(kind == "name", named).otherwise(form)


def entities(mentions: DataFrame, key: str) -> DataFrame:
    """(kind, value, form): a distinct surrogate for each distinct entity, none of them a real one."""
    real = cut(mentions.select("kind", "value").distinct())
    todo, done, attempt = real, [], 0
    while True:
        drawn = todo.withColumn("form", surrogate(key, F.col("kind"), F.col("value"), F.lit(attempt)))
        taken = reduce(DataFrame.unionByName, [real.select("kind", F.col("value").alias("form")), *(d.select("kind", "form") for d in done)])
        first = F.row_number().over(Window.partitionBy("kind", "form").orderBy("value"))
        drawn = cut(drawn.withColumn("nth", first).join(taken.distinct().withColumn("taken", F.lit(True)), ["kind", "form"], "left").withColumn("ok", (F.col("nth") == 1) & F.col("taken").isNull()))
        done.append(drawn.where("ok").select("kind", "value", "form"))
        todo, attempt = drawn.where("NOT ok").select("kind", "value"), attempt + 1
        if not todo.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        if attempt == 200:
            raise ValueError("there are more entities of some kind than surrogates of its form")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text with surrogates, n_entities, kinds (sorted, distinct).

    Null texts stay null, texts without entities stay as they are, texts of any length are searched whole. Repeated rows and null ids are rows of
    their own, and equal entities get equal surrogates wherever they stand. Extra columns are dropped. An empty table gives no rows.

    Names are found behind a title or one of ``CUES``. Names and secrets grow by letters where the table holds so many
    of a form that several draws found none that is free; numbers and addresses keep their form, and where one has no free
    forms left (over half a billion social security numbers, say) a ValueError says so.
    """
    with scratch(docs.sparkSession) as keep:
        return _pseudonymised(docs, key, id_col, text_col, keep)


def _pseudonymised(docs: DataFrame, key: str, id_col: str, text_col: str, keep) -> DataFrame:
    rows = with_row(docs, id_col, text_col)
    text = F.col("text")
    hit = F.coalesce(text.rlike(HINT) & text.rlike(PATTERN), F.lit(False))
    found = keep(cut(rows.where(hit).withColumn("mentions", F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).withColumn("gaps", F.split(text, PATTERN, -1)).drop("text")))
    mentions = found.select("row", F.posexplode("mentions").alias("at", "mention")).withColumn("kind", _kind(F.col("mention"))).withColumn("lead", _lead(F.col("kind"), F.col("mention"))).withColumn("mention", _body(F.col("kind"), F.col("mention"))).withColumn("value", canonical(F.col("kind"), F.col("mention")))
    known = keep(cut(entities(mentions, key)))
    placed = mentions.join(known, ["kind", "value"]).select("row", "at", "kind", F.concat("lead", rendered(F.col("kind"), F.col("mention"), F.col("form"))).alias("new"))
    listed = placed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "new", "kind"))).alias("news"))
    gaps, news = F.col("gaps"), F.col("news")
    joined = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(news)), news, lambda g, n: F.concat(g, n["new"])), ""), F.element_at(gaps, -1))
    changed = found.join(listed, "row").select("id", joined.alias("text"), F.size(news).alias("n_entities"), F.array_sort(F.array_distinct(F.transform(news, lambda n: n["kind"]))).alias("kinds"))
    same = rows.where(~hit).select("id", "text", F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    return changed.unionByName(same).withColumnRenamed("id", id_col)
