"""Line dedup, filter interactions and source divergence, held against plain versions."""

import itertools
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from sieveline.llm import filter_audit, line_dedup, queries, source_audit

SPACE = " \t\n\x0b\x0c\r"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = ["A line that is long enough to count, number %d, for this test" % i for i in range(12)]


def texts(seed, n=120):
    """Lines that few or many documents share, repeated within one, in other case and between blanks, beside nulls and empties."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lines = [rng.choice(["short", "", "  ", f"own line of document {i} which is long enough to have a key"])] * rng.randrange(3)
        for k, line in enumerate(LONG):
            if rng.random() < (0.5, 0.02, 0.05, 0.3)[k % 4]:
                lines += [rng.choice([line, line.upper(), f"\t{line} \r", f" {line}"])] * rng.choice([1, 1, 2])
        rng.shuffle(lines)
        out.append("\n".join(lines))
    return [*out, None, "", "\n", "\n\n", LONG[0], "é" * 40, "é" * 40 + "\n" + "é" * 39, "x\0y " + LONG[0]]


def plain_lines(rows, chars=40, docs=5):
    """(n_lines, n_dropped, text) by row; rows: (id, text)."""
    key = lambda line: line.strip(SPACE).translate(ASCII)
    split = [(t or "").split("\n") for _, t in rows]
    holders = defaultdict(set)
    for i, ls in enumerate(split):
        for k in map(key, ls):
            if len(k) >= chars:
                holders[k].add(i)
    stays = {k: max(h, key=lambda i: (rows[i][0] is not None, rows[i][0])) for k, h in holders.items() if len(h) >= docs}
    out = []
    for i, ls in enumerate(split):
        kept = [x for x in ls if stays.get(key(x), i) == i]
        out.append((rows[i][0], len(ls), len(ls) - len(kept), rows[i][1] if len(kept) == len(ls) else "\n".join(kept)))
    return out


@pytest.mark.parametrize(("batches", "fan"), [(1, 2), (5, 2), (8, 4), (30, 3)])
def test_line_dedup(spark, batches, fan):
    rows = list(enumerate(texts(batches)))
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string").repartition(3)
    got = line_dedup.dedup(df, batches=batches, fan=fan).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == sorted(plain_lines(rows))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_line_dedup_string_ids_and_other_columns(spark):
    rows = [(f"id{i:04}", t) for i, t in enumerate(texts(3))]
    df = spark.createDataFrame([(t, i, 1, "k") for i, t in rows], "body string, name string, row int, key string")
    got = line_dedup.dedup(df, "name", "body").collect()
    assert sorted((r.name, r.n_lines, r.n_dropped, r.text or "") for r in got) == sorted((a, b, c, d or "") for a, b, c, d in plain_lines(rows))


def test_line_dedup_null_and_repeated_ids(spark):
    rows = [(None, LONG[0])] * 3 + [(1, LONG[0])] * 4
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_dropped, r.text) for r in got) == Counter([(None, 1, "")] * 3 + [(1, 1, "")] * 3 + [(1, 0, LONG[0])])
    none = line_dedup.dedup(spark.createDataFrame([(None, LONG[0])] * 5, "doc_id long, text string")).collect()
    assert sorted(r.n_dropped for r in none) == [0, 1, 1, 1, 1]


def test_line_dedup_hot_line_in_many_runs(spark):
    """A line of every document, over more batches than a level holds, and one that reaches the number of documents only over several runs."""
    rows = [(i, LONG[0] + ("\n" + LONG[1] if i % 60 == 0 else "")) for i in range(300)]
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), batches=16, fan=2).collect()}
    assert got[299] == (0, LONG[0]) and got[298] == (1, "") and got[240] == (1, LONG[1]) and got[0] == (2, "") and sum(n for n, _ in got.values()) == 299 + 4


def test_line_dedup_empty(spark, empty):
    assert line_dedup.dedup(empty).count() == 0
    nothing = line_dedup.dedup(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert (nothing.text, nothing.n_lines, nothing.n_dropped) == (None, 1, 0)


def plain_audit(rows, filters):
    """rows: (part, set of failed filters, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_at, steps = Counter(), []
        for order in itertools.permutations(filters):
            here = own
            for k, f in enumerate(order):
                gone, before = [r for r in here if f in r[1]], here
                here = [r for r in here if f not in r[1]]
                removed_at[f] += len(gone)
                steps.append(("".join(order), k + 1, f, len(here), len(gone), sum(f in r[1] for r in own) - sum(f in r[1] for r in before), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        for o, k, f, *rest in steps:
            out[part, o, k] = (*rest, removed_at[f])
    return out


@pytest.mark.parametrize("filters", ["A", "XY", "ABCDE"])
def test_audit(spark, filters):
    rng = random.Random(len(filters))
    rows = [(rng.choice(["p", "q", "", None]), {f for f in filters if rng.random() < 0.4}, rng.random() < 0.5, rng.random() < 0.2) for _ in range(200)] + [("all gone", set(filters), True, False)] * 3
    kind = "part string, " + ", ".join(f"{f} boolean" for f in filters) + ", good boolean, bad boolean"
    df = spark.createDataFrame([(p, *[f in s or (None if i % 2 else False) for i, f in enumerate(filters)], g, b or None) for p, s, g, b in rows], kind)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good, r.bad, r.shapley) for r in filter_audit.audit(df, list(filters), ["good", "bad"]).collect()}
    assert got == plain_audit(rows, filters)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_audit_of_documents(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [
        (1, " ".join(words), "a"), (2, " ".join(words), "a"), (None, " ".join(words), "a"), (2, " ".join(words), None), (3, " ".join(words[:49]), "a"), (4, " ".join(words[:10] * 6), "a"), (5, "AAAA " + " ".join(words), "b"),
        (6, "a|b " + " ".join(words), ""), (7, None, "b"), (8, "", "b"), (9, "é" * 99, "a"),
    ]
    df = spark.createDataFrame([(t, s, i, 9, "d") for i, t, s in rows], "text string, source string, doc_id long, digest int, part string")
    labels = spark.createDataFrame([(2, 1, 0), (2, 0, 1), (7, None, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    fails = [set(), {"E"}, {"E"}, {"E"}, {"A"}, {"B"}, {"C"}, {"D"}, {"A"}, {"A", "E"}, {"A"}]
    fails[6] = {"C"} if 400 > 5 * len(rows[6][1]) else set()
    marked = [(s or "", f, i == 2, i in (2, 7)) for (i, _, s), f in zip(rows, fails, strict=True)]
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.audit_documents(df, labels).collect()}
    assert got == plain_audit(marked, "ABCDE") and len(got) == 3 * 600


def test_audit_empty_and_refused(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_documents(empty, labels).count() == 0
    for bad in ([], ["AB"], list("ABCDEFGH")):
        with pytest.raises(ValueError, match="filters"):
            filter_audit.audit(empty, bad, [])


def plain_terms(text):
    out, now = [], ""
    for ch in (text or "") + " ":
        if ch.isascii() and not ch.isalpha():
            out, now = [*out, now] if now else out, ""
        else:
            now += ch.translate(ASCII)
    return out


def plain_divergence(rows, least=3, k=200):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = plain_terms(text)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {r[1] for r in rows}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted({r[2] for r in rows if r[1] == lang})
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: share(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], whole[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, k)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, v, rank))
    return out


def corpus(seed, n=200):
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("the", "An", "été", "中文", "x", "Straße", "naïve") for b in ("", "s", "ing", "é", "ÉÉ", "ab", "abc", "ac")]
    out = []
    for _ in range(n):
        lang, source = rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s0", "s1", "s2", None])
        few = vocabulary if source == "s0" else vocabulary[: len(vocabulary) // 2]
        out.append((rng.choice([" ", ", ", "1", "\n", "_"]).join(rng.choices(few, k=rng.randrange(12))), lang, source))
    return [*out, (None, "de", "s1"), ("12 !?", "de", "s2"), ("only once here", "es", "s1"), ("rare", "en", "lonely")]


@pytest.mark.parametrize("k", [1, 4, 9, 200])
def test_divergence(spark, k):
    rows = corpus(k)
    df = spark.createDataFrame([(s, 3, t, lang, "i") for t, lang, s in rows], "source string, term int, text string, lang string, item string").repartition(4)
    got = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in source_audit.audit(df, k=k).collect()}
    assert got == plain_divergence(rows, k=k)


def test_divergence_in_small_portions(spark, monkeypatch):
    """Counts handed on early and pairs compared few at a time give the same."""
    rows = corpus(5)
    names = ("a", "b", "c", "d")
    posts = [("l", [(s, (i * 37 + j * 11) % 90 + 2, j + 1) for j, s in enumerate(names[: i % 5])]) for i in range(40)]
    df = spark.createDataFrame(posts, "lang string, posts array<struct<source:string,p:long,p0:long>>").where("size(posts) > 1")
    want = Counter()
    f = lambda a, b: (a - b) ** 2 // b
    for _, ps in posts:
        for (a, p, p0), (b, q, q0) in itertools.permutations(ps, 2):
            want[a, b] += f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    import pyarrow as pa

    for block in (1, 7, 1 << 20):
        monkeypatch.setattr(source_audit, "BLOCK", block)
        got = Counter()
        for b in source_audit._met(iter(df.toArrow().combine_chunks().to_batches())):
            for r in pa.Table.from_batches([b]).to_pylist():
                got[r["source"], r["item"]] += r["value"]
        assert got == want
    monkeypatch.setattr(source_audit, "HELD", 3)
    batch = pa.RecordBatch.from_pylist([{"lang": lang or "", "source": s or "", "text": t} for t, lang, s in rows], schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.string())]))
    n = Counter()
    for b in source_audit._counted(iter([batch.slice(i, 20) for i in range(0, batch.num_rows, 20)])):
        for r in b.to_pylist():
            n[r["lang"], r["source"], r["term"]] += r["n"]
    assert n == Counter((lang or "", s or "", t) for text, lang, s in rows for t in plain_terms(text))


@pytest.mark.parametrize("k", [1, 5, 50, 400])
def test_top_of_tied_values(spark, k):
    """Ties that differ late, items that begin others, values over all bits, groups with fewer rows than asked for."""
    rng = random.Random(k)
    rows = []
    for g in range(4):
        items = {rng.choice(["common prefix of many bytes ", "é" * 9, "", "z"]) + "".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(3 if g == 3 else 300)}
        rows += [("l", f"g{g}", x, rng.choice([0, 1, 1, 1, 2**40, 2**40 + 1, 2**62]) if g else 7) for x in sorted(items)]
    df = spark.createDataFrame(rows, "lang string, source string, item string, value long").repartition(5)
    got = sorted((r.source, r["rank"], r.item, r.value) for r in source_audit.top(df, k).collect())
    want = []
    for g in sorted({r[1] for r in rows}):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[3], r[2].encode()))[:k]
        want += [(g, i, r[2], r[3]) for i, r in enumerate(own, 1)]
    assert got == sorted(want)


def test_shares_of_large_counts(spark):
    n = [(0, 0, 1), (10**12, 10**13, 7), (3, 9, 2), (10**14 - 1, 10**14, 10**6)]
    got = [r[0] for r in spark.createDataFrame([(i, *x) for i, x in enumerate(n)], "i int, c long, t long, v long").orderBy("i").select(source_audit.share(F.col("c"), F.col("t"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 1) // (t + v) for c, t, v in n]


def test_divergence_empty(spark, empty):
    assert source_audit.audit(empty).count() == 0


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_filter_audit", "op13_source_divergence"])
def test_registered_query_matches_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    got = queries.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want))
