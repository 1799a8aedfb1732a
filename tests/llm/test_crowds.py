"""Crowds of many sizes in near dedup, and tasks bounded by shingles."""

import random

from pyspark.sql import functions as F

from sieveline.llm import near_dedup as N
from sieveline.llm.common import exact_shingles, words_of

WORDS = [a + b for a in ("th", "on", "er", "in", "re", "st") for b in ("an", "or", "ea", "ble", "ou", "ti", "ha")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, changes):
    ws = text.split(" ")
    for _ in range(changes):
        ws[rng.randrange(len(ws))] = "changed" + str(rng.randrange(1000))
    return " ".join(ws)


def components(texts, n=5):
    sets = exact_shingles([words_of(t) for t in texts], n)
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if N._links(75, sets[i], sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_passage_in_documents_of_all_sizes(spark, monkeypatch):
    """One passage in documents from its own length to thirty times that: they make one crowd, of which only neighbouring sizes are compared."""
    rng = random.Random(8)
    passage = prose(rng, 90)
    texts = []
    for k in range(260):
        own = passage + " " + prose(rng, rng.choice([0, 3, 9, 20, 28, 60, 150, 400, 900, 2500]) + k % 3)
        texts += [own, edited(rng, own, 1 + k % 2)] if k % 6 == 0 else [own]
    monkeypatch.setattr(N, "DENSE", 0.05)
    seen = []
    real = N._by_size

    def told(crowd, classes, threshold):
        out = real(crowd, classes, threshold)
        seen.append((crowd.count(), out.groupBy("crowd").count().collect()))
        return out

    monkeypatch.setattr(N, "_by_size", told)
    got = {r.doc_id: r.component_id for r in N.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), leaf=16).collect()}
    assert [got[i] for i in range(len(texts))] == components(texts)
    assert seen and len(seen[0][1]) > 5 and max(r["count"] for r in seen[0][1]) < 0.7 * seen[0][0]


def test_sizes_that_may_link_share_a_part(spark):
    sizes = [1, 3, 4, 75, 76, 99, 100, 101, 133, 134, 178, 5000, 6666, 6667]
    classes = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "cls long, size long")
    parts = N._by_size(classes.select(F.lit(1).cast("long").alias("crowd"), "cls"), classes, 0.75).collect()
    of = {i: {r.crowd for r in parts if r.cls == i} for i in range(len(sizes))}
    for i, a in enumerate(sizes):
        for j, b in enumerate(sizes):
            if 4 * min(a, b) >= 3 * max(a, b):
                assert of[i] & of[j], (a, b)
    assert not of[0] & of[11]
    few = N._by_size(classes.where("size BETWEEN 75 AND 134").select(F.lit(1).cast("long").alias("crowd"), "cls"), classes, 0.75)
    assert {r.crowd for r in few.collect()} == {1} and few.count() == 7


def test_long_classes_make_more_blocks(spark):
    known = spark.createDataFrame([(i, i, 1.0 if i < 40 else 30.0) for i in range(50)], "cls long, label long, weight double")
    crowd = known.select(F.lit(7).cast("long").alias("crowd"), "cls")
    rows = N._blocks(crowd, known, 32).groupBy("task").agg(F.sum("weight").alias("held"), F.max("weight").alias("most")).collect()
    assert max(r.held for r in rows) <= 2 * (32 + 4 * 30) and len(rows) > 20
    pairs = set()
    for r in N._blocks(crowd, known, 32).groupBy("task").agg(F.collect_list(F.struct("cls", "side")).alias("c")).collect():
        pairs |= {(a.cls, b.cls) for a in r.c for b in r.c if a.cls < b.cls}
    assert len(pairs) == 50 * 49 // 2
