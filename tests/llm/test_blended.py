"""Blended orders and mixed-in words of the text model, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import lm_score, queries

M = 511


def test_op2_is_not_behind_its_base_on_few_texts(spark):
    r = queries.queries()["op2_ppm_score"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r.s > r.b and -math.inf < r.low and r.high < 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_blended_probabilities_sum_to_one_and_agree_with_a_plain_version(order):
    seen = lm_score._Counted(order)
    for t in (b"abracadabra abra", b"banana", b""):
        seen.add(t, True)
    codes, n = seen.result()
    contexts = sorted({c >> 9 for c in codes.tolist()})[:12] + [99 << 9 * (order - 1) | 7]
    grams = np.array(sorted({c << 9 | s for c in contexts for s in range(1, 258)} | set(codes.tolist())))
    counts = dict(zip(codes.tolist(), n.tolist()))
    n = np.array([counts.get(g, 0) for g in grams.tolist()])
    real, least = [g for g, c in counts.items() if c], min(3, order)
    longer = {g & (1 << 9 * (least + 1)) - 1 for g in real}
    short = sorted({g & (1 << 9 * least) - 1 for g in longer})
    low = lm_score.Low(least, np.array(short), np.array([sum(g & (1 << 9 * least) - 1 == s for g in longer) for s in short]), True)

    def plain(context, s, k):
        if k < 0:
            return 1 / 257
        cut = (1 << 9 * k) - 1
        if k == order:
            of = {g & M: counts[g] for g in real if g >> 9 == context}
        else:
            after = {g & (1 << 9 * (k + 2)) - 1 for g in real}
            of = {}
            for g in after:
                if g >> 9 & cut == context & cut:
                    of[g & M] = of.get(g & M, 0) + 1
        below = plain(context, s, k - 1)
        return (max(of.get(s, 0) - 0.8, 0) + 0.8 * len(of) * below) / sum(of.values()) if of else below

    got = dict(zip(grams.tolist(), lm_score.blended(grams, n, order, low).tolist()))
    for c in contexts:
        assert abs(sum(10 ** got[c << 9 | s] for s in range(1, 258)) - 1) < 1e-9
        for s in (2, 3, 99, 100, 257):
            assert abs(10 ** got[c << 9 | s] - plain(c, s, order)) < 1e-12


def test_mixed_words_agree_with_a_plain_version():
    texts, share, end = [[0, 1, 0, 1, 2], [-1], [2, 2, 2], [1, 0, 1, 0, 1, 0]], np.array([0.5, 0.25, 0.0]), 0.2
    words = np.concatenate(texts)
    doc = np.repeat(range(4), [len(t) for t in texts])
    last = np.append(doc[1:] != doc[:-1], True)
    spelled = -np.arange(1, len(words) + 1) * 400.0 / len(words)  # beyond what a double's power can hold
    got, at = lm_score.mixed(spelled, words, doc, last, np.where(words < 0, 0.0, share[words]), end), 0
    for t in texts:
        for i, w in enumerate(t):
            known = share[w] if w >= 0 else 0.0
            w0, m = 0.1 * i / (i + 50), sum(x == t[i - 1] for x in t[: i - 1]) if i else 0
            w1 = 0.2 * m / (m + 1)
            own = t[:i].count(w) / max(i, 1)
            pair = sum(t[j - 1] == t[i - 1] and t[j] == w for j in range(1, i)) / max(m, 1)
            told = ((1 - w1) * ((1 - w0) * 0.1 * known + w0 * own) + w1 * pair) * (end if i == len(t) - 1 else 1 - end)
            spell = (1 - w1) * (1 - w0) * 0.9
            want = math.log10(told + spell * 10 ** spelled[at]) if told else math.log10(spell) + spelled[at]
            assert abs(got[at] - want) < 1e-9
            at += 1


def test_blended_scores_without_training_rows(spark):
    d = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "doc_id int, text string")
    for held in (True, False):
        got = lm_score.score(d, F.lit(held), order=3, blend=True).collect()
        assert len(got) == 3 and all(-math.inf < r.score < 0 for r in got)
    assert lm_score.score(d.where("false"), F.lit(False), blend=True).collect() == []
