"""Language proportions by expectation maximisation.

Each language is a letter-trigram model (hashed tables, learned from a bounded sample of labelled
rows: at most about ``sample_rows`` a language). A document is a mixture: each word was drawn
from one language, or from noise (letters at random). Expectation maximisation over a document's words
estimates the proportions. The language set is then chosen by penalised likelihood (BIC): the best
single language, or the best k by proportion where the likelihood gain pays for k - 1 more
parameters. All documents of a chunk are estimated together with segment sums.

A text without letters, and any text when no language was learned, is ``und`` with score 0.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import share, thrifty

_RUNS, _LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")
SIZE = 1 << 16
CHUNK_WORDS = 600_000
UNIFORM = float(np.log(60.0))  # nats a letter under noise


def letters(text: str) -> list[str]:
    """Words: runs of letters by Unicode (category L), in lower case; fractions, superscripts and roman numeral signs aren't letters."""
    words = _RUNS.findall(text.lower())
    return words if all(map(str.isalpha, words)) else [x for w in words for x in ([w] if w.isalpha() else _LETTERS.findall(w))]


def _indices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigram and context of each letter and word end, and where each word begins among them."""
    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    space = c == 32
    one, zero = c[:-1], c[1:]
    two = np.concatenate([c[:1], c[:-2]])
    two = np.where(space[:-1], np.uint32(32), two)
    ctx = two * np.uint32(0x9E3779B1) ^ one * np.uint32(0x85EBCA77)
    tri = (ctx ^ zero * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    ctx = ctx * np.uint32(0x165667B1)
    return (tri >> np.uint32(16)).astype(np.int64), (ctx >> np.uint32(16)).astype(np.int64), np.flatnonzero(space[:-1])


class Model:
    def __init__(self, langs: list[str], tri: np.ndarray, ctx: np.ndarray, alpha: float = 0.02):
        self.langs = langs
        self.tri = np.log(tri + alpha).astype(np.float32)  # SIZE x languages
        self.ctx = np.log(ctx + alpha * 64).astype(np.float32)

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """log P(word) under each language, then under noise."""
        tri, ctx, at = _indices(words)
        own = np.add.reduceat(self.tri[tri] - self.ctx[ctx], at, axis=0)
        sizes = np.diff(np.append(at, len(tri)))
        return np.concatenate([own, (-UNIFORM * sizes)[:, None].astype(np.float32)], axis=1)


def labelled(docs: DataFrame, held_out, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(row, lang, text) of the rows to learn from: those where ``held_out`` is false and neither text nor label is null."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(True)).alias("skip"))
    return rows.where("NOT skip AND lang IS NOT NULL AND text IS NOT NULL").select("row", "lang", "text")


def learn(labelled: DataFrame, sample_rows: int = 4_000) -> Model:
    """labelled: (row, lang, text), nulls excluded. Each row is drawn on its own, at a rate set by its language's count, so that no text that many
    rows repeat is sampled whole or not at all; a language's sample is of about ``sample_rows`` rows.
    """
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((SIZE, 0)), np.zeros((SIZE, 0)))
    rate = F.element_at(F.create_map(*[F.lit(x) for g in langs for x in (g, min(1.0, sample_rows / sizes[g]))]), F.col("lang"))
    sample = labelled.where(share("row") < rate)

    def count(batches):
        tri, ctx = np.zeros((len(langs), SIZE), np.int64), np.zeros((len(langs), SIZE), np.int64)
        where = {g: k for k, g in enumerate(langs)}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = letters(text)
                if words:
                    t, c, _ = _indices(words)
                    tri[where[lang]] += np.bincount(t, minlength=SIZE)
                    ctx[where[lang]] += np.bincount(c, minlength=SIZE)
        both = np.stack([tri, ctx])
        kind, lang, slot = np.nonzero(both)
        yield pa.record_batch([pa.array(kind, pa.int32()), pa.array(lang, pa.int32()), pa.array(slot, pa.int32()), pa.array(both[kind, lang, slot], pa.int64())], ["kind", "lang", "slot", "n"])

    # at most 2 * languages * SIZE rows, whatever the input
    got = sample.select("lang", "text").mapInArrow(thrifty(count), "kind int, lang int, slot int, n long").groupBy("kind", "lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    tables = np.zeros((2, SIZE, len(langs)))
    tables[got.column("kind").to_numpy(), got.column("slot").to_numpy(), got.column("lang").to_numpy()] = got.column("n").to_numpy()
    return Model(langs, tables[0], tables[1])


def _em(p: np.ndarray, starts: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x components) and log-likelihoods; p: word likelihoods, scaled by word; allowed: which components each document may have."""
    share = allowed / allowed.sum(1, keepdims=True)
    for k in range(rounds + 1):
        r = p * np.repeat(share, sizes, axis=0)
        s = r.sum(1, keepdims=True)
        np.maximum(s, 1e-30, out=s)
        if k < rounds:
            share = np.add.reduceat(r / s, starts, axis=0) / sizes[:, None]
    return share, np.add.reduceat(np.log(s[:, 0]), starts)


def estimate(model: Model, texts: list[list[str]], rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Of documents with at least one word each: proportions over languages and noise, and the size of the chosen language set."""
    codes: dict[str, int] = {}
    flat = np.array([codes.setdefault(w, len(codes)) for ws in texts for w in ws], np.int64)
    ll = model.likelihoods(list(codes))
    scaled = np.exp(ll - ll.max(1, keepdims=True))
    sizes = np.array([len(ws) for ws in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    p = scaled[flat]
    n, m = len(texts), ll.shape[1]
    share, full = _em(p, starts, sizes, np.ones((n, m), np.float32), rounds)
    # one language and noise: an upper bound on what a single language reaches needs one EM with its own set
    order = np.argsort(-share[:, :-1], axis=1, kind="stable")
    chosen, best = np.ones(n, np.int64), np.full(n, -np.inf)
    out = share.copy()
    todo = np.arange(n)
    for k in range(1, m):
        allowed = np.zeros((len(todo), m), np.float32)
        np.put_along_axis(allowed, order[todo, :k], 1, axis=1)
        allowed[:, -1] = 1
        rows = np.concatenate([np.arange(starts[t], starts[t] + sizes[t]) for t in todo]) if len(todo) < n else slice(None)
        own = sizes[todo]
        got, like = _em(p[rows], np.cumsum(own) - own, own, allowed, rounds)
        fit = like - 0.5 * (k - 1) * np.log(own)
        better = fit > best[todo]
        best[todo[better]], chosen[todo[better]], out[todo[better]] = fit[better], k, got[better]
        # more languages can't reach more than the full likelihood less their penalty
        todo = todo[full[todo] - 0.5 * k * np.log(sizes[todo]) > best[todo]]
        if not len(todo):
            break
    return out, chosen


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score (the language's share among languages), noise_share, n_langs, shares (a map)."""
    langs = model.langs

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            cols: list[list] = [[], [], [], [], []]
            at = 0
            while at < len(texts):
                chunk, held = [], 0
                while at < len(texts) and (not chunk or held < CHUNK_WORDS):
                    ws = letters(texts[at]) if texts[at] and langs else []
                    texts[at] = None
                    chunk.append(ws)
                    held += len(ws)
                    at += 1
                some = [ws for ws in chunk if ws]
                shares, sizes = estimate(model, some) if some else (np.empty((0, 1)), [])
                k = 0
                for ws in chunk:
                    if not ws:
                        row = ("und", 0.0, 0.0, 0, {})
                    else:
                        s = shares[k, :-1].astype(float)
                        best = int(s.argmax())
                        row = (langs[best], float(min(1.0, s[best] / max(s.sum(), 1e-30))), float(shares[k, -1]), int(sizes[k]), {g: float(x) for g, x in zip(langs, s, strict=True) if x > 0.005})
                        k += 1
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            yield pa.record_batch(
                [ids, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int32()), pa.array([list(x.items()) for x in cols[4]], pa.map_(pa.string(), pa.float64()))],
                ["id", "lang_pred", "score", "noise_share", "n_langs", "shares"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = StructType.fromDDL("lang_pred string, score double, noise_share double, n_langs int, shares map<string,double>")
    return rows.mapInArrow(thrifty(run), StructType([rows.schema["id"], *out.fields])).withColumnRenamed("id", id_col)


def identify(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 4_000) -> DataFrame:
    """Learn from rows of ``docs`` where ``held_out`` is false and text and label aren't null, then predict every row.

    Null and empty texts and those without a letter are ``und`` with score 0. Repeated rows and null ids are rows of their own, a
    very long text is one document of many words, extra columns are ignored. Of languages with equal shares the first by name is
    predicted. Without a labelled row everything is ``und``; an empty table gives no rows.
    """
    return predict(docs, learn(labelled(docs, held_out, text_col, lang_col), sample_rows), id_col, text_col)
