"""Toxicity by Levenshtein automata over a learned lexicon trie, with context-window scores.

The lexicon is learned from a bounded sample of labelled rows (at most about ``sample_rows`` of each label): words and
word beginnings that stand in toxic texts in at least three contexts, and clearly more often than in
clean ones. A trie holds them. The automaton that accepts everything within one edit of a term is
intersected with the trie: its states are sets of (trie node, edits used), made once when first reached, so a word
costs a few table look-ups and most words die after three letters. Terms of five letters or more match
with one edit, shorter ones exactly; beginnings match exactly.

Each hit is weighed by its window of words: near quotation marks or reporting verbs it counts as quoted, near
second-person pronouns as directed. Sums over the text (exact, fuzzy, by beginning, quoted, directed, the densest
window) go into a logistic model, fitted on the same sample with each row's own counts left out.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import cut, scratch, share

STRIP = ".,;:!?\"'()[]{}<>*#$%&-_/|«»„“”‘’…"
QUOTES = frozenset("\"«»„“”")
#: Reporting verbs, and second-person pronouns, of the languages at hand.
REPORTS = frozenset("said says wrote called quote quoted sagte schrieb nannte zitat dijo escribió llamó cita dit écrit appelé citation".split())
DIRECT = frozenset("you your you're u du dich dir dein ihr euch tú tu te ti vous toi ton".split())
WINDOW, DENSE = 4, 50
FEATURES = ("exact", "stem", "fuzzy", "quoted", "directed", "densest", "length")


def tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class Automaton:
    """Lexicon trie intersected with the one-edit Levenshtein automaton, determinised as words ask for it."""

    FUZZY = 5

    def __init__(self, words: set[str], stems: set[str]):
        self.child: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.deep = [0]  # length of the longest term below, so that short terms get no edits
        for term, kind in [*((w, self.word) for w in words), *((s, self.stem) for s in stems)]:
            n = 0
            for ch in term:
                if kind is self.word:
                    self.deep[n] = max(self.deep[n], len(term))
                if ch not in self.child[n]:
                    self.child[n][ch] = len(self.child)
                    self.child.append({})
                    for a in (self.word, self.stem):
                        a.append(None)
                    self.deep.append(0)
                n = self.child[n][ch]
            kind[n] = term
            if kind is self.word:
                self.deep[n] = max(self.deep[n], len(term))
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.ends: list[tuple[str | None, str | None]] = []  # best word at the end here: (exact, fuzzy)
        self.stems: list[str | None] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, raw: set[tuple[int, int]]) -> int:
        full = set(raw)
        for n, e in raw:  # a letter of the term left out
            if e == 0:
                full.update((c, 1) for c in self.child[n].values() if self.deep[c] >= self.FUZZY)
        key = frozenset((n, e) for n, e in full if not (e == 1 and (n, 0) in full))
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            exact = next((self.word[n] for n, e in key if e == 0 and self.word[n]), None)
            fuzzy = min((self.word[n] for n, e in key if e == 1 and self.word[n] and len(self.word[n]) >= self.FUZZY), default=None)
            self.ends.append((exact, fuzzy))
            self.stems.append(next((self.stem[n] for n, e in key if e == 0 and self.stem[n]), None))
            self.moves.append({})
        return self.ids[key]

    def _move(self, state: int, ch: str) -> int:
        to: set[tuple[int, int]] = set()
        for n, e in self.states[state]:
            if ch in self.child[n]:
                to.add((self.child[n][ch], e))
            if e == 0:
                if self.deep[n] >= self.FUZZY:
                    to.add((n, 1))  # an extra letter
                to.update((c, 1) for c in self.child[n].values() if self.deep[c] >= self.FUZZY)  # another letter
        self.moves[state][ch] = found = self._state(to)
        return found

    def match(self, word: str) -> tuple[str, str] | None:
        """(kind, term): the exact term, else the longest beginning, else a term within one edit."""
        s, stem = self.start, None
        for ch in word:
            to = self.moves[s].get(ch)
            s = self._move(s, ch) if to is None else to
            if s < 0:
                break
            stem = self.stems[s] or stem
        exact, fuzzy = self.ends[s] if s >= 0 and word else (None, None)
        return ("exact", exact) if exact else ("stem", stem) if stem else ("fuzzy", fuzzy) if fuzzy else None


STEMS = range(3, 7)


def _terms(word: str) -> list[str]:
    return [word, *(f"^{word[:k]}" for k in STEMS if len(word) > k)]


def _in_toxic(batches):
    for b in batches:
        df: Counter = Counter()
        contexts: dict[str, set[int]] = {}
        for text in b.column(0).to_pylist():
            ws = [w.strip(STRIP) for w in tokens(text)]
            seen = set()
            for i, w in enumerate(ws):
                if not w:
                    continue
                mark = xxh32_intdigest(f"{ws[i - 1] if i else ''} {w} {ws[i + 1] if i + 1 < len(ws) else ''}") & 0x7FFFFFFF
                for t in _terms(w):
                    seen.add(t)
                    c = contexts.setdefault(t, set())
                    if len(c) < 3:
                        c.add(mark)
            df.update(seen)
        yield pa.record_batch([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64()), pa.array([sorted(contexts[t]) for t in df], pa.list_(pa.int32()))], ["term", "df", "contexts"])


def _in_clean(wanted: frozenset):
    def run(batches):
        for b in batches:
            df: Counter = Counter()
            for text in b.column(0).to_pylist():
                df.update({t for w in {w.strip(STRIP) for w in tokens(text)} if w for t in _terms(w) if t in wanted})
            yield pa.record_batch([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], ["term", "df"])

    return run


class Scorer:
    def __init__(self, counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int):
        self.counts, self.n_toxic, self.n_clean = counts, n_toxic, n_clean
        self.coef = self.mean = self.scale = None
        self.auto = None

    def __getstate__(self):
        return self.__dict__ | {"auto": None}

    def weight(self, term: str, own: int | None = None) -> float:
        """Log odds of the term, without the row's own label where that is given."""
        toxic, clean = self.counts[term]
        toxic, clean = max(0, toxic - (own == 1)), max(0, clean - (own == 0))
        return max(0.0, math.log((toxic + 0.5) / (self.n_toxic + 1)) - math.log((clean + 0.5) / (self.n_clean + 1)))

    def features(self, texts: list[str | None], own: list[int | None]) -> np.ndarray:
        if self.auto is None:
            self.auto = Automaton({t for t in self.counts if t[0] != "^"}, {t[1:] for t in self.counts if t[0] == "^"})
        out = np.zeros((len(texts), len(FEATURES)))
        known: dict[str, tuple[str, str] | None] = {}
        match, get = self.auto.match, known.get
        for r, text in enumerate(texts):
            ws = tokens(text)
            for w in set(ws):
                if w not in known:
                    known[w] = match(w.strip(STRIP))
            if len(known) > 300_000:
                found = [known[w] for w in ws]
                known.clear()
            else:
                found = list(map(get, ws))
            at = [i for i, f in enumerate(found) if f] if any(found) else []
            sums, seen = dict.fromkeys(FEATURES, 0.0), set()
            marks = []
            for i in at:
                kind, term = found[i]
                w = self.weight(f"^{term}" if kind == "stem" else term, own[r])
                if w <= 0:
                    continue
                near = ws[max(0, i - WINDOW) : i + WINDOW + 1]
                quoted = any(x[0] in QUOTES or x[-1] in QUOTES for x in near) or not REPORTS.isdisjoint(near)
                marks.append((i, w * (0.5 if quoted else 1)))
                key = ws[i].strip(STRIP)
                if key in seen:
                    continue
                seen.add(key)
                sums[kind] += w
                sums["quoted"] += w * quoted
                sums["directed"] += w * (not DIRECT.isdisjoint(near))
            best = run = 0.0
            low = 0
            for i, w in marks:
                run += w
                while marks[low][0] <= i - DENSE:
                    run -= marks[low][1]
                    low += 1
                best = max(best, run)
            sums["densest"], sums["length"] = best, len(ws)
            out[r] = [math.log1p(max(0.0, sums[f])) for f in FEATURES]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale])
        c = np.zeros(z.shape[1])
        penalty = ridge * np.eye(len(c))
        penalty[0, 0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ c)
            c = c + np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
        self.coef = c

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.coef[0] + ((x - self.mean) / self.scale) @ self.coef[1:], -30, 30)
        return 1 / (1 + np.exp(-z))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int) -> Scorer | None:
    """labels: (id, toxic) of the rows to learn from, one a document. None where either label is missing."""
    sizes = dict(labels.groupBy("toxic").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        return None
    rate = F.when(F.col("toxic") == 1, min(1.0, sample_rows / sizes[1])).otherwise(min(1.0, sample_rows / sizes[0]))
    some = labels.where(share("id") < rate)
    # the sample has about 2 * sample_rows rows of two numbers each, whatever the input
    # of rows that share a labelled id the one of the least hash counts, so that repeats don't lift the sample over its bound
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL").join(F.broadcast(some), "id")
    texts = cut(texts.groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select("toxic", "first.text"))
    toxic = (
        texts.where("toxic = 1").select("text").mapInArrow(_in_toxic, "term string, df long, contexts array<int>").groupBy("term")
        .agg(F.sum("df").alias("df"), F.size(F.array_distinct(F.flatten(F.collect_list("contexts")))).alias("contexts")).where("df >= 3 AND contexts >= 3").select("term", "df")
    )
    t = {r[0]: r[1] for r in toxic.collect()}
    clean = texts.where("toxic = 0").select("text").mapInArrow(_in_clean(frozenset(t)), "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    c = {r[0]: r[1] for r in clean.collect()}
    n_toxic, n_clean = (texts.where(f"toxic = {k}").count() for k in (1, 0))
    counts = {}
    for term, a in t.items():
        b = c.get(term, 0)
        odds = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        if odds - 1.64 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= math.log(1.5):
            counts[term] = (a, b)
    model = Scorer(counts, n_toxic, n_clean)

    def measure(batches):
        for b in batches:
            own = b.column(1).to_pylist()
            x = model.features(b.column(0).to_pylist(), own)
            yield pa.record_batch([pa.array(own, pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = texts.select("text", F.col("toxic").cast("int").alias("y")).mapInArrow(measure, "y int, x array<double>").toArrow()
    if not got.num_rows:
        return None
    model.fit(np.array(got.column("x").to_pylist()), got.column("y").to_numpy().astype(float))
    return model


def score(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: id, score (0 to 1), n_hits' sums by kind as a map.

    held_out: a Column over the id, true for labels that aren't learned from. Null and empty texts get the score
    of a text without hits. Several labels of one document count as toxic if any is; null labels and ids
    are ignored. Rows that repeat are scored each; of rows with one labelled id one is learned from. Without labels of
    both kinds every score is 0. An empty table gives no rows.
    """
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
    with scratch(docs.sparkSession):
        model = learn(docs, some, id_col, text_col, sample_rows)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            if model is None:
                scores, x = np.zeros(len(texts)), np.zeros((len(texts), len(FEATURES)))
            else:
                x = model.features(texts, [None] * len(texts))
                scores = model.score(x)
            yield pa.record_batch([b.column(0), pa.array(scores, pa.float64()), pa.array([list(zip(FEATURES, map(float, r), strict=True)) for r in x], pa.map_(pa.string(), pa.float64()))], ["id", "score", "features"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, features map<string,double>").withColumnRenamed("id", id_col)
