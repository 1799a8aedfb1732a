"""Prediction by partial matching: code lengths of documents under a byte-context trie.

A text is modelled as its words (A-Z lower-cased) joined by one space and closed by an end symbol.
The trie of byte contexts up to ``order`` bytes is learned from all training documents. A symbol is
predicted from the longest context seen; where the context has never been followed by it the model
escapes (method D: half a count from each distinct follower) to the next shorter context, and the
symbols already ruled out are excluded there. Since all counts come from one corpus, the followers of
a context are followers of its suffixes too, so the excluded mass is a property of the context alone and the
probability of every (context, symbol) can be worked out once for the whole corpus.

With ``blend`` orders are blended instead (``blended``) and words are mixed in (``mixed``), which is ahead of
exclusion on few texts: contexts of five bytes are rare there, and half of a rare context's mass is too much for its followers.

The trie isn't gathered anywhere. Documents are dealt into blocks of bounded text; a block asks for
its distinct n-grams and words, with its own training counts. Counts are summed by n-gram, and all
n-grams that share the last three context bytes (a closed part of the trie) are worked out together. Counts of shorter contexts
are sent to all tasks: strings of three bytes, of which there are some millions in text of all scripts and 17 million at
most, however large the corpus. The n-grams of one group are bounded alike. Answers return to the blocks that asked.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import cut, give_back, scratch, settled, tasks, words_of

BITS = 9  # symbols: 0 pads the start, 1 to 256 are bytes, END closes
END = 257
ALPHABET = 257


def _symbols(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts after one another, each with ``order`` pads before and the end after; and where each begins."""
    size = np.fromiter((len(t) + order + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(size)
    sym = np.frombuffer((b"\x00" * order).join([b"", *[t + b"\x00" for t in texts]]) if texts else b"", np.uint8).astype(np.int16) + 1
    starts = ends - size
    for k in range(order):
        sym[starts + k] = 0
    sym[ends - 1] = END
    return sym, starts


#: Entries of a table for numbering n-grams (5 bytes each); where more would be needed they are sorted.
TABLE = 64_000_000


def _grams(sym: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of each position's (order+1)-gram (positions from ``order`` on), and the packed grams by number, ascending.

    Grams are numbered from short to long through tables of those that occur, so no sort of all positions is needed.
    """
    there = np.zeros(END + 1, bool)
    there[sym] = True
    alphabet = np.flatnonzero(there)
    small = (np.cumsum(there) - 1).astype(np.int32)[sym]
    a, ids, codes = len(alphabet), small, alphabet
    for k in range(1, order + 1):
        if len(codes) * a > TABLE:
            pair = ids[:-1].astype(np.int64) * a + small[k:]
            seen, ids = np.unique(pair, return_inverse=True)
            ids = ids.astype(np.int32)
        else:
            pair = ids[:-1] * np.int32(a)
            pair += small[k:]
            there = np.zeros(len(codes) * a, bool)
            there[pair] = True
            seen = np.flatnonzero(there)
            where = np.empty(len(there), np.int32)
            where[seen] = np.arange(len(seen), dtype=np.int32)
            ids = where.take(pair)
        codes = (codes[seen // a] << BITS) | alphabet[seen % a]
    return ids, codes


#: Text that is worked on at a time: temporary arrays take some 25 bytes for each of its bytes.
CHUNK = 2_000_000


def _rows(block: pa.Table, *names: str):
    """Rows of some columns as Python values, a slice at a time."""
    for at in range(0, block.num_rows, 500):
        part = block.slice(at, 500)
        yield from zip(*[part.column(n).to_pylist() for n in names], strict=True)


class _Counted:
    """Distinct n-grams of texts added one by one, with counts over those to learn from."""

    def __init__(self, order: int):
        self.order, self.parts, self.pending, self.held = order, [], {True: [], False: []}, {True: 0, False: 0}

    def add(self, text: bytes, learn: bool) -> None:
        self.pending[learn].append(text)
        self.held[learn] += len(text) + self.order + 1
        if self.held[learn] > CHUNK:
            self._flush(learn)

    def _flush(self, learn: bool) -> None:
        if self.pending[learn]:
            sym, _ = _symbols(self.pending[learn], self.order)
            ids, codes = _grams(sym, self.order)
            n = np.bincount(ids, minlength=len(codes))
            real = (codes & ((1 << BITS) - 1)) != 0  # a pad is never predicted
            # a block's counts fit into four bytes
            self.parts.append((codes[real], n[real].astype(np.int32) if learn else np.zeros(int(real.sum()), np.int32)))
            if len(self.parts) > 2:
                self._merge()
        self.pending[learn], self.held[learn] = [], 0

    def _merge(self) -> None:
        codes, n = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        self.parts = []
        at = np.argsort(codes, kind="stable")  # parts are ascending, so this merges them
        codes = codes[at]
        n = n[at]
        del at
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, np.int64)
        self.parts = [(codes[first], np.add.reduceat(n, first) if len(first) else n)]

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        self._flush(True)
        self._flush(False)
        self._merge()
        return self.parts[0]


def _counts(order: int):
    def run(block: pa.Table) -> pa.Table:
        words: Counter = Counter()
        other: set = set()
        grams, n_train = _Counted(order), 0
        for held, text in _rows(block, "held_out", "text"):
            ws = words_of(text)
            if held:
                other.update(ws)
            else:
                words.update(ws)
                n_train += 1
            grams.add(b" ".join(ws), not held)
        codes, counts = grams.result()
        counts = counts.astype(np.int64)
        other -= words.keys()
        names = [*words, *other]
        n = [*words.values(), *([0] * len(other))]
        del words, other, grams
        give_back()
        key = block.column("block")[0].as_py()
        total = len(names) + len(codes) + 1
        return pa.table({
            "block": pa.array(np.full(total, key), pa.int32()),
            "word": pa.concat_arrays([pa.array(names, pa.binary()), pa.nulls(len(codes) + 1, pa.binary())]),
            "gram": pa.concat_arrays([pa.nulls(len(names), pa.int64()), pa.array(codes, pa.int64()), pa.nulls(1, pa.int64())]),
            "n": pa.concat_arrays([pa.array(n, pa.int64()), pa.array(counts, pa.int64()), pa.array([n_train], pa.int64())]),
        })

    return run


class Low:
    """Counts of contexts shorter than ``least``, from all training grams (packed) of ``least`` symbols: those of ``least - 1`` context bytes.

    kinds: ``n`` tells how many different symbols stand before each gram, and the shorter ones are counted so as well.
    """

    def __init__(self, least: int, grams: np.ndarray, n: np.ndarray, kinds: bool = False):
        self.least, self.of = least, {}
        for k in range(least - 1, -1, -1):
            codes, at = np.unique(grams & ((1 << BITS * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(at, n, len(codes)).astype(np.int64)
            context, group = np.unique(codes >> BITS, return_inverse=True)
            self.of[k] = codes, count, context, np.bincount(group, count, len(context)).astype(np.int64), np.bincount(group, count > 0, len(context)).astype(np.int64)
            if kinds:
                grams, n = codes, np.ones(len(codes))

    def counts(self, grams: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each gram's last k context bytes: the symbol's count after them, all symbols' count, and how many symbols there are."""
        codes, count, context, total, kinds = self.of[k]

        def find(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
            if not len(keys):
                return [np.zeros(len(wanted), np.int64) for _ in values]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return [np.where(keys[at] == wanted, v[at], 0) for v in values]

        low = grams & ((1 << BITS * (k + 1)) - 1)
        return *find(codes, low, count), *find(context, low >> BITS, total, kinds)


def log_probabilities(grams: np.ndarray, n: np.ndarray, order: int, low: Low) -> np.ndarray:
    """log10 P(symbol | context) for each packed gram; all training grams that share the last ``low.least`` context bytes must be there."""
    least = low.least
    sym = grams & ((1 << BITS) - 1)
    out, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
    # of the context one longer: for each gram, its followers and the mass they have one order below
    up_of = up_seen = up_group = None
    for k in range(order, -2, -1):
        if k < 0:
            d0 = low.of[0][4].sum()
            out[open_] -= math.log10(max(1, ALPHABET - d0))
            break
        if k >= least:
            keys, group = np.unique((grams >> BITS) & ((1 << BITS * k) - 1), return_inverse=True)
            pair, row = np.unique(group.astype(np.int64) << BITS | sym, return_inverse=True)
            count = np.bincount(row, n, len(pair)).astype(np.int64)
            total = np.bincount(pair >> BITS, count, len(keys))
            kinds = np.bincount(pair >> BITS, count > 0, len(keys))
            own, total, kinds = count[row], total[group], kinds[group]
        else:
            _, group = np.unique((grams >> BITS) & ((1 << BITS * k) - 1), return_inverse=True)
            own, total, kinds = low.counts(grams, k)
        gone_mass = gone_kinds = 0
        if up_of is not None:
            # each follower of the longer context once: its mass here is excluded
            pair, first = np.unique(up_group.astype(np.int64) << BITS | sym, return_index=True)
            mass = np.bincount(up_group[first], np.where(up_of[first] > 0, own[first], 0), up_group.max() + 1)
            gone_mass, gone_kinds = mass[up_group], up_seen
        t, d = total - gone_mass, kinds - gone_kinds
        hit = open_ & (own > 0) & (t > 0)
        out[hit] += np.log10((2 * own[hit] - 1) / (2 * t[hit]))
        open_ &= ~hit
        esc = open_ & (t > 0)
        out[esc] += np.log10(d[esc] / (2 * t[esc]))
        up_of, up_seen, up_group = own, kinds, group
    return out


#: What each follower of a context gives of its count to the order below, where orders are blended.
DISCOUNT = 0.8


def blended(grams: np.ndarray, n: np.ndarray, order: int, low: Low) -> np.ndarray:
    """As ``log_probabilities``, with all orders blended: each follower's count less a discount, and what the discounts leave dealt out by the order below.

    Below the longest contexts a symbol counts once for each different symbol that stands before context and symbol (Kneser and Ney), so ``low`` counts by kinds.
    """
    levels, pair, count = [], grams, n
    for k in range(order, low.least - 1, -1):
        pair, row = np.unique(pair & ((1 << BITS * (k + 1)) - 1), return_inverse=True)
        count = np.bincount(row, count if k == order else count > 0, len(pair))
        first = np.append(True, pair[1:] >> BITS != pair[:-1] >> BITS)[: len(pair)]
        group = np.cumsum(first) - 1
        levels.append((row, count, np.bincount(group, count)[group], np.bincount(group, count > 0)[group]))
    p = np.full(len(pair), 1 / ALPHABET)

    def step(p: np.ndarray, count: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return np.where(total > 0, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds * p) / np.maximum(total, 1), p)

    for k in range(low.least):
        p = step(p, *low.counts(pair, k))
    for row, *counts in reversed(levels):
        p = step(p, *counts)[row]  # for each follower one order above
    return np.log10(p)


#: Shares of a text's words that are told by the words of all training texts, by the text's earlier words (up to ``OWN``, half of it after ``OWN_HALF`` words), and by what followed the word before earlier in the text.
KNOWN, OWN, OWN_HALF, FOLLOWING = 0.1, 0.1, 50, 0.2


def mixed(spelled: np.ndarray, words: np.ndarray, doc: np.ndarray, last: np.ndarray, share: np.ndarray, end: float) -> np.ndarray:
    """log10 of the probability of each word with what closes it, given all before it in its text.

    spelled: log10 P of its bytes and the space or end after it; words: their numbers (negative: a text without words); doc: texts, ascending; last: whether it closes the text;
    share: of the words of the training texts; end: the part of those that close a text.
    """
    m = len(spelled)
    start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    before = np.arange(m) - np.repeat(start, np.diff(np.append(start, m)))

    def earlier(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each key stands further ahead, and its number."""
        at = np.argsort(keys, kind="stable")
        new = np.append(True, keys[at[1:]] != keys[at[:-1]])
        group = np.cumsum(new) - 1
        n, ids = np.empty(m, np.int64), np.empty(m, np.int64)
        n[at] = np.arange(m) - np.flatnonzero(new)[group]
        ids[at] = group
        return n, ids

    own, ids = earlier(doc * (int(words.max()) + 2) + words + 1)
    previous = np.append(-1, ids[:-1])
    previous[before == 0] = -1
    after, _ = earlier(np.where(previous < 0, -1 - np.arange(m), previous * (int(ids.max()) + 1) + ids))
    followed = np.where(before > 0, np.append(0, own[:-1]), 0)
    closes = np.where(last, end, 1 - end)
    known = KNOWN if share.any() else 0.0
    w0, w1 = OWN * before / (before + OWN_HALF), FOLLOWING * followed / (followed + 1)
    told = (1 - w1) * ((1 - w0) * known * share + w0 * own / np.maximum(before, 1)) + w1 * after / np.maximum(followed, 1)
    with np.errstate(divide="ignore"):
        return np.logaddexp(spelled * math.log(10) + np.log((1 - w1) * (1 - w0) * (1 - known)), np.log(told * closes)) / math.log(10)


def _score(order: int, log_total: float, n_docs: int, n_total: int, kind: pa.DataType, blend: bool):
    log_end, end_known = math.log10(n_docs + 1), int(n_docs > 0)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        is_word = answers.column("word").is_valid().to_numpy(zero_copy_only=False)
        value = answers.column("value").to_numpy()
        # frequent words first, so that those that are looked up most lie together
        at = np.flatnonzero(is_word)
        at = at[np.argsort(-value[at])]
        names, word_value = answers.column("word").take(pa.array(at)).to_pylist(), value[at]
        number = dict(zip(names, range(len(names)), strict=True))
        del names
        share = (np.rint(10**word_value) - 1) / max(1, n_total - n_docs) if blend else None
        grams, logp = answers.filter(pa.array(~is_word)).column("gram").to_numpy(), value[~is_word]
        at = np.argsort(grams)
        grams, logp = grams[at], logp[at]
        base, known, tokens, scores, pending, numbers, held = [], [], [], [], [], [], 0

        def flush() -> None:
            if not pending:
                return
            sym, starts = _symbols(pending, order)
            ids, codes = _grams(sym, order)
            pads = (codes & ((1 << BITS) - 1)) == 0
            found = np.searchsorted(grams, codes)
            own = np.where(pads, 0.0, logp[np.minimum(found, len(grams) - 1)])
            if not (pads | (grams[np.minimum(found, len(grams) - 1)] == codes)).all():
                raise ValueError("an n-gram of a block has no answer: its documents changed between two reads")
            if blend:
                closed = np.flatnonzero((sym[order:] == ord(" ") + 1) | (sym[order:] == END))
                spelled = np.add.reduceat(own[ids], np.append(0, closed[:-1] + 1))
                last = sym[order:][closed] == END
                doc = np.cumsum(last) - last
                words = np.concatenate([w if len(w) else [-1] for w in numbers])
                one = mixed(spelled, words, doc, last, np.where(words < 0, 0.0, share[words]) if len(share) else np.zeros(len(words)), n_docs / n_total if n_total else 0.5)
                scores.extend(np.add.reduceat(one, np.flatnonzero(np.append(True, last[:-1]))).tolist())
            else:
                scores.extend(np.add.reduceat(own[ids], starts).tolist())
            pending.clear()
            numbers.clear()

        for (text,) in _rows(docs, "text"):
            ws = words_of(text)
            nums = np.fromiter(map(number.__getitem__, ws), np.int64, len(ws))
            vals = word_value[nums]
            tokens.append(len(ws) + 1)
            known.append(int(np.count_nonzero(vals)) + end_known)
            base.append(float(vals.sum()) + log_end - (len(ws) + 1) * log_total)
            pending.append(b" ".join(ws))
            if blend:
                numbers.append(nums)
            held += len(pending[-1])
            if held > CHUNK:
                flush()
                held = 0
        flush()
        del number, word_value, share, grams, logp
        give_back()
        return pa.table({
            "id": docs.column("id").cast(kind), "held_out": docs.column("held_out"), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array(np.full(len(tokens), n_total), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(scores, pa.float64()),
        })

    return run


def score(docs: DataFrame, held_out, order: int = 5, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16_000_000, blend: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    held_out: a Column over ``docs``; rows where it is true (or null) are scored but not learned from.
    blend: orders are blended and words mixed in, instead of method D with exclusion.
    Null and empty texts are the end symbol alone. Repeated rows and null ids are rows of their own, ids are of any type, extra
    columns are ignored. Without any training row the trie is empty and
    every symbol is equally likely. An empty table gives no rows.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        return _scored(spark, docs, held_out, order, id_col, text_col, block_bytes, blend, keep).withColumnRenamed("id", id_col)


def _scored(spark, docs: DataFrame, held_out, order: int, id_col: str, text_col: str, block_bytes: int, blend: bool, keep) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = keep(settled(rows))
    kind = rows.schema["id"]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(tasks(spark), -(-size // block_bytes))
    # by row, not by text: copies are dealt evenly too
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    asked = cut(dealt.groupBy("block").applyInArrow(_counts(order), "block int, word binary, gram long, n long"))

    sum_c = cut(asked.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")))
    # contexts below this length are told to all tasks: there are at most ALPHABET ** least strings of them (17 million), however much text there is;
    # groups share this many context bytes, so the rows of one are bounded alike
    least = min(3, order)
    ending = lambda k: F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("gram")
    learned = sum_c.where("n > 0")
    if blend:
        learned = learned.select(ending(least + 1)).distinct().withColumn("n", F.lit(1))
    got = learned.groupBy(ending(least)).agg(F.sum("n").alias("n")).toArrow()
    low = Low(least, got.column("gram").to_numpy(), got.column("n").to_numpy(), blend)
    model = blended if blend else log_probabilities

    def work(part: pa.Table) -> pa.Table:
        g = part.column("gram").to_numpy()
        return pa.table({"gram": part.column("gram"), "value": pa.array(model(g, part.column("n").to_numpy(), order, low), pa.float64())})

    tail = F.shiftright("gram", BITS).bitwiseAND(F.lit((1 << least * BITS) - 1))
    logp = sum_c.withColumn("tail", tail).groupBy("tail").applyInArrow(lambda t: work(t), "gram long, value double")
    gram_answers = asked.where("gram IS NOT NULL").select("block", "gram").join(logp, "gram").select("block", F.lit(None).cast("binary").alias("word"), "gram", "value")

    words = cut(asked.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")))
    word_answers = asked.where("word IS NOT NULL").select("block", "word").join(words, "word").select("block", "word", F.lit(None).cast("long").alias("gram"), F.log10(F.col("c") + 1).alias("value"))
    answers = keep(cut(word_answers.unionByName(gram_answers)))
    distinct, n_words = words.agg(F.count_if(F.col("c") > 0), F.sum("c")).first()
    n_docs = asked.where("word IS NULL AND gram IS NULL").agg(F.sum("n")).first()[0] or 0
    distinct += n_docs > 0
    total = (n_words or 0) + n_docs
    run = _score(order, math.log10(total + distinct + 1), n_docs, total, to_arrow_type(kind.dataType), blend)
    out = StructType([kind, *StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: run(a, b), out)


class AdaptiveTrie:
    """The same model learning as it goes: ``code_length(data)`` gives -log2 P of bytes, then the trie knows them."""

    def __init__(self, order: int = 4):
        self.order, self.nodes = order, {}

    def code_length(self, data: bytes) -> float:
        bits, history = 0.0, (0,) * self.order
        for s in [*(b + 1 for b in data), END]:
            bits -= math.log2(self.probability(history, s))
            for k in range(self.order + 1):
                self.nodes.setdefault(history[self.order - k :], Counter())[s] += 1
            history = (*history[1:], s)[-self.order :] if self.order else ()
        return bits

    def probability(self, history: tuple, s: int) -> float:
        p, gone = 1.0, set()
        for k in range(self.order, -1, -1):
            followers = {x: n for x, n in self.nodes.get(history[self.order - k :], {}).items() if x not in gone}
            if not followers:
                continue
            total = sum(followers.values())
            if s in followers:
                return p * (2 * followers[s] - 1) / (2 * total)
            p *= len(followers) / (2 * total)
            gone |= followers.keys()
        return p / max(1, ALPHABET - len(gone))


def adaptive_code_lengths(docs: DataFrame, order: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bits): each document's own code length with a trie that starts empty; repetitive texts get few bits a byte."""

    def run(batches):
        for b in batches:
            bits = [AdaptiveTrie(order).code_length(b" ".join(words_of(t))) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(bits, pa.float64())], ["id", "bits"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, bits double").withColumnRenamed("id", id_col)
