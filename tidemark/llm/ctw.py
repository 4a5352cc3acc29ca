"""Operator 1, language-model scores by context-tree weighting.

A byte is eight binary choices down a tree of 255 nodes; each node of each context (the last 0 to D bytes)
holds a Krichevsky-Trofimov (KT) estimator of its next bit. Context-tree weighting gives each context the
probability Pw = (KT + product of Pw over the contexts one byte longer) / 2, so a bit is predicted by a
mixture over all depths whose weights the training counts set. All of it depends on training texts
only through the counts of (D+1)-byte strings: a context's KT probability is a closed form of its counts.

1. Each task reduces its texts to distinct (D+1)-byte strings with training counts; counts are added up.
2. Strings are grouped by the two latest context bytes. Such a group holds the whole subtree of these contexts,
   so weights and predictions are worked out inside, vectorised over all its strings. What reaches beyond the group,
   the nodes of depth 0 and 1, is a table of at most 257 x 255 rows, made from per-group sums.
3. That gives each string that occurs in any text its log10 probability of the last byte after the
   others; a text's score adds them up. A context that training never saw passes its parent's
   prediction on.

Texts are scored as the base scores them: A-Z lower-cased, words joined by one space, a line feed as end.
That byte string and the tokens determine each other, so both scores are about the same event.

A word counts by one 64-bit hash (63 bits and a mark): of a billion distinct words about 0.05 share one by chance.
Splitting step 2 by two bytes bounds a group by the distinct strings after one pair of bytes, at most 256^4 in theory and a few
percent of all distinct strings in natural text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .blocks import blocked, meet
from .common import read, ship

_U = np.uint64
DEPTH = 5
#: Bytes of text in a block, about: larger ones hold fewer distinct strings a byte.
BLOCK = 32 << 20
_SMALL = 1 << 14
#: log of gamma(n + 1/2) / gamma(1/2) and of n!, for small n.
_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL - 1) + 0.5))])
_FACT = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL)))])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for large x (Stirling's series)."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _log_half(n: np.ndarray) -> np.ndarray:
    small = np.minimum(n, _SMALL - 1)
    return np.where(n < _SMALL, _HALF[small], _lgamma(np.maximum(n, 1) + 0.5) - 0.5 * math.log(math.pi))


def _log_fact(n: np.ndarray) -> np.ndarray:
    small = np.minimum(n, _SMALL - 1)
    return np.where(n < _SMALL, _FACT[small], _lgamma(np.maximum(n, 1) + 1.0))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the KT probability of any sequence with these counts."""
    return _log_half(zeros) + _log_half(ones) - _log_fact(zeros + ones)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs in a sorted key, and each element's run."""
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return np.flatnonzero(new), np.cumsum(new) - 1


class Level:
    """The bit nodes of all contexts of one depth: sorted keys (context, place in the byte's tree), counts and weights."""

    def __init__(self, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.key, self.zeros, self.ones = key, zeros, ones
        self.kt = log_kt(zeros, ones)
        self.pw = self.kt
        self.stay = np.ones(len(key))  # weight of the node's own estimate against longer contexts

    def weigh(self, key: np.ndarray, pw: np.ndarray) -> None:
        """Takes the log Pw of the contexts one byte longer, under this level's keys."""
        sums = np.bincount(np.searchsorted(self.key, key), pw, minlength=len(self.key)) if len(key) else np.zeros(len(self.key))
        top = np.logaddexp(self.kt, sums)
        self.pw = top - math.log(2)
        self.stay = np.exp(self.kt - top)


def level(context_byte: np.ndarray, count: np.ndarray) -> Level:
    """Bit nodes from (context * 256 + byte) values, sorted or not, with training counts; nodes without a count are left out."""
    order = np.argsort(context_byte, kind="stable")
    v, n = context_byte[order], count[order]
    starts, _ = _groups(v)
    v, n = v[starts], np.add.reduceat(n, starts) if len(v) else n
    v, n = v[n > 0], n[n > 0]
    keys, zeros, ones = [], [], []
    for bit in range(8):
        node = node_keys(v, bit)
        s, _ = _groups(node)
        if not len(node):
            break
        one = (v >> _U(7 - bit)) & _U(1)
        keys.append(node[s])
        ones.append(np.add.reduceat(n * one.astype(np.int64), s))
        zeros.append(np.add.reduceat(n, s) - ones[-1])
    if not keys:
        return Level(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    return Level(key[order], np.concatenate(zeros)[order], np.concatenate(ones)[order])


def node_keys(context_byte: np.ndarray, bit: int) -> np.ndarray:
    """(context, node) of the choice of `bit` (0 is the first) on the way to the byte; node 1 is the tree's root."""
    context, byte = context_byte >> _U(8), context_byte & _U(255)
    return (context << _U(8)) | (_U(1 << bit) | (byte >> _U(8 - bit)))


def cut_context(grams: np.ndarray, depth: int) -> np.ndarray:
    """Strings (oldest byte highest) as context * 256 + byte with the latest `depth` bytes of context."""
    return grams & _U((1 << (8 * (depth + 1))) - 1)


def parent(key: np.ndarray, depth: int) -> np.ndarray:
    """Node keys of one byte less context, for keys of contexts of `depth` bytes."""
    return key & _U((1 << (8 * depth)) - 1)


def build(grams: np.ndarray, count: np.ndarray, depth: int, top: int) -> dict[int, Level]:
    """Levels `depth` down to `top`, weighed bottom-up."""
    levels = {}
    for d in range(depth, top - 1, -1):
        levels[d] = level(cut_context(grams, d), count)
        if d < depth:
            below = levels[d + 1]
            levels[d].weigh(parent(below.key, d + 1), below.pw)
    return levels


def longer(grams: np.ndarray, levels: dict[int, Level], bit: int, one: np.ndarray) -> np.ndarray:
    """The mixture's probability of a bit by these levels; nan where even the shallowest context is unseen.

    A context that training saw mixes its estimate with the longer ones'; where those are unseen it stands alone."""
    p = np.full(len(grams), np.nan)
    for d in sorted(levels, reverse=True):
        v = levels[d]
        if not len(v.key):
            continue
        key = node_keys(cut_context(grams, d), bit)
        i = np.minimum(np.searchsorted(v.key, key), len(v.key) - 1)
        kt = (np.where(one, v.ones[i], v.zeros[i]) + 0.5) / (v.zeros[i] + v.ones[i] + 1.0)
        mixed = np.where(np.isnan(p), kt, v.stay[i] * kt + (1 - v.stay[i]) * p)
        p = np.where(v.key[i] == key, mixed, p)
    return p


def log10_last(grams: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """log10 of the mixture's probability of each string's last byte after the bytes before it, all levels at hand."""
    out = np.zeros(len(grams))
    for bit in range(8):
        one = ((grams >> _U(7 - bit)) & _U(1)).astype(bool)
        p = longer(grams, levels, bit, one)
        out += np.log10(np.where(np.isnan(p), 0.5, p))
    return out


def canonical(text: str | None) -> bytes:
    """The bytes that are scored: lower-cased words joined by spaces, then the end."""
    return b" ".join((text or "").encode().lower().split()) + b"\n"


#: Keys are one signed 64-bit integer: strings as they are (below 2^63), words as hashes with the highest bit set.
END = -1


def _word_keys(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all words of canonical texts, and each text's number of words."""
    w = tb.Words(data, at)
    return (w.hashes(tb.byte_prefix(data)) | _U(1 << 63)).view(np.int64), w.count


def _strings(parts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The (depth+1)-byte strings that end at each byte of each text (line feeds stand before a text), and the texts' lengths."""
    pad = b"\n" * depth
    a = np.frombuffer(pad + pad.join(parts), np.uint8).astype(np.uint64)
    size = np.array([len(p) for p in parts], np.int64)
    g = np.zeros(len(a) - depth, np.uint64)
    for k in range(depth + 1):
        g = (g << _U(8)) | a[k : len(a) - depth + k]
    # Strings that end inside a pad belong to no text.
    keep = np.ones(len(g), bool)
    starts = np.cumsum(size + depth)[:-1] - depth
    for k in range(depth):
        keep[starts + k] = False
    return g[keep], size


def _pieces(texts: pa.ChunkedArray | pa.Array, most: int = 1 << 19):
    """(first, canonical texts) of runs of texts with about `most` bytes."""
    part, first, size = [], 0, 0
    for i, t in enumerate(texts):
        part.append(canonical(t.as_py()))
        size += len(part[-1])
        if size >= most:
            yield first, part
            part, first, size = [], i + 1, 0
    if part:
        yield first, part


class _Counts:
    """Distinct keys with added-up training counts, merged whenever they have doubled."""

    def __init__(self):
        self.key, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, key: np.ndarray, train: np.ndarray) -> None:
        """Keys, and which of them stand in training texts."""
        for use in (True, False):
            part = np.sort(key[train == use])
            if len(part):
                start, _ = _groups(part)
                n = np.diff(np.append(start, len(part))) if use else np.zeros(len(start), np.int64)
                self.more.append((part[start], n))
                self.waiting += len(start)
        if self.waiting > max(1 << 20, len(self.key)):
            self.merge()

    def merge(self) -> None:
        key = np.concatenate([self.key, *(k for k, _ in self.more)])
        n = np.concatenate([self.n, *(n for _, n in self.more)])
        order = np.argsort(key)
        key, n = key[order], n[order]
        if len(key):
            start, _ = _groups(key)
            self.key, self.n = key[start], np.add.reduceat(n, start)
        self.more, self.waiting = [], 0


def _count(depth: int):
    """Rows (text, train, block) to (block, key, n): every key of a block, with its count in training texts."""

    def flush(block: int, counts: _Counts) -> Iterator[pa.RecordBatch]:
        counts.merge()
        for i in range(0, len(counts.key), 200_000):
            key, n = counts.key[i : i + 200_000], counts.n[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block)), pa.array(key), pa.array(n)], names=["block", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, _Counts()
        for batch in batches:
            blocks = batch.column(2).to_numpy()
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(blocks)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                if now is not None and blocks[lo] != now:
                    yield from flush(now, counts)
                    counts = _Counts()
                now = blocks[lo]
                for first, part in _pieces(batch.column(0).slice(lo, hi - lo)):
                    use = train[lo + first : lo + first + len(part)]
                    g, size = _strings(part, depth)
                    counts.add(g.view(np.int64), np.repeat(use, size))
                    data = np.frombuffer(b"".join(part), np.uint8)
                    words, n = _word_keys(data, np.concatenate([[0], np.cumsum(size)]))
                    counts.add(words, np.repeat(use, n))
                    counts.add(np.full(len(use), END), use)
        if now is not None:
            yield from flush(now, counts)

    return run


def _subtree(depth: int):
    """A group of strings with the same two latest context bytes, to what the shallow nodes need of it: log Pw by
    (last byte, node), and byte counts by (last byte, byte)."""

    def run(table: pa.Table) -> pa.Table:
        g = table.column("key").to_numpy().view(np.uint64)
        n = table.column("n").to_numpy()
        low = build(g, n, depth, 2)[2]
        pw, at = np.unique(parent(low.key, 2), return_inverse=True)
        pw_sum = np.bincount(at, low.pw, minlength=len(pw))
        one, at = np.unique(cut_context(g, 1), return_inverse=True)
        n_sum = np.bincount(at, n, minlength=len(one)).astype(float)
        keys = np.concatenate([pw, one]).astype(np.int64)
        return pa.table({"what": pa.array([0] * len(pw) + [1] * len(one), pa.int32()), "key": pa.array(keys), "x": pa.array(np.concatenate([pw_sum, n_sum]))})

    return run


def _shallow(table: pa.Table) -> pa.Table:
    """The nodes of depth 0 and 1 (at most 2 * 65536 rows in) to one row for each last byte: for each node, the
    chance of a one by these two depths alone and the weight left for longer contexts."""
    what, key, x = (table.column(c).to_numpy() for c in ("what", "key", "x"))
    one = key[what == 1].astype(np.uint64)
    n = np.rint(x[what == 1]).astype(np.int64)
    levels = {1: level(one, n), 0: level(one & _U(255), n)}
    levels[1].weigh(key[what == 0].astype(np.uint64), x[what == 0])
    levels[0].weigh(parent(levels[1].key, 1), levels[1].pw)
    node = np.arange(256, dtype=np.uint64)

    def of(v: Level, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(v.key):
            return np.zeros(len(keys), bool), np.full(len(keys), 0.5), np.ones(len(keys))
        i = np.minimum(np.searchsorted(v.key, keys), len(v.key) - 1)
        return v.key[i] == keys, (v.ones[i] + 0.5) / (v.zeros[i] + v.ones[i] + 1.0), v.stay[i]

    rows = []
    known0, kt0, stay0 = of(levels[0], node)
    for c in range(256):
        known1, kt1, stay1 = of(levels[1], (_U(c) << _U(8)) | node)
        # alone: the prediction where longer contexts are unseen; base and left: base + left * longer prediction.
        below = np.where(known1, kt1, kt0)
        alone = np.where(known0, np.where(known1, stay0 * kt0 + (1 - stay0) * below, kt0), 0.5)
        base = np.where(known1, stay0 * kt0 + (1 - stay0) * stay1 * kt1, kt0)
        left = np.where(known1, (1 - stay0) * (1 - stay1), 0.0)
        rows.append(np.concatenate([alone, base, left]).tobytes())
    return pa.table({"last": pa.array(range(256), pa.int32()), "shallow": pa.array(rows, pa.binary())})


def _predict(depth: int):
    """Cogroup: strings with the same two latest context bytes, and the shallow nodes' row for the last of them."""

    def run(table: pa.Table, shallow: pa.Table) -> pa.Table:
        g = table.column("key").to_numpy().view(np.uint64)
        levels = build(g, table.column("n").to_numpy(), depth, 2)
        alone, base, left = np.frombuffer(shallow.column("shallow")[0].as_py()).reshape(3, 256)
        logs = np.zeros(len(g))
        for bit in range(8):
            node = (node_keys(g, bit) & _U(255)).astype(np.int64)
            one = ((g >> _U(7 - bit)) & _U(1)).astype(bool)
            p = longer(g, levels, bit, one)
            seen = ~np.isnan(p)
            # Chances are of a one above, of the actual bit in p.
            flip = lambda v: np.where(one, v, 1 - v)
            mixed = np.where(one, base[node], 1 - left[node] - base[node]) + left[node] * np.where(seen, p, 0)
            logs += np.log10(np.where(seen, mixed, flip(alone[node])))
        return pa.table({"key": table.column("key"), "v": pa.array(logs)})

    return run


class _Index:
    """Values by 64-bit key, in an open-addressed table with at least two slots a key."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.key, self.value = np.append(key, 0), np.append(value, np.nan)
        self.bits = max(4, int(2 * len(key)).bit_length())
        self.slot = np.full(1 << self.bits, len(key), np.int32)
        todo, at = np.arange(len(key), dtype=np.int32), self._start(key)
        while len(todo):
            free = self.slot[at] == len(key)
            self.slot[at[free]] = todo[free]
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & (len(self.slot) - 1)

    def _start(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def __getitem__(self, key: np.ndarray) -> np.ndarray:
        """The values of keys, all of which must be there."""
        at = self._start(key)
        row = self.slot[at]
        wrong = np.flatnonzero(self.key[row] != key)
        while len(wrong):
            if (row[wrong] == len(self.key) - 1).any():
                raise ValueError("a block changed between counting and scoring")
            at[wrong] = (at[wrong] + 1) & (len(self.slot) - 1)
            row[wrong] = self.slot[at[wrong]]
            wrong = wrong[self.key[row[wrong]] != key[wrong]]
        return self.value[row]


def _score(depth: int):
    """Cogroup: a block's texts and the values of its keys; gives each text's sums."""

    def run(texts: pa.Table, values: pa.Table) -> pa.Table:
        look = _Index(values.column("key").to_numpy(), values.column("v").to_numpy())
        end = float(look[np.array([END])][0])
        n_bytes, n_tokens, n_known, base, score = [], [], [], [], []
        for _, part in _pieces(texts.column("text")):
            g, size = _strings(part, depth)
            n_bytes.append(np.asarray(size, np.int64))
            score.append(np.add.reduceat(look[g.view(np.int64)], np.cumsum(size) - size))
            data = np.frombuffer(b"".join(part), np.uint8)
            words, n = _word_keys(data, np.concatenate([[0], np.cumsum(size)]))
            x = look[words]
            of = np.repeat(np.arange(len(part)), n)
            n_tokens.append(n + 1)
            n_known.append(np.bincount(of, x > 0, minlength=len(part)).astype(np.int64) + (end > 0))
            base.append(np.bincount(of, x, minlength=len(part)) + end)
        put = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"doc": texts.column("doc"), "held_out": texts.column("held_out"), "n_tokens": put(n_tokens, pa.int64()), "n_known": put(n_known, pa.int64()), "base": put(base, pa.float64()), "score": put(score, pa.float64()), "n_bytes": put(n_bytes, pa.int64())})

    return run


#: Keys are never null, else each join would filter them below the exchange that all branches share.
_ASKED = T.StructType([T.StructField("block", T.LongType(), False), T.StructField("key", T.LongType(), False), T.StructField("n", T.LongType())])


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row for each of docs, with these columns only: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes
    (of the canonical text, its end included) and bits_per_byte, the code length per byte.

    Texts where held_out is false train. Defined results: a null or empty text is the end alone; a null id
    is scored like any other; without training texts nothing is known and every bit has probability 1/2."""
    ship(docs.sparkSession)
    texts = blocked(docs.select(F.col(id_col).alias("doc"), F.col(text).alias("text"), held_out.alias("held_out")), limit=BLOCK)
    # A task's blocks one after another, so that each is counted whole.
    asked = texts.select("text", F.expr("not held_out").alias("train"), "block").sortWithinPartitions("block").mapInArrow(_count(depth), _ASKED)
    # One exchange serves all that follows: every branch reads all its columns and filters above it only.
    asked = asked.repartition("key")
    totals = asked.groupBy("key").agg(F.sum("n").alias("n"), F.min("block").alias("first"), F.max(F.col("key") < 0).alias("word"))
    strings = totals.where("not word").select("key", "n", "first", F.expr("cast(shiftright(key, 8) & 65535 as int)").alias("late")).repartition("late")
    parts = strings.groupBy("late").applyInArrow(_subtree(depth), "what int, key long, x double")
    shallow = parts.groupBy("what", "key").agg(F.sum("x").alias("x")).withColumn("all", F.col("what") * 0).groupBy("all").applyInArrow(_shallow, "last int, shallow binary")
    lates = strings.groupBy(F.col("late").alias("to")).agg(F.max("key").alias("key"), F.max("n").alias("n"), F.max("first").alias("first"))
    guide = lates.withColumn("last", F.expr("to & 255")).join(shallow, "last")
    logs = strings.groupBy("late").cogroup(guide.groupBy("to")).applyInArrow(_predict(depth), "key long, v double")
    words = totals.where("word").withColumn("n", F.when(F.col("first").isNotNull(), F.col("n")))
    values = words.select("key", F.log10(F.col("n") + 1.0).alias("v")).unionAll(logs)
    answers = asked.join(values, "key").select("block", "key", F.when(F.col("n").isNotNull(), F.col("v")).alias("v"))
    sums = meet(texts, answers, _score(depth), docs.select(F.col(id_col).alias("doc")).schema.add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("base", "double").add("score", "double").add("n_bytes", "long"))
    size = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("train_tokens"), F.count(F.when(F.col("n") > 0, 1)).alias("distinct"))
    out = sums.crossJoin(F.broadcast(size))  # one row
    base = F.col("base") - F.col("n_tokens") * F.log10((F.col("train_tokens") + F.col("distinct") + 1).cast("double"))
    return out.select(F.col("doc").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score", "n_bytes", (F.col("score") / -math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"))


def op1_context_tree(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return score(docs, held_out)
