"""Operator 6, removal of repeated 50-word passages by difference-cover anchors.

A difference cover D modulo P has, for any two places i and j, a shift below P that puts both on cover
positions. So two equal passages of WINDOW words share an anchor of WINDOW - P + 1 words that starts on
a cover position in both texts, and only cover positions (6 of 31) need hashing and shuffling.

Documents work in blocks (see blocks.py), texts are shuffled to their block's tasks once, and each
step's questions and answers hold a key at most once for each block:
1. Whole documents: a document whose word sequence equals that of a smaller one (and holds a window) loses all
   its words and leaves the search, where the smaller one stands for it.
2. Anchors: hashes seen in two different documents are shared.
3. Extension: all windows around shared anchors are hashed (two 64-bit hashes, rolled from prefix sums); the
   smallest document that holds a window owns it.
4. Each text drops the words covered by windows that a smaller document owns.

Defined results: null and empty texts have no words; a null id has no smaller document and is none, so
nothing is removed; rows of one id never mark one another; repeated rows get equal results; other
columns are left out of the shuffles but for those asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .blocks import blocked, meet
from .common import read, ship

WINDOW = 50
PERIOD = 31
#: Every difference modulo 31 occurs among these (a perfect difference set).
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1
NO_ID = np.iinfo(np.int64).min
WHOLE, SHARED, OWNED = 0, 1, 2
_KEYS = "block long, a long, b long, low long, high long"


class _Chunk:
    """A chunk of a block's texts with what every step needs of it."""

    def __init__(self, first: int, data: np.ndarray, at: np.ndarray, ids: np.ndarray):
        self.first, self.at, self.data = first, at, data
        self.words = tb.Words(data, at)
        self.id = ids[first : first + len(at) - 1]
        self.sums = [tb.word_prefix(self.words.hashes(tb.byte_prefix(data, f), f), f) for f in (0, 1)]

    def hashes(self, start: np.ndarray, end: np.ndarray, family: int) -> np.ndarray:
        return tb.word_runs(self.sums[family], start, end, family).view(np.int64)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        f = self.words.first
        return self.hashes(f[:-1], f[1:], 0), self.hashes(f[:-1], f[1:], 1)

    def copies(self, owner: "_Owners") -> np.ndarray:
        """Documents that equal a smaller one."""
        at = owner.of(*self.whole())
        return (at != NO_ID) & (at < self.id) & (self.words.count >= WINDOW) & (self.id != NO_ID)

    def by_word(self, of_doc: np.ndarray) -> np.ndarray:
        return np.repeat(of_doc, self.words.count)


class _Owners:
    """Smallest documents of keys, from answers (a, b, low)."""

    def __init__(self, answers: pa.Table, what: int):
        rows = answers.filter(pa.array(answers.column("what").to_numpy() == what))
        a = rows.column("a").to_numpy()
        order = np.argsort(a, kind="stable")
        self.a, self.b, self.low = a[order], rows.column("b").to_numpy()[order], rows.column("low").to_numpy()[order]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The owner of each key, NO_ID without one."""
        if not len(self.a):
            return np.full(len(a), NO_ID)
        i = np.minimum(np.searchsorted(self.a, a), len(self.a) - 1)
        return np.where((self.a[i] == a) & (self.b[i] == b), self.low[i], NO_ID)


def _chunks(texts: pa.Table) -> Iterator[_Chunk]:
    ids = pc.fill_null(texts.column("doc"), NO_ID).to_numpy()
    for first, data, at in tb.chunks(texts.column("text")):
        yield _Chunk(first, data, at, ids)


def _asked(block: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """Keys (a, b) of documents as one row each with the smallest and the largest document."""
    a, b, doc = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else ((), (), ())))
    order = np.lexsort((doc, b, a))
    a, b, doc = a[order], b[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(a))[: len(start)] - 1
    n = len(start)
    return pa.table({"block": pa.array(np.full(n, block, np.int64)), "a": pa.array(a[start]), "b": pa.array(b[start]), "low": pa.array(doc[start]), "high": pa.array(doc[end])})


def _ask_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for c in _chunks(table):
            k = np.flatnonzero((c.words.count >= WINDOW) & (c.id != NO_ID))
            a, b = c.whole()
            blocks = batch.column(2).to_numpy()[c.first : c.first + len(c.id)][k]
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(a[k]), pa.array(b[k]), pa.array(c.id[k]), pa.array(c.id[k])], names=["block", "a", "b", "low", "high"])


def _ask_anchors(texts: pa.Table, answers: pa.Table) -> pa.Table:
    owner, parts = _Owners(answers, WHOLE), []
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    for c in _chunks(texts):
        place, n = c.words.within(), c.by_word(c.words.count)
        open_ = c.by_word(~c.copies(owner) & (c.id != NO_ID))
        k = np.flatnonzero(open_ & cover[place % PERIOD] & (place + ANCHOR <= n) & (n >= WINDOW))
        h = c.hashes(k, k + ANCHOR, 0)
        parts.append((h, np.zeros(len(h), np.int64), c.by_word(c.id)[k]))
    return _asked(texts.column("block")[0].as_py() if texts.num_rows else 0, parts)


def _near(c: _Chunk, owner: _Owners, shared: np.ndarray) -> np.ndarray:
    """Starts of all windows that hold a shared anchor."""
    place, n = c.words.within(), c.by_word(c.words.count)
    fits = np.flatnonzero(c.by_word(~c.copies(owner) & (c.id != NO_ID)) & (place + ANCHOR <= n) & (n >= WINDOW))
    hit = np.zeros(len(place) + 1, np.int64)
    if len(shared) and len(fits):
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        p = fits[cover[place[fits] % PERIOD]]
        p = p[np.isin(c.hashes(p, p + ANCHOR, 0), shared)]
        first = p - place[p]
        low, high = np.maximum(p - (PERIOD - 1), first), np.minimum(p, first + n[p] - WINDOW) + 1
        np.add.at(hit, low, 1)
        np.add.at(hit, high, -1)
    return np.flatnonzero(np.cumsum(hit[:-1]) > 0)


def _shared(answers: pa.Table) -> np.ndarray:
    return answers.filter(pa.array(answers.column("what").to_numpy() == SHARED)).column("a").to_numpy()


def _ask_windows(texts: pa.Table, answers: pa.Table) -> pa.Table:
    owner, shared, parts = _Owners(answers, WHOLE), _shared(answers), []
    for c in _chunks(texts):
        k = _near(c, owner, shared)
        parts.append((c.hashes(k, k + WINDOW, 0), c.hashes(k, k + WINDOW, 1), c.by_word(c.id)[k]))
    return _asked(texts.column("block")[0].as_py() if texts.num_rows else 0, parts)


def _strip(kept: list[str], to: tuple[str, str, str]):
    """Cogroup: a block's texts and all answers to it, to rows with the kept text."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        owner, owned, out = _Owners(answers, WHOLE), _Owners(answers, OWNED), []
        n_words, n_removed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c in _chunks(texts):
            w = c.words
            gone = np.zeros(len(w.start) + 1, np.int64)
            copy = c.by_word(c.copies(owner))
            if len(owned.a):
                n = c.by_word(w.count)
                k = np.flatnonzero((w.within() + WINDOW <= n) & c.by_word(c.id != NO_ID))
                k = k[np.isin(c.hashes(k, k + WINDOW, 0), owned.a)]
                low = owned.of(c.hashes(k, k + WINDOW, 0), c.hashes(k, k + WINDOW, 1))
                k = k[(low != NO_ID) & (low < c.by_word(c.id)[k])]
                np.add.at(gone, k, 1)
                np.add.at(gone, k + WINDOW, -1)
            drop = copy | (np.cumsum(gone[:-1]) > 0)
            dropped = np.add.reduceat(np.append(drop, False).astype(np.int64), w.first[:-1]) * (w.count > 0)
            raw = c.data.tobytes()
            for d in range(len(c.at) - 1):
                words = raw[c.at[d] : c.at[d + 1]].split()
                if dropped[d]:
                    words = [words[q] for q in np.flatnonzero(~drop[w.first[d] : w.first[d + 1]])]
                out.append(b" ".join(words))
            n_words.append(w.count)
            n_removed.append(dropped)
        columns = {k: texts.column("_" + k) for k in kept}
        columns |= {to[0]: pa.array(np.concatenate(n_words)), to[1]: pa.array(np.concatenate(n_removed)), to[2]: pa.array(out, pa.binary()).cast(pa.string())}
        return pa.table(columns)

    return run


def _owners(asked: DataFrame, what: int) -> DataFrame:
    """Answers to the blocks that asked for a key which two documents hold. A key has one row for each block."""
    by = Window.partitionBy("a", "b")
    found = asked.withColumn("least", F.min("low").over(by)).withColumn("most", F.max("high").over(by)).where("least < most")
    return found.select("block", F.lit(what).alias("what"), "a", "b", F.col("least").alias("low"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", to: tuple[str, str, str] = ("n_words", "n_removed", "text")) -> DataFrame:
    """docs with the number of words, the number removed, and the kept words joined by spaces (in the
    text's own column unless `to` names another)."""
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in to]
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"), *[F.col(c).alias("_" + c) for c in kept if c != id_col or docs.schema[c].dataType != T.LongType()])
    texts = blocked(texts)
    plain = [c for c in kept if "_" + c not in texts.columns]
    each = texts.select("doc", "text", "block").mapInArrow(_ask_whole, _KEYS)
    whole = _owners(each.groupBy("block", "a", "b").agg(F.min("low").alias("low"), F.max("high").alias("high")), WHOLE)
    shared = _owners(meet(texts, whole, _ask_anchors, _KEYS), SHARED)
    owned = _owners(meet(texts, whole.unionAll(shared), _ask_windows, _KEYS), OWNED)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(to[0], T.LongType()), T.StructField(to[1], T.LongType()), T.StructField(to[2], T.StringType())])
    strip = _strip(kept, to)

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        for c in plain:
            block = block.append_column("_" + c, block.column("doc"))
        return strip(block, answers)

    return meet(texts, whole.unionAll(owned), run, schema)


def op6_difference_cover(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
