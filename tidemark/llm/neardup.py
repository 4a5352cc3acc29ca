"""Operator 3, near-duplicate documents by HyperMinHash.

A document's set holds its distinct k-word shingles (A-Z lower-cased), as 64-bit hashes. Its sketch has one
register for each of 256 ranges of the hash space: the leading zeros and ten further bits (the mantissa)
of the smallest hash there, 16 bits in all. Empty registers borrow from full ones in a fixed random order, and
bands of six registers are hashed; documents that agree in a band are candidates. A candidate pair's
similarity is estimated from the registers, corrected for chance collisions; what can still reach the
threshold is confirmed on full sets.

Equal sets are one class from the start, whatever their number, and stay out of all that follows but for
one representative. No candidate pairs are listed: buckets (classes that share a band) that have members in
common form clusters, found by contraction, and a cluster of up to WHOLE classes and WHOLE_BYTES is compared inside one task, which gives
its components. Larger ones take two steps:
1. Star rounds: a bucket's members are compared with one leader of it; who is linked is done there, the
   others meet another leader in the next round.
2. Rest: where buckets still hold several components, each cluster's classes outside its largest component are a
   query set that is compared with all its classes, block by block in tasks of bounded size,
   and only links come out. No candidate is left out but by its estimate.
Nothing but counts reaches the driver.

A pair at the threshold 0.8 is missed by all 42 bands, or dropped by its estimate, with a probability of about 3 in a million.

Defined results: null and empty texts have an empty set and no links; a text of fewer than k words has one
shingle, the whole; a null id has no links, a null component and is kept; rows of one id and set share
a result. `groups` returns its four columns only, so other columns' names can't clash; `first_of_each` returns docs' own columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import cut, read, ship
from .graph import components

REGISTER_BITS = 8
REGISTERS = 1 << REGISTER_BITS
MANTISSA = 10
EMPTY = 0xFFFF
ROWS = 6
BANDS = REGISTERS // ROWS
ROUNDS = 3
#: Estimates this many standard errors below the threshold still go to the exact check. By the binomial law, for any number of
#: registers, at most 3 in ten million pairs at the threshold lie lower: a tenth of what all bands miss.
MARGIN = 6.0
#: The largest cluster that one task compares whole, by classes and by bytes of their sets.
WHOLE = 4000
WHOLE_BYTES = 64 << 20
#: Documents on each side of one block of comparisons, and pairs in one block of star comparisons; both hold about BYTES of sets.
BLOCK = 1000
PAIRS = 4000
BYTES = 32 << 20
#: Chance that unequal minima share a register, by the width of a register's cell relative to its value.
CHANCE = 0.1699 / (1 << MANTISSA)
_U = np.uint64
#: The order in which an empty register asks others.
_ORDER = np.random.Generator(np.random.PCG64(77)).permuted(np.tile(np.arange(REGISTERS), (REGISTERS, 1)), axis=1)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk."""
    data = tb.lower(data)
    w = tb.Words(data, at)
    sums = tb.word_prefix(w.hashes(tb.byte_prefix(data)))
    if len(w.start) >= k:
        i = np.arange(len(w.start) - k + 1)
        grams = tb.word_runs(sums, i, i + k)
    whole = tb.word_runs(sums, w.first[:-1], w.first[1:])
    for d, n in enumerate(w.count):
        if n >= k:
            yield np.unique(grams[w.first[d] : w.first[d] + n - k + 1])
        else:
            yield whole[d : d + (n > 0)]


def sketch(x: np.ndarray) -> np.ndarray:
    """The registers of a sorted set of hashes."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    bucket = (x >> _U(64 - REGISTER_BITS)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(x) else np.zeros(0, int)
    y = (x[first] << _U(REGISTER_BITS)) >> _U(11)
    length = np.frexp(y.astype(np.float64))[1]
    zeros = np.minimum(53 - length, 62)
    mantissa = (y << (53 - length).astype(np.uint64)) >> _U(52 - MANTISSA) & _U((1 << MANTISSA) - 1)
    out[bucket[first]] = (zeros << MANTISSA) | mantissa.astype(np.int64)
    return out


def densify(s: np.ndarray) -> np.ndarray:
    """Sketches (rows) without empty registers; rows that are empty altogether stay so."""
    out = s.copy()
    todo = np.flatnonzero((out == EMPTY).any(1) & (out != EMPTY).any(1))
    for t in range(REGISTERS):
        if not len(todo):
            break
        part, from_ = out[todo], s[todo][:, _ORDER[:, t]]
        part = np.where(part == EMPTY, from_, part)
        out[todo] = part
        todo = todo[(part == EMPTY).any(1)]
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each densified sketch."""
    d = s[:, : BANDS * ROWS].reshape(len(s), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(tb.mix(np.arange(1, BANDS + 1, dtype=np.uint64)), d.shape[:2]).copy()
    for r in range(ROWS):
        h = tb.mix(h * _U(0x9E3779B97F4A7C15) + d[:, :, r])
    return h


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected similarity of sketches, and the number of registers it rests on."""
    n = np.maximum(1, ((a != EMPTY) | (b != EMPTY)).sum(-1))
    same = ((a == b) & (a != EMPTY)).sum(-1)
    return np.maximum(0, (same / n - CHANCE) / (1 - CHANCE)), n


def _node(x: np.ndarray) -> int:
    """A set's own hash: equal for equal sets, whatever their texts."""
    return int(tb.mix(np.array([np.add.reduce(tb.mix(x))], np.uint64)).view(np.int64)[0])


def _rows(matrix: np.ndarray) -> pa.Array:
    """A list column with one row of the matrix each."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)), pa.array(matrix.ravel()))


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, data, at in tb.chunks(batch.column(1)):
                n, h, s = [], [], []
                for x in shingle_sets(data, at, k):
                    n.append(len(x))
                    h.append(_node(x))
                    s.append(sketch(x))
                keys = band_keys(densify(np.stack(s)))
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(at) - 1), pa.array(n, pa.int64()), pa.array(h, pa.int64()), _rows(keys.view(np.int64))], names=["doc", "n", "node", "keys"])

    return run


def _sets(k: int):
    """Rows (text, node) to (node, sketch, set) where the text's set is the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(1).to_numpy()
            for i, data, at in tb.chunks(batch.column(0)):
                keep, s, sets = [], [], []
                for d, x in enumerate(shingle_sets(data, at, k)):
                    if _node(x) == nodes[i + d]:
                        keep.append(nodes[i + d])
                        s.append(sketch(x).tobytes())
                        sets.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(s, pa.binary()), pa.array(sets, pa.binary())], names=["node", "sketch", "set"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


class _Store:
    """Sketches and sets of a table (node, sketch, set), by node."""

    def __init__(self, table: pa.Table):
        self.node = table.column("node").to_numpy()
        self.row = {n: i for i, n in enumerate(self.node.tolist())}
        self.sketch = np.stack([np.frombuffer(x.as_py(), np.uint16) for x in table.column("sketch")]) if table.num_rows else np.zeros((0, REGISTERS), np.uint16)
        self._set = table.column("set")
        self.size = np.array([len(x.as_py()) // 8 for x in self._set], np.int64)

    def set(self, i: int) -> np.ndarray:
        return np.frombuffer(self._set[i].as_py(), np.uint64)


def _verify(percent: int):
    """Cogroup: pairs of a block, and the sketches and sets of their documents; gives linked pairs."""

    def run(pairs: pa.Table, docs: pa.Table) -> pa.Table:
        store = _Store(docs)
        a = np.array([store.row[x] for x in pairs.column("a").to_pylist()], np.int64)
        b = np.array([store.row[x] for x in pairs.column("b").to_pylist()], np.int64)
        j, n = estimate(store.sketch[a], store.sketch[b])
        t = percent / 100
        close = j >= t - MARGIN * np.sqrt(t * (1 - t) / n)
        hit = [k for k in np.flatnonzero(close) if _linked(store.set(a[k]), store.set(b[k]), percent)]
        return pa.table({"a": pa.array(store.node[a[hit]] if hit else [], pa.int64()), "b": pa.array(store.node[b[hit]] if hit else [], pa.int64())})

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked. Pairs are dealt into blocks by a, each block gets the sets it names once."""
    pairs = cut(pairs.distinct())
    size = sets.select("node", F.octet_length("set").cast("long").alias("w"))
    both = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node")))
    held = both.join(size, "node").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    blocks = max(1, pairs.count() // PAIRS, held // BYTES)
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)))
    named = dealt.select("block", F.col("a").alias("node")).unionAll(dealt.select("block", F.col("b").alias("node"))).distinct()
    docs = named.join(sets, "node").select(F.col("block").alias("of"), "node", "sketch", "set")
    return cut(dealt.groupBy("block").cogroup(docs.groupBy("of")).applyInArrow(_verify(percent), "a long, b long"))


def _within(percent: int):
    """Group: a whole cluster (node, doc, sketch, set); gives each node's component by its smallest id. Documents
    that already are in one component are not compared."""

    def run(table: pa.Table) -> pa.Table:
        store = _Store(table)
        n = len(store.node)
        keys, t = band_keys(densify(store.sketch)), percent / 100
        comp = np.arange(n)
        for i in range(1, n):
            # The documents before this one that share a band, most similar first.
            may = np.flatnonzero(100 * np.minimum(store.size[:i], store.size[i]) >= percent * np.maximum(store.size[:i], store.size[i]))
            may = may[(keys[may] == keys[i]).any(1)]
            if not len(may):
                continue
            j, used = estimate(store.sketch[may], store.sketch[i])
            near = j >= t - MARGIN * np.sqrt(t * (1 - t) / used)
            may = may[near][np.argsort(-j[near], kind="stable")]
            for k in may:
                if comp[k] != comp[i] and _linked(store.set(i), store.set(k), percent):
                    comp[comp == comp[i]] = comp[k]
        doc = table.column("doc").to_numpy()
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, comp, doc)
        return pa.table({"node": pa.array(store.node), "least": pa.array(least[comp])})

    return run


def _rest(percent: int):
    """Group: one block of a cluster's documents (side 0) and one of its query set (side 1); gives one link for each query and component it reaches."""

    def run(table: pa.Table) -> pa.Table:
        out: tuple[list[int], list[int]] = ([], [])
        side = table.column("side").to_numpy()
        left, right = table.filter(pa.array(side == 1)), table.filter(pa.array(side == 0))
        if left.num_rows and right.num_rows:
            q, m = _Store(left), _Store(right)
            qc, mc = left.column("comp").to_numpy(), right.column("comp").to_numpy()
            qk, mk = band_keys(densify(q.sketch)), band_keys(densify(m.sketch))
            t = percent / 100
            for i in range(len(q.node)):
                may = (mc != qc[i]) & (100 * np.minimum(m.size, q.size[i]) >= percent * np.maximum(m.size, q.size[i]))
                may = np.flatnonzero(may)
                may = may[(mk[may] == qk[i]).any(1)]
                if not len(may):
                    continue
                j, n = estimate(m.sketch[may], q.sketch[i])
                near = j >= t - MARGIN * np.sqrt(t * (1 - t) / n)
                may = may[near][np.argsort(-j[near], kind="stable")]
                reached = set()
                for k in may:
                    if mc[k] not in reached and _linked(q.set(i), m.set(k), percent):
                        reached.add(mc[k])
                        out[0].append(int(q.node[i]))
                        out[1].append(int(m.node[k]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def rest_links(members: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links across components among documents that share a bucket; None where no bucket holds several."""
    rows = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("node").alias("lead")).where("low < high").select("key", "lead")
    shared = cut(rows.join(mixed, "key").select("node", "comp", "lead").distinct())
    if shared.isEmpty():
        return None
    clusters = components(shared.select(F.col("node").alias("a"), F.col("lead").alias("b")).unionAll(shared.select("node", F.col("comp"))))
    docs = shared.select("node", "comp").distinct().join(clusters.select("node", F.col("comp").alias("cluster")), "node")
    # A block's share of documents and of bytes: whichever asks for more blocks.
    docs = docs.join(sets.select("node", (1 / F.lit(BLOCK) + F.octet_length("set") / BYTES).alias("load")), "node")
    sizes = docs.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("load").alias("load"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("n", "comp", "load")).alias("main"), F.sum("load").alias("all"))
    main = main.select("cluster", "main.comp", "all", (F.col("all") - F.col("main.load")).alias("rest")).withColumnRenamed("comp", "main")
    docs = cut(docs.drop("load").join(main, "cluster"))
    high = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n)).cast("int"))
    own = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), high(n)).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), high(n) - 1))
    every = docs.withColumn("i", own("all", 1)).withColumn("j", all_("rest")).withColumn("side", F.lit(0))
    query = docs.where("comp <> main").withColumn("j", own("rest", 2)).withColumn("i", all_("all")).withColumn("side", F.lit(1))
    cells = every.unionByName(query).select("node", "comp", "cluster", "i", "j", "side").join(sets, "node")
    return cells.groupBy("cluster", "i", "j").applyInArrow(_rest(percent), "a long, b long")


def _large(members: DataFrame, sets: DataFrame, percent: int, rounds: int) -> DataFrame:
    """(node, least) for the documents of clusters too large for one task, by star rounds and the rest."""
    found, open_ = [], members.select("key", "node")
    for r in range(rounds):
        leads = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("h"), "node"))["node"].alias("lead"))
        star = open_.join(leads, "key").where("node <> lead")
        found.append(verified(star.select(F.col("node").alias("a"), F.col("lead").alias("b")), sets, percent))
        if r + 1 < rounds:
            done = found[-1].select(F.col("a").alias("node"), F.col("b").alias("lead"))
            open_ = cut(star.join(done, ["node", "lead"], "left_anti").select("key", "node"))
    comps = components(reduce(DataFrame.unionAll, found))
    more = rest_links(members.select("key", "node"), comps, sets, percent)
    if more is not None:
        comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionAll(more))
    linked = members.select("node", "doc").distinct().join(comps, "node")
    return linked.join(linked.groupBy("comp").agg(F.min("doc").alias("least")), "comp").select("node", "least")


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 2, percent: int = 80, rounds: int = ROUNDS, whole: int = WHOLE) -> DataFrame:
    """One row for each row of docs, with these four columns: its id, n_shingles, component_id and kept."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    sketches = cut(texts.mapInArrow(_sketches(words), "doc long, n long, node long, keys array<long>"))
    real = sketches.where("n > 0 and doc is not null")
    classes = real.groupBy("node").agg(F.min("doc").alias("doc"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    bands = classes.select("node", "doc", "n", F.explode("keys").alias("key"))
    full = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).where("n > 1").select("key", "lead")
    members = cut(bands.join(full, "key"))

    # A class follows the least of its buckets' leads, of which it has at most one a band; only leads need linking.
    nodes = cut(members.groupBy("node").agg(F.first("doc").alias("doc"), F.first("n").alias("n"), F.array_sort(F.collect_set("lead")).alias("leads")))
    hubs = components(nodes.select(F.explode("leads").alias("a"), F.col("leads")[0].alias("b")).where("a <> b").distinct())
    hubs = hubs.select(F.col("node").alias("lead"), "comp")
    clusters = nodes.withColumn("lead", F.col("leads")[0]).join(hubs, "lead", "left").select("node", "doc", "n", F.coalesce("comp", "lead").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum(8 * F.col("n")).alias("bytes"))
    large = (F.col("size") > whole) | (F.col("bytes") > WHOLE_BYTES)
    wanted = cut(clusters.join(sizes.select("cluster", large.alias("large")), "cluster").select("node", "doc", "cluster", "large"))
    sets = texts.where("doc is not null").join(wanted.select("node", "doc"), "doc").select("text", "node").mapInArrow(_sets(words), "node long, sketch binary, set binary").dropDuplicates(["node"])
    large = wanted.where("large")
    if large.isEmpty():
        least = sets.join(wanted, "node").groupBy("cluster").applyInArrow(_within(percent), "node long, least long")
    else:
        sets = cut(sets)
        least = sets.join(wanted.where("not large"), "node").groupBy("cluster").applyInArrow(_within(percent), "node long, least long")
        least = least.unionAll(_large(cut(members.join(large.select("node"), "node")), sets, percent, rounds))
    # A class without links is its own component, under its smallest id.
    named = real.groupBy("node").agg(F.min("doc").alias("doc")).join(least, "node", "left").select(F.col("node").alias("of"), F.coalesce("least", "doc").alias("least"))
    out = sketches.select("doc", "n", "node").join(named, (F.col("node") == F.col("of")) & (F.col("n") > 0) & F.col("doc").isNotNull(), "left")
    component = F.coalesce("least", "doc")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 2, percent: int = 80) -> DataFrame:
    """docs without those whose group holds a smaller id; an id goes when all its rows do."""
    judged = groups(docs, id_col, text, words, percent)
    gone = judged.groupBy(id_col).agg(F.max("kept").alias("_kept")).where("not _kept").select(id_col)
    return docs.join(gone, id_col, "left_anti")


def op3_hyperminhash(spark, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
