"""Operator 7, approximate nearest neighbours by adaptive dimension scans inside probed lists.

Vectors are scaled to length 1 (so the nearest by cosine are the nearest by distance), rotated by a random
orthogonal matrix, and dealt to the lists of a k-means index. After a random rotation, the distance over the
first t of d columns, times d/t, estimates the whole distance with an error that shrinks with t: a scan goes through
the columns block by block and drops a candidate as soon as a test says that it is farther than the
k-th best so far. What survives all columns is scored exactly on the original vectors, in double precision.

Equal vectors are one row with their k + 1 smallest ids, and equal queries are one query, so repeats neither
fill a list nor make ties among themselves. A long list is cut into blocks, and its queries too; each pair of
blocks is one task of bounded size. The index is fitted on at most SAMPLE vectors; every vector is indexed.

Recall: how many lists a query scans is learned, not set. Queries of the sample are answered exactly within the sample, and
the lists of their neighbours are ranked as the query would probe them; enough lists are probed for COVER of the
neighbours. Neighbours in the whole table are nearer than those in a sample, so this errs on the side of more lists. Clustered
vectors need few lists; vectors without clusters have no near lists and need nearly all, whatever the index. The tests
hold recall against brute force.

Defined results: vectors that are null, zero, hold nulls or non-finite numbers, or are not of the most frequent
length (ties: the longer) take no part; null ids take no part; equal pairs of id and vector are one;
fewer candidates than k give fewer rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read, ship

K = 5
SAMPLE = 20_000
#: Vectors a list holds on average, and lists at most.
LIST = 1024
LISTS = 4096
#: Share of the sample's neighbours that the probed lists must hold, and sample queries that tell.
COVER = 0.97
ASKED = 512
COLUMNS = 16
#: Width of the test in standard errors: larger drops later.
EPSILON = 3.0
#: Vectors and queries of one task.
BLOCK, QUERIES = 4096, 4096
#: Queries whose first distances are held at once.
ROWS = 256


def valid(vector: Column) -> Column:
    """Whether a vector takes part: all numbers finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, also where squares would overflow."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long rows as doubles."""
    n = len(column)
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def fit(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.Generator(np.random.PCG64(5))
    c = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
    return c


def probes(sample: np.ndarray, centres: np.ndarray, k: int = K, cover: float = COVER, asked: int = ASKED) -> int:
    """How many of the nearest lists hold `cover` of the k nearest of a sample's queries."""
    some = sample[:: max(1, len(sample) // asked)][:asked]
    if len(sample) < 2:
        return len(centres)
    close = some @ sample.T
    close[np.arange(len(some)), np.arange(0, len(sample), max(1, len(sample) // asked))[: len(some)]] = -np.inf
    k = min(k, len(sample) - 1)
    near = np.argpartition(-close, k - 1, axis=1)[:, :k]
    own = (sample @ centres.T).argmax(1)
    rank = np.argsort(np.argsort(-(some @ centres.T), axis=1, kind="stable"), axis=1)
    ranks = np.take_along_axis(rank, own[near], axis=1)
    return int(np.quantile(ranks, cover, method="higher")) + 1


def scan(q: np.ndarray, v: np.ndarray, k: int, columns: int = COLUMNS, epsilon: float = EPSILON) -> list[np.ndarray]:
    """For each rotated unit query the rows of v that no test dropped; the k nearest of the block are among them
    but for the tests' error."""
    d = v.shape[1]
    first = min(columns, d)
    part = ((q[:, :first] ** 2).sum(1)[:, None] + (v[:, :first] ** 2).sum(1)[None] - 2 * q[:, :first] @ v[:, :first].T).clip(0)
    out = []
    for i in range(len(q)):
        dist, rows = part[i], np.arange(len(v))
        if len(v) > k:
            # The k-th best of those that look nearest so far bounds the k-th best of all.
            seed = np.argpartition(dist, min(len(v) - 1, 4 * k))[: 4 * k + 1]
            bound = np.partition(((v[seed] - q[i]) ** 2).sum(1), k - 1)[k - 1]
            at = first
            while True:
                near = dist * (d / at) <= bound * (1 + epsilon / np.sqrt(at)) ** 2 + 1e-12 if at < d else dist <= bound + 1e-12
                dist, rows = dist[near], rows[near]
                if at >= d or len(rows) <= k:
                    break
                to = min(d, at + columns)
                dist = dist + ((v[rows, at:to] - q[i, at:to]) ** 2).sum(1)
                at = to
        out.append(rows)
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of row a with rows b, on the vectors as given."""
    scale_a, scale_b = np.abs(a).max(), np.abs(b).max(1)
    if max(scale_a, scale_b.max()) > 1e100 or min(scale_a, scale_b.min()) < 1e-100:
        a, b = a / scale_a, b / scale_b[:, None]
    return (b * a).sum(1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(1)))


def _assign(centres: np.ndarray, probes: int):
    """Rows (key, vector) to their nearest lists: one for a vector, `probes` for a query."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u = _unit(_matrix(batch.column(1)))
            near = np.argsort(-(u @ centres.T), axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), near.shape[1])), pa.array(near.ravel().astype(np.int32))], names=["key", "list"])

    return run


def _search(k: int, turn: np.ndarray):
    """Cogroup: a block of a list's vectors and a block of the queries that probe it; gives each query's best k + 1."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if vectors.num_rows and queries.num_rows:
            v, q = _matrix(vectors.column("vector")), _matrix(queries.column("asked"))
            key, qkey = vectors.column("key").to_numpy(), queries.column("asker").to_numpy()
            low = vectors.column("low").to_numpy()
            turned, asked = _unit(v) @ turn, _unit(q) @ turn
            found = (some for i in range(0, len(q), ROWS) for some in scan(asked[i : i + ROWS], turned, k + 1))
            for i, some in enumerate(found):
                score = cosines(q[i], v[some])
                best = np.lexsort((low[some], -score))[: k + 1]
                rows += [(qkey[i], key[some[b]], score[b]) for b in best]
        a, b, s = zip(*rows) if rows else ((), (), ())
        return pa.table({"query": pa.array(a, pa.int64()), "key": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector: str = "embedding", k: int = K, list_size: int = LIST, cover: float = COVER, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest of every row where is_query holds, the row's own id left out."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks")).where(F.col("id").isNotNull() & valid(F.col("vector")))
    rows = rows.withColumn("size", F.size("vector"))
    sizes = rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    empty = vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    if sizes is None:
        return empty
    d = sizes["size"]
    # -0.0 and 0.0 are one number; a distinct vector is known by two hashes of its numbers.
    rows = rows.where(F.col("size") == d).withColumn("vector", F.transform("vector", lambda x: x + 0.0))
    rows = rows.withColumn("key", F.xxhash64("vector")).withColumn("check", F.xxhash64(F.lit(7), "vector"))
    pairs = rows.groupBy("key", "check", "id").agg(F.max("asks").alias("asks"), F.first("vector").alias("vector"))
    first = Window.partitionBy("key", "check").orderBy("id")
    few = pairs.select("key", "check", "id", "vector").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    single = cut(few.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min("id").alias("low"), F.min_by("vector", "id").alias("vector")))
    asking = cut(pairs.where("asks").select("key", "id"))
    n = single.count()
    lists = max(1, min(LISTS, round(n / list_size)))
    sample = single.select("vector").orderBy(F.xxhash64("key", F.lit(3))).limit(SAMPLE).toPandas()["vector"]
    sample = _unit(np.stack([np.asarray(x, np.float64) for x in sample]))
    centres = fit(sample, lists)
    scanned = probes(sample, centres, k, cover)

    vec = single.select("key", "vector")
    own = vec.mapInArrow(_assign(centres, 1), "key long, list int")
    asked = vec.join(asking.select("key").distinct(), "key")
    probed = asked.mapInArrow(_assign(centres, scanned), "key long, list int")
    own, probed = cut(own), cut(probed)
    # Blocks of each list's vectors and of its queries; the table has one row a list.
    plan = own.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nv")).join(probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / queries).cast("int").alias("nq")), "list")
    dealt = own.join(plan, "list").withColumn("i", F.pmod(F.xxhash64("key"), F.col("nv")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    asks = probed.join(plan, "list").withColumn("jj", F.pmod(F.xxhash64("key"), F.col("nq")).cast("int")).withColumn("ii", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)))
    left = dealt.join(single.select("key", "vector", "low"), "key").select("list", "i", "j", "key", "vector", "low")
    right = asks.join(asked, "key").select(F.col("list").alias("of"), "ii", "jj", F.col("key").alias("asker"), F.col("vector").alias("asked"))
    found = left.groupBy("list", "i", "j").cogroup(right.groupBy("of", "ii", "jj")).applyInArrow(_search(k, rotation(d)), "query long, key long, score double")
    # The best distinct vectors of each distinct query, then ids for each row that asked.
    best = Window.partitionBy("query").orderBy(F.desc("score"), "low")
    top = found.join(single.select("key", "ids", "low"), "key").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    each = asking.select(F.col("key").alias("query"), F.col("id").alias("query_id")).join(top.select("query", "score", F.explode("ids").alias("id")), "query").where("id <> query_id")
    # Two vectors with one id count once, with the better score.
    each = each.groupBy("query", "query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "id")
    out = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def op7_adaptive_scan(spark, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
