"""Nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised residuals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.llm.common import keep, smallest

#: The model is fitted on at most so many vectors, those with the smallest hashes of their ids; every vector is indexed.
SAMPLE = 16_384
#: Share of the sample's true neighbours that the lists probed must hold; sets how many lists are probed.
COVERAGE = 0.975
TOP = 20
#: Candidates of each query and shard that are ranked again by their original vectors first; then all that, by the error of
#: their codes, may be nearer than the last of these.
RERANK = 128
#: Different queries whose true neighbours among all rows are found, to set how many lists are probed.
PROBED = 128
#: Rows of a shard and queries of a block, at most about.
SHARD, BLOCK = 16_384, 8_192
#: Queries scored at a time.
TILE = 128
SEED = 7


@dataclass
class Model:
    centroids: np.ndarray  # lists x d
    codebooks: np.ndarray  # subspaces x codes x width, zero-padded
    probes: int
    sizes: np.ndarray | None = None  # rows of each list, once all are filed

    @property
    def padded(self) -> int:
        return self.codebooks.shape[0] * self.codebooks.shape[2]

    def assign(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = _pad(x - self.centroids[lists], self.padded).reshape(len(x), len(self.codebooks), -1)
        return np.stack([_nearest(r[:, m], b) for m, b in enumerate(self.codebooks)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x subspaces x codes: each code's share of the inner product."""
        return np.einsum("qmw,mkw->qmk", _pad(q, self.padded).reshape(len(q), len(self.codebooks), -1), self.codebooks, optimize=True)

    def decode(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.codebooks)], axis=1)
        return self.centroids[lists] + r[:, : self.centroids.shape[1]]

    def places(self, q: np.ndarray) -> np.ndarray:
        """queries x lists: each list's place in the order in which a query probes them."""
        return np.argsort(np.argsort(-(q @ self.centroids.T), axis=1, kind="stable"), axis=1)

    def probed(self, q: np.ndarray, top: int) -> np.ndarray:
        """queries x lists: which lists are probed, in order of the centroids' scores until they hold more than top rows, and
        so many at least as were fitted."""
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        short = (np.cumsum(self.sizes[order], axis=1) <= top).sum(axis=1) + 1
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, np.arange(order.shape[1])[None] < np.maximum(self.probes, short)[:, None], axis=1)
        return out


def _pad(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(axis=1)
    some = max(1, min(4096, (1 << 23) // max(1, len(c))))
    return np.concatenate([np.argmax(x[i : i + some] @ c.T - half, axis=1) for i in range(0, len(x), some)] or [np.zeros(0, np.int64)])


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        a = _nearest(x, c)
        n = np.bincount(a, minlength=k)
        order = np.argsort(a, kind="stable")
        sums = np.add.reduceat(np.concatenate([x[order], np.zeros((1, x.shape[1]), x.dtype)]), np.minimum(np.cumsum(n) - n, len(x)), axis=0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def fit(x: np.ndarray, rows: int, lists: int | None = None, width: int = 2, coverage: float = COVERAGE, top: int = TOP) -> Model:
    """x: the sample, float64. rows: vectors to index, whose root sets the number of lists unless that is given. Where the
    sample is too small for so many, each of the centroids it bears is moved by each of a second level's, which are
    fitted on what the first leaves, so the number of lists follows the rows at any size."""
    rng = np.random.default_rng(SEED)
    wanted = max(1, lists or max(8, round(rows**0.5 / 4)))
    lists = max(1, min(wanted, max(8, len(x) // 8), len(x)))
    centroids = _kmeans(x, lists, rng, 15)
    if wanted > lists and len(x) > lists:
        second = _kmeans(x - centroids[_nearest(x, centroids)], min(-(-wanted // lists), len(x)), rng)
        centroids = (centroids[:, None] + second[None]).reshape(-1, x.shape[1])
        lists = len(centroids)
    near = _nearest(x, centroids)
    parts = -(-x.shape[1] // width)
    r = _pad(x - centroids[near], parts * width).reshape(len(x), parts, width)[:8192]
    codebooks = np.stack([_kmeans(r[:, m], min(256, len(r)), rng, 8) for m in range(parts)])
    some = rng.choice(len(x), min(256, len(x)), replace=False)
    q = x[some]
    scores = q @ x.T
    scores[np.arange(len(q)), some] = -np.inf
    best = np.argpartition(-scores, min(top, len(x) - 1), axis=1)[:, :top]
    model = Model(centroids, codebooks, lists)
    model.probes = min(lists, _enough(np.take_along_axis(model.places(q), near[best], axis=1).ravel(), coverage))
    return model


def _enough(places: np.ndarray, coverage: float) -> int:
    """Lists to probe so that they hold this share of neighbours whose lists have these places."""
    needed = np.sort(places)
    return int(needed[min(len(needed) - 1, int(np.ceil(coverage * len(needed))))]) + 1


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest finite scores; of ties, the columns that come first."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        above = scores > least
        ties = (scores == least) & np.isfinite(scores)
        ties &= np.cumsum(ties, axis=1) <= k - above.sum(axis=1, keepdims=True)
        return np.nonzero(above | ties)
    return np.nonzero(np.isfinite(scores))


def _products(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, some: int = 1 << 15) -> np.ndarray:
    """Inner products of the rows a of q and b of x, in double precision."""
    return np.concatenate([np.einsum("nd,nd->n", q[a[i : i + some]], x[b[i : i + some]].astype(np.float64)) for i in range(0, len(a), some)] or [np.zeros(0)])


def _vectors(column: pa.ChunkedArray, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _search(model: Model, d: int, top: int, rerank: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(key, rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        rows = rows.combine_chunks().sort_by("vec_id")
        ids, lists, x = rows["vec_id"].to_numpy(), rows["list"].to_numpy(), _vectors(rows["x"], d)
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        qid, q = queries["query_id"].to_numpy(), _vectors(queries["x"], d).astype(np.float64)
        error = np.linalg.norm(x - model.decode(codes, lists), axis=1)
        largest = float(np.linalg.norm(x.astype(np.float64), axis=1).max())
        out = []
        for i in range(0, len(qid), TILE):
            qt = q[i : i + TILE]
            tables = model.tables(qt)
            near = model.probed(qt, top)[:, lists] & (ids[None, :] != qid[i : i + TILE, None])
            scores = (qt @ model.centroids.T)[:, lists]
            for m in range(codes.shape[1]):
                scores += tables[:, m, :][:, codes[:, m]]
            scores[~near] = -np.inf
            a, b = _best(scores, rerank)
            exact = _products(qt, x, a, b)
            # what may be as near as the last of the best: its score by the code is off by no more than |q| times the code's error
            least = np.array([np.partition(e, len(e) - top)[len(e) - top] if len(e) > top else -np.inf for e in np.split(exact, np.searchsorted(a, np.arange(1, len(qt))))])
            size = np.linalg.norm(qt, axis=1)[:, None]
            scores += size * (error + 1e-9 * largest)
            more = near & (scores >= least[:, None])
            more[a, b] = False
            a2, b2 = np.nonzero(more)
            a, b, exact = np.concatenate([a, a2]), np.concatenate([b, b2]), np.concatenate([exact, _products(qt, x, a2, b2)])
            order = np.lexsort((ids[b], -exact, a))
            a, b, exact = a[order], b[order], exact[order]
            first = np.searchsorted(a, np.arange(len(qt)))
            kept = np.arange(len(a)) - first[a] < top
            out.append(pa.table([pa.array(qid[i + a[kept]]), pa.array(ids[b[kept]]), pa.array(exact[kept])], schema=schema))
        return pa.concat_tables(out)

    return run


def _true_places(model: Model, x: np.ndarray, indexed: DataFrame, asked: DataFrame, d: int, top: int) -> np.ndarray:
    """Places of the lists that hold the true neighbours, among all rows, of up to PROBED different queries (asked: vec_id,
    x). x: the sample, whose neighbours say below which score none can be."""
    some = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * PROBED).toArrow()
    q, first = np.unique(_vectors(some["x"], d).astype(np.float64), axis=0, return_index=True)
    q, own = q[np.argsort(first)][:PROBED], some["vec_id"].to_numpy()[np.sort(first)][:PROBED]
    if not len(q):
        return np.zeros(1, int)
    scores = q @ x.T
    k = min(top + 1, len(x))  # the query itself may be in the sample
    least = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k] - 1e-9 * np.abs(scores).max(axis=1) if len(x) > top else np.full(len(q), -np.inf)

    def best(batches):
        held = pa.table({"i": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "list": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        for batch in batches:
            ids, lists, y = batch.column(0).to_numpy(), batch.column(2).to_numpy(), _vectors(batch.column(1), d).astype(np.float64)
            scores = q @ y.T
            a, b = np.nonzero((scores >= least[:, None]) & (ids[None] != own[:, None]))
            held = pa.concat_tables([held, pa.table({"i": a, "vec_id": ids[b], "list": lists[b], "score": scores[a, b]})]).sort_by([("i", "ascending"), ("score", "descending"), ("vec_id", "ascending")])
            i = held["i"].to_numpy()
            held = held.filter(pa.array(np.arange(len(i)) - np.searchsorted(i, i) < top))
        yield from held.combine_chunks().to_batches()

    found = indexed.select("vec_id", "x", "list").mapInArrow(best, "i long, vec_id long, list long, score double")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= top).select("i", "list").toArrow()
    if not found.num_rows:
        return np.zeros(1, int)
    return model.places(q)[found["i"].to_numpy(), found["list"].to_numpy()]


RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x (floats or doubles): rows with an id and a vector without null or non-finite components that isn't zero."""
    x = F.col(vector_col)
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.cast(f"array<{'float' if kind == 'float' else 'double'}>").alias("x"))
    x = F.col("x")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)).groupBy("vec_id").agg(F.min("x").alias("x"))


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP, rerank: int = RERANK, lists: int | None = None, coverage: float = COVERAGE, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id satisfies is_query (Column -> Column), the `top` others of
    largest inner product that the index finds, ties to the smaller id.

    The model (coarse centroids, residual codebooks and the number of lists probed) is fitted on at most `sample` vectors;
    all are indexed. Enough lists are probed to hold the share `coverage` of the true neighbours, among all rows, of some of
    the queries. A query probes further lists until they hold more than `top` rows, so it has `top` neighbours where there
    are as many. Lists are packed into shards, lists larger than a shard are cut by a hash of the id, and queries go in
    blocks to the shards that hold lists they probe; so no group grows with a hot list, and a shard that few queries probe is sent to one task only. A shard scores its rows by distance
    tables, ranks the best `rerank` by their original vectors in double precision, then all others of the lists probed whose
    codes are too coarse to rule them out, and passes on its best `top`.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id or
    with another dimension than most. Of rows that share an id the least vector counts. A single vector has no
    neighbours and gives no rows; so does an empty table. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = keep(usable(vectors, id_col, vector_col), "vectors")
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], RESULT)
    d, total = size
    rows = rows.filter(F.size("x") == d)
    some = _vectors(smallest(rows, ["vec_id"], sample, total).select("x").toArrow()["x"], d).astype(np.float64)
    model = fit(np.unique(some, axis=0), total, lists, coverage=coverage, top=top)  # copies would hide the rest
    shared = spark.sparkContext.broadcast(model)  # centroids and codebooks: their size doesn't depend on the rows

    def index(batches):
        m = shared.value
        for batch in batches:
            x = _vectors(batch.column(1), d).astype(np.float64)
            near = m.assign(x)
            codes = m.encode(x, near)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "x", "list", "code"])

    kind = dict(rows.dtypes)["x"]
    indexed = keep(rows.mapInArrow(index, f"vec_id long, x {kind}, list long, code binary"), "index")
    sizes = {r[0]: r[1] for r in indexed.groupBy("list").count().collect()}  # a row for each list
    asked = indexed.filter(is_query(F.col("vec_id"))).select("vec_id", "x")
    model.probes = min(len(model.centroids), max(model.probes, _enough(_true_places(model, some, indexed, asked, d, top), coverage)))
    model.sizes = np.array([sizes.get(k, 0) for k in range(len(model.centroids))])
    filed = spark.sparkContext.broadcast(model)
    first, pieces, shard, filled = {}, {}, 0, 0
    for k, n in sorted(sizes.items()):
        if filled and filled + n > SHARD:
            shard, filled = shard + 1, 0
        first[k], pieces[k] = shard, max(1, -(-n // SHARD))
        filled += n
        if pieces[k] > 1:
            shard, filled = shard + pieces[k], 0
    layout = spark.createDataFrame([(k, first[k], pieces[k]) for k in sizes], "list long, first long, pieces long")
    shards_of = {k: list(range(first[k], first[k] + pieces[k])) for k in sizes}
    asked = asked.withColumnRenamed("vec_id", "query_id")

    def probe(batches):
        m = filed.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists_of = m.probed(_vectors(batch.column(1), d).astype(np.float64), top)
            to = [sorted({s for k in np.flatnonzero(ks).tolist() for s in shards_of.get(k, ())}) for ks in lists_of]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(to, pa.list_(pa.int64()))], names=["query_id", "x", "shards"])

    sent = keep(asked.mapInArrow(probe, f"query_id long, x {kind}, shards array<long>").select("query_id", "x", F.explode("shards").alias("shard")), "asked")
    # a shard is copied only where more queries probe it than one task should hold
    blocks = sent.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # a row for each shard
    sent = sent.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).drop("blocks")
    held = indexed.join(F.broadcast(layout), "list").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("pieces")))
    held = held.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("vec_id", "x", "list", "code", "shard", "block")
    search = _search(model, d, top, rerank)
    found = held.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(lambda key, a, b: search(key, a, b), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
