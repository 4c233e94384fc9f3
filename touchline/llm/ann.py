"""Nearest vectors by largest inner product: probed lists with an adaptive dimension scan.

Vectors are dealt into layers by length (a factor of four each), and scaled, so
that a few long ones set nothing for the others. Inside a layer they get one more
component that makes all lengths equal, so that the largest inner product is the
smallest distance; a random rotation then spreads the information evenly over the
components. k-means on a bounded sample makes the lists of a layer, and each query
probes the lists of its nearest centroids in every layer. Inside a list,
distances grow column block by column block, and after each block a hypothesis
test on the partial distance drops the candidates that are beyond the query's
k-th best so far. The scores of what is left are inner products of the original
vectors in double precision.

Equal vectors are one candidate with its k + 1 smallest ids: no more can appear
among k neighbours. Lists are scanned in blocks of rows against blocks of
queries, so a hot list is many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.sources.store import materialize

SAMPLE = 20_000
LISTS_SHARE = 8  # lists: the square root of the rows over this
BLOCK_ROWS, BLOCK_QUERIES, CHUNK = 4096, 1024, 256
COLUMNS = 16
EPSILON = 2.1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the vectors that take part.

    Left out are null ids and vectors that are null, empty, zero, or hold a null
    or a number that is not finite. Vectors of another length than the most
    frequent one are left out too (the shorter length if two are as frequent).
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine & F.exists("embedding", lambda x: x != 0))
    lengths = good.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return good.filter(F.size("embedding") == (lengths[0].n if lengths else -1))


def power_of(embedding: str) -> Column:
    """Binary logarithm of a vector's length; nothing overflows on the way."""
    largest = F.array_max(F.transform(embedding, lambda x: F.abs(x)))
    return F.log2(largest) + F.log2(F.aggregate(embedding, F.lit(0.0), lambda s, x: s + (x / largest) * (x / largest))) / 2


class Index:
    """Centroids of one layer and the rotation of all; small enough to travel with a task."""

    def __init__(self, layer: int, rotation: np.ndarray, sample: np.ndarray, longest: float, lists: int, seed: int):
        self.layer, self.rotation, self.longest = layer, rotation, longest
        self.centroids = np.zeros((1, len(rotation)))
        if lists == 1:
            return
        rng = np.random.Generator(np.random.PCG64(seed))
        points = self.rotate(sample)
        self.centroids = points[rng.choice(len(points), min(lists, len(points)), replace=False)]
        for _ in range(8):
            near = self.nearest(points, 1)[:, 0]
            order = np.argsort(near, kind="stable")
            starts = np.searchsorted(near[order], np.arange(len(self.centroids)))
            counts = np.bincount(near, minlength=len(self.centroids))
            sums = np.add.reduceat(points[order], np.minimum(starts, len(points) - 1), axis=0)
            self.centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], self.centroids)

    def rotate(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        """Scaled and rotated vectors with the component that evens lengths (0 for queries, which get the layer's largest length)."""
        if queries:
            unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
            scaled = unit * (self.longest / np.sqrt((unit**2).sum(axis=1, keepdims=True)))
            return np.column_stack([scaled, np.zeros(len(vectors))]) @ self.rotation
        scaled = np.ldexp(vectors, -2 * self.layer)
        return np.column_stack([scaled, np.sqrt(np.maximum(self.longest**2 - (scaled**2).sum(axis=1), 0))]) @ self.rotation

    def nearest(self, points: np.ndarray, n: int) -> np.ndarray:
        far = (self.centroids**2).sum(axis=1) - 2 * points @ self.centroids.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]


def scan(points: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Rows of `points` that may be among the k nearest of each query, -1 where there are fewer."""
    size = points.shape[1]
    best = np.full((len(queries), k), np.inf)
    rows = np.full((len(queries), k), -1, np.int64)
    bounds = [(a, min(a + COLUMNS, size)) for a in range(0, size, COLUMNS)]
    for start in range(0, len(points), CHUNK):
        part = points[start : start + CHUNK]
        far = np.full((len(queries), len(part)), np.inf)
        limit = best.max(axis=1)
        a, b = bounds[0]
        first = (part[:, a:b] ** 2).sum(axis=1) + (queries[:, a:b] ** 2).sum(axis=1)[:, None] - 2 * queries[:, a:b] @ part[:, a:b].T
        q, x = np.nonzero(first <= (limit * (b / size) * (1 + EPSILON / np.sqrt(b)) ** 2)[:, None])
        seen = first[q, x]
        for a, b in bounds[1:]:
            seen = seen + ((part[x, a:b] - queries[q, a:b]) ** 2).sum(axis=1)
            bound = limit[q] * (1.0 if b == size else (b / size) * (1 + EPSILON / np.sqrt(b)) ** 2)
            stays = seen <= bound
            q, x, seen = q[stays], x[stays], seen[stays]
        far[q, x] = seen
        both = np.concatenate([best, far], axis=1)
        ids = np.concatenate([rows, np.broadcast_to(np.arange(start, start + len(part)), far.shape)], axis=1)
        top = np.argpartition(both, k - 1, axis=1)[:, :k]
        best, rows = np.take_along_axis(both, top, 1), np.take_along_axis(ids, top, 1)
        rows[np.isinf(best)] = -1
    return rows


def matrix(column, dtype=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 20, probe_share: float = 0.7, sample: int = SAMPLE, seed: int = 5
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, nearest first, ties to the smaller vec_id.

    `vectors` and `queries` have vec_id and embedding; a query's own id is no
    candidate. The number of a layer's lists grows with the square root of its rows, up
    to one per 16 of its sampled vectors; a query probes `probe_share` of them. Queries whose vectors
    take no part (see `usable`) give no rows, like an empty table. Rows repeated
    with one id and vector are one candidate.
    """
    good = materialize(usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))))
    asked = usable(queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    asked = asked.join(good.select("vec_id").distinct(), "vec_id", "left_semi")
    schema = "query_id long, rank int, vec_id long, score double"
    layered = good.withColumn("power", power_of("embedding")).withColumn("layer", F.floor(F.col("power") / 2 + 0.5).cast("int"))
    layers = layered.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.max("power").alias("power"), F.max(F.size("embedding")).alias("size")).orderBy("layer").collect()
    if not layers:
        return vectors.sparkSession.createDataFrame([], schema)
    drawn = layered.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("layer", "embedding").toArrow()
    points, of_layer = matrix(drawn["embedding"]), np.asarray(drawn["layer"])
    size = layers[0].size + 1
    rotation = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).normal(size=(size, size)))[0]
    indexes, firsts, layer_of = {}, {}, []
    for layer, n, power, _ in layers:
        inside = points[of_layer == layer]
        lists = int(max(1, min(np.ceil(np.sqrt(n) / LISTS_SHARE), len(inside) // 16)))
        indexes[layer] = Index(layer, rotation, inside, 2.0 ** (power - 2 * layer) * (1 + 1e-9), lists, seed)
        firsts[layer] = len(layer_of)
        layer_of += [layer] * len(indexes[layer].centroids)

    # equal vectors become one row with their smallest ids
    turn = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    classes = layered.drop("power").distinct().withColumn("turn", turn).filter(F.col("turn") <= k + 1).groupBy("embedding", "layer").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))

    def assign(batches):
        for batch in batches:
            batch_points, layer = matrix(batch.column("embedding")), np.asarray(batch.column("layer"))
            near = np.zeros(len(layer), np.int32)
            for at in np.unique(layer).tolist():
                index = indexes[at]
                near[layer == at] = firsts[at] + index.nearest(index.rotate(batch_points[layer == at]), 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), batch.column("embedding"), batch.column("ids")], ["list", "embedding", "ids"])

    def probe(batches):
        for batch in batches:
            asking = matrix(batch.column("embedding"))
            probes = lambda index: int(np.ceil(probe_share * len(index.centroids)))
            near = np.column_stack([firsts[at] + index.nearest(index.rotate(asking, queries=True), probes(index)) for at, index in indexes.items()])
            yield pa.RecordBatch.from_arrays([pa.array(list(near.astype(np.int32)), pa.list_(pa.int32())), *batch.columns], ["probes", *batch.schema.names])

    placed = materialize(classes.mapInArrow(assign, "list int, embedding array<double>, ids array<long>"))
    probed = materialize(asked.mapInArrow(probe, "probes array<int>, vec_id long, embedding array<double>"))
    probed = probed.select(F.explode("probes").alias("list"), F.col("vec_id").alias("query_id"), "embedding")
    blocks = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("row_blocks"))
    query_blocks = probed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    shape = materialize(blocks.join(query_blocks, "list"))
    spread = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = placed.join(shape, "list").select("list", spread(F.col("ids")[0], "row_blocks").alias("part"), every("query_blocks").alias("turn"), "embedding", "ids")
    wanted = probed.join(shape, "list").select("list", every("row_blocks").alias("part"), spread(F.col("query_id"), "query_blocks").alias("turn"), "embedding", "query_id")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])
        if not left.num_rows or not right.num_rows:
            return none
        vectors, asked = matrix(left["embedding"]), matrix(right["embedding"])
        ids, names = left["ids"].to_pylist(), right["query_id"].to_pylist()
        index = indexes[layer_of[left["list"][0].as_py()]]
        found = scan(index.rotate(vectors), index.rotate(asked, queries=True), k + 1)
        out_q, out_v, out_s = [], [], []
        for i, name in enumerate(names):
            near = found[i][found[i] >= 0]
            scores = (vectors[near] * asked[i]).sum(axis=1)
            all_pairs = sorted((-s, v) for s, x in zip(scores.tolist(), near.tolist(), strict=True) for v in ids[x] if v != name)[:k]
            out_q += [name] * len(all_pairs)
            out_v += [v for _, v in all_pairs]
            out_s += [-s for s, _ in all_pairs]
        return pa.table([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array(out_s, pa.float64())], ["query_id", "vec_id", "score"])

    key = ("list", "part", "turn")
    found = rows.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
