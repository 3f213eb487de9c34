"""Approximate nearest neighbours over learned partitions.

A bounded sample gives a graph of nearest neighbours, which is cut into equal
parts with few edges between them. A small network learns to name the part of a
vector from the vector alone; it places every row of the table, and sends each
query to the parts that are most probable for it. Within them all rows are
compared exactly, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.llm.shared import stored

# The network is fitted on at most so many vectors, drawn by a hash of their number.
SAMPLE = 4096
GRAPH_DEGREE = 10
# Nearest neighbours that visits must reach.
VISIT_DEGREE = 5
# Parts double with the table so that one holds about so many rows, within these bounds; tables of a handful have one.
PART_ROWS, LEAST_PARTS, MOST_PARTS, HANDFUL = 512, 8, 256, 128
# This share of the sample is kept from the network and decides how many parts are visited.
HELD_SHARE = 0.2
HIDDEN, EPOCHS, BATCH, RATE = 128, 40, 256, 3e-3
# Parts are visited until they hold this share of the neighbours of sample vectors that the network has not seen.
WANTED_RECALL = 0.97
# Rows and queries of one comparison.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048


@dataclass
class Router:
    """Weights of the network, and how many parts a query visits."""

    layers: list[np.ndarray]
    parts: int
    visits: int

    def probabilities(self, unit: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.ones((len(unit), 1), np.float32)
        w1, b1, w2, b2 = self.layers
        z = np.maximum(unit @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def neighbour_graph(unit: np.ndarray, degree: int) -> np.ndarray:
    """Numbers of the nearest other vectors of each, by blocks."""
    out = np.zeros((len(unit), degree), np.int64)
    for a in range(0, len(unit), 1024):
        near = unit[a : a + 1024] @ unit.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        out[a : a + 1024] = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
    return out


def _halves(rows: np.ndarray, graph: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut a set of vertices into equal halves: spectral order first, then swaps that remove cut edges."""
    place = np.full(n, -1)
    place[rows] = np.arange(len(rows))
    ends = place[graph[rows]]
    start = np.repeat(np.arange(len(rows)), graph.shape[1]).reshape(ends.shape)
    inside = ends >= 0
    i, j = np.concatenate([start[inside], ends[inside]]), np.concatenate([ends[inside], start[inside]])
    degree = np.bincount(i, minlength=len(rows)) + 1.0
    # Second eigenvector of the random walk, by power iteration with the first one removed.
    x = np.random.default_rng(len(rows)).standard_normal(len(rows))
    for _ in range(150):
        x -= (x * degree).sum() / degree.sum()
        x /= max(np.linalg.norm(x), 1e-12)
        x = 0.5 * x + 0.5 * (np.bincount(i, weights=x[j], minlength=len(rows)) + x) / degree
    side = np.zeros(len(rows), bool)
    side[np.argsort(x, kind="stable")[len(rows) // 2 :]] = True
    for _ in range(20):
        cross = side[i] != side[j]
        gain = np.bincount(i, weights=np.where(cross, 1.0, -1.0), minlength=len(rows))
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        swaps = int(np.count_nonzero(gain[left[:m]] + gain[right[:m]] > 0)) // 4
        if not swaps:
            break
        side[left[:swaps]], side[right[:swaps]] = True, False
    return rows[~side], rows[side]


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """Part of each vertex; ``parts`` is a power of two and all are equal up to one vertex per cut."""
    groups = [np.arange(len(graph))]
    while len(groups) < parts:
        groups = [half for g in groups for half in _halves(g, graph, len(graph))]
    out = np.zeros(len(graph), np.int64)
    for k, g in enumerate(groups):
        out[g] = k
    return out


def train(whole: np.ndarray, parts: int) -> Router:
    """Fit the network to the parts of each vector's neighbours and choose the number of visits on vectors kept from it."""
    rng = np.random.default_rng(7)
    kept = np.zeros(len(whole), bool)
    kept[rng.permutation(len(whole))[: max(1, int(len(whole) * HELD_SHARE))]] = True
    unit = whole[~kept]
    graph = neighbour_graph(unit, min(GRAPH_DEGREE, len(unit) - 1))
    part = balanced_parts(graph, parts)
    target = np.zeros((len(unit), parts), np.float32)
    target[np.arange(len(unit)), part] = 1
    np.add.at(target, (np.arange(len(unit))[:, None], part[graph]), 1)
    target /= target.sum(axis=1, keepdims=True)
    size = unit.shape[1]
    layers = [
        (rng.standard_normal((size, HIDDEN)) * np.sqrt(2)).astype(np.float32),
        np.zeros(HIDDEN, np.float32),
        (rng.standard_normal((HIDDEN, parts)) / np.sqrt(HIDDEN)).astype(np.float32),
        np.zeros(parts, np.float32),
    ]
    mean, square, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    router = Router(layers, parts, parts)
    for _ in range(EPOCHS):
        order = rng.permutation(len(unit))
        for a in range(0, len(unit), BATCH):
            rows = order[a : a + BATCH]
            x = unit[rows]
            h = np.maximum(x @ layers[0] + layers[1], 0)
            error = (router.probabilities(x) - target[rows]) / len(rows)
            back = (error @ layers[2].T) * (h > 0)
            step += 1
            for w, m, s, g in zip(layers, mean, square, [x.T @ back, back.sum(axis=0), h.T @ error, error.sum(axis=0)]):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    # Rows are placed by the network, so visits are counted in its own parts.
    placed = router.probabilities(whole).argmax(axis=1)
    near = neighbour_graph(whole, min(VISIT_DEGREE, len(whole) - 1))[kept]
    rank = np.argsort(np.argsort(-router.probabilities(whole[kept]), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(rank, placed[near], axis=1)
    found = np.array([(needed < v).mean() for v in range(1, parts + 1)])
    router.visits = int(np.argmax(found >= WANTED_RECALL)) + 1 if found[-1] >= WANTED_RECALL else parts
    return router


def usable(embedding: Column) -> Column:
    """Not null, without null or non-finite components, not all zero."""
    fine = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def fit(vectors: DataFrame, size: int, rows: int, key: str, embedding: str, sample: int = SAMPLE) -> Router:
    """Fit on at most about ``sample`` rows, which the driver holds meanwhile."""
    if rows < HANDFUL:
        return Router([], 1, 1)
    parts = LEAST_PARTS
    while parts < MOST_PARTS and parts * PART_ROWS * 2 <= rows * 1.5:
        parts *= 2
    share = min(1.0, sample / rows)
    drawn = vectors.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20))).select(key, embedding).limit(2 * sample)
    taken = drawn.orderBy(key).toArrow()
    # A sample that is small by chance gives fewer parts.
    while parts > LEAST_PARTS and taken.num_rows < 10 * parts:
        parts //= 2
    return train(_unit(_matrix(taken.column(1), size)), parts)


def search(table: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the ``k`` nearest rows found for each query.

    Nearness is the cosine in double precision, ties go to the smaller number.
    Vectors that are null, zero or hold a null or non-finite component take no
    part, nor do rows without a number or with another dimension than most. A
    query is never its own neighbour; equal vectors of other rows are.
    """
    valid = table.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("vector"), is_query.alias("is_query"))
    valid = valid.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = valid.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return table.sparkSession.createDataFrame([], schema)
    size, rows = sizes
    valid = valid.where(F.size("vector") == size)
    router = fit(valid, size, rows, "vec_id", "vector", sample)
    shared = table.sparkSession.sparkContext.broadcast(router)
    # Of equal vectors, those with the smallest numbers stand for all: k besides the query itself.
    order = Window.partitionBy("vector").orderBy("vec_id")
    ids = valid.select("vec_id", "vector").distinct().withColumn("number", F.row_number().over(order)).where(F.col("number") <= k + 1)
    distinct = ids.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probabilities(_unit(_matrix(batch.column(0), size)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.argmax(axis=1).astype(np.int32))], ["vector", "ids", "part"])

    placed = stored(distinct.mapInArrow(place, distinct.withColumn("part", F.lit(0)).schema))
    held = {row[0]: row[1] for row in placed.groupBy("part").count().collect()}
    least = 4 * (k + 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.array([held.get(part, 0) for part in range(router.parts)])
        for batch in batches:
            p = shared.value.probabilities(_unit(_matrix(batch.column(1), size)))
            order = np.argsort(-p, axis=1, kind="stable")
            # At least as many parts as hold rows enough.
            enough = (np.cumsum(counts[order], axis=1) < least).sum(axis=1) + 1
            visits = np.minimum(np.maximum(enough, shared.value.visits), router.parts)
            row = np.repeat(np.arange(len(order)), visits)
            part = np.concatenate([o[:v] for o, v in zip(order, visits)]) if len(order) else np.zeros(0)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(part.astype(np.int32))], ["query_id", "query", "part"])

    queries = valid.where("is_query").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")).dropDuplicates(["query_id", "query"])
    routed = stored(queries.mapInArrow(route, queries.withColumn("part", F.lit(0)).schema))
    asked = {row[0]: row[1] for row in routed.groupBy("part").count().collect()}
    # Rows and queries of a part meet in blocks of bounded size.
    blocks = F.create_map(*[F.lit(x) for part in range(router.parts) for x in (part, -(-held.get(part, 1) // BLOCK_ROWS))])
    turns = F.create_map(*[F.lit(x) for part in range(router.parts) for x in (part, -(-asked.get(part, 1) // BLOCK_QUERIES))])
    left = placed.withColumn("block", F.pmod(F.xxhash64("ids"), F.element_at(blocks, F.col("part")))).withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.element_at(turns, F.col("part")) - 1))
    )
    right = routed.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.element_at(turns, F.col("part"))).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), (F.element_at(blocks, F.col("part")) - 1).cast("long")))
    )

    def compare(_, rows: pa.Table, asked_: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if rows.num_rows and asked_.num_rows:
            vectors, numbers = _matrix(rows.column("vector"), size), rows.column("ids").to_pylist()
            wanted, own = _matrix(asked_.column("query"), size), asked_.column("query_id").to_pylist()
            lengths = np.sqrt((vectors * vectors).sum(axis=1))
            scaled = (vectors / lengths[:, None]).T
            for a in range(0, len(wanted), 256):
                some = wanted[a : a + 256]
                near = (some / np.sqrt((some * some).sum(axis=1))[:, None]) @ scaled
                # One more than asked for, as the query's own vector is among them; equal scores all count.
                kth = min(k + 1, near.shape[1])
                bar = np.partition(near, near.shape[1] - kth, axis=1)[:, near.shape[1] - kth] - 1e-9
                for q in range(len(some)):
                    at = np.flatnonzero(near[q] >= bar[q])
                    exact = (vectors[at] * some[q]).sum(axis=1) / (lengths[at] * np.sqrt((some[q] * some[q]).sum()))
                    best = sorted((-score, number) for score, i in zip(exact.tolist(), at) for number in numbers[i] if number != own[a + q])
                    found.extend((own[a + q], number, -score) for score, number in best[:k])
        columns = zip(*found) if found else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    keys = ["part", "block", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
