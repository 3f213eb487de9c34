"""Exact ranked lexical search over all documents, by ball trees of sparse vectors and largest inner product.

A document is a vector over the terms of the items: a saturated term frequency,
in whole numbers. An item is a vector of term weights, and a score is their inner
product. Documents are taken in blocks; each block becomes a balanced tree, whose
nodes hold a centroid and the radius around it. No document below a node scores
more than (item · centroid) + |item within the node's terms| * radius; node by
node, the best bound first, an item descends while that reaches its k-th best
score so far, which a task carries from block to block. Bounds are doubles
widened beyond any rounding; documents at leaves are scored in 64-bit integers,
so results are exact.

Only terms of the items count, so a document is read and split once per block of
items; a block is closed by the number of its terms. What tasks find is at most
k rows an item.

Defined results: a null text has no terms; documents and items without terms take
part in no result; every row is a document, or an item, of its own, also where
keys repeat; equal scores go by ascending key, null keys last; empty tables give
no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm.shared import remove, slices, stored

# Distinct terms of a block of items, unless one item has more.
BLOCK_TERMS = 1 << 17
# Documents of a tree and of a leaf; numbers that all centroids of a tree take.
TREE_ROWS, LEAF_ROWS, CENTROID_NUMBERS = 8192, 32, 1 << 23
# Bounds are widened by this share, radii by this share of the squared lengths behind them.
SLACK, RADIUS_SLACK = 1e-9, 1e-10

# Fixed values of the score: weights and frequencies in thousandths, saturation, length share of 90 in 100.
WEIGHT_UNIT, FREQUENCY_UNIT, FREQUENCY_SCALE, SATURATION, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 8, 90

# A-Z in lower case; other ASCII than letters and digits separates terms.
LETTERS = bytes(b if b >= 128 or chr(b).isdigit() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))

ROW = "key long, n long, terms array<int>, times array<long>, counted boolean"


def split_terms(text: str | None) -> list[bytes]:
    """Terms in order: runs of ASCII letters, digits and all beyond ASCII; only A-Z are lower-cased."""
    return text.encode().translate(LETTERS).split() if text else []


@dataclass
class Items:
    """A block of items: their terms as numbers, and the terms."""

    keys: list
    terms: list[np.ndarray]
    numbers: dict[bytes, int]


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[Items]:
    """All items, in blocks of about ``BLOCK_TERMS`` distinct terms."""
    block = Items([], [], {})
    for item, words in items.select(key, text).toLocalIterator():
        terms = set(split_terms(words))
        if block.numbers and len(terms | block.numbers.keys()) > BLOCK_TERMS:
            yield block
            block = Items([], [], {})
        if terms:
            block.keys.append(item)
            block.terms.append(np.array(sorted(block.numbers.setdefault(t, len(block.numbers)) for t in terms)))
    if block.keys:
        yield block


def term_counts(docs: DataFrame, numbers, key: str, text: str) -> DataFrame:
    """Per document with terms its number ``n`` of terms and how often it holds the numbered ones.

    One more row per task (``counted``) says how many documents hold each numbered term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        names = known.keys()
        holding = np.zeros(len(known), np.int64)

        def rows(keys: pa.Array, ns: list, terms: list, times: list, counted: bool) -> pa.RecordBatch:
            marks = pa.array([counted] * len(ns), pa.bool_())
            lists = pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([keys, pa.array(ns, pa.int64()), *lists, marks], ["key", "n", "terms", "times", "counted"])

        for batch in slices(batches, 500):
            kept, ns, terms, times = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = split_terms(text)
                if words:
                    held = Counter(words)
                    found = [(known[t], held[t]) for t in names & held.keys()]
                    kept.append(i)
                    ns.append(len(words))
                    terms.append(np.fromiter((t for t, _ in found), np.int32, len(found)))
                    times.append(np.fromiter((c for _, c in found), np.int64, len(found)))
            if kept:
                holding += np.bincount(np.concatenate(terms), minlength=len(known))
                yield rows(batch.column(0).take(pa.array(kept)), ns, terms, times, False)
        some = np.flatnonzero(holding)
        yield rows(pa.array([None], pa.int64()), [0], [some.astype(np.int32)], [holding[some]], True)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(run, ROW)


@dataclass
class Corpus:
    """What scores need of all documents: how many have terms, all their terms, weights of the numbered ones."""

    documents: int
    length: int
    weights: np.ndarray


def corpus(counts: DataFrame, terms: int) -> Corpus:
    documents, length = counts.where("NOT counted").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    pairs = counts.where("counted").select(F.explode(F.arrays_zip("terms", "times")).alias("x"))
    holding = dict(pairs.groupBy("x.terms").agg(F.sum("x.times")).collect())
    weights = [math.floor(WEIGHT_UNIT * math.log((2 * documents + 2) / (2 * holding.get(t, 0) + 1))) for t in range(terms)]
    return Corpus(documents, length, np.array(weights, np.int64))


class Tree:
    """A balanced ball tree over documents, rows of a sparse matrix (``starts``, ``terms``, ``values``)."""

    def __init__(self, keys: list, starts: np.ndarray, terms: np.ndarray, values: np.ndarray):
        # Only terms that occur here have a column.
        self.columns = np.unique(terms)
        columns = np.searchsorted(self.columns, terms)
        rows = np.repeat(np.arange(len(keys)), np.diff(starts))
        length = np.bincount(rows, values.astype(float) ** 2, len(keys))
        leaf = max(LEAF_ROWS, math.ceil(2 * len(keys) * len(self.columns) / CENTROID_NUMBERS))
        order = np.arange(len(keys))
        self.spans, self.children, self.radii, centroids = [], [], [], []
        self._grow(order, 0, len(keys), leaf, starts, columns, values, length, centroids)
        # One row per term: an item gathers few of them.
        self.centroids = np.array(centroids).T.copy()
        self.radii = np.array(self.radii)
        self.keys = [keys[i] for i in order]
        sizes = np.diff(starts)[order]
        self.starts = np.append(0, np.cumsum(sizes))
        take = np.repeat(starts[:-1][order] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.terms, self.values = columns[take], values[take]

    def _grow(self, order, a, b, leaf, starts, columns, values, length, centroids) -> int:
        """Adds the node over ``order[a:b]`` and those below it; sorts ``order``."""
        rows = order[a:b]
        sizes = np.diff(starts)[rows]
        first = np.append(0, np.cumsum(sizes))
        take = np.repeat(starts[:-1][rows] - first[:-1], sizes) + np.arange(first[-1])
        inside, held = columns[take], values[take]
        of = np.repeat(np.arange(len(rows)), sizes)
        centroid = np.bincount(inside, held, len(self.columns)) / len(rows)
        square = centroid @ centroid

        def distances(point: np.ndarray, its_square: float) -> np.ndarray:
            return length[rows] - 2 * np.bincount(of, held * point[inside], len(rows)) + its_square

        away = distances(centroid, square)
        node = len(self.spans)
        self.spans.append((a, b))
        self.children.append(None)
        self.radii.append(math.sqrt(max(away.max(), 0.0) + RADIUS_SLACK * (length[rows].max() + square)))
        centroids.append(centroid)
        if b - a > leaf:
            # The document furthest away, and the one furthest from that, pull the others apart.
            def dense(i: int) -> np.ndarray:
                return np.bincount(inside[first[i] : first[i + 1]], held[first[i] : first[i + 1]], len(self.columns))

            one = int(away.argmax())
            from_one = distances(dense(one), length[rows[one]])
            two = int(from_one.argmax())
            side = from_one - distances(dense(two), length[rows[two]])
            middle = (b - a) // 2
            order[a:b] = rows[np.argpartition(side, middle)]
            self.children[node] = (
                self._grow(order, a, a + middle, leaf, starts, columns, values, length, centroids),
                self._grow(order, a + middle, b, leaf, starts, columns, values, length, centroids),
            )
        return node

    def bounds(self, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For every node, a number that no document below it exceeds."""
        centroids = self.centroids[columns]
        weights = weights.astype(float)
        reach = np.sqrt((weights * weights) @ (centroids > 0))
        return (weights @ centroids + reach * self.radii) * (1 + SLACK) + 1

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Add the documents for one item to ``best``, a heap of (score, order by key) of at most ``k``; leaves visited."""
        at = np.searchsorted(self.columns, terms)
        here = at < len(self.columns)
        here[here] = self.columns[at[here]] == terms[here]
        here &= weights > 0
        if not here.any():
            return 0
        columns, weights = at[here], weights[here]
        bounds = self.bounds(columns, weights)
        item = np.zeros(len(self.columns), np.int64)
        item[columns] = weights
        visited, nodes = 0, [(-bounds[0], 0)]
        while nodes:
            bound, node = heapq.heappop(nodes)
            if -bound < (best[0][0] if len(best) >= k else 1):
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    heapq.heappush(nodes, (max(bound, -bounds[child]), child))
                continue
            visited += 1
            a, b = self.spans[node]
            s, e = self.starts[a], self.starts[b]
            sums = np.append(0, np.cumsum(item[self.terms[s:e]] * self.values[s:e]))
            scores = sums[self.starts[a + 1 : b + 1] - s] - sums[self.starts[a:b] - s]
            least = max(best[0][0] if len(best) >= k else 1, 1)
            for i in np.flatnonzero(scores >= least):
                entry = int(scores[i]), self.keys[a + i]
                if len(best) < k:
                    heapq.heappush(best, entry)
                else:
                    heapq.heappushpop(best, entry)
        return visited


# Order of keys in a heap whose least goes first: larger keys before smaller ones, null before all.
NO_KEY = -(1 << 64)


def find_best(counts: DataFrame, block, k: int) -> DataFrame:
    """``item`` (its place in the block), ``key`` and ``score``: per task the ``k`` best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, whole = block.value
        best: list[list[tuple[int, int]]] = [[] for _ in items.terms]
        weights = [whole.weights[t] for t in items.terms]
        held: list[tuple] = []

        def search() -> None:
            sizes = np.concatenate([h[1] for h in held])
            starts = np.append(0, np.cumsum(sizes))
            ns = np.repeat(np.concatenate([h[2] for h in held]), sizes)
            times = np.concatenate([h[4] for h in held])
            # What a document holds of a term counts less the longer the document is.
            saturated = SATURATION * (100 - LENGTH_SHARE + LENGTH_SHARE * ns * whole.documents // whole.length)
            values = FREQUENCY_UNIT * times // (FREQUENCY_SCALE * times + saturated)
            keys = [NO_KEY if key is None else -key for h in held for key in h[0]]
            tree = Tree(keys, starts, np.concatenate([h[3] for h in held]), values)
            for terms, weight, found in zip(items.terms, weights, best):
                tree.search(terms, weight, found, k)
            held.clear()

        for batch in slices(batches, TREE_ROWS // 4):
            lists, times = batch.column(2), batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            some = np.flatnonzero(sizes > 0)
            if len(some):
                chosen = batch.column(0).take(pa.array(some)).to_pylist()
                held.append((chosen, sizes[some], batch.column(1).to_numpy()[some], lists.flatten().to_numpy(), times.flatten().to_numpy()))
            if sum(len(h[0]) for h in held) >= TREE_ROWS:
                search()
        if held:
            search()
        rows = [(i, None if key == NO_KEY else -key, score) for i, found in enumerate(best) for score, key in found]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "key", "score"])

    return counts.where("NOT counted AND size(terms) > 0").drop("counted").mapInArrow(run, "item long, key long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per item its ``k`` best documents with a score above 0: ``item_key``, ``rank`` from 1, ``key``, ``score``.

    Keys of documents are whole numbers.
    """
    spark = docs.sparkSession
    named = StructType([StructField("item", LongType()), StructField("item_key", items.schema[item_key].dataType)])
    out = None
    for block in item_blocks(items, item_key, item_text):
        found = _block(spark, docs, block, k, key, text).join(F.broadcast(spark.createDataFrame(list(enumerate(block.keys)), named)), "item")
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], "item long, key long, score long, rank int").join(spark.createDataFrame([], named), "item")
    return out.select(F.col("item_key").alias(item_key), "rank", F.col("key").alias(key), "score")


def _block(spark: SparkSession, docs: DataFrame, items: Items, k: int, key: str, text: str) -> DataFrame:
    kept: list[str] = []
    numbers = spark.sparkContext.broadcast(items.numbers)
    counts = stored(term_counts(docs, numbers, key, text), kept)
    whole = corpus(counts, len(items.numbers))
    block = spark.sparkContext.broadcast((Items([], items.terms, {}), whole))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    ranked = find_best(counts, block, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    result = stored(ranked)
    remove(spark, kept)
    return result
