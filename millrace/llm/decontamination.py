"""Documents that hold a benchmark item, verbatim or reworded, by latent semantic retrieval.

Documents are cut into overlapping passages, each a TF-IDF vector over the words
of the benchmark (a word counts once per passage; the others only lengthen the
vector). A random sketch of all passages, summed over the cluster, together with
the items gives the main right singular vectors; in that space passages are
compared with items by cosine and by the share of the item's squared weight that
the passage holds, which foreign words around a short item do not lower. Of an
item that stands whole in a text, one of two neighbouring passages holds half at
least. Passages whose words can reach neither are left out beforehand, which
loses none. A candidate is confirmed by the
longest common subsequence of item and text around the passage, weighed by the
rareness of the words, and by whether the item's answer is there.

The space holds every passage of the items whole: its rank is that of the sketch
and the items' passages together, so an item loses nothing by the projection.
Items are taken in blocks of so many passages, a long item in several, so that
what each task holds is bounded, however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.shared import remove, slices, stored

BLOCK_ITEMS = 512
# Passages of items in a block; with the sketch's rows they are the rank of the space.
BLOCK_PASSAGES = 384
PASSAGE, STRIDE = 32, 16
SKETCH_ROWS = 192
COSINE = 0.5
# Share of squared weight that makes a candidate too; of items under SHORT words, which few words fill, more is asked.
HELD, SHORT_HELD, SHORT = 0.35, 0.6, 8
# Weight of a word that nearly all texts hold.
LEAST_WEIGHT = 0.1
# Share of an item's weight that the common subsequence must hold, alone or with the answer found.
ALONE, WITH_ANSWER, ANSWER = 0.75, 0.5, 0.8
# Without an answer of its own, an item's answer is its last words, this share of it.
ANSWER_SHARE = 0.25
# Passages are compared in runs of so many.
RUN_PASSAGES = 1 << 14

# Letters, digits and bytes beyond ASCII belong to words.
WORD_BYTES = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def split_words(texts: pa.Array) -> pa.ListArray:
    """Lower-case words of each text; a null or empty text has none."""
    lower = pc.utf8_lower(pc.fill_null(pa.concat_arrays([texts.cast(pa.string())]), ""))
    _, offsets, data = lower.buffers()
    marked = WORD_BYTES[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    plain = pa.StringArray.from_buffers(len(lower), offsets, pa.py_buffer(marked.tobytes()))
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(plain))


def word_places(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of all words in the vocabulary (-1: not there) and where each text starts."""
    words = split_words(texts)
    flat = words.flatten()
    places = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy()
    # A text without words is split into one empty word.
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    bounds = words.offsets.to_numpy()
    if empty.any():
        bounds = bounds - np.concatenate([[0], np.cumsum(empty)])[bounds]
        places = places[~empty]
    return places.astype(np.int32), bounds.astype(np.int64)


@dataclass
class Items:
    """A block of items: their words as places in the block's vocabulary, the weights of the words, the latent space."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: pa.Array
    spans: list[tuple[int, int]]  # first and last passage (exclusive) of each item that the block compares
    weights: np.ndarray | None = None  # by place; the last one is that of any other word
    basis: np.ndarray | None = None
    queries: np.ndarray | None = None
    owners: np.ndarray | None = None
    wanted: np.ndarray | None = None  # product of query and passage that makes a candidate by the share held
    reach: np.ndarray | None = None  # by place: the most that a word adds to a passage's share of what is wanted


def item_blocks(benchmark: DataFrame, key: str, text: str, answer: str | None) -> Iterator[Items]:
    columns = [F.col(key), F.col(text)] + ([F.col(answer)] if answer else [])
    rows: list = []
    spans: list[tuple[int, int]] = []
    held = 0
    for row in benchmark.select(*columns).orderBy(key).toLocalIterator():
        at, passages = 0, passage_count(len([w for w in split_words(pa.array([row[1]], pa.string()))[0].as_py() if w]))
        while at < passages:
            # An item that fits a block is not cut.
            if rows and (held + min(passages - at, BLOCK_PASSAGES) > BLOCK_PASSAGES or len(rows) == BLOCK_ITEMS):
                yield _block(rows, spans)
                rows, spans, held = [], [], 0
            taken = min(passages - at, BLOCK_PASSAGES)
            rows.append(row)
            spans.append((at, at + taken))
            at, held = at + taken, held + taken
    if rows:
        yield _block(rows, spans)


def _block(rows: list, spans: list[tuple[int, int]]) -> Items:
    split = split_words(pa.array([r[1] for r in rows], pa.string())).to_pylist()
    words = [[w for w in ws if w] for ws in split]
    if len(rows[0]) > 2:
        answers = [[w for w in ws if w] for ws in split_words(pa.array([r[2] for r in rows], pa.string())).to_pylist()]
    else:
        answers = [ws[-max(1, round(len(ws) * ANSWER_SHARE)) :] for ws in words]
    vocabulary = sorted({w for ws in words + answers for w in ws})
    place = {w: i for i, w in enumerate(vocabulary)}

    def places(ws: list[str]) -> np.ndarray:
        return np.array([place[w] for w in ws], np.int32)

    return Items([r[0] for r in rows], [places(ws) for ws in words], [places(ws) for ws in answers], pa.array(vocabulary, pa.string()), spans)


def passage_count(words):
    """Number of passages of texts of so many words."""
    return np.where(words > 0, np.maximum(0, -(-(words - PASSAGE) // STRIDE)) + 1, 0)


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of all passages; the last one of a text may be shorter."""
    per_text = passage_count(np.diff(bounds))
    text = np.repeat(np.arange(len(per_text)), per_text)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    start = bounds[text] + number * STRIDE
    return text, start, np.minimum(start + PASSAGE, bounds[text + 1])


def passage_rows(places: np.ndarray, start: np.ndarray, end: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each passage, their weights (0: none) and the length of its vector."""
    at = start[:, None] + np.arange(PASSAGE)
    inside = at < end[:, None]
    words = np.where(inside, places[np.minimum(at, len(places) - 1)], -2)
    words.sort(axis=1)
    weight = np.where(words >= 0, weights[words], 0)
    weight[:, 1:][words[:, 1:] == words[:, :-1]] = 0
    other = (words == -1).sum(axis=1) * float(weights[-1]) ** 2
    return words, weight, np.sqrt((weight**2).sum(axis=1) + other)


def _stored_places(docs: DataFrame, items: Items, key: str, text: str, held: list[str]) -> DataFrame:
    kind = np.int16 if len(items.vocabulary) < 1 << 15 else np.int32
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    schema = rows.drop("text").withColumn("places", F.lit(b"")).schema
    vocabulary = docs.sparkSession.sparkContext.broadcast(items.vocabulary.to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.string())
        for batch in slices(batches):
            places, bounds = word_places(batch.column(2), known)
            data = [places[a:b].astype(kind).tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["key", "text_hash", "places"])

    return stored(rows.mapInArrow(run, schema), held)


def _read_places(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    data = column.to_pylist()
    places = np.frombuffer(b"".join(data), kind).astype(np.int32)
    size = np.dtype(kind).itemsize
    return places, np.concatenate([[0], np.cumsum([len(x) // size for x in data])]).astype(np.int64)


def _weigh(texts: DataFrame, items: Items, kind) -> None:
    """Weights from the number of distinct texts that hold each word: copies of a leaked item do not make its words common."""
    size = len(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(size, np.int64), 0
        for batch in slices(batches):
            places, bounds = _read_places(batch.column(0), kind)
            text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            pairs = np.unique(text[places >= 0] * size + places[places >= 0])
            seen += np.bincount(pairs % size, minlength=size)
            n += len(bounds) - 1
        word = np.flatnonzero(seen)
        # The last place counts the documents.
        yield pa.RecordBatch.from_arrays([pa.array([*word.tolist(), size], pa.int64()), pa.array([*seen[word].tolist(), n], pa.int64())], ["word", "seen"])

    counts = texts.dropDuplicates(["text_hash"]).select("places").mapInArrow(run, "word long, seen long").groupBy("word").agg(F.sum("seen")).collect()
    seen = np.zeros(size + 1)
    for word, n in counts:
        seen[word] = n
    weights = np.maximum(np.log((seen[-1] + 1) / (seen[:-1] + 0.5)), LEAST_WEIGHT)
    items.weights = np.append(weights, np.median(weights)).astype(np.float32)


def _sketch(texts: DataFrame, items: Items, kind) -> np.ndarray:
    """Every passage's unit vector, with a random sign, added to one of ``SKETCH_ROWS`` rows."""
    size = len(items.vocabulary)
    weights = texts.sparkSession.sparkContext.broadcast(items.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH_ROWS * size)
        for batch in slices(batches):
            places, bounds = _read_places(batch.column(1), kind)
            text, start, end = windows(bounds)
            # The draw depends on the text and the passage only.
            draw = batch.column(0).to_numpy().astype(np.uint64)[text] + (start - bounds[text]).astype(np.uint64)
            draw = (draw ^ (draw >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            draw ^= draw >> np.uint64(32)
            row = (draw >> np.uint64(8)) % np.uint64(SKETCH_ROWS)
            sign = np.where(draw & np.uint64(1), 1.0, -1.0)
            for a in range(0, len(text), RUN_PASSAGES):
                z = slice(a, a + RUN_PASSAGES)
                words, weight, length = passage_rows(places, start[z], end[z], weights.value)
                used = weight > 0
                cell = row[z].astype(np.int64)[:, None] * size + words
                value = weight * (sign[z] / np.maximum(length, 1e-9))[:, None]
                total += np.bincount(cell[used], weights=value[used], minlength=len(total))
        rows = total.reshape(SKETCH_ROWS, size).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SKETCH_ROWS, dtype=np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())], ["row", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for value in group.column("sums"):
            total += np.frombuffer(value.as_py(), "<f4")
        return pa.table({"row": group.column("row")[:1], "sums": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    schema = "row int, sums binary"
    partial = texts.select("text_hash", "places").mapInArrow(run, schema)
    # In two steps, so that no group holds the sums of all tasks.
    some = partial.withColumn("part", F.spark_partition_id() % 64).groupBy("part", "row").applyInArrow(lambda _, t: add(t), schema)
    whole = some.groupBy("row").applyInArrow(lambda _, t: add(t), schema).collect()
    out = np.zeros((SKETCH_ROWS, size))
    for row, sums in whole:
        out[row] = np.frombuffer(sums, "<f4")
    return out


def _fit(texts: DataFrame, items: Items, kind) -> None:
    """Latent space from the sketch and the items' own passages."""
    _weigh(texts, items, kind)
    size = len(items.vocabulary)
    places = np.concatenate(items.words)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in items.words])])
    owner, start, end = windows(bounds)
    # The last passage of a longer item is as long as the others.
    start = np.maximum(np.minimum(start, end - PASSAGE), bounds[owner])
    first, last = np.array(items.spans).T
    number = np.arange(len(owner)) - np.searchsorted(owner, owner)
    here = (number >= first[owner]) & (number < last[owner])
    owner, start, end = owner[here], start[here], end[here]
    words, weight, length = passage_rows(places, start, end, items.weights)
    queries = np.zeros((len(owner), size))
    np.add.at(queries, (np.arange(len(owner))[:, None], np.maximum(words, 0)), weight)
    # A word's share of the squared weight, over the share wanted.
    held = np.where(np.array([len(w) for w in items.words])[owner] < SHORT, SHORT_HELD, HELD)
    items.wanted = (held * length).astype(np.float32)
    items.reach = np.append((queries**2 / (held * length**2)[:, None]).max(axis=0), 0).astype(np.float32)
    queries /= length[:, None]
    sketch = _sketch(texts, items, kind)
    scale = np.linalg.norm(sketch, axis=1).max()
    _, _, right = np.linalg.svd(np.concatenate([sketch / max(scale, 1e-9), queries]), full_matrices=False)
    # All directions: the items' passages lie in the space, and their vectors keep their length.
    items.basis = np.ascontiguousarray(right.T, np.float32)
    items.queries = (queries @ items.basis).astype(np.float32)
    items.owners = owner


def common_weight(item: np.ndarray, text: np.ndarray, weights: np.ndarray) -> float:
    """Weight of the heaviest common subsequence, by rows of the usual table."""
    best = np.zeros(len(text) + 1, np.float64)
    for word in item:
        taken = best[:-1] + np.where(text == word, weights[word], 0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], taken))
    return float(best[-1])


def confirm(items: Items, item: int, text: np.ndarray) -> tuple[bool, float, bool]:
    """(contaminated, share of the item's weight found in order, answer found) for the text around a passage."""
    words, answer, weights = items.words[item], items.answers[item], items.weights
    share = common_weight(words, text, weights) / max(float(weights[words].sum()), 1e-9)
    found = bool(len(answer)) and common_weight(answer, text, weights) >= ANSWER * float(weights[answer].sum())
    return share >= ALONE or share >= WITH_ANSWER and found, share, found


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", answer: str | None = None) -> DataFrame:
    """One row per document and item that it holds: ``key``, ``text_hash``, ``item``, ``cosine``, ``common`` and ``answer_found``.

    ``common`` is the share of the item's weight found in order around the best
    confirmed passage. Null or empty texts and items match nothing; an empty
    benchmark gives no row. Documents and items that repeat are each reported,
    except rows equal in key and text, which give one.
    """
    kept = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = None
    for items in item_blocks(benchmark, item, item_text, answer):
        kind = np.int16 if len(items.vocabulary) < 1 << 15 else np.int32
        held: list[str] = []
        texts = _stored_places(kept, items, "key", "text", held)
        _fit(texts, items, kind)
        block = stored(_matches(texts, items, kind, benchmark.select(F.col(item).alias("item")).schema["item"]))
        remove(docs.sparkSession, held)
        found = block if found is None else found.unionAll(block)
    if found is None:
        none = F.lit(None).cast(benchmark.schema[item].dataType)
        found = kept.where("false").select(
            "key", F.xxhash64("text").alias("text_hash"), none.alias("item"), F.lit(0.0).alias("cosine"), F.lit(0.0).alias("common"), F.lit(False).alias("answer_found")
        )
    best = found.groupBy("key", "text_hash", "item").agg(F.max(F.struct("common", "cosine", "answer_found")).alias("b"))
    return best.select(F.col("key").alias(key), "text_hash", F.col("item").alias(item), "b.cosine", "b.common", "b.answer_found")


def _matches(texts: DataFrame, items: Items, kind, item_field) -> DataFrame:
    longest = max(map(len, items.words))
    shared = texts.sparkSession.sparkContext.broadcast(
        (items.ids, items.words, items.answers, items.weights, items.basis, items.queries, items.owners, items.wanted, items.reach)
    )
    schema = texts.drop("places").schema.add("item", item_field.dataType).add("cosine", "double").add("common", "double").add("answer_found", "boolean")

    kinds = [to_arrow_type(item_field.dataType), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words_, answers, weights, basis, queries, owners, wanted, reach = shared.value
        block = Items(ids, words_, answers, None, None, weights)
        for batch in slices(batches):
            places, bounds = _read_places(batch.column(2), kind)
            text, start, end = windows(bounds)
            rows, found = [], []
            settled: set[tuple[int, int]] = set()
            for a in range(0, len(text), RUN_PASSAGES):
                z = slice(a, a + RUN_PASSAGES)
                words, weight, length = passage_rows(places, start[z], end[z], weights)
                # No cosine can exceed the share of the vector that the vocabulary holds, no share the sum of its words' shares.
                most = np.where(weight > 0, reach[words], 0).sum(axis=1)
                able = np.flatnonzero(((weight**2).sum(axis=1) >= (COSINE * length) ** 2) | (most >= 0.999))
                able = able[length[able] > 0]
                for b in range(0, len(able), 4096):
                    some = able[b : b + 4096]
                    latent = np.zeros((len(some), basis.shape[1]), np.float32)
                    for k in range(PASSAGE):
                        used = np.flatnonzero(weight[some, k])
                        latent[used] += weight[some[used], k, None] * basis[words[some[used], k]]
                    product = latent @ queries.T
                    around = length[some].astype(np.float32)
                    for p, q in zip(*np.nonzero(product >= np.minimum(COSINE * around[:, None], wanted))):
                        passage, item = a + some[p], int(owners[q])
                        doc = int(text[passage])
                        if (doc, item) in settled:
                            continue
                        lo = max(start[passage] - longest, bounds[doc])
                        hi = min(end[passage] + longest, bounds[doc + 1])
                        sure, share, answer = confirm(block, item, places[lo:hi])
                        if sure:
                            settled.add((doc, item))
                            rows.append(doc)
                            found.append((ids[item], float(product[p, q] / around[p]), share, answer))
            if rows:
                taken = batch.select([0, 1]).take(pa.array(rows))
                data = [*taken.columns, *[pa.array([f[i] for f in found], kinds[i]) for i in range(4)]]
                yield pa.RecordBatch.from_arrays(data, schema.fieldNames())

    return texts.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, in their own columns."""
    found = stored(contaminated(docs, benchmark, key, text).select(F.col(key).alias("__key"), F.col("text_hash").alias("__hash")).distinct())
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(text) == F.col("__hash"))
    return docs.join(found, same, "left_anti")
