"""Quality scores from compression against dictionaries of good and of bad text.

Text that resembles the good examples shrinks more with their dictionary than
with that of the bad ones. A text is compressed in pieces, so that a long one
cannot become its own dictionary; several pairs of dictionaries, from separate
examples, are averaged, so that one memorised passage does not decide. The
difference of the two sizes, per compressed and per raw byte, next to the
better of the two rates, is calibrated to a probability on examples that no
dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from millrace.llm.shared import slices

# Sample: about so many labelled rows of each class, drawn by a hash of their key.
SAMPLE_ROWS = 4000
PAIRS = 3
DICTIONARY_BYTES = 64 << 10
PIECE_BYTES = 512
EXAMPLE_BYTES = 2048
LEVEL = 3


def pieces(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


@dataclass
class Model:
    """Dictionaries as (good, bad) and the weights of the calibration; without dictionaries, the same score for all."""

    dictionaries: list[tuple[bytes, bytes]]
    weights: np.ndarray

    def compressors(self) -> list[tuple]:
        def one(raw: bytes):
            return zstandard.ZstdCompressor(
                level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=False, write_dict_id=False
            ).compress

        return [(one(good), one(bad)) for good, bad in self.dictionaries]

    def score(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.weights[1:] + self.weights[0] if self.dictionaries else np.full(len(features), self.weights[0])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(compressors: list[tuple], texts: list[bytes]) -> np.ndarray:
    """Size difference per compressed byte and per raw byte, and the better rate; an empty text differs in nothing."""
    out = np.zeros((len(texts), 3))
    for i, data in enumerate(texts):
        if not data:
            out[i, 2] = 1
            continue
        parts = pieces(data, PIECE_BYTES)
        sizes = [(sum(len(good(p)) for p in parts), sum(len(bad(p)) for p in parts)) for good, bad in compressors]
        out[i, 0] = np.mean([(b - g) / max(g, b) for g, b in sizes])
        out[i, 1] = np.mean([b - g for g, b in sizes]) / len(data)
        out[i, 2] = np.mean([min(g, b) for g, b in sizes]) / len(data)
    return out


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights of a logistic model, constant first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    weights = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -40, 40)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (p - y) + penalty @ weights)
        weights -= step
        if np.abs(step).max() < 1e-9:
            break
    return weights


def dictionary(examples: list[bytes]) -> bytes:
    """A trained dictionary; too few examples for training serve as they are."""
    samples = [p for e in examples for p in pieces(e, EXAMPLE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE_ROWS) -> Model:
    """Fit on at most about ``sample`` labelled texts per class, which the driver holds while fitting.

    Rows without label or text teach nothing; of contradicting labels the lower
    one counts. With one class only, every score is the smoothed share of label 1.
    """
    marked = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("_label"))
    totals = {row[0]: row[1] for row in marked.groupBy("_label").count().collect()}
    good, bad = totals.get(1, 0), totals.get(0, 0)
    prior = np.log((good + 1) / (bad + 1))
    if not good or not bad:
        return Model([], np.array([prior]))
    chance = F.when(F.col("_label") == 1, F.lit(min(1.0, sample / good))).otherwise(F.lit(min(1.0, sample / bad)))
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 20))
    drawn = marked.where((draw < chance * (1 << 20)) & F.col("_label").isin(0, 1)).select(key, "_label")
    # About two times ``sample`` narrow rows: the texts need not move.
    found = docs.select(key, text).where(F.length(text) > 0).join(F.broadcast(drawn), key)
    rows = found.select(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(2 * PAIRS)).alias("part"), "_label", text).limit(3 * sample).collect()
    examples = sorted((int(part), int(mark), value.encode()) for part, mark, value in rows)
    used = [[e for part, mark, e in examples if mark == m and part < PAIRS] for m in (0, 1)]
    if min(map(len, used)) < PAIRS or len({mark for part, mark, _ in examples if part >= PAIRS}) < 2:
        # Too few to keep any apart.
        used = [[e for _, mark, e in examples if mark == m] for m in (0, 1)]
        if not all(used):
            return Model([], np.array([prior]))
        rest = examples
    else:
        rest = [x for x in examples if x[0] >= PAIRS]
    pairs = []
    for k in range(PAIRS):
        bads, goods = (u[k::PAIRS] or u for u in used)
        pairs.append((dictionary(goods), dictionary(bads)))
    model = Model(pairs, np.zeros(4))
    x = features(model.compressors(), [e for _, _, e in rest])
    y = np.array([mark for _, mark, _ in rest], float)
    model.weights = calibrate(x, y)
    # Classes were drawn at different rates: move the constant to the true odds.
    model.weights[0] += prior - np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    return model


def classify(docs: DataFrame, model: Model, columns: list[str], text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``columns`` with ``score`` and ``predicted`` (1 from ``threshold`` on).

    One pass without a shuffle, over whole texts; a null text counts as empty
    and is scored too, repeated rows each.
    """
    rows = docs.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = rows.drop("_text").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = shared.value.compressors()
        for batch in slices(batches):
            texts = [v.encode() for v in batch.column(batch.num_columns - 1).to_pylist()]
            score = shared.value.score(features(compressors, texts))
            data = [*batch.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(data, schema.fieldNames())

    return rows.mapInArrow(run, schema)
