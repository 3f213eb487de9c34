"""Language identification by prediction by partial matching.

One byte context tree per language, grown from a bounded sample of labelled
texts and then frozen. The code length of a byte in the longest context a tree
knows is that of the usual escape scheme: a symbol seen there costs
count / (total + distinct); any other one costs an escape, distinct / (total +
distinct), and is then coded one byte shorter, where the symbols already ruled
out no longer count; bytes never seen cost an equal share of what is left. The
language with the shortest code for a text wins.

All trees share one set of contexts, so that one lookup per byte yields the code
lengths of all languages; every cost is computed beforehand, none estimated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.shared import give_back, slices

UNKNOWN = "und"
ORDER = 3

# Sample: about so many texts of each language, drawn by a hash of their key.
SAMPLE_TEXTS = 1200

# A context is kept in a tree's frozen statistics if the sample shows it so often.
LEAST_SEEN = 4

# Texts are scored in runs of about so many bytes.
RUN_BYTES = 1 << 20

COUNTS = "lang string, context long, length int, symbol int, seen long"


def _grams(data: bytes, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(context length, context as a number, symbol) of every byte of one text, each context inside it."""
    symbols = np.frombuffer(data, np.uint8)
    context = np.zeros(len(symbols), np.int64)
    for length in range(order + 1):
        if len(symbols) <= length:
            return
        if length:
            context = context[1:] | (symbols[: len(context) - 1].astype(np.int64) << (8 * (length - 1)))
        yield length, context, symbols[length:]


def context_counts(texts: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER) -> DataFrame:
    """How often each byte follows each context of up to ``order`` bytes, per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            by_lang: dict[str, list[bytes]] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(name, []).append(value.encode())
            for name, values in by_lang.items():
                grams: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
                for value in values:
                    for length, context, symbol in _grams(value, order):
                        grams[length].append(context << 8 | symbol)
                for length, found in enumerate(grams):
                    if found:
                        keys, seen = np.unique(np.concatenate(found), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([name] * len(keys), pa.string()),
                                pa.array(keys >> 8, pa.int64()),
                                pa.array(np.full(len(keys), length, np.int32)),
                                pa.array((keys & 255).astype(np.int32)),
                                pa.array(seen.astype(np.int64)),
                            ],
                            ["lang", "context", "length", "symbol", "seen"],
                        )

    counted = texts.select(F.col(lang), F.col(text)).mapInArrow(run, COUNTS)
    return counted.groupBy("lang", "context", "length", "symbol").agg(F.sum("seen").alias("seen"))


@dataclass
class Model:
    """Frozen statistics: steps through the shared contexts, and the cost in bits of each symbol in each of them."""

    languages: list[str]
    symbols: np.ndarray  # byte to symbol; 0: no tree has seen the byte
    steps: list[np.ndarray]  # per length: (context one shorter, symbol before it) to context, 0: unknown
    base: list[int]  # number of the first context of a length among all contexts
    costs: np.ndarray  # context, symbol, language

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language; an empty text takes none."""
        out = np.zeros((len(texts), len(self.languages)))
        rows: list[int] = []
        held: list[tuple[bytes, int]] = []
        size = 0
        for i, value in enumerate(texts):
            for at in range(0, max(len(value), 1), RUN_BYTES):
                # A later run of a long text starts with the bytes that its contexts need.
                rows.append(i)
                held.append((value[max(at - ORDER, 0) : at + RUN_BYTES], min(at, ORDER)))
                size += len(held[-1][0])
                if size >= RUN_BYTES:
                    self._add(out, rows, held)
                    rows, held, size = [], [], 0
        if held:
            self._add(out, rows, held)
        return out

    def _add(self, out: np.ndarray, rows: list[int], held: list[tuple[bytes, int]]) -> None:
        # A zero symbol in front of each run ends every context.
        lengths = np.array([len(value) + 1 for value, _ in held])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        symbol = self.symbols[np.frombuffer(b"".join(b"\0" + value for value, _ in held), np.uint8)]
        symbol[starts] = 0
        known = node = np.zeros(len(symbol), np.int32)
        for length, step in enumerate(self.steps, 1):
            earlier = np.zeros(len(symbol), np.int16)
            earlier[length:] = symbol[:-length]
            known = step[known, earlier]
            node = np.where(known > 0, known + self.base[length], node)
        bits = self.costs[node, symbol]
        bits[starts] = 0
        for start, (_, lead) in zip(starts, held):
            bits[start : start + 1 + lead] = 0
        np.add.at(out, rows, np.add.reduceat(bits, starts, axis=0, dtype=np.float64))


def freeze(counts: list[tuple[str, int, int, int, int]], order: int = ORDER, least: int = LEAST_SEEN) -> Model:
    """Build the shared contexts and all costs from ``context_counts`` rows."""
    languages = sorted({row[0] for row in counts})
    seen_bytes = sorted({row[3] for row in counts})
    symbols = np.zeros(256, np.int16)
    symbols[seen_bytes] = np.arange(1, len(seen_bytes) + 1)
    width = len(seen_bytes) + 1
    tables: list[dict[tuple[int, ...], np.ndarray]] = [{} for _ in range(order + 1)]
    for name, context, length, symbol, seen in counts:
        # The byte nearest to the symbol comes first.
        path = tuple(int(symbols[context >> (8 * k) & 255]) for k in range(length))
        table = tables[length].get(path)
        if table is None:
            table = tables[length][path] = np.zeros((len(languages), width))
        table[languages.index(name), symbols[symbol]] += seen
    paths = [{(): 0}]
    for length in range(1, order + 1):
        kept = sorted(p for p, t in tables[length].items() if t.sum() >= least and p[:-1] in paths[length - 1])
        paths.append({p: i for i, p in enumerate(kept, 1)})
    total = 1 + sum(len(p) for p in paths[1:])
    base = [0] + [sum(len(p) for p in paths[1:length]) for length in range(1, order + 1)]
    steps = []
    for length in range(1, order + 1):
        step = np.zeros((len(paths[length - 1]) + (length > 1), width), np.int32)
        for path, number in paths[length].items():
            step[paths[length - 1][path[:-1]], path[-1]] = number
        steps.append(step)
    costs = np.zeros((total, width, len(languages)), np.float32)
    unseen_bytes = 256 - len(seen_bytes)
    for length in range(order + 1):
        for path, number in paths[length].items():
            chain = [tables[k].get(path[:k]) for k in range(length, -1, -1)]
            for j in range(len(languages)):
                costs[base[length] + number, :, j] = _costs([t[j] for t in chain], width, unseen_bytes)
    return Model(languages, symbols, steps, base, costs)


def _costs(chain: list[np.ndarray], width: int, unseen_bytes: int) -> np.ndarray:
    """Bits of each symbol, from the longest context's counts down to the empty one's."""
    bits = np.full(width, np.nan)
    spent = 0.0
    open_ = np.ones(width, bool)
    for seen in chain:
        here = np.where(open_, seen, 0)
        distinct = np.count_nonzero(here)
        if not distinct:
            continue
        total = here.sum()
        found = here > 0
        bits[found] = spent - np.log2(here[found] / (total + distinct))
        spent -= np.log2(distinct / (total + distinct))
        open_ &= ~found
    left = np.count_nonzero(open_[1:]) + unseen_bytes
    bits[open_] = spent + np.log2(max(left, 1))
    return bits


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample: int = SAMPLE_TEXTS) -> Model:
    """Trees from about ``sample`` texts of each language that ``docs`` names; rows without text or language teach nothing.

    Only counts of byte contexts reach the driver; the sample bounds them.
    """
    known = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0))
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("draw"))
    totals = {row[0]: row[1] for row in known.groupBy("lang").count().collect()}
    chance = F.lit(0.0)
    for name, n in totals.items():
        chance = F.when(F.col("lang") == name, F.lit(min(1.0, sample / n))).otherwise(chance)
    chosen = known.where(F.pmod("draw", F.lit(1 << 20)) < chance * (1 << 20))
    return freeze([tuple(row) for row in context_counts(chosen).collect()])


VERDICT = "lang_pred string, score double, bits_per_byte double"
# Texts unpacked at once.
SLICE = 1000


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` with ``lang_pred``, ``score`` (the winner's share of 2**-bits over all languages) and ``bits_per_byte``.

    One pass without a shuffle. A text that is null or holds no letter, or any
    text when nothing was learned, is ``und`` with score 0. Ties go to the first
    language in order. Repeated rows are each answered.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # Only texts go to Python; the other columns, whole rows too, stay in the JVM.
    @F.arrow_udf(VERDICT)
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trees = shared.value
        for batch in texts:
            parts = [_verdicts(trees, batch.slice(at, SLICE)) for at in range(0, len(batch), SLICE)]
            yield pa.concat_arrays(parts) if parts else _verdicts(trees, batch)
        give_back()

    # Asked once a row, whatever is filtered by it afterwards.
    rows = docs.select(*columns, judge.asNondeterministic()(F.when(has_letter(F.col(text)), F.col(text))).alias("_verdict"))
    return rows.select(*columns, "_verdict.*")


def _verdicts(trees: Model, column: pa.Array) -> pa.StructArray:
    texts = [v.encode() if v else b"" for v in column.to_pylist()]
    names, scores, rates = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    if trees.languages and texts:
        bits = trees.code_lengths(texts)
        best = bits.argmin(axis=1)
        least = bits.min(axis=1)
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        for i, value in enumerate(texts):
            if value:
                names[i], scores[i], rates[i] = trees.languages[best[i]], share[i], least[i] / len(value)
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(rates)], ["lang_pred", "score", "bits_per_byte"])
