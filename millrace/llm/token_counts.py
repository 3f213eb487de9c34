"""Token counts by byte-pair merging over a heap and a linked list, without building identifiers.

The count of a text is its number of initial symbols minus its number of merges.
A merge can never cross a place where no vocabulary entry continues, so a text is
cut there and equal pieces are counted once per worker.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from millrace.llm.shared import slices

SPACE = "▁"

# Pieces up to this many characters are remembered, at most so many at a time; longer ones are counted anew.
REMEMBERED_LENGTH, REMEMBERED_PIECES = 48, 800_000


def merge_count(symbols: list[str], scores: dict[str, float], cost: Callable[[str], int]) -> int:
    """Tokens left after merging neighbours, best score first, leftmost first among equals.

    ``cost`` is the number of tokens of a symbol that no vocabulary entry covers.
    Each heap entry names its left symbol and the merged text; it is stale when
    either side has changed since. Time is O(n log n), memory O(n).
    """
    n = len(symbols)
    if n < 2:
        return sum(map(cost, symbols))
    text = list(symbols)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    after[-1] = -1
    heap = []
    for i in range(n - 1):
        score = scores.get(text[i] + text[i + 1])
        if score is not None:
            heap.append((-score, i, text[i] + text[i + 1]))
    heapq.heapify(heap)
    count = sum(map(cost, symbols))
    while heap:
        _, left, merged = heapq.heappop(heap)
        right = after[left] if text[left] else -1
        if right < 0 or len(text[left]) + len(text[right]) != len(merged) or text[left] + text[right] != merged:
            continue
        count -= cost(text[left]) + cost(text[right]) - 1
        text[left], text[right] = merged, ""
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left
            score = scores.get(merged + text[after[left]])
            if score is not None:
                heapq.heappush(heap, (-score, left, merged + text[after[left]]))
        if before[left] >= 0:
            score = scores.get(text[before[left]] + merged)
            if score is not None:
                heapq.heappush(heap, (-score, before[left], text[before[left]] + merged))
    return count


class PieceCounter(dict):
    """Number of tokens of a piece; remembers short pieces."""

    def __init__(self, model_file: str):
        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        self.scores = {
            model.id_to_piece(i): model.get_score(i)
            for i in ids
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        }
        self.byte_fallback = any(model.is_byte(i) for i in ids)
        self.normalize = model.normalize
        longer = [piece for piece in self.scores if len(piece) > 1]
        self.spaces_lead = all(SPACE not in piece.lstrip(SPACE) for piece in longer)
        self.newline_alone = not any("\n" in piece for piece in longer)
        # Where spaces only lead entries, a run of spaces and what follows it stand alone;
        # a character that no longer entry holds stands alone as well.
        if self.spaces_lead and self.newline_alone:
            self.pieces = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall
        elif self.spaces_lead:
            self.pieces = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        else:
            self.pieces = lambda text: [text]
        self.plain = model.normalize("a  b\tc ﬁ ") == f"{SPACE}a{SPACE}{SPACE}b\tc ﬁ{SPACE}"

    def symbol_cost(self, symbol: str) -> int:
        return 1 if symbol in self.scores or not self.byte_fallback else len(symbol.encode())

    def __missing__(self, piece: str) -> int:
        count = merge_count(list(piece), self.scores, self.symbol_cost)
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED_PIECES:
                self.clear()
            self[piece] = count
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        # The vocabulary's own normalisation; this one only marks spaces and leads with one.
        text = SPACE + text.replace(" ", SPACE) if self.plain else self.normalize(text)
        return sum(map(self.__getitem__, self.pieces(text)))


@lru_cache(maxsize=2)
def counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every row of ``docs``.

    One pass without a shuffle. A null or empty text has no byte and no token.
    Rows with equal or null keys are each kept; other columns are ignored.
    """
    texts = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = texts.select(key, F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(model_file)
        for batch in slices(batches):
            values = batch.column("text").to_pylist()
            sizes = pa.array([len(v.encode()) for v in values], pa.int64())
            counts = pa.array([tokens.count(v) for v in values], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, counts], [key, "n_bytes", "n_tokens"])

    return texts.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
