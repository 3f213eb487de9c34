"""Token ids as patched frame-of-reference blocks.

Layout of one segment (little-endian), which holds whole documents in order:

    magic "PFR1", ids (uint32), blocks (uint32)
    block starts: uint32 per block, counted from the end of this table
    per block of 128 ids: minimum (uint32), width (uint8), exceptions (uint8),
        the low ``width`` bits of every offset from the minimum, packed,
        positions of the exceptions (uint8 each), their offsets (uint32 each)

The width is that of the chosen percentile of a block's offsets; larger offsets
are exceptions. Segments are rows of a Parquet data set next to the documents'
identifiers and lengths, so writing is atomic on every store, a lost task is
simply written again, and any segment or block can be read alone.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from millrace.llm.shared import gathered, give_back, shared_folder, stored, write
from millrace.session import setting

MAGIC = b"PFR1"
BLOCK = 128
PERCENTILE = 90

# A segment is closed after the document with which it reaches so many ids.
SEGMENT_IDS = 1 << 16

# Words up to this many characters are remembered per worker, in two generations of at most so many.
REMEMBERED_LENGTH, REMEMBERED_WORDS = 32, 400_000

# Texts are encoded in runs of at most so many bytes, unless another number is asked for.
RUN_BYTES = 6 << 20

# Rows at a time between Spark and Python: texts, of which so many are encoded at once, and segments of some 100 KB each.
TEXT_ROWS, RUN_ROWS, SEGMENT_ROWS = 250, 2000, 16
READER_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
# A page's size is looked at after so many segments; after 100, as usual, it would hold a whole file's.
PAGE_ROWS = 8

SEGMENTS = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def encode_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """One segment of the format above."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return MAGIC + np.array([0, 0], "<u4").tobytes()
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n], padded[n:] = ids, ids[-1]
    rows = padded.reshape(blocks, BLOCK)
    minimum = rows.min(axis=1)
    offsets = rows - minimum[:, None]
    rank = min(BLOCK - 1, max(0, -(-BLOCK * percentile // 100) - 1))
    chosen = np.partition(offsets, rank, axis=1)[:, rank]
    widths = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.uint8)
    outside = offsets >> np.minimum(widths, 31)[:, None].astype(np.uint32) > 0
    outside[widths >= 32] = False
    packed: list[bytes] = [b""] * blocks
    for width in np.unique(widths):
        here = np.flatnonzero(widths == width)
        if width:
            bits = np.unpackbits(offsets[here].astype("<u4").view(np.uint8), axis=1, bitorder="little")
            bits = np.ascontiguousarray(bits.reshape(len(here), BLOCK, 32)[:, :, :width]).reshape(len(here), -1)
            low, size = np.packbits(bits, axis=1, bitorder="little").tobytes(), BLOCK * int(width) // 8
            for at, i in enumerate(here.tolist()):
                packed[i] = low[at * size : (at + 1) * size]
    counts = outside.sum(axis=1)
    heads = np.zeros(blocks, [("minimum", "<u4"), ("width", "u1"), ("exceptions", "u1")])
    heads["minimum"], heads["width"], heads["exceptions"] = minimum, widths, counts
    head = heads.tobytes()
    positions, values = np.nonzero(outside)[1].astype(np.uint8).tobytes(), offsets[outside].astype("<u4").tobytes()
    ends = np.cumsum(counts).tolist()
    parts = [
        head[6 * i : 6 * i + 6] + packed[i] + positions[a:b] + values[4 * a : 4 * b]
        for i, (a, b) in enumerate(zip([0, *ends], ends))
    ]
    sizes = np.array([len(part) for part in parts])
    starts = (np.cumsum(sizes) - sizes).astype("<u4")
    return MAGIC + np.array([n, blocks], "<u4").tobytes() + starts.tobytes() + b"".join(parts)


def decode_blocks(payload: bytes) -> np.ndarray:
    """The ids of a segment."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token segment")
    n, blocks = (int(x) for x in np.frombuffer(payload, "<u4", 2, 4))
    starts = np.frombuffer(payload, "<u4", blocks, 12).astype(np.int64) + 12 + 4 * blocks
    data = np.frombuffer(payload, np.uint8)
    head = data[starts[:, None] + np.arange(6)]
    minimum = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
    widths, exceptions = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    offsets = np.zeros((blocks, BLOCK), np.uint32)
    for width in np.unique(widths):
        here = np.flatnonzero(widths == width)
        if width:
            low = data[starts[here][:, None] + 6 + np.arange(BLOCK * width // 8)]
            bits = np.zeros((len(here), BLOCK, 32), np.uint8)
            bits[:, :, :width] = np.unpackbits(low, axis=1, bitorder="little").reshape(len(here), BLOCK, width)
            offsets[here] = np.packbits(bits.reshape(len(here), -1), axis=1, bitorder="little").view("<u4")
    if exceptions.any():
        # Place of every exception in its block's list, and of the list in the data.
        block = np.repeat(np.arange(blocks), exceptions)
        number = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        lists = (starts + 6 + BLOCK * widths // 8)[block]
        values = data[(lists + exceptions[block] + 4 * number)[:, None] + np.arange(4)]
        offsets[block, data[lists + number]] = np.ascontiguousarray(values).view("<u4")[:, 0]
    return (offsets + minimum[:, None]).reshape(-1)[:n]


# Byte-level vocabularies write a byte as itself where it is printable, else as the next character from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SYMBOLS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
LETTERS_AND_MARKS = re.compile("([A-Za-z\xc0-\u024f]+)([!-/:-@\\[-`{-~]*)").fullmatch


class WordEncoder(dict):
    """Ids of texts, word by word; equal words are encoded once.

    Splitting at ASCII white space changes no id where the tokenizer drops white
    space and its rules, its normalisation and its special strings never reach
    across it; tokenizers that keep white space get whole texts. A word of plain
    letters, perhaps with marks behind it, can skip normalisation and
    splitting if the tokenizer treats such words as their lower-case letters and
    the marks apart, which is tried out first.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS, run_bytes: int | None = None):
        super().__init__()
        self.remembered, self.run_bytes = remembered, run_bytes
        self.older: dict[str, bytes] = {}
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = self.encode(" a \n b\t\r\v\fc") == self.encode("a") + self.encode("b") + self.encode("c")
        self.model = self.tokenizer.model
        self.plain = self.by_word and all(
            self.encode(word + mark) == self.letters(word) + self.encode(mark)
            for word in ("Thing", "zONED", "a", "the", "Onlyre", "unbelievable", "QX", "Kelvin", "\xc9t\xe9", "stra\xdfe", "\u0141\xf3d\u017a")
            for mark in ("", ".", ",", "!!", ")|", "'")
        )

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def letters(self, word: str) -> list[int]:
        symbols = word.lower()
        if not word.isascii():
            symbols = symbols.encode().decode("latin-1").translate(BYTE_SYMBOLS)
        return [token.id for token in self.model.tokenize(symbols)]

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode_word(word)
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= self.remembered:
                # Words in use move on from the older generation, the others go with it.
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode_word(self, word: str) -> bytes:
        if self.plain:
            if word.isascii() and word.isalpha():
                return array("I", [token.id for token in self.model.tokenize(word.lower())]).tobytes()
            split = LETTERS_AND_MARKS(word)
            # Beyond Latin letters in composed form, the tokenizer's own normalisation decides.
            if split and split[1].isalpha() and len(split[1].lower()) == len(split[1]):
                return self[split[1]] + self[split[2]] if split[2] else array("I", self.letters(word)).tobytes()
        return array("I", self.encode(word)).tobytes()

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_word:
            return [array("I", self.encode(text)).tobytes() for text in texts.to_pylist()]
        sizes, most = pc.binary_length(texts).to_numpy(zero_copy_only=False), self.run_bytes or RUN_BYTES
        out, at, held = [], 0, 0
        for i, size in enumerate(sizes):
            if size > most:
                out += self._run(texts[at:i])
                out.append(b"".join(b"".join(self._run(pa.array([part]))) for part in _cut(texts[i].as_py(), most)))
                at, held = i + 1, 0
            elif held + size > most:
                out += self._run(texts[at:i])
                at, held = i, size
            else:
                held += size
        return out + self._run(texts[at:])

    def _run(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        codes = words.indices.to_numpy()
        found = list(map(self.__getitem__, words.dictionary.to_pylist()))
        flat = np.frombuffer(b"".join(found), "<u4")
        # A run is small enough for 32-bit places, unless one text fills it.
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        per_word = sizes[codes]
        ends = np.cumsum(per_word)
        kind = np.int32 if ends[-1] < 1 << 31 and len(flat) < 1 << 31 else np.int64
        shift = ((np.cumsum(sizes) - sizes)[codes] - (ends - per_word)).astype(kind)
        ids = flat[np.repeat(shift, per_word) + np.arange(ends[-1], dtype=kind)]
        at = np.concatenate([[0], ends])[bounds]
        return [ids[i:j].tobytes() for i, j in zip(at, at[1:])]


def _cut(text: str, size: int) -> Iterator[str]:
    """Pieces of a very long text, cut at blanks."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            end = text.rfind(" ", at, end) + 1 or text.find(" ", end) + 1 or len(text)
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int = REMEMBERED_WORDS, run_bytes: int | None = None) -> WordEncoder:
    return WordEncoder(path, remembered, run_bytes)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = None,
    key: str = "doc_id",
    text: str = "text",
    remembered: int = REMEMBERED_WORDS,
    forget: bool = False,
    run_bytes: int | None = None,
) -> None:
    """Write the ids of all texts to ``path`` in ascending key order.

    Rows are dealt out by ranges of the key, so shards follow the key order and
    no task holds more than a range; equal keys are ordered by a hash of the text and each
    kept, a null key comes first, a null text counts as empty. Memory per task:
    one segment, the longest document, some ten times ``run_bytes``, and twice
    ``remembered`` words per worker (some 200 bytes each). With ``forget`` a worker gives words and tokenizer up
    at the end of each task, for the steps that follow it.
    """
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    texts = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = texts.repartitionByRange("key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, remembered, run_bytes)
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [shard, segment, first, len(ids), keys, [len(p) // 4 for p in parts], encode_blocks(ids)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], SEGMENTS.fieldNames())

        for batch in gathered(batches, RUN_ROWS, run_bytes or RUN_BYTES):
            for k, ids in zip(batch.column(0).to_pylist(), encode.ids(batch.column(1))):
                parts.append(ids + end)
                keys.append(k)
                held += len(parts[-1]) // 4
                if held >= SEGMENT_IDS or len(keys) >= SEGMENT_IDS:
                    yield closed()
                    segment, first, held, keys, parts = segment + 1, first + held, 0, [], []
        if keys:
            yield closed()
        if forget:
            del encode
            encoder.cache_clear()
            give_back()

    write(ordered.mapInArrow(run, SEGMENTS), path, rows=TEXT_ROWS, page_rows=PAGE_ROWS)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """One row per document, from the files: ``key``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``.

    ``start`` is the number of ids in front of the document over the whole data
    set. Only one row per shard, its number of ids, is added up in one place.
    Segments go to Python as many at a time as the session's batches have rows.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    schema = f"`{key}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    columns = [key, "start", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Workers that wrote the files remember words for nothing now.
        encoder.cache_clear()
        give_back()
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                raw = decode_blocks(row["payload"]).astype("<u4").tobytes()
                if len(raw) != 4 * bounds[-1]:
                    raise ValueError("a segment holds other ids than its index says")
                pieces = [raw[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:])]
                data = [
                    pa.array(row["keys"], pa.int64()),
                    pa.array(bounds[:-1] + row["first_id"] + row["shard_start"], pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                ]
                if ids:
                    data.append(pa.array([np.frombuffer(p, "<u4").astype(np.int64) for p in pieces], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(data, columns)

    return segments.join(F.broadcast(starts), "shard").mapInArrow(run, schema)


def encode_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None,
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    remembered: int = REMEMBERED_WORDS,
    forget: bool = False,
    run_bytes: int | None = None,
) -> DataFrame:
    """Write the token files (to a new shared folder unless ``path`` is given) and index them from what was written.

    The index is stored, so that segments are read a few at a time whatever the session's batches.
    """
    spark = docs.sparkSession
    path = path or shared_folder(spark)
    write_tokens(docs, path, tokenizer, end_id, key, text, remembered, forget, run_bytes)
    with setting(spark, READER_ROWS, str(SEGMENT_ROWS)):
        return stored(read_tokens(spark, path, key), rows=SEGMENT_ROWS)
