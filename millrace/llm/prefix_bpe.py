"""Byte-level byte-pair encoding by prefix dynamic programming, and its decoding.

A text is split by a pattern; each piece is encoded by itself. Every prefix of a
piece has one encoding, so one last token, and that is all that is stored per
byte: the token t that ends at a byte is the one that may stand beside the last
token of the prefix before it. The ids follow by walking back from the end. Adding
bytes leaves the stored ones valid, and after an edit only pieces near it are
split and encoded again.

Two tokens may stand side by side when no merge across their border would have
come before the merges that closed it (``Vocabulary.beside``). All follows from
the ranks alone; equal ranks merge from the left. The ranks must be those of a
training: a token longer than a byte is what its own bytes are merged to, and its
two halves have lower ranks.

Defined results: a null text counts as empty, an empty one has no ids, strings of
special tokens are ordinary text, texts of any length are encoded whole. Rows may
repeat; other columns are not touched.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.shared import slices

# Characters behind its end that decide where a match of the pattern ends.
LOOK_AHEAD = 2
# Words, pieces and pairs of tokens a worker remembers, and characters of the longest such word.
WORDS, PIECES, PAIRS, LONGEST_WORD = 1 << 19, 1 << 18, 1 << 19, 64
NEVER = 1 << 40

# A piece begins at every space before a character that is no white space, and what is
# before it does not depend on what follows. Where all spaces are like that, plain splitting will do.
WORD_START, OTHER_SPACE = re.compile(r" (?=\S)"), re.compile(r" (?:\s|\Z)")


class Remembered(dict):
    """Results of ``make`` by string; the last ``limit`` to twice as many new ones are kept."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_WORD:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def packed(ids: list[int]) -> bytes:
    """As little-endian unsigned 32-bit integers."""
    return np.array(ids, "<u4").tobytes() if len(ids) > 64 or sys.byteorder != "little" else array("I", ids).tobytes()


class Vocabulary:
    """Ranks of byte strings, where a rank is also the token's id, and what follows from them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int]] = {}
        self._spines: tuple[dict[int, list[int]], dict[int, list[int]]] = {}, {}
        self._pairs: dict[int, bool] = {}
        self._latest: tuple[bytes, list[int]] = b"", []
        self._pieces = Remembered(self.piece, PIECES)
        self._words = Remembered(lambda word: self.run(" " + word), WORDS)

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    @cached_property
    def ends(self) -> ahocorasick.Automaton:
        """Finds the tokens that end at each byte; built when first needed, as decoding does without."""
        found = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            # One character a byte.
            found.add_word(token.decode("latin-1"), (rank, len(token)))
        found.make_automaton()
        return found

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token`` from its bytes; None if they become something else. Bytes have none."""
        if token not in self._halves:
            parts = [self.ranks[bytes([b])] for b in self.tokens[token]]
            while len(parts) > 2:
                merged = [self.ranks.get(self.tokens[a] + self.tokens[b], NEVER) for a, b in zip(parts, parts[1:])]
                least = min(merged)
                if least >= token:
                    break
                at = merged.index(least)
                parts[at : at + 2] = [least]
            if len(parts) != 2:
                return None
            self._halves[token] = parts[0], parts[1]
        return self._halves[token]

    def stands(self, token: int) -> bool:
        """Whether the encoding of a token's bytes is the token."""
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def spine(self, token: int, side: int) -> list[int]:
        """The token, and from it downwards the first (0) or last (1) part of each, to a byte."""
        spines = self._spines[side]
        if token not in spines:
            out, at = [token], token
            while len(self.tokens[at]) > 1:
                at = self.halves(at)[side]
                out.append(at)
            spines[token] = out
        return spines[token]

    def beside(self, left: int, right: int) -> bool:
        """Whether the encoding of the bytes of both is the two tokens.

        At any time the border lies between one part of ``left`` and one of
        ``right``. A part lives until its merge into the next larger one, whose
        rank is the time of that. The border falls if two parts that live at the
        same time merge before either is taken up; at the same rank the merge
        further left is made first.
        """
        key = left << 24 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self.stands(right) and self._holds(self.spine(left, 1), self.spine(right, 0))
        return known

    def _holds(self, lefts: list[int], rights: list[int]) -> bool:
        i, j = len(lefts) - 1, len(rights) - 1
        while True:
            left_until = lefts[i - 1] if i else NEVER
            right_until = rights[j - 1] if j else NEVER
            merge = self.ranks.get(self.tokens[lefts[i]] + self.tokens[rights[j]], NEVER)
            if merge < left_until and merge <= right_until and merge != NEVER:
                return False
            if not i and not j:
                return True
            if left_until <= right_until:
                i -= 1
            else:
                j -= 1

    def prefixes(self, piece: bytes, known: list[int] | tuple = ()) -> list[int]:
        """The last token of the encoding of every prefix; ``known`` holds those of the first prefixes."""
        last = list(known)
        pairs, n = self._pairs, len(last)
        start = max(0, n - self.longest)
        for end, (token, size) in self.ends.iter(piece[start:].decode("latin-1")):
            # Matches that end at a byte come one after the other; one of them fits.
            if end + start == n:
                before = n - size
                if before < 0:
                    fits = token in self._halves or self.stands(token)
                else:
                    fits = pairs.get(last[before] << 24 | token)
                    if fits is None:
                        fits = self.beside(last[before], token)
                if fits:
                    last.append(token)
                    n += 1
        return last

    def back(self, last: list[int]) -> list[int]:
        """The ids of a piece from the last tokens of its prefixes."""
        ids, at = [], len(last)
        while at:
            ids.append(last[at - 1])
            at -= len(self.tokens[last[at - 1]])
        return ids[::-1]

    def piece(self, piece: str) -> bytes:
        """Ids of a piece, in bytes."""
        raw = piece.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return packed([whole])
        # What it has in common with the piece before need not be searched again.
        before, last = self._latest
        same = 0
        for a, b in zip(raw, before):
            if a != b:
                break
            same += 1
        last = self.prefixes(raw, last[:same])
        self._latest = raw, last
        return packed(self.back(last))

    def run(self, text: str) -> bytes:
        """Ids of a text, piece by piece."""
        return b"".join(map(self._pieces.__getitem__, self.find.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text, in bytes."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of several texts; words that recur are encoded once, new ones in order, as neighbours begin alike."""
        split = [WORD_START.split(t) if OTHER_SPACE.search(t) else t.split(" ") for t in texts]
        words = self._words
        for word in sorted({w for s in split for w in s[1:] if w not in words}):
            words[word]
        return [self.run(s[0]) + b"".join(map(words.__getitem__, s[1:])) for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class PrefixText:
    """A text with the last token of each byte prefix of its pieces; it takes additions and edits."""

    def __init__(self, vocabulary: Vocabulary, text: str = "", last: list[list[int]] | None = None):
        self.vocabulary, self.text = vocabulary, text
        # Per piece its start, in characters, and its last tokens.
        spans = [m.span() for m in vocabulary.find.finditer(text)]
        self.starts = [a for a, _ in spans]
        self.last = last if last is not None else [vocabulary.prefixes(text[a:b].encode()) for a, b in spans]

    @classmethod
    def stored(cls, vocabulary: Vocabulary, text: str, last: bytes) -> PrefixText:
        """From the text and what ``table`` returned."""
        flat, out, at = np.frombuffer(last, "<u4").tolist(), [], 0
        for piece in vocabulary.find.findall(text):
            n = len(piece.encode())
            out.append(flat[at : at + n])
            at += n
        return cls(vocabulary, text, out)

    def table(self) -> bytes:
        """The last token of every byte prefix, in bytes."""
        return packed(list(chain.from_iterable(self.last)))

    def ids(self) -> bytes:
        ids = []
        for start, end, last in zip(self.starts, [*self.starts[1:], len(self.text)], self.last):
            whole = self.vocabulary.ranks.get(self.text[start:end].encode())
            ids += [whole] if whole is not None else self.vocabulary.back(last)
        return packed(ids)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, put: str) -> int:
        """Replace the characters from ``start`` to ``end`` by ``put``; the number of pieces that were encoded again."""
        text = self.text[:start] + put + self.text[end:]
        ends = [*self.starts[1:], len(self.text)]
        shift = len(text) - len(self.text)
        first = next((k for k, e in enumerate(ends) if e > start - LOOK_AHEAD), len(ends))
        at = self.starts[first] if first < len(self.starts) else (ends[-1] if self.starts else 0)
        old = {s + shift: k for k, s in enumerate(self.starts) if s >= end}
        starts, last, back = [], [], len(self.starts)
        for match in self.vocabulary.find.finditer(text, at):
            a, b = match.span()
            if a in old and a >= start + len(put):
                # From here on the pieces are those of before.
                back = old[a]
                break
            raw = text[a:b].encode()
            known: list[int] = []
            if not last and first < len(self.starts) and a == self.starts[first]:
                # Prefixes of the first piece that end before the change are as they were.
                known = self.last[first][: len(text[a : max(a, min(start, b))].encode())]
            starts.append(a)
            last.append(self.vocabulary.prefixes(raw, known))
        self.starts = self.starts[:first] + starts + [s + shift for s in self.starts[back:]]
        self.last = self.last[:first] + last + self.last[back:]
        self.text = text
        return len(starts)


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary.read(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text", tables: bool = False) -> DataFrame:
    """``keep`` and ``ids`` (little-endian unsigned 32-bit integers) of every row; with ``tables`` also the table of last tokens."""
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    schema = rows.select("row", F.lit(b"").alias("ids"), *[F.lit(b"").alias("last")] * tables).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in slices(batches, 200):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(words.encode_all(texts), pa.binary())]
            if tables:
                columns.append(pa.array([PrefixText(words, t).table() for t in texts], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return rows.mapInArrow(run, schema).select("row.*", *schema.fieldNames()[1:])


def decode(rows: DataFrame, path: str, pattern: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep``, ``ids`` and the ``decoded`` bytes of every row; null ids give no bytes."""
    packed = rows.select(F.struct(*keep).alias("row"), F.col(ids).alias("ids"))
    schema = packed.withColumn("decoded", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in slices(batches, 200):
            decoded = [words.decode(i or b"") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], schema.fieldNames())

    return packed.mapInArrow(run, schema).select("row.*", "ids", "decoded")


def edit(rows: DataFrame, path: str, pattern: str, keep: list[str], start: Column, end: Column, put: Column) -> DataFrame:
    """``keep``, the edited ``text``, its ``ids``, its table ``last`` and ``encoded_again``, the number of pieces near the edit.

    ``rows`` hold ``text`` and ``last``; characters from ``start`` to ``end``
    (within the text) give way to ``put``. A null ``put`` leaves a row as it is.
    """
    packed = rows.select(F.struct(*keep).alias("row"), "text", "last", start.cast("int").alias("start"), end.cast("int").alias("end"), put.alias("put"))
    schema = packed.select("row", "text", F.lit(b"").alias("ids"), "last", F.lit(0).cast("int").alias("encoded_again")).schema
    types = [to_arrow_type(f.dataType) for f in schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in slices(batches, 200):
            out = []
            for row in batch.select(["text", "last", "start", "end", "put"]).to_pylist():
                held = PrefixText.stored(words, row["text"] or "", row["last"] or b"")
                again = held.edit(row["start"], row["end"], row["put"]) if row["put"] is not None else 0
                out.append((held.text, held.ids(), held.table(), again))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.fieldNames())

    return packed.mapInArrow(run, schema).select("row.*", *schema.fieldNames()[1:])
