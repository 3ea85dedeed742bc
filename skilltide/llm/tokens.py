"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers.

The symbols of a word are a linked list; a heap holds its adjacent pairs by
(rank, position). The lowest rank is popped again and again, pairs whose symbols
have changed since are skipped, and the count is initial symbols minus merges.
Symbols that no merge could take and the vocabulary lacks count their UTF-8
bytes (byte fallback).

The vocabulary file (a SentencePiece BPE model) is read with a small protobuf
reader. Pieces begin at a word's start at the earliest, so words are counted by
themselves and a count is reused where the word comes again. White space is
squeezed and a space put before the text as the model's flags say; a model with a
normalisation table, user-defined or unused pieces, or pieces that cross words is
refused.

Edge cases: null and empty texts have no tokens; texts of any length are counted
whole; special strings in a text are ordinary text; repeated rows are counted
each; other columns are not read.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Kinds of pieces in the model file (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n
        else:
            n = {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[i : i + n]
            i += n


class Model:
    """Ranks and normalisation rules of a SentencePiece BPE model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.rank: dict[str, int] = {}
        self.single: set[str] = set()
        self.unused: set[str] = set()
        self.user: list[str] = []
        self.dummy_prefix = self.squeeze = self.escape = True
        self.charsmap = b""
        self.byte_fallback = False
        order: list[tuple[float, int, str]] = []
        number = 0
        for key, value in _fields(data):
            if key == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                if kind in (NORMAL, USER_DEFINED, UNUSED):
                    order.append((-score, number, piece))
                    if len(piece) == 1:
                        self.single.add(piece)
                    if kind == USER_DEFINED:
                        self.user.append(piece)
                    if kind == UNUSED:
                        self.unused.add(piece)
                number += 1
            elif key == 2:
                for k, v in _fields(value):
                    if k == 35:
                        self.byte_fallback = bool(v)
            elif key == 3:
                for k, v in _fields(value):
                    if k == 2:
                        self.charsmap = v
                    elif k == 3:
                        self.dummy_prefix = bool(v)
                    elif k == 4:
                        self.squeeze = bool(v)
                    elif k == 5:
                        self.escape = bool(v)
        for r, (_, _, piece) in enumerate(sorted(order)):
            self.rank.setdefault(piece, r)
        self.breaks = not any("\n" in p for p in self.rank if len(p) > 1)
        # Words are independent only where no piece goes on over a space that follows other characters
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.rank)
        if self.charsmap or self.user or self.unused or self.crossing:
            raise ValueError("this model needs rules that the counter does not have")


def count_word(word: str, model: Model) -> int:
    """Tokens of one word: symbols minus merges, a lone symbol outside the vocabulary by its bytes."""
    rank, n = model.rank, len(word)
    symbols: list[str | None] = list(word)
    if n == 1:
        return 1 if word in model.single else _lone(word, model)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, word[i : i + 2]) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, merged = heapq.heappop(heap)
        if symbols[i] is None:
            continue
        j = after[i]
        if j >= n or symbols[i] + symbols[j] != merged:
            continue
        symbols[i], symbols[j] = merged, None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank.get(pair := merged + symbols[k])) is not None:
                heapq.heappush(heap, (r, i, pair))
        h = before[i]
        if h >= 0 and (r := rank.get(pair := symbols[h] + merged)) is not None:
            heapq.heappush(heap, (r, h, pair))
    return sum(1 if len(s) > 1 or s in model.single else _lone(s, model) for s in symbols if s is not None)


def _lone(symbol: str, model: Model) -> int:
    return len(symbol.encode("utf-8", "surrogatepass")) if model.byte_fallback else 1


class Counter:
    """Counts whole texts; keeps counts of words within a bound."""

    def __init__(self, model: Model, most: int = 500_000):
        self.model, self.most, self.known = model, most, {}

    def _words(self, words: list[str]) -> int:
        known = self.known
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) >= self.most:
            known.clear()
        total = 0
        for w in words:
            c = known.get(w)
            if c is None:
                c = count_word(SPACE + w, self.model)
                if len(w) <= 64:
                    known[w] = c
            total += c
        return total

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        m = self.model
        if m.breaks and "\n" in text and not m.squeeze:
            # No piece holds a line break, so it parts the text as a word's start does
            lines = text.split("\n")
            first = (" " if m.dummy_prefix else "") + lines[0]
            return sum(map(self._rest, [first, *lines[1:]])) + (len(lines) - 1) * count_word("\n", m)
        if m.squeeze:
            text = " ".join(filter(None, text.replace(SPACE, " ").split(" ")))
            return (self._words(text.split(" ")) if m.dummy_prefix else self._rest(text)) if text else 0
        return self._rest((" " if m.dummy_prefix else "") + text)

    def _rest(self, text: str) -> int:
        """Without squeezing: a run of spaces goes with the word after it."""
        if "  " not in text and SPACE not in text and text[:1] == " " and text[-1] != " ":
            return self._words(text[1:].split(" "))
        text = text.replace(" ", SPACE)
        total, start, n, known = 0, 0, len(text), self.known
        while start < n:
            end = start
            while end < n and text[end] == SPACE:
                end += 1
            end = text.find(SPACE, end)
            end = n if end < 0 else end
            word = text[start:end]
            c = known.get(("", word))
            if c is None:
                if len(known) >= self.most:
                    known.clear()
                c = count_word(word, self.model)
                if len(word) <= 64:
                    known["", word] = c
            total, start = total + c, end
        return total


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; ``vocabulary``: the model file, at the same path on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(Model(vocabulary))
        for batch in batches:
            tokens = [count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counted = docs.select(F.col(id_col).cast("long"), text, F.octet_length(text).cast("long")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
