"""Byte-level BPE by a tree: halves are encoded and joined, ids are decoded up a tree.

Encoding is a monoid over the bytes of a piece (one match of the pre-tokenizer's pattern): a
long piece is halved down to short leaves, and two neighbours' ids are joined by encoding
anew a window around their boundary, one id wide on each side at first.

When a window is wide enough is decided, not guessed. Merging takes the pair of least rank,
leftmost first. Ids t1 .. tk are the encoding of their bytes exactly if each adjacent pair
is the encoding of its own bytes: take the first merge across a border of t; until then both of
its sides were merged as they are when the two are encoded alone, so that encoding would
have made the merge too. Pairs inside the left half, the window and the right half hold by themselves,
so only the pairs at the two rims of the window are looked at, and a side whose pair fails doubles.

Texts are cut the same way: between a character that isn't white space and white space, where
a match always ends, so that the matches of the parts are those of the whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from changefold.llm.common import slices

#: Bytes of a piece, characters of a text and ids that a leaf of a tree holds; a power of two keeps runs of one character aligned.
LEAF_BYTES, LEAF_CHARS, LEAF_IDS = 64, 1 << 14, 1 << 12
#: Entries that a memory of encoded pieces, or of pairs, holds before it starts anew.
MEMORY = 1 << 18
#: Stands for the rank of a pair that isn't merged.
NO_RANK = 1 << 62
#: Bytes a vocabulary file may have, being sent to every task.
MOST_VOCABULARY = 64 << 20


class _Pieces(dict):
    """Encoded short pieces, by their characters, as the bytes of their ids."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        ids = np.array(self.codec.encode_piece(data), dtype="<u4").tobytes()
        if len(data) <= LEAF_BYTES:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes by the ranks of a vocabulary, which has every single byte."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has every single byte")
        self.ranks, self.tokens, self.pattern = ranks, {i: t for t, i in ranks.items()}, regex.compile(pattern)
        self.ascii = _ascii_pattern(pattern)
        self.pieces, self.stable = _Pieces(self), {}

    # --- encoding ----------------------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """The ids of a few bytes, by merging the pair of least rank, leftmost first."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > 2 * LEAF_BYTES:
            return self._merge_long(data)
        rank, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        held = [rank(data[i : i + 2], NO_RANK) for i in range(len(data) - 1)]
        while held and (least := min(held)) != NO_RANK:
            at = held.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del held[at]
            if at < len(held):
                held[at] = rank(parts[at] + parts[at + 1], NO_RANK)
            if at:
                held[at - 1] = rank(parts[at - 1] + parts[at], NO_RANK)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same for many bytes: parts are linked, and their pairs wait in a heap."""
        ranks, n = self.ranks, len(data)
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place; 0 once it is merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = ends[i]
            if not j or j >= n or ends[j] != stop:  # one of the two has changed since
                continue
            ends[i], ends[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : ends[stop]])) is not None:
                    heapq.heappush(heap, (r, i, ends[stop]))
            h = before[i]
            if h >= 0 and (r := ranks.get(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return out

    def holds(self, a: int, b: int) -> bool:
        """Whether two adjacent ids are the encoding of their bytes."""
        found = self.stable.get((a, b))
        if found is None:
            if len(self.stable) >= MEMORY:
                self.stable.clear()
            found = self.stable[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes together, from those of each."""
        if not left or not right:
            return left + right
        if self.holds(left[-1], right[0]):
            return left + right
        i, j = 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(b"".join([self.tokens[t] for t in left[len(left) - i :] + right[:j]]))
            left_holds = i == len(left) or self.holds(left[-i - 1], window[0])
            right_holds = j == len(right) or self.holds(window[-1], right[j])
            if left_holds and right_holds:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if left_holds else 2 * i, j if right_holds else 2 * j

    def encode_piece(self, data: bytes) -> list[int]:
        """The ids of one piece. The left half has a power of two of leaves."""
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = LEAF_BYTES << (((len(data) - 1) // LEAF_BYTES).bit_length() - 1)
        return self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))

    def encode(self, text: str) -> bytes:
        """The ids of a text, four bytes each, least first."""
        if len(text) <= LEAF_CHARS:
            pattern = self.ascii if self.ascii and text.isascii() else self.pattern
            return b"".join(map(self.pieces.__getitem__, pattern.findall(text)))
        cut = _cut(text)
        if cut is None:
            return b"".join(self.pieces[m[0]] for m in self.pattern.finditer(text))
        return self.encode(text[:cut]) + self.encode(text[cut:])

    # --- decoding ----------------------------------------------------------------------

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids as ``encode`` gives them, concatenated up a tree."""
        n = len(ids) // 4
        if n <= LEAF_IDS:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        half = n // 2 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _ascii_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for ASCII texts, where letters and numbers are those of ASCII, in the standard library's form,
    which is three times as fast; none if other properties are named."""
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    return None if r"\p" in plain or r"\P" in plain else re.compile(plain, re.ASCII)


def _cut(text: str) -> int | None:
    """A place near the middle before white space and after something else, if there is one."""
    middle = len(text) // 2
    found = _EDGE.search(text, middle - 1) or _LAST_EDGE.search(text, 0, middle)
    return found.start() + 1 if found else None


_EDGE, _LAST_EDGE = regex.compile(r"\S\s"), regex.compile(r"(?r)\S\s")
_CODECS: dict[tuple[str, str], Codec] = {}


def read_vocabulary(path: str) -> bytes:
    """A vocabulary file: lines of a token in base 64 and its rank."""
    with open(path, "rb") as file:
        data = file.read(MOST_VOCABULARY + 1)
    if len(data) > MOST_VOCABULARY:
        raise ValueError(f"{path}: a vocabulary has at most {MOST_VOCABULARY} bytes")
    return data


def codec_of(vocabulary: bytes, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """The codec of a vocabulary; a Python worker keeps the last one it made."""
    key = (hashlib.sha256(vocabulary).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec({base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.splitlines())}, pattern)
    return _CODECS[key]


def encode_texts(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens and ids (binary, unsigned 32-bit, least byte first) of each text.

    The vocabulary at ``path`` is read by the driver and sent to the tasks, being bounded. One row
    per row; null counts as empty, which has no ids; repeated rows give equal rows; other columns
    are left out. Special tokens are ordinary text. Texts are encoded whole, so memory follows a slice of a batch and the longest text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(sent.value, pattern)
        for whole in batches:
            for batch in slices(whole, 1):
                ids = [codec.encode(text or "") for text in batch.column(1).to_pylist()]
                made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(convert, f"doc_id {kind}, n_tokens long, ids binary")


def decode_texts(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode_texts`` with ``decoded``, the bytes of their ids; null ids count
    as none. An id outside the vocabulary fails."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(sent.value)
        for whole in batches:
            for batch in slices(whole, whole.schema.get_field_index("ids")):
                data = [codec.decode(x or b"") for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], [*batch.schema.names, "decoded"])

    rows = encoded.drop("decoded")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(convert, ", ".join([*fields, "decoded binary"]))
