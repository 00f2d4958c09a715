"""Fill-in-middle: texts cut in three by select on a set of unit boundaries.

The boundaries of a text's units are kept as a Roaring-style set of byte offsets: one
container per 65,536 bytes, as a sorted array, a bitmap or runs, whichever is least, and
cumulative cardinalities over the containers. The offset of the k-th boundary is found by a
search over those and a select inside one container, so cuts by code point, word or line
are cuts of bytes, and a text is never made into a list of its units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefold.llm.common import slices

#: Bytes that a container covers, its words as a bitmap, and the most values of an array.
SPAN, BITMAP_WORDS, ARRAY_MOST = 1 << 16, 1 << 10, 1 << 12
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


class ArrayContainer:
    """Few values: a sorted array."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])


class RunContainer:
    """Values in runs: first values, and how many values come before each run."""

    def __init__(self, firsts: np.ndarray, lengths: np.ndarray):
        self.firsts = firsts.astype(np.uint16)
        self.before = (np.cumsum(lengths) - lengths).astype(np.int64)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.firsts[run]) + k - int(self.before[run])


class BitmapContainer:
    """Many values without runs: 1,024 words of 64 bits, and the bits before each word."""

    def __init__(self, mask: np.ndarray):
        bits = np.zeros(SPAN, dtype=bool)
        bits[: len(mask)] = mask
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        bits = _BITS[self.words[word : word + 1].view(np.uint8)].ravel()
        return word * 64 + int(np.flatnonzero(bits)[k - int(self.before[word])])


def container(mask: np.ndarray):
    """(container, cardinality) of up to SPAN bytes, in the form that takes the least space."""
    edges = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    firsts = edges[mask[edges]] if not mask[0] else np.concatenate([[0], edges[mask[edges]]])
    n = int(np.count_nonzero(mask))
    if 4 * len(firsts) <= min(2 * n, 8 * BITMAP_WORDS):
        ends = edges[~mask[edges]]
        ends = ends if len(ends) == len(firsts) else np.concatenate([ends, [len(mask)]])
        return RunContainer(firsts, ends - firsts), n
    return (ArrayContainer(np.flatnonzero(mask)) if n <= ARRAY_MOST else BitmapContainer(mask)), n


class BoundarySet:
    """Where the units of a text begin, as byte offsets, and where the text ends."""

    def __init__(self, data: np.ndarray, unit: str = "char"):
        starts = STARTS[unit]
        self.end, self.keys, self.containers, counts = len(data), [], [], []
        for at in range(0, len(data), SPAN):
            mask = starts(data, at, min(at + SPAN, len(data)))
            if mask.any():
                made, n = container(mask)
                self.keys.append(at)
                self.containers.append(made)
                counts.append(n)
        self.upto = np.cumsum(counts, dtype=np.int64)

    def __len__(self) -> int:
        """How many units the text has."""
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, k: int) -> int:
        """The byte offset before unit k, counting from 0; past the last unit, the end."""
        if k >= len(self):
            return self.end
        i = int(np.searchsorted(self.upto, k, side="right"))
        return self.keys[i] + self.containers[i].select(k - (int(self.upto[i - 1]) if i else 0))


def _char_starts(data: np.ndarray, a: int, b: int) -> np.ndarray:
    return (data[a:b] & 0xC0) != 0x80


def _after(held: np.ndarray, first: bool) -> np.ndarray:
    """A mask moved on by one place, with the given value in the first."""
    return np.concatenate([[first], held[:-1]])


def _word_starts(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """White space goes with the word after it; a text's first byte begins its first word."""
    space = (data[a:b] == 32) | ((data[a:b] >= 9) & (data[a:b] <= 13))
    before = a > 0 and bool(data[a - 1] == 32 or 9 <= data[a - 1] <= 13)
    mask = space & ~_after(space, before)
    if a == 0:
        mask[0] = True
    return mask


def _line_starts(data: np.ndarray, a: int, b: int) -> np.ndarray:
    return _after(data[a:b] == 10, a == 0 or bool(data[a - 1] == 10))


STARTS = {"char": _char_starts, "word": _word_starts, "line": _line_starts}


def draws(doc_id: Column, seed: int = 1, n: int = 4) -> list[Column]:
    """The first n (up to eight) 32-bit numbers of the hash of seed and id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def fill_in_middle(
    docs: DataFrame, seed: int = 1, unit: str = "char", plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """Cut each text at two drawn boundaries and put the marked parts in a new order.

    Returns doc_id, n (units), form, prefix_units, middle_units (null if plain) and output,
    a row per row; other columns are left out. Forms: plain, the text as it is, for empty and null
    texts, texts that hold a mark, and ``plain_percent`` of the rest; spm, suffix before
    prefix, for ``spm_percent`` of what is cut; else psm. A unit is a code point (char), a word
    with the white space before it (word), or a line (line). Draws depend on seed and id
    alone, so reruns agree and repeated rows give equal rows. Texts are handled one after the
    other, so memory follows a batch and the longest text.
    """
    prefix_mark, suffix_mark, middle_mark = (m.encode() for m in marks)
    columns = {"n": pa.int64(), "form": pa.string(), "prefix_units": pa.int64(), "middle_units": pa.int64(), "output": pa.string()}

    def cut(text: bytes, h: list[int]) -> tuple:
        data = np.frombuffer(text, dtype=np.uint8)
        units = BoundarySet(data, unit)
        n = len(units)
        if not n or h[2] % 100 >= 100 - plain_percent or any(m in text for m in (prefix_mark, suffix_mark, middle_mark)):
            return n, "plain", None, None, text
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        i, j = units.select(a), units.select(b)
        prefix, middle, suffix = text[:i], text[i:j], text[j:]
        if h[3] % 100 < spm_percent:
            return n, "spm", a, b - a, b"".join((suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle))
        return n, "psm", a, b - a, b"".join((prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                texts, hs = batch.column(1).cast(pa.binary()), zip(*[batch.column(k).to_pylist() for k in range(2, 6)], strict=True)
                rows = [cut(text.as_py() or b"", h) for text, h in zip(texts, hs, strict=True)]
                made = [pa.array(c, t if t != pa.string() else pa.binary() if name == "output" else t) for c, (name, t) in zip(zip(*rows, strict=True), columns.items(), strict=True)]
                made[-1] = made[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *columns])

    names = {pa.int64(): "long", pa.string(): "string"}
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))])
    return rows.mapInArrow(convert, f"doc_id {kind}, " + ", ".join(f"{n} {names[t]}" for n, t in columns.items()))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from an output and its form. A text that was cut holds no mark, and a mark
    has no end that is also its beginning, so each mark is found once."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
