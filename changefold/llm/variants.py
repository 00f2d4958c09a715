"""Spelling variants: words one edit apart, found by a bit-sliced position index.

Two words that differ by one inserted, deleted or replaced code point share their first or
their last code points up to half of the shorter one. So the vocabulary is dealt out by
length class and such a half, and by parts where a half is shared by very many words; each small set
of words is indexed and asked for its own words. Only words that share a half meet, each
pair in one place, and no task holds more than two parts.

The index of a set has a bitset over its words per (position, letter). A question runs along
the asked word's letters, and two bitsets say which words agree so far with no error and
with one: ``zero`` is met with the bitset of the next letter, ``one`` with that of the next letter at its
shifted position, and whatever leaves ``zero`` enters ``one``. All words of the set are
answered at once, 64 and more to a machine operation.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefold.llm.common import ascii_lower, broadcast_if_small, saved

#: Fixed pattern: a run of letters, of ASCII and of Latin-1 (which has two signs among them).
RUN = r"[A-Za-zÀ-ÿ]+"
#: Words that a part of a set holds; a set beyond this many is dealt into parts.
PART = 2048
#: Pairs that go to Spark at once.
BATCH = 8192


class PositionIndex:
    """Bitsets over words (bit i is word i) per (position, letter) and per length."""

    def __init__(self, words: list[str]):
        self.words, self.at, self.long = words, defaultdict(int), defaultdict(int)
        held: dict[tuple[int, str], list[int]] = defaultdict(list)
        lengths: dict[int, list[int]] = defaultdict(list)
        for i, word in enumerate(words):
            lengths[len(word)].append(i)
            for p, letter in enumerate(word):
                held[p, letter].append(i)
        self.at = {k: _bitset(v, len(words)) for k, v in held.items()}
        self.long = {k: _bitset(v, len(words)) for k, v in lengths.items()}

    def replaced(self, word: str) -> int:
        """Words of the same length with one other letter."""
        zero, one = self.long.get(len(word), 0), 0
        for p, letter in enumerate(word):
            hit = self.at.get((p, letter), 0)
            one = (one & hit) | (zero & ~hit)
            zero &= hit
        return one

    def inserted(self, word: str) -> int:
        """Words that have one letter more."""
        zero = self.long.get(len(word) + 1, 0)
        one = zero  # the letter more comes first
        for p, letter in enumerate(word):
            one &= self.at.get((p + 1, letter), 0)
            zero &= self.at.get((p, letter), 0)
            one |= zero
        return one

    def deleted(self, word: str) -> int:
        """Words that have one letter less."""
        zero = self.long.get(len(word) - 1, 0)
        one = 0
        for p, letter in enumerate(word):
            one = (one & self.at.get((p - 1, letter), 0)) | zero
            zero &= self.at.get((p, letter), 0)
        return one

    def near(self, word: str) -> list[int]:
        """Which words are one edit from the given one."""
        return _members(self.replaced(word) | self.inserted(word) | self.deleted(word))


def _bitset(members: list[int], n: int) -> int:
    out = bytearray((n + 7) // 8)
    for i in members:
        out[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(out, "little")


def _members(bits: int) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def runs(docs: DataFrame, drop_every: int | None = None) -> DataFrame:
    """Each run of letters of the texts, A-Z lower-cased, as ``word``; null texts have none.

    With ``drop_every`` a letter is lost where that number divides the checksum of id and
    run: the one at checksum modulo length, from 0. A null id counts as empty there.
    """
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))).alias("word"))
    if not drop_every:
        return words.select("word")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary"))
    return words.select("word", h.alias("h")).select(F.when(F.col("h") % drop_every == 0, _without("word", F.col("h"))).otherwise(F.col("word")).alias("word"))


def _without(word: str, h: Column) -> Column:
    place = (h % F.length(word)).cast("int")
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def vocabulary(words: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of words of at least so many code points that occur at least so often. Counts
    are added up before the shuffle, so that frequent words are no hot keys."""
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def near_pairs(words: DataFrame, part: int = PART) -> DataFrame:
    """(word, near, near_n): every ordered pair of words of (word, n) that are one edit
    apart, once. Words must be distinct and not null; empty ones are near to those of one letter."""
    size = F.length("word")
    first = F.struct(F.lit(0).alias("side"), size.alias("class"), F.left("word", _half(size)).alias("half"))
    last = F.struct(F.lit(1).alias("side"), size.alias("class"), F.right("word", _half(size)).alias("half"))
    first_less = F.struct(F.lit(0).alias("side"), (size - 1).alias("class"), F.left("word", _half(size - 1)).alias("half"))
    last_less = F.struct(F.lit(1).alias("side"), (size - 1).alias("class"), F.right("word", _half(size - 1)).alias("half"))
    keyed = saved(words.select("word", "n", F.explode(F.array(first, last, first_less, last_less)).alias("k")).filter("k.class >= 0").select("word", "n", "k.*"), "variant-halves")
    sets = saved(keyed.groupBy("side", "class", "half").agg(F.count("*").alias("size")).filter("size > 1"), "variant-sets")
    crowded = broadcast_if_small(sets.filter(F.col("size") > part), 100_000)
    parts = F.coalesce(F.ceil(F.col("size") / part), F.lit(1)).cast("int")
    dealt = keyed.join(crowded, ["side", "class", "half"], "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    # a part meets itself and every other part, each two in one tile
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("low"), F.greatest(o, F.col("part")).alias("high")))
    tiles = dealt.select("side", "class", "half", F.explode(others).alias("tile"), "part", "word", "n").select("side", "class", "half", "tile.low", "tile.high", "part", "word", "n")
    tile = ["side", "class", "half", "low", "high"]
    return tiles.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(_pairs_of_tiles, "word string, near string, near_n long")


def _half(size: Column) -> Column:
    return F.floor(size / 2).cast("int")


def _pairs_of_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of the tiles of a partition, whose rows are sorted by tile; batches of a few
    thousand pairs, however small the tiles are."""
    made: list[tuple] = []
    for tile, rows in _tiles(batches):
        for pair in _pairs_of_tile(tile, rows):
            made.append(pair)
            if len(made) >= BATCH:
                yield _batch(made)
                made = []
    if made:
        yield _batch(made)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[tuple]]]:
    """Each tile with its rows (part, word, n), if there are two or more."""
    now, rows = [], []
    for batch in batches:
        for *tile, part, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if tile != now:
                if len(rows) > 1:
                    yield now, rows
                now, rows = tile, []
            rows.append((part, word, n))
    if len(rows) > 1:
        yield now, rows


def _pairs_of_tile(tile: list, rows: list[tuple]) -> Iterator[tuple[str, str, int]]:
    """Near pairs of one tile, in both directions. In the sets by last letters, pairs that share
    their first ones are left out, as they are in a set by first letters too; in the sets of a class,
    pairs whose shorter word is of another class."""
    side, size, _, low, high = tile
    index = PositionIndex([w for p, w, _ in rows if p == low])
    counts = [n for p, _, n in rows if p == low]
    for p, word, n in rows:
        if p != high:
            continue
        for i in index.near(word):
            other = index.words[i]
            if low == high and other > word:
                continue  # found from the other word
            if min(len(word), len(other)) == size and not (side and word[: size // 2] == other[: size // 2]):
                yield word, other, counts[i]
                yield other, word, n


def _batch(pairs: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*pairs, strict=True), kinds, strict=True)], ["word", "near", "near_n"])


def variant_groups(words: DataFrame, ratio: int = 5) -> DataFrame:
    """Words of (word, n) with the form each is a variant of, and the root of its group.

    ``n_near`` counts the words one edit away; ``form`` is the one of them with the largest n (ties: the
    least in code-point order), if that is at least ``ratio`` times the word's own n, else
    null, and ``form_n`` its n; ``root`` is where following forms ends. A ratio above 1 lets no forms
    go round. One row per word; null words and counts are left out, an empty vocabulary gives no rows,
    and repeated words count together. Pairs are added up before their shuffle.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = saved(words.filter("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "variant-words")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), "near")).alias("best"))
    met = words.join(best, "word", "left").withColumn("form_n", -F.col("best.rank"))
    met = met.withColumn("form", F.when(F.col("form_n") >= F.col("n") * ratio, F.col("best.near"))).withColumn("form_n", F.when(F.col("form").isNotNull(), F.col("form_n")))
    met = saved(met.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"), "variant-forms")
    roots = _roots(met.filter("form is not null").select("word", F.col("form").alias("root")))
    return met.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) by doubling: each round joins every root with where that leads, until
    none leads on. Counts grow along forms, so a few rounds are enough."""
    links = saved(links, "variant-roots")
    while True:
        onward = links.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        done = saved(links.join(onward, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")), "variant-roots")
        moved = done.filter("_moved").limit(1).count()
        links = done.drop("_moved")
        if not moved:
            return links


def spelling_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, drop_every: int | None = None) -> DataFrame:
    """``variant_groups`` of the words of whole texts: runs of letters, A-Z lower-cased. Null and empty
    texts have none; repeated rows count again; other columns are not looked at."""
    return variant_groups(vocabulary(runs(docs, drop_every), min_length, min_count), ratio)
