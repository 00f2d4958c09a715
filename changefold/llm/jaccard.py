"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

1. Texts become sets of hashed word n-grams; equal sets form one class.
2. N-grams are ordered rarest first, by counts over the whole corpus kept in a fixed number
   of hash buckets. The order only steers pruning: any order gives the same links.
3. Each class posts the n-grams of its prefix. Similar sets share a prefix n-gram, at
   places that leave room for the overlap they need (length and positional filters), and
   their counts over fixed cuts of the n-gram order differ by no more than their symmetric
   difference may (suffix filter).
4. First every class is compared with one leader of each of its n-grams (one for each part
   of the holders of a hot n-gram), and what proves similar is joined into components. Then
   only pairs of different components are left. They are formed and filtered in tiles of
   bounded size, and those that pass all filters are compared. So a group of thousands of
   copies costs links in proportion to its members, and no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changefold.llm.common import Words, broadcast_if_small, chunks, mix64, saved
from changefold.llm.components import components, extended

#: Buckets of the corpus counts, cut into pieces of so many when they are summed.
BUCKET_BITS, PIECE = 20, 4096
#: Cuts of the n-gram order for the suffix filter.
CUTS = 64
#: Holders of an n-gram beyond 2^PART_BITS, and beyond eight times a bucket's mean, are dealt
#: into parts with a leader each.
PART_BITS = 16
#: Hashes of texts that may be broadcast; bytes of text whose sets are made together.
MOST_TEXTS, TOGETHER = 1_000_000, 1 << 20
#: Partners that share one copy of a text; holders of an n-gram in a block of a tile; pairs
#: that are filtered together.
BLOCK, TILE, PAIRS = 64, 1024, 1 << 17
_KEY = np.uint64(0xD6E8FEB86659FD93)


class Sets:
    """Distinct n-grams of several texts, rarest first within each text."""

    def __init__(self, run: list[bytes], n: int, steps: np.ndarray | None = None):
        h, text = Words(run).shingles(n)
        if steps is None:
            order = np.lexsort((h, text))
        else:
            order = np.lexsort((h, steps[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)], text))
        h, text = h[order], text[order]
        self.raw = h  # with repeats
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        self.h, self.text = h[first], text[first]
        self.sizes = np.bincount(self.text, minlength=len(run))
        self.ends = np.cumsum(self.sizes)

    def keys(self) -> np.ndarray:
        """A 64-bit fingerprint of each set; 0 for an empty one."""
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(self.h ^ _KEY), dtype=np.uint64)])
        got = mix64(sums[self.ends] - sums[self.ends - self.sizes] + self.sizes.astype(np.uint64))
        return np.where(self.sizes > 0, got, 0).astype(np.uint64).view(np.int64)

    def cut_counts(self) -> np.ndarray:
        """Per text, n-grams in each cut, modulo 256."""
        cut = (mix64(self.h) >> np.uint64(58)).astype(np.int64)
        return np.bincount(self.text * CUTS + cut, minlength=len(self.sizes) * CUTS).astype(np.uint8).reshape(-1, CUTS)


def set_sizes(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(rows, steps), from one pass over all texts.

    ``rows``: doc_id, tid (a hash of the text), n (size of the set) and key per row. ``steps``:
    how frequent the n-grams of each hash bucket are, a byte per bucket, eight steps to a
    doubling. Counts cover all documents; what reaches the driver is 2^20 bytes.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("piece", pa.int64()), ("counts", pa.binary())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            for start, run in chunks(batch.column(2).to_pylist()):
                sets = Sets(run, n)
                seen += np.bincount((sets.raw >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(seen))
                ids = [c.slice(start, len(run)) for c in batch.columns[:2]]
                none = [pa.nulls(len(run), f.type) for f in list(schema)[4:]]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(sets.sizes, pa.int64()), pa.array(sets.keys()), *none], schema=schema)
        pieces = seen.reshape(-1, PIECE)
        used = np.flatnonzero(pieces.any(axis=1))
        none = [pa.nulls(len(used), f.type) for f in list(schema)[:4]]
        yield pa.RecordBatch.from_arrays([*none, pa.array(used, pa.int64()), pa.array([pieces[k].astype(np.uint32).tobytes() for k in used], pa.binary())], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(data, dtype=np.uint32).astype(np.int64)
        if sums:
            steps = [np.minimum(255, 8 * np.log2(x + 1.0)).astype(np.uint8).tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(steps, pa.binary())], ["piece", "steps"])

    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text")
    both = saved(both.mapInArrow(convert, "doc_id long, tid long, n long, key long, piece long, counts binary"), "jaccard-rows")
    summed = both.filter("piece is not null").select("piece", "counts").repartition(16, "piece").mapInArrow(add, "piece long, steps binary")
    steps = np.zeros((1 << BUCKET_BITS) // PIECE * PIECE, dtype=np.uint8).reshape(-1, PIECE)
    for piece, data in summed.collect():
        steps[piece] = np.frombuffer(data, dtype=np.uint8)
    return both.filter("piece is null").select("doc_id", "tid", "n", "key"), steps.ravel()


def class_table(docs: DataFrame, n: int, percent: int, steps: np.ndarray) -> DataFrame:
    """One row per distinct non-empty set: key, n, cuts, prefix (n-gram hashes, rarest first),
    parts (for each, into how many parts its holders are dealt, as a power of two; null if
    all are whole), and tid, the hash of one text that has this set."""
    # a bucket of a large corpus is full of rare n-grams; a hot one stands out by far
    mean = float(np.mean(2.0 ** (steps / 8.0) - 1))
    part_bits = max(PART_BITS, int(np.ceil(np.log2(8 * mean))) if mean > 0 else 0)
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("tid", pa.int64()), ("cuts", pa.binary()), ("prefix", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32()))])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, run in chunks(batch.column(1).to_pylist()):
                sets = Sets(run, n, steps)
                size = sets.sizes
                take = np.where(size > 0, size - -(-percent * size // 100) + 1, 0)
                begin = sets.ends - size
                inside = np.arange(len(sets.h)) - begin[sets.text] < take[sets.text]
                offsets = pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32))
                h = sets.h[inside]
                often = steps[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.int32)
                deal = np.maximum(0, -(-often // 8) - part_bits).astype(np.int32)
                parts = pa.ListArray.from_arrays(offsets, pa.array(deal)) if deal.any() else pa.nulls(len(run), schema.field("parts").type)
                prefix = pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))
                cuts = pa.array([x.tobytes() for x in sets.cut_counts()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(sets.keys()), pa.array(size, pa.int64()), batch.column(0).slice(start, len(run)), cuts, prefix, parts], schema=schema)

    rows = docs.select(F.xxhash64("text"), "text").mapInArrow(convert, "key long, n long, tid long, cuts binary, prefix array<long>, parts array<int>").filter("n > 0")
    one = rows.groupBy("key").agg(F.first("n").alias("n"), F.min("tid").alias("tid"), *[F.first(c).alias(c) for c in ("cuts", "prefix", "parts")])
    return saved(one, "jaccard-classes")


def least_overlap(n1: Column, n2: Column, percent: int) -> Column:
    """Common n-grams that two sets of these sizes need for the similarity."""
    return F.expr("0L") + F.ceil((n1 + n2) * percent / F.lit(100 + percent))


def may_link(percent: int) -> Column:
    """Length and positional filters on a pair that shares an n-gram at pos1 and pos2."""
    n1, n2 = F.col("n1"), F.col("n2")
    room = F.lit(1) + F.least(n1 - F.col("pos1"), n2 - F.col("pos2")) - 1
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (room >= least_overlap(n1, n2, percent))


def suffix_filtered(pairs: DataFrame, unique: DataFrame, percent: int) -> DataFrame:
    """Keep pairs (a, b) whose counts per cut allow the overlap they need, and name a text
    of each side (ta, tb)."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, CUTS) for k in (6, 7))
            apart = left - right
            apart = np.minimum(apart, (256 - apart.astype(np.int16)).astype(np.int16)).sum(axis=1)
            both = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            ok = apart <= both - 2 * -(-percent * both // (100 + percent))
            yield batch.filter(pa.array(ok)).select([0, 1, 2, 3])

    for end in ("a", "b"):
        side = unique.select(F.col("key").alias("_k"), F.col("n").alias(f"n{end}"), F.col("tid").alias(f"t{end}"), F.col("cuts").alias(f"cuts{end}"))
        pairs = pairs.join(side, F.col(end) == F.col("_k")).drop("_k")
    return pairs.select("a", "b", "ta", "tb", "na", "nb", "cutsa", "cutsb").mapInArrow(near, "a long, b long, ta long, tb long")


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of the saved pairs (a, b, ta, tb) whose sets reach the similarity.

    Texts, which are smaller than their sets, are shipped: only texts that occur in a pair
    leave the scan, by a broadcast of their hashes while these are few. The end with more
    pairs hosts them, in blocks of BLOCK; its text goes to each block once, ahead of
    the texts of its partners, so a task holds the set of one host and a run of partners.
    """

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, own = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            hosts, guests = batch.column("host"), batch.column("guest")
            for start, run in chunks(batch.column("text").to_pylist(), TOGETHER):
                sets = Sets(run, n)
                parts = np.split(sets.h, sets.ends[:-1])
                ok = np.zeros(len(run), dtype=bool)
                for i, part in enumerate(parts):
                    if not guests[start + i].is_valid:
                        host, own = hosts[start + i].as_py(), part
                    elif hosts[start + i].as_py() == host:
                        both = np.sort(np.concatenate([own, part]), kind="stable")
                        common = int(np.count_nonzero(both[1:] == both[:-1]))
                        ok[i] = 100 * common >= percent * (len(own) + len(part) - common)
                met = pa.RecordBatch.from_arrays([hosts.slice(start, len(run)), guests.slice(start, len(run))], ["host", "guest"])
                yield met.filter(pa.array(ok))

    degree = pairs.select(F.explode(F.array("ta", "tb")).alias("_t")).groupBy("_t").agg(F.count("*").alias("deg"))
    degree = saved(degree, "jaccard-wanted")
    texts = docs.select(F.xxhash64("text").alias("tid"), "text").join(broadcast_if_small(degree.select("_t"), MOST_TEXTS), F.col("tid") == F.col("_t"), "left_semi")
    texts = saved(texts.groupBy("tid").agg(F.first("text").alias("text")), "jaccard-texts")
    for end in ("a", "b"):
        pairs = pairs.join(degree.select(F.col("_t").alias(f"_t{end}"), F.col("deg").alias(f"deg{end}")), F.col(f"t{end}") == F.col(f"_t{end}"))
    first = (F.col("dega") > F.col("degb")) | ((F.col("dega") == F.col("degb")) & (F.col("a") < F.col("b")))
    sides = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("a", "b", "host"), ("b", "a", "guest"), ("ta", "tb", "t_host"), ("tb", "ta", "t_guest"))]
    block = F.pmod(F.xxhash64("guest"), F.ceil(F.greatest("dega", "degb") / BLOCK).cast("long"))
    held = saved(pairs.select(*sides, "dega", "degb").withColumn("block", block), "jaccard-hosted")
    hosts = held.select("host", "block", F.col("t_host").alias("_t"), F.lit(None).cast("long").alias("guest")).distinct()
    guests = held.select("host", "block", F.col("t_guest").alias("_t"), "guest")
    # of tables of their own, so that Spark splits the join where a text has many pairs
    rows = [side.join(texts, F.col("tid") == F.col("_t")).select("host", "block", "guest", "text") for side in (hosts, guests)]
    met = rows[0].unionByName(rows[1]).repartition("host", "block").sortWithinPartitions("host", "block", F.col("guest").asc_nulls_first())
    found = met.select("host", "guest", "text").mapInArrow(alike, "host long, guest long")
    return found.select(F.least("host", "guest").alias("a"), F.greatest("host", "guest").alias("b"))


def near_pairs(placed: DataFrame, unique: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, ta, tb) of classes of different components that share an n-gram of their
    prefixes and pass the length, positional and suffix filters.

    ``placed``: token, key, n, pos, comp. The holders of a token are cut into blocks of about TILE;
    each pair of blocks is a tile, of bounded size, whose pairs are formed and filtered inside
    a task by numpy. Only pairs that pass all filters become rows.
    """
    sides = unique.select(F.col("key").alias("_k"), "tid", "cuts")
    rows = placed.join(sides, F.col("key") == F.col("_k")).drop("_k")
    counts = placed.groupBy("token").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks")).filter("blocks > 1").withColumnRenamed("token", "_t")
    rows = rows.join(counts, F.col("token") == F.col("_t"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.select("token", "key", "n", "pos", "comp", "tid", "cuts", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("token", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "key", "n", "pos", "comp", "tid", "cuts")
    tiles = ["token", "b1", "b2"]
    tiled = rows.repartition(*tiles).sortWithinPartitions(*tiles, "key")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ta", pa.int64()), ("tb", pa.int64())])

    def pairs_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """The pairs of whole tiles."""
        token, b1, b2, own, key, n, pos, comp, tid = (table.column(k).to_numpy() for k in range(9))
        cuts = np.frombuffer(b"".join(table.column(9).to_pylist()), dtype=np.uint8).reshape(-1, CUTS)
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(token))[np.cumsum(new) - 1]
        partners = ends - np.arange(len(token)) - 1
        upto = np.cumsum(partners)
        at = 0
        while at < len(token):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
            count = partners[at:stop]
            i = np.repeat(np.arange(at, stop), count)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            # a tile of two blocks has the pairs between them, one of a single block its own
            ok = (comp[i] != comp[j]) & ((b1[i] == b2[i]) | (own[i] != own[j]))
            i, j = i[ok], j[ok]
            both, low, high = n[i] + n[j], np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            need = -(-percent * both // (100 + percent))
            ok = (low * 100 >= high * percent) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need)
            i, j, both, need = i[ok], j[ok], both[ok], need[ok]
            apart = cuts[i] - cuts[j]
            ok = np.minimum(apart, np.uint8(0) - apart).sum(axis=1, dtype=np.int64) <= both - 2 * need
            i, j = i[ok], j[ok]
            swap = key[i] > key[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[i], key[j], tid[i], tid[j])], schema=schema)
            at = stop

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            # rows before the last tile are whole tiles; that one may go on in the next batch
            before = np.flatnonzero((marks != marks[-1]).any(axis=1))
            cut = int(before[-1]) + 1 if len(before) else 0
            if left and (marks[0] != last).any():
                yield from pairs_of(pa.Table.from_batches(left))
                left = []
            if cut:
                yield from pairs_of(pa.Table.from_batches([*left, batch.slice(0, cut)]))
                left = []
            left.append(batch.slice(cut))
            last = marks[-1]
        if left:
            yield from pairs_of(pa.Table.from_batches(left))

    return tiled.mapInArrow(join, "a long, b long, ta long, tb long").distinct()


def jaccard_groups(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Groups of documents linked, directly or not, by n-gram Jaccard >= percent / 100.

    Reads doc_id and text; extra columns are left out. Returns one row per input row:
    doc_id, tid (hash of the text), n_shingles, class_key (equal for equal sets), n_links (links between its class
    and other classes that were verified), component_id, the smallest doc_id reachable,
    itself included, and component_key, the smallest class_key reachable, which alone tells
    components apart where rows of unlike texts share a doc_id or have none. Texts without words (null, empty, white space) have size 0, no key and
    link with nothing. Fewer words than n count as one n-gram. A null doc_id is never the
    smallest; repeated rows are copies of each other; an empty table gives an empty one.
    N-grams are compared by 64-bit hashes.
    """
    docs = docs.select("doc_id", "text")
    rows, steps = set_sizes(docs, n)
    unique = class_table(docs, n, percent, steps)
    postings = unique.select("key", "n", "parts", F.posexplode("prefix").alias("pos", "token"))
    postings = postings.select("token", "key", "n", "pos", F.coalesce(F.expr("parts[pos]"), F.lit(0)).alias("bits"))
    postings = postings.withColumn("part", F.when(F.col("bits") > 0, F.pmod("key", F.expr("shiftleft(1L, bits)"))).otherwise(F.lit(0)))
    order = W.partitionBy("token", "part").orderBy("pos", "key")
    shared = postings.withColumn("_next", F.lead("key").over(order)).withColumn("lead", F.first("key").over(order)).withColumn("lead_n", F.first("n").over(order)).withColumn("lead_pos", F.first("pos").over(order))
    shared = saved(shared.filter("_next is not null or lead <> key or bits > 0").drop("_next", "part"), "jaccard-postings")

    ends = [F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")]
    first = shared.select(
        F.col("key").alias("k1"), F.col("n").alias("n1"), F.col("pos").alias("pos1"), F.col("lead").alias("k2"), F.col("lead_n").alias("n2"),
        F.col("lead_pos").alias("pos2"),
    )
    heads = shared.filter("bits > 0 and key = lead").select("token", F.col("key").alias("k1"), F.col("n").alias("n1"), F.col("pos").alias("pos1"))
    of_heads = W.partitionBy("token").orderBy("pos1", "k1")
    for name in ("k", "n", "pos"):
        heads = heads.withColumn(f"{name}2", F.first(f"{name}1").over(of_heads))
    first = first.unionByName(heads.drop("token"))
    first = first.filter("k1 <> k2").filter(may_link(percent)).select(*ends).distinct()
    first = saved(suffix_filtered(first, unique, percent), "jaccard-pairs")
    links = saved(verified(first, docs, n, percent), "jaccard-links")

    comps = components(links).withColumnsRenamed({"node": "_n", "comp": "_c"})
    placed = shared.join(comps, F.col("key") == F.col("_n"), "left").select("token", "key", "n", "pos", F.coalesce("_c", "key").alias("comp"))
    placed = saved(placed, "jaccard-placed")
    mixed = placed.groupBy("token").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo <> _hi").select(F.col("token").alias("_t"))
    placed = saved(placed.join(mixed, F.col("token") == F.col("_t"), "left_semi"), "jaccard-mixed")
    rest = near_pairs(placed, unique, percent).join(first, ["a", "b"], "left_anti")
    more = saved(verified(saved(rest, "jaccard-rest"), docs, n, percent), "jaccard-more")
    if not more.isEmpty():
        links = saved(links.unionByName(more).distinct(), "jaccard-links")
        comps = saved(extended(comps.withColumnsRenamed({"_n": "node", "_c": "comp"}), more), "jaccard-components")
    else:
        comps = comps.withColumnsRenamed({"_n": "node", "_c": "comp"})

    ids = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("low"))
    tops = comps.join(ids.withColumnRenamed("key", "_k"), F.col("node") == F.col("_k")).groupBy("comp").agg(F.min("low").alias("top")).withColumnRenamed("comp", "_g")
    degree = links.select(F.explode(F.array("a", "b")).alias("_k")).groupBy("_k").agg(F.count("*").alias("deg"))
    named = ids.join(comps, F.col("key") == F.col("node"), "left").join(tops, F.col("comp") == F.col("_g"), "left").join(degree, F.col("key") == F.col("_k"), "left")
    named = named.select(
        F.col("key").alias("_key"), F.coalesce("comp", "key").alias("component_key"), F.coalesce("top", "low").alias("component"),
        F.coalesce("deg", F.lit(0)).alias("deg"),
    )
    named = saved(named, "jaccard-named")  # a plain shuffle, which Spark splits where one class has many rows
    done = rows.join(named, (F.col("n") > 0) & (F.col("key") == F.col("_key")), "left")
    return done.select(
        "doc_id", "tid", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
        F.when(F.col("n") > 0, F.col("key")).alias("class_key"), F.coalesce("deg", F.lit(0)).cast("long").alias("n_links"), "component_key",
    )


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of linked documents: the one with the smallest doc_id, null last,
    then the smallest hash of its text. Rows without words are kept; columns stay as they are.

    Rows equal in doc_id and text collapse to one of them. Rows of unlike texts stay even if
    they share a doc_id; linked rows form a group even if all their doc_ids are null.
    """
    mine = [F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("__jaccard_id"), F.xxhash64("text").alias("__jaccard_tid")]
    groups = jaccard_groups(docs, n, percent).filter("n_shingles > 0").select(mine[0], F.col("tid").alias("__jaccard_tid"), F.col("component_key").alias("group"))
    rows = saved(groups.groupBy("group", "__jaccard_id", "__jaccard_tid").agg(F.count("*").alias("copies")), "jaccard-kept")
    first = rows.groupBy("group").agg(F.min(F.struct("__jaccard_id", "__jaccard_tid")).alias("keep"))
    losing = rows.join(first, "group").filter(F.struct("__jaccard_id", "__jaccard_tid") != F.col("keep")).select("__jaccard_id", "__jaccard_tid")
    losing = broadcast_if_small(saved(losing, "jaccard-losing"), MOST_TEXTS)
    twice = broadcast_if_small(saved(rows.filter("copies > 1").select("__jaccard_id", "__jaccard_tid"), "jaccard-twice"), MOST_TEXTS)
    left = docs.select("*", *mine).join(losing, ["__jaccard_id", "__jaccard_tid"], "left_anti")
    once = left.join(twice, ["__jaccard_id", "__jaccard_tid"], "left_anti")
    again = left.join(twice, ["__jaccard_id", "__jaccard_tid"], "left_semi").dropDuplicates(["__jaccard_id", "__jaccard_tid"])
    return once.unionByName(again).drop("__jaccard_id", "__jaccard_tid")
