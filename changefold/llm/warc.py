"""Merkle fixity audit of WARC replicas.

Records are dealt to files by a hash of what they first held, their name, and lie there in
its order; each has an offset and a length. Ranges of names, which are fixed, cut a file
into ordered ranges of offsets. Every record is hashed; the records of a range, with their
offsets inside it and their lengths, are hashed into a node, and the ranges of a file, with
theirs, into its root. Two replicas are compared at the roots; below, only branches that
differ are read, down to records, which are told by name. So a record that is lost or added
shifts the offsets of others without condemning them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changefold.llm.common import saved

#: Records of a file on average; a file has 16 ranges, one for each leading digit of the name's rest.
PER_FILE = 256


def record(page_id: Column, url: Column, body: Column) -> Column:
    """A resource record of WARC 1.1; nulls read as empty."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, files: int) -> DataFrame:
    """file, range, name, digest, bytes (of one copy), copies, page_id and start of each record.

    Equal records are one row with ``copies``, added up before any shuffle, so that a record
    repeated at will is no burden to its file.
    """
    named = pages.select("page_id", "name", record(F.col("page_id"), F.col("url"), F.col("html")).alias("rec"))
    named = named.select("page_id", "name", F.octet_length("rec").cast("long").alias("bytes"), F.sha2(F.col("rec").cast("binary"), 256).alias("digest"))
    named = named.groupBy("name", "digest").agg(F.count("*").alias("copies"), F.min("page_id").alias("page_id"), F.min("bytes").alias("bytes"))
    named = named.withColumn("file", F.conv(F.substring("name", 1, 8), 16, 10).cast("long") % files).withColumn("rest", F.substring("name", 9, 24))
    named = named.withColumn("range", F.conv(F.substring("rest", 1, 1), 16, 10).cast("long"))
    order = W.partitionBy("file").orderBy("rest", "name", "digest")
    return named.withColumn("start", F.sum(F.col("bytes") * F.col("copies")).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("bytes") * F.col("copies")).drop("rest")


def page_name(pages: DataFrame) -> Column:
    """A hash of id, address and body as first stored."""
    return F.md5(F.concat_ws("\x1f", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))))


def parents(level: DataFrame, by: list[str]) -> DataFrame:
    """Nodes of a level: start, bytes and the digest of what lies in each, in order, each child
    with its offset from the node's start, its length and its digest."""
    packed = level.groupBy(*by).agg(
        F.min("start").alias("start"), F.sum("size").alias("size"),
        F.sort_array(F.collect_list(F.struct(F.col("start").alias("at"), F.col("size").alias("len"), "digest"))).alias("kids"),
    )
    lines = F.transform("kids", lambda k: F.concat_ws(":", (k["at"] - F.col("start")).cast("string"), k["len"].cast("string"), k["digest"]))
    return packed.select(*by, "start", "size", F.sha2(F.array_join(lines, ",").cast("binary"), 256).alias("digest"))


def tree(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranges, roots) over the records, saved."""
    sized = leaves.withColumn("size", F.col("bytes") * F.col("copies"))
    ranges = saved(parents(sized, ["file", "range"]), "warc-ranges")
    return ranges, saved(parents(ranges, ["file"]), "warc-roots")


def mismatches(ours: tuple[DataFrame, DataFrame], theirs: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(file, range) of the branches that differ: roots first, then the ranges below roots that do."""
    bad: DataFrame | None = None
    for level, keys in ((1, ["file"]), (0, ["file", "range"])):
        sides = [side[level] for side in (ours, theirs)]
        if bad is not None:
            up = bad.select(F.col("file").alias("_f"))
            sides = [side.join(up, F.col("file") == F.col("_f"), "left_semi") for side in sides]
        one, two = (side.select(*keys, F.col("digest").alias(f"digest{i}")) for i, side in enumerate(sides))
        both = one.join(two, keys, "full").filter(~F.col("digest0").eqNullSafe(F.col("digest1")))
        bad = saved(both.select(*keys), "warc-bad")
    return bad


def audit(pages: DataFrame, replica: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """Compare a replica with the pages, record by record, by descending the trees.

    Both hold page_id, url, html; ``replica`` also holds ``name``, the hash of the page as
    first stored (``page_name``), which places its records. Returns one row per page, and one
    per record that only the replica has: page_id, file, record_offset (null for these),
    n_bytes, record_sha256, file_root (of the pages' file), state and intact. The state is intact, damaged (the
    replica has another record of that name), lost or extra. Null ids, addresses and bodies
    read as empty; repeated rows are records of their own, told apart by number alone; extra
    columns are left out; empty tables give none.
    """
    files = max(1, -(-pages.count() // per_file))
    ours = saved(records(pages.withColumn("name", page_name(pages)), files), "warc-records")
    theirs = saved(records(replica, files), "warc-records")
    our_tree, their_tree = tree(ours), tree(theirs)
    bad = mismatches(our_tree, their_tree)
    within = [side.join(bad, ["file", "range"], "left_semi") for side in (ours, theirs)]
    # of each name in a bad range: our copies, theirs in all, and theirs that are as ours
    mine = within[0].select(F.col("name"), F.col("digest").alias("want"), F.col("copies").alias("n"))
    met = within[1].join(mine, "name", "left").withColumn("same", F.col("digest").eqNullSafe(F.col("want")))
    met = met.withColumn("left", F.col("copies") - F.when(F.col("same"), F.least("n", "copies")).otherwise(F.lit(0)))
    by_name = met.groupBy("name").agg(F.sum(F.when(F.col("same"), F.col("copies")).otherwise(F.lit(0))).alias("same"), F.sum("left").alias("left"))
    faults = mine.join(by_name, "name", "left").withColumn("lacks", F.greatest(F.lit(0), F.col("n") - F.coalesce("same", F.lit(0))))
    faults = faults.withColumn("damaged", F.least("lacks", F.coalesce("left", F.lit(0))))
    faults = saved(faults.filter("lacks > 0").select(F.col("name").alias("_name"), "lacks", "damaged"), "warc-faults")
    roots = our_tree[1].select(F.col("file").alias("_file"), F.col("digest").alias("file_root"))

    copy = F.posexplode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_i", "_copy")
    rows = ours.join(faults, F.col("name") == F.col("_name"), "left").select("*", copy)
    sound = F.col("copies") - F.coalesce("lacks", F.lit(0))
    state = F.when(F.col("_i") < sound, "intact").when(F.col("_i") < sound + F.col("damaged"), "damaged").otherwise("lost")
    rows = rows.select("page_id", "file", (F.col("start") + F.col("_i") * F.col("bytes")).alias("record_offset"), "bytes", "digest", state.alias("state"))
    # what is left over of a name stands for its damaged copies first
    order = W.partitionBy("name").orderBy("digest")
    met = met.withColumn("upto", F.sum("left").over(order.rowsBetween(W.unboundedPreceding, 0)))
    more = met.join(faults, F.col("name") == F.col("_name"), "left").withColumn("copies", F.least("left", F.col("upto") - F.coalesce("damaged", F.lit(0))))
    more = more.filter("copies > 0").select("*", copy).select("page_id", "file", F.lit(None).cast("long").alias("record_offset"), "bytes", "digest", F.lit("extra").alias("state"))
    rows = rows.unionByName(more).join(roots, F.col("file") == F.col("_file"), "left")
    return rows.select(
        "page_id", "file", "record_offset", F.col("bytes").alias("n_bytes"), F.col("digest").alias("record_sha256"), "file_root", "state",
        (F.col("state") == "intact").alias("intact"),
    )


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with faults, chosen by the page's hash: of every 64 pages about one has a
    character of its body overwritten, of every 256 one is lost, and of every 256 one has a
    second record under another name."""
    name = page_name(pages)
    digits = F.substring(name, 9, 2)
    middle = F.floor(F.length("html") / 2).cast("int")
    broken = F.concat(F.substring(F.col("html"), F.lit(1), middle), F.lit("\x00"), F.substring(F.col("html"), middle + 2, F.length("html")))
    hit = digits.isin("00", "40", "80", "c0") & (F.length("html") > 0)
    kept = pages.filter(digits != "21").select("page_id", "url", F.when(hit, broken).otherwise(F.col("html")).alias("html"), name.alias("name"))
    return kept.unionByName(pages.filter(digits == "a5").select("page_id", "url", "html", F.md5(F.concat(name, F.lit("+"))).alias("name")))
