"""Language ID by Bayesian evidence fusion.

Four kinds of evidence add up as logarithms: the likelihood of the page's text under byte
trigram models learned from all labelled documents; the language that the markup declares;
the suffix of the address; and a prior for the page's host, smoothed towards its suffix and
that towards all pages. How far to trust markup and suffix is not assumed but counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefold.llm.common import broadcast_if_small, chunks, saved
from changefold.llm.html import Page, host_of

#: Buckets of hashed trigrams; weight of one trigram, as neighbours aren't independent.
BITS, TEMPER = 15, 0.2
#: Pseudo-counts by which a host leans on its suffix and a suffix on all pages.
LEAN = 10.0
#: Hosts whose votes may be broadcast.
MOST_HOSTS = 100_000
#: Languages of the labelled documents; more are refused, as each is a table of 256 kB in every task.
MOST_LANGS = 256


def trigrams(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every byte trigram; A-Z lower-cased, and all bytes of ASCII other
    than letters read as a blank."""
    fold = np.full(256, 32, dtype=np.uint32)
    fold[97:123], fold[65:91], fold[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)
    buf = fold[np.frombuffer(b" ".join([*run, b""]), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(run)), [len(x) + 1 for x in run])
    if len(buf) < 3:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    code = (buf[:-2] << np.uint32(16)) | (buf[1:-1] << np.uint32(8)) | buf[2:]
    own = owner[:-2] == owner[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)[own], owner[:-2][own]


def text_models(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability of each bucket in each), counted over all documents with
    a language. A row per language and task is shuffled; the driver gets one table of
    2^BITS numbers per language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for start, run in chunks(batch.column(1).to_pylist()):
                names, ids = np.unique(np.array(langs[start : start + len(run)], dtype=object), return_inverse=True)
                bucket, owner = trigrams(run)
                table = np.bincount(ids[owner] * (1 << BITS) + bucket, minlength=len(names) << BITS).reshape(len(names), -1)
                for name, row in zip(names, table, strict=True):
                    sums[name] = sums.get(name, 0) + row
        yield from _sums(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[name] = sums.get(name, 0) + np.frombuffer(data, dtype=np.int64)
        yield from _sums(sums)

    def _sums(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["lang", "counts"])

    counted = docs.filter("lang is not null").select("lang", "text").mapInArrow(count, "lang string, counts binary")
    added = saved(counted.repartition(8, "lang").mapInArrow(add, "lang string, counts binary"), "language-counts")
    if added.count() > MOST_LANGS:
        raise ValueError(f"documents have more than {MOST_LANGS} languages")
    rows = added.orderBy("lang").collect()
    langs = [r["lang"] for r in rows]
    counts = np.array([np.frombuffer(r["counts"], dtype=np.int64) for r in rows], dtype=float).reshape(-1, 1 << BITS) + 0.5
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def page_likelihoods(pages: DataFrame, models: np.ndarray) -> DataFrame:
    """page_id, url, declared (language code of the markup, or null) and, per language, the
    tempered log-likelihood of the page's main text."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [Page(h).text() for h in part.column(2).to_pylist()]
                rows = []
                for _, run in chunks(texts):
                    bucket, owner = trigrams(run)
                    rows += np.column_stack([np.bincount(owner, weights=m[bucket], minlength=len(run)) for m in models]).tolist() if len(models) else [[]] * len(run)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array([[TEMPER * v for v in row] for row in rows], pa.list_(pa.float64()))],
                    ["page_id", "url", "declared", "text_ll"],
                )

    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.nullif(declared, F.lit("")).alias("declared"))
    return rows.mapInArrow(convert, "page_id long, url string, declared string, text_ll array<double>")


def softmax(scores: Column) -> Column:
    """Scores as probabilities. The top and the sum are taken once, not once per score."""
    top = F.array_repeat(F.array_max(scores), F.size(scores))
    parts = F.zip_with(scores, top, lambda x, t: F.exp(x - t))
    return F.zip_with(parts, F.array_repeat(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b), F.size(scores)), lambda x, z: x / z)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _votes(rows: DataFrame, by: str, n: int) -> DataFrame:
    """Sums of the pages' text posteriors by a column, as an array."""
    return rows.groupBy(F.col(by).alias(f"_{by}")).agg(
        F.array(*[F.sum(F.element_at("vote", k + 1)) for k in range(n)]).alias(f"{by}_votes"), F.count("*").cast("double").alias(f"{by}_n"),
    )


def _weight(column: str, yes: float, no: float) -> Callable[[Column], Column]:
    """What a stated language adds to the score of each."""
    return lambda name: F.when(F.col(column) == name, F.lit(yes)).otherwise(F.lit(no))


def identify_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """The language of each page: page_id, url, lang, posterior, text_lang (by text alone),
    declared.

    One row per input row. Null html or text without trigrams gives no text evidence; null
    addresses share an empty host; ties go to the language that is first in order. Without
    labelled documents lang is null; more than ``MOST_LANGS`` languages are refused. Extra columns are left out. Hosts are counted with
    partial sums, so a host with a third of all pages is no burden to one task.
    """
    langs, models = text_models(docs)
    if not langs:
        empty = F.lit(None).cast("string")
        return pages.select(
            F.col("page_id").cast("long").alias("page_id"), "url", empty.alias("lang"), F.lit(None).cast("double").alias("posterior"), empty.alias("text_lang"),
            empty.alias("declared"),
        )
    n = len(langs)
    rows = page_likelihoods(pages, models).withColumn("host", host_of(F.col("url"))).withColumn("suffix", suffix_of(F.col("host")))
    rows = rows.withColumn("code", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^?#]*?//[^/?#]*/([a-zA-Z]{2})(?:[-/?#]|$)", 1)))
    rows = saved(rows.withColumn("vote", softmax(F.col("text_ll"))), "language-pages")
    names = F.array(*[F.lit(x) for x in langs])
    total = rows.agg(F.array(*[F.sum(F.element_at("vote", k + 1)) for k in range(n)]).alias("v"), F.count("*").alias("c")).collect()[0]
    prior = [((v or 0.0) + 1.0) / (total["c"] + n) for v in total["v"]]

    def reliability(column: str) -> tuple[float, float]:
        """Log-likelihood of a stated language where it is the true one, and where not,
        counted over pages that state a known language."""
        at = F.array_position(names, F.col(column))
        seen = rows.filter(at > 0).agg(F.sum(F.element_at("vote", at.cast("int"))).alias("right"), F.count("*").alias("all")).collect()[0]
        right = ((seen["right"] or 0.0) + 1.0) / (seen["all"] + 2.0)
        return float(np.log(right)), float(np.log((1 - right) / max(1, n - 1)))

    stated = {c: reliability(c) for c in ("declared", "code")}
    by_suffix, by_host = (broadcast_if_small(saved(_votes(rows, c, n), f"language-{c}"), MOST_HOSTS) for c in ("suffix", "host"))
    joined = rows.join(by_suffix, F.col("suffix") == F.col("_suffix")).join(by_host, F.col("host") == F.col("_host"))

    # per language: prior, and the page's own vote taken out of its suffix's and host's counts
    priors = F.array(*[F.lit(float(x)) for x in prior])
    of_suffix = F.zip_with(F.zip_with("suffix_votes", "vote", lambda s, v: s - v), priors, lambda s, q: (s + LEAN * q) / (F.col("suffix_n") - 1 + LEAN))
    of_host = F.zip_with(F.zip_with("host_votes", "vote", lambda h, v: h - v), of_suffix, lambda h, s: (h + LEAN * s) / (F.col("host_n") - 1 + LEAN))
    score = F.zip_with("text_ll", of_host, lambda t, h: t + F.log(F.greatest(h, F.lit(1e-9))))
    for column, (yes, no) in stated.items():
        weights = F.transform(names, _weight(column, yes, no))
        said = F.zip_with(score, weights, lambda x, w: x + w)
        score = F.when(F.array_contains(names, F.col(column)), said).otherwise(score)
    done = joined.withColumn("_score", score).withColumn("p", softmax(F.col("_score")))

    def best(scores: Column) -> Column:
        return F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))

    return done.select("page_id", "url", best(F.col("p")).alias("lang"), F.array_max("p").alias("posterior"), best(F.col("vote")).alias("text_lang"), "declared")
