"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in numpy for many texts at once. Trees are grown on
the driver from a bounded sample of labelled rows, level by level on binned statistics, and
flattened into arrays of complete binary trees, which tasks walk for all rows and trees
together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefold.llm.common import Words, chunks

#: Classes of ASCII characters whose shares are statistics.
CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789", "blank": " \t", "line": "\n\r",
    "stop": ".", "comma": ",;:", "shout": "!?", "bar": "|/\\", "sign": "#$%&*+=@^~<>", "bracket": "()[]{}", "quote": "'\"`", "dash": "-_",
}
NAMES = ["words", "bytes", "word_bytes", *CLASSES, "high", "distinct", "echo", "top", "pairs", "long_words"]


def statistics(run: list[bytes]) -> np.ndarray:
    """One row of statistics per text; zeros for texts without words."""
    n = len(run)
    w = Words(run)
    raw = np.frombuffer(b"\n".join(run) + b"\n", dtype=np.uint8)
    kind = np.full(256, len(CLASSES) + 1, dtype=np.int64)
    for k, chars in enumerate(CLASSES.values()):
        kind[list(chars.encode())] = k
    kind[128:] = len(CLASSES)
    starts = w.text_ends - np.array([len(x) + 1 for x in run], dtype=np.int64)
    lengths = w.text_ends - starts - 1
    owner = np.repeat(np.arange(n), lengths + 1)
    counts = np.bincount(owner * (len(CLASSES) + 2) + kind[raw], minlength=n * (len(CLASSES) + 2)).reshape(n, -1).astype(float)
    counts[:, list(CLASSES).index("line")] -= 1  # the byte that joins the texts
    words, size = np.maximum(w.counts, 1), np.maximum(lengths, 1)

    def distinct(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values per text, and how often the commonest occurs."""
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(first)
        often = np.diff(np.append(at, len(h)))
        most = np.zeros(n)
        np.maximum.at(most, text[at], often)
        return np.bincount(text[at], minlength=n), most

    kinds, most = distinct(w.hash, w.text)
    pair_h, pair_t = w.shingles(2)
    pairs, _ = distinct(pair_h, pair_t)
    same = (w.hash[1:] == w.hash[:-1]) & (w.text[1:] == w.text[:-1])
    echo = np.bincount(w.text[1:][same], minlength=n)
    long_words = np.bincount(w.text[w.lens > 20], minlength=n)
    columns = [np.log1p(w.counts), np.log1p(lengths), np.bincount(w.text, weights=w.lens, minlength=n) / words]
    columns += [counts[:, k] / size for k in range(len(CLASSES) + 1)]
    columns += [kinds / words, echo / words, most / words, pairs / np.maximum(np.bincount(pair_t, minlength=n), 1), long_words / words]
    return np.column_stack(columns)


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays of (tree, node)."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        n_trees, inner = self.feature.shape
        trees = np.arange(n_trees)[None, :]
        node = np.zeros((len(x), n_trees), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.limit[trees, node])
        margin = self.base + self.leaf[trees, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Grow trees for the logistic loss by second-order gains on histograms.

    Without rows the score is 0.5; with one class alone it is near that class.
    """
    inner = 2**depth - 1
    feature = np.zeros((n_trees, inner), dtype=np.int64)
    limit = np.full((n_trees, inner), np.inf)
    leaf = np.zeros((n_trees, inner + 1))
    share = (y.sum() + 1) / (len(y) + 2)
    model = Trees(feature, limit, leaf, float(np.log(share / (1 - share))))
    if not len(y):
        return model
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(n_features)]
    binned = np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)])
    margin = np.full(len(y), model.base)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-12)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            width = 2**level
            first = width - 1
            slot = (node - first)[:, None] * (n_features * bins) + np.arange(n_features) * bins + binned
            shape = (width, n_features, bins)
            g, h = (np.bincount(slot.ravel(), weights=np.repeat(v, n_features), minlength=width * n_features * bins).reshape(shape).cumsum(axis=2) for v in (grad, hess))
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(h < least) | (all_h - h < least)] = 0
            for k, e in enumerate(edges):
                gain[:, k, len(e) :] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i in range(width):
                k, b = divmod(int(best[i]), bins)
                if gain[i, k, b] > 1e-9:
                    feature[t, first + i], limit[t, first + i] = k, edges[k][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > limit[t, node])
        at = node - inner
        g, h = (np.bincount(at, weights=v, minlength=inner + 1) for v in (grad, hess))
        leaf[t] = -rate * g / (h + ridge)
        margin += leaf[t][at]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of doc_id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Trees:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold, taken by hash of
    doc_id. Null labels and ids are left out; a doc_id labelled twice counts twice."""
    picked = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    picked = picked.select(
        F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y"), F.xxhash64("doc_id", "quality").alias("_at"),
    ).orderBy("_at", "_id").limit(max_rows)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def measured(text: pa.Array) -> pa.Array:
        found = [x for _, run in chunks(text.to_pylist()) for x in statistics(run)]
        return pa.array(found, pa.list_(pa.float64()))

    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    rows = rows.select("_y", "_at", measured("text").alias("x")).orderBy("_at", F.hash("x")).limit(max_rows).collect()
    x = np.array([r["x"] for r in rows], dtype=float).reshape(-1, len(NAMES))
    return fit(x, np.array([r["_y"] for r in rows], dtype=float))


def scorer(model: Trees):
    """A column function from text to the model's score; null counts as empty."""

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        found = [model.score(statistics(run)) for _, run in chunks(text.to_pylist())]
        return pa.array(np.concatenate(found) if found else np.empty(0))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """All columns of ``docs`` with ``held_out``, ``score`` and ``predicted`` added (columns
    of these names give way). Statistics come from text alone; null and empty texts have all
    statistics 0 and are scored; repeated rows score alike; empty tables are fine: without
    labels every score is 0.5.
    """
    model = train(docs, labels, max_rows)
    kept = docs.drop("held_out", "score", "predicted")
    scored = kept.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", scorer(model)(F.col("text")))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
