"""Quality scores by regularised quadratic discriminant analysis over statistics of whole texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.common import saved

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:",
    "loud": b"!?",
    "mark": b"|#$%&*+<=>@^_`~{}[]\\/",
    "line": b"\n",
}
#: Shares of bytes and of words in ordinary prose. Shares of a text are smoothed by so many bytes and words of it,
#: so that a text of a few words is not far from everything.
BYTES, WORDS = 100, 20
USUAL_BYTES = np.array([0.02, 0.77, 0.002, 0.02, 0.001, 0.001, 0.004, 0.03])
USUAL_WORDS = np.array([0.8, 0.002, 0.08, 0.002, 0.005])
USUAL_LENGTH = 6.0
NAMES = ["word_length", *CLASSES, "other", "distinct", "again", "top", "shout", "tail"]


def statistics(texts: list[str]) -> np.ndarray:
    """A row of transformed statistics for each text: logarithms of smoothed shares and of the mean word length."""
    kinds = np.zeros(256, dtype=np.int64)
    for i, chars in enumerate(CLASSES.values(), 1):
        kinds[list(chars)] = i
    kinds[128:] = len(CLASSES) + 1
    out = np.empty((len(texts), len(NAMES)))
    for row, text in enumerate(texts):
        data = text.encode()
        hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        shares = np.bincount(kinds, weights=hist, minlength=len(CLASSES) + 2)[1:]
        words = data.split()
        n = len(words)
        counts = Counter(words)
        repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
        top = max(counts.values(), default=0)
        shout = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
        tail = sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1] not in b".,")
        out[row] = [
            np.log((len(data) + USUAL_LENGTH * WORDS) / (n + WORDS)),
            *np.log((shares + BYTES * USUAL_BYTES) / (len(data) + BYTES)),
            *np.log((np.array([len(counts), repeats, top, shout, tail]) + WORDS * USUAL_WORDS) / (n + WORDS)),
        ]
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of the whole text (null: empty)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(["" if t is None else t for t in batch.column("text").to_pylist()])
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, x array<double>")


@dataclass
class Model:
    """Class means and inverses of the Cholesky factors of the shrunk class covariances, with log determinants."""

    prior: float
    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray

    def gap(self, x: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0, from squared Mahalanobis lengths."""
        density = [-0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) - 0.5 * d for m, w, d in zip(self.means, self.whiten, self.log_det, strict=True)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior))
        if len(self.means):
            odds = odds + self.gap(x)
        return 1 / (1 + np.exp(-np.clip(odds + np.zeros(len(x)), -700, 700)))


def fit(training: DataFrame, shrink: float = 0.1, ridge: float = 1e-3) -> Model:
    """Fits on rows (x, quality) of any number: each task sums counts, vectors and products, Spark adds the sums.

    Class covariances are drawn by `shrink` to the pooled one and by `ridge` to a multiple of the identity. Without
    rows of both classes only the smoothed share of class 1 is left as the score.
    """
    d = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            y = batch.column("quality").to_numpy()
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        c, k = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel()), pa.array(k.ravel()), pa.array(total.ravel())], names=["c", "k", "v"])

    got = np.zeros((2, 1 + d + d * d))
    # 2 * (1 + d + d * d) rows, whatever the input
    for r in training.mapInArrow(sums, "c long, k long, v double").groupBy("c", "k").agg(F.sum("v").alias("v")).collect():
        got[r.c, r.k] = r.v
    n = got[:, 0]
    prior = (n[1] + 1) / (n.sum() + 2)
    if n.min() < 2:
        return Model(prior, np.empty((0, d)), np.empty((0, d, d)), np.empty(0))
    means = got[:, 1 : d + 1] / n[:, None]
    scatter = [got[c, d + 1 :].reshape(d, d) - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / n.sum()
    whiten, log_det = [], []
    for c in (0, 1):
        cov = (1 - shrink) * scatter[c] / n[c] + shrink * pooled
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Model(prior, means, np.array(whiten), np.array(log_det))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, shrink: float = 0.1) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Only labels with crc32(doc_id as text) mod 5 other than 0 and a quality of 0 or 1 are learnt from; a document labelled
    twice counts twice. Null and empty texts are scored like any. Labels, lang, source and doc_id are no inputs
    of a score. Rows that repeat a doc_id get a row each.
    """
    known = saved(features(docs), "statistics")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    marks = labels.select(F.col("doc_id").alias("of"), F.col("quality").cast("long").alias("quality")).where(F.col("quality").isin(0, 1))
    model = fit(known.where(~held).join(marks, F.col("doc_id") == F.col("of")).select("x", "quality"), shrink)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = known.mapInArrow(each, f"doc_id {kind}, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows predicted 1, with all their columns; rows that repeat a doc_id stay if any of them is."""
    good = quality_scores(docs, labels, **how).where("predicted = 1").select(F.col("doc_id").alias("of")).distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["of"]), "left_semi")
