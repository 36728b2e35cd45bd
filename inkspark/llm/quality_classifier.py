"""Regularised quadratic discriminant analysis on transformed statistics of a document's text.

Each text gives `FEATURES` statistics (logs of sizes, square roots of shares). From labelled rows a class keeps its mean
and covariance, shrunk towards the pooled diagonal; the Cholesky factors of both covariances are kept in the model.
The score is the logistic of the difference of the two Gaussian log-densities (Mahalanobis distances through the
factors, and log determinants) plus the log prior ratio, divided by `temper`.

Fitting uses all labelled rows that are handed in: each task sums counts, vectors and outer products, which are added up by
class and place, so that the driver gets one 17 x 16 block of numbers for each class, however many rows and tasks there are.

The share of the most frequent word says little of a few words: it's set to 0.3, about what running text has, for texts of 20
words or fewer.

Defined cases: a null or empty text, or one without words, has statistics 0 and is scored as such; labels that are null or
neither 0 nor 1 are not learned from; without rows of one class the score is the share of label 1 (0.5 without any);
repeated rows count again (a doc_id with several rows and labels learns from each pair); rows without doc_id are scored and not
learned from; other columns are ignored; labels, lang, source and doc_id are no inputs; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspark.llm import shingles
from inkspark.llm.common import save, work_dir

FEATURES = (
    "log_words", "word_length", "distinct_words", "repeated_next", "symbols", "marks", "capitals", "digits", "bars",
    "stops", "repeated_lines", "line_words", "top_word", "long_words", "high_bytes", "repeated_shingles",
)
_KINDS = np.zeros(256, np.uint8)
for _kind, _chars in enumerate(("#*$%&<>~^=_\\{}[]@", "!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "|", ".,;:"), 1):
    _KINDS[[ord(c) for c in _chars]] = _kind
_KINDS[0x80:] = 7
_NO_WORD = re.compile(rb"^[\x20\x09-\x0D]*$")


def _row(raw: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, made: np.ndarray) -> list[float]:
    n = len(hashes)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KINDS[raw], minlength=8) / max(1, lengths.sum())
    _, counts = np.unique(hashes, return_counts=True)
    lines = raw.tobytes().split(b"\n")
    full = [x for x in lines if not _NO_WORD.match(x)]
    share = {
        "log_words": np.log1p(n) / 10,
        "word_length": np.log1p(lengths.mean()),
        "distinct_words": len(counts) / n**0.9,
        "repeated_next": np.sqrt((hashes[1:] == hashes[:-1]).mean() if n > 1 else 0.0),
        "symbols": np.sqrt(kinds[1]),
        "marks": np.sqrt(kinds[2]),
        "capitals": np.sqrt(kinds[3]),
        "digits": np.sqrt(kinds[4]),
        "bars": np.sqrt(kinds[5]),
        "stops": np.sqrt(kinds[6]),
        "repeated_lines": np.sqrt(1 - len(set(full)) / max(1, len(full))),
        "line_words": np.log1p(n / max(1, len(full))) / 5,
        "top_word": np.sqrt(counts.max() / n) if n > 20 else 0.3,
        "long_words": np.sqrt((lengths > 20).mean()),
        "high_bytes": np.sqrt(kinds[7]),
        "repeated_shingles": np.sqrt(1 - len(np.unique(made)) / len(made)),
    }
    return [float(share[k]) for k in FEATURES]


def statistics(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = []
    for _, raw, ends in shingles.slices(column):
        starts, stops, rows = shingles.words(raw, ends)
        hashes = shingles.word_hashes(raw, starts, stops)
        made, first = shingles.shingles(hashes, rows)
        lengths = stops - starts
        for i in range(len(ends) - 1):
            own = slice(rows[i], rows[i + 1])
            out.append(_row(raw[ends[i] : ends[i + 1]], lengths[own], hashes[own], made[first[i] : first[i + 1]]))
    return np.array(out).reshape(-1, len(FEATURES))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics as one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = statistics(batch["text"])
            ends = np.arange(0, values.size + 1, len(FEATURES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))], names=["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, features array<double>")


@dataclass
class Model:
    """Class means, inverted Cholesky factors and log determinants; score() needs nothing else."""

    prior: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    log_dets: np.ndarray | None = None
    temper: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        dense = []
        for mean, inverse, log_det in zip(self.means, self.factors, self.log_dets, strict=True):
            z = (x - mean) @ inverse.T
            dense.append(-0.5 * ((z * z).sum(1) + log_det))
        gap = (dense[1] - dense[0] + np.log(self.prior / (1 - self.prior))) / self.temper
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    total = np.zeros((2, d + 1, d))
    counts = np.zeros(2, np.int64)
    for batch in batches:
        x = np.array(batch["features"].flatten()).reshape(-1, d)
        y = batch["label"].to_numpy()
        for c in (0, 1):
            own = x[y == c]
            counts[c] += len(own)
            total[c, 0] += own.sum(0)
            total[c, 1:] += own.T @ own
    yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(counts), pa.array([t.ravel().tolist() for t in total], pa.list_(pa.float64()))], names=["label", "n", "sums"])


def fit(labelled: DataFrame, shrink: float = 0.1, temper: float = 2.0, floor: float = 1e-4) -> Model:
    """The model of labelled rows (features, label)."""
    d = len(FEATURES)
    sums, counts = np.zeros((2, d + 1, d)), np.zeros(2)
    rows = labelled.where("label in (0, 1) and features is not null").select("features", F.col("label").cast("long").alias("label"))
    parts = rows.mapInArrow(_sums, "label long, n long, sums array<double>").select("label", "n", F.posexplode("sums").alias("place", "value"))
    for row in parts.groupBy("label", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).collect():
        sums[row["label"]].flat[row["place"]] = row["value"]
        counts[row["label"]] = row["n"]
    if min(counts) < 2:
        return Model(float(counts[1] / counts.sum()) if counts.sum() else 0.5)
    means = sums[:, 0] / counts[:, None]
    own = [sums[c, 1:] / counts[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = np.diag(np.diag(own[0] * counts[0] + own[1] * counts[1]) / counts.sum())
    lower = [np.linalg.cholesky((1 - shrink) * s + shrink * pooled + floor * np.eye(d)) for s in own]
    dets = np.array([2 * np.log(np.diag(x)).sum() for x in lower])
    return Model(float(counts[1] / counts.sum()), means, np.array([np.linalg.inv(x) for x in lower]), dets, temper)


def scored(rows: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of rows (doc_id, features, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(np.array(batch["features"].flatten()).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "features", "held_out").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, least: float = 0.3) -> DataFrame:
    """Learn labels.quality from the rows outside fold 0 of crc32(doc_id as text) and score every document."""
    root = work_dir(docs.sparkSession, "quality")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    rows = save(features(docs).withColumn("held_out", fold == 0), f"{root}/features")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    return scored(rows, fit(rows.where("not held_out").join(known, "doc_id")), least)


