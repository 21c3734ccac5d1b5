"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics (see ``stats``) are standardised and mapped to ``features`` cosines whose random frequencies come from a
fixed seed, which approximates a Gaussian kernel. Each partition of the labelled rows sums its part of the normal
equations; partial sums are added in a second stage of ``adders`` tasks, so the driver gets that many matrices whatever
the input's size. Folds 0 and 1 fit the weights; fold 3 calibrates: its raw scores fall into fixed bins, counted by
Spark, and pooling neighbours that violate the order gives the probability of each bin.

Cases: null and empty texts have counts of 0 and a score like any other; without labelled rows of a fold the score is
the share of label 1 (0.5 without labels); repeated rows are scored one by one; other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.shared import fold, held_out, store
from tabweave.llm.stats import NAMES, RATIOS, with_counts

BINS, LOW, HIGH = 2048, -0.5, 1.5
FEATURES = ("n_words", *RATIOS)


def design(batch: pa.RecordBatch) -> np.ndarray:
    """Statistics of a batch of counts, on scales of a few units: log counts and square roots of shares."""
    c = {n: batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in NAMES}
    share = {n: c[a] / np.maximum(c[b], 1) for n, (a, b) in RATIOS.items()}
    logs = {"n_words": c["n_words"], "word_length": share["word_length"], "line_words": share["line_words"]}
    return np.stack([np.log1p(logs[n]) if n in logs else np.sqrt(share[n]) for n in FEATURES], 1)


@dataclass
class Fourier:
    mean: np.ndarray
    scale: np.ndarray
    features: int = 256
    width: float = 2.5
    seed: int = 7

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        w, b = rng.normal(0, 1 / self.width, (x.shape[1], self.features)), rng.uniform(0, 2 * np.pi, self.features)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate((np.sqrt(2 / self.features) * np.cos(z @ w + b), np.ones((len(x), 1))), 1)


def sum_parts(rows: DataFrame, part, length: int, adders: int = 8) -> np.ndarray:
    """Sum of ``part(batch)``, a vector of ``length`` doubles, over all batches: per partition, then in ``adders`` tasks, then here."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    out = rows.mapInArrow(first, "v binary").repartition(adders).mapInArrow(again, "v binary").collect()
    return sum((np.frombuffer(r["v"]) for r in out), np.zeros(length))


def isotonic(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing probability of each bin: neighbours that violate the order are pooled; empty bins are interpolated."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(total):
        blocks.append([float(good[i]), float(total[i]), i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g, t, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g, blocks[-1][1] + t, blocks[-1][2], hi]
    at = np.array([x for b in blocks for x in (b[2], b[3])], float)
    value = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return np.interp(np.arange(len(total)), at, value)


def to_bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)


@dataclass
class QualityModel:
    fourier: Fourier
    weights: np.ndarray
    curve: np.ndarray

    def raw(self, batch: pa.RecordBatch) -> np.ndarray:
        return self.fourier(design(batch)) @ self.weights

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        return np.clip(self.curve[to_bin(self.raw(batch))], 0.0, 1.0)


def fit_quality(counts: DataFrame, labels: DataFrame, ridge: float = 1e-3, features: int = 256) -> QualityModel:
    """Fit on all labelled rows of ``counts`` outside fold 2."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("__y")).dropDuplicates(["doc_id"])
    rows = store(counts.join(usable, "doc_id").withColumn("__fold", fold(F.col("doc_id"))), "labelled")
    train, test = rows.where("__fold in (0, 1)"), rows.where("__fold = 3")
    d = len(FEATURES)

    def moments(batch):
        x = design(batch)
        return np.concatenate(([len(x)], x.sum(0), (x * x).sum(0)))

    m = sum_parts(train, moments, 2 * d + 1)
    n = max(m[0], 1)
    mean = m[1 : d + 1] / n
    fourier = Fourier(mean, np.sqrt(np.maximum(m[d + 1 :] / n - mean**2, 1e-6)), features)
    k = features + 1

    def normal(batch):
        z, y = fourier(design(batch)), batch.column("__y").to_numpy(zero_copy_only=False).astype(float)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y))

    s = sum_parts(train, normal, k * k + k)
    a = s[: k * k].reshape(k, k) / n + ridge * np.diag([1.0] * features + [0.0])
    weights = np.linalg.lstsq(a, s[k * k :] / n, rcond=None)[0]
    model = QualityModel(fourier, weights, np.full(BINS, 0.5))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(to_bin(model.raw(batch))), batch.column("__y")], ["bin", "y"])

    good, total = np.zeros(BINS), np.zeros(BINS)
    for r in test.mapInArrow(binned, "bin long, y int").groupBy("bin").agg(F.sum("y").alias("good"), F.count("*").alias("n")).collect():
        good[r["bin"]], total[r["bin"]] = r["good"], r["n"]
    if total.any():
        model.curve = isotonic(good, total)
    elif m[0]:
        model.curve = np.full(BINS, float(weights[-1]))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    counts = store(with_counts(docs), "counts")
    model = fit_quality(counts, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch))], ["doc_id", "score"])

    out = counts.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
