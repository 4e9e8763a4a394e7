"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Stored, bucket_of, ship

#: Labelled documents that are learned from at most (in expectation; they are chosen by a hash of their id).
MAX_TRAINING_DOCUMENTS = 20_000
FEATURES, SEED, RIDGE = 256, 77, 1e-3
#: Partitions that sum normal equations; each sends one matrix of FEATURES squared to the driver.
SUMMING = 8
#: A document is predicted good from this score on.
THRESHOLD = 0.7

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#*$%&|<>{}[]\\^~_=+@/"
_MARK = b"!?"
_POINT = b".,;:"


def statistics(text: bytes | None) -> list[float]:
    """Statistics of a whole text, none of which grows with its length but the first."""
    t = text or b""
    words = t.split()
    n, size = len(words), max(1, len(t))
    lines = [x for x in t.split(b"\n") if x.strip()]
    count = lambda kind: len(t) - len(t.translate(None, kind))
    upper, lower = count(_UPPER), count(_LOWER)
    kinds = len(set(words))
    runs = len(set(zip(words, words[1:], words[2:], strict=False)))
    bare = sum(w.isalpha() for w in words if w.isascii())
    plain = sum(map(bytes.isascii, words))
    return [
        math.log1p(n),
        len(t) / max(1, n),
        upper / max(1, upper + lower),
        (upper + lower) / size,
        math.sqrt(count(_DIGIT) / size),
        math.sqrt(count(_SYMBOL) / size),
        math.sqrt(count(_MARK) / size),
        math.sqrt(count(_POINT) / size),
        kinds / max(1.0, n**0.9),
        runs / max(1, n - 2) if n > 2 else 1.0,
        len(set(lines)) / max(1, len(lines)),
        math.log1p(n / max(1, len(lines))),
        bare / max(1, plain),
        sum(len(w) == 1 for w in words) / max(1, n),
        math.log1p(max(map(len, words), default=0)),
    ]


def standard(rows: list[list[float]] | np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((np.asarray(rows, float).reshape(-1, len(mean)) - mean) / scale, -6, 6)


def fourier(x: np.ndarray, features: int = FEATURES, seed: int = SEED) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel with width root of the dimension, and a constant."""
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((x.shape[1], features)) / math.sqrt(x.shape[1])
    z = np.cos(x @ w + rng.uniform(0, 2 * math.pi, features)) * math.sqrt(2 / features)
    return np.hstack([z, np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the mean place and the fitted value of each block, both ascending."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, sum of x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 2] / b[:, 1], b[:, 0] / b[:, 1]


@dataclass
class Model:
    """What a score needs; without labelled documents the score is `prior` alone."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    places: np.ndarray
    values: np.ndarray
    prior: float | None = None

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.prior is not None or not texts:
            return np.full(len(texts), self.prior if self.prior is not None else 0.0)
        raw = fourier(standard([statistics(t) for t in texts], self.mean, self.scale)) @ self.weights
        return np.clip(np.interp(raw, self.places, self.values), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", most: int = MAX_TRAINING_DOCUMENTS) -> Model:
    """Learns labels.quality from documents that are not held out (crc32 of the id, modulo 4, is 2).

    About `most` labelled documents at most are learned from. Their statistics are summed to means, then to normal
    equations, by partition; three quarters of them fit the ridge weights, one quarter calibrates. A document with two labels counts
    with the lower one; null labels and labels without a document are not used.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("double").alias("y")).where("l_id is not null and y is not null")
    known = known.where(bucket_of("l_id", 4) != 2).groupBy("l_id").agg(F.min("y").alias("y"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("l_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * most / n))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["i", "y", "x"])

    source = docs.select(F.col(id_col).alias("i"), F.col(text).cast("string").cast("binary").alias("t"))
    found = source.join(F.broadcast(known), source.i == known.l_id).select(F.col("i").cast("long"), "y", "t")  # at most about `most` ids
    rows = Stored(found.mapInArrow(measure, "i long, y double, x array<double>"), "quality-rows")
    table = rows.read()
    width = len(statistics(None))
    sums = table.agg(F.count(F.lit(1)), F.avg("y"), *[f(F.col("x")[i]) for i in range(width) for f in (F.avg, F.stddev_pop)]).first()
    none = np.zeros(0)
    if not sums[0] or sums[1] in (0.0, 1.0):
        return Model(none, none, none, none, none, 1.0 if sums[1] is None else float(sums[1]))
    mean, scale = np.array(sums[2::2], float), np.maximum(np.array(sums[3::2], float), 1e-6)
    calibrates = F.pmod(F.xxhash64("i", F.lit(11)), F.lit(4)) == 0

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            if batch.num_rows:
                z = fourier(standard(batch.column(1).to_pylist(), mean, scale))
                a += z.T @ z
                b += z.T @ batch.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"])

    parts = table.where(~calibrates).select("y", "x").coalesce(SUMMING).mapInArrow(normal, "a binary, b binary").collect()  # SUMMING matrices
    a = sum(np.frombuffer(r.a).reshape(FEATURES + 1, FEATURES + 1) for r in parts)
    b = sum(np.frombuffer(r.b) for r in parts)
    weights = np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) * np.eye(len(b)) / FEATURES, b)
    held = table.where(calibrates).select("y", "x").toPandas()  # a quarter of the training documents
    if held["y"].nunique() < 2:
        held = table.select("y", "x").toPandas()
    raw = fourier(standard(held["x"].tolist(), mean, scale)) @ weights
    places, values = isotonic(raw, held["y"].to_numpy())
    return Model(mean, scale, weights, places, values)


def scorer(docs: DataFrame, model: Model):
    """A function of a text column that gives each text's score."""
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score([None if t is None else t.encode() for t in texts]))

    return score


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null and empty texts are scored by the statistics of an empty text. Without any usable label every score is 1. Repeated
    rows come back repeated, a null id counts as an empty one, an empty table gives an empty result; other columns are never read.
    """
    score = scorer(docs, fit(docs, labels, text, id_col))(F.col(text).cast("string"))
    out = docs.select(F.col(id_col).alias("doc_id"), (bucket_of(id_col, 4) == 2).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that are predicted good; all columns of docs, no others."""
    return docs.where(scorer(docs, fit(docs, labels, text, id_col))(F.col(text).cast("string")) >= THRESHOLD)
