"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Every text becomes a short vector of statistics. Cosines of random projections of the standardised vector
approximate a Gaussian kernel; the normal equations of a ridge regression on them are summed per partition and
then by row, so what reaches the driver is one matrix of a fixed size. Raw scores of rows set apart for it are counted in
fixed bins, and pooling adjacent violators turns the bins into a monotone map to probabilities.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotline.session import Staging

FEATURES, RIDGE, WIDTH, SEED = 384, 1e-2, 3.0, 11
BINS, LOW, HIGH = 1024, -0.5, 1.5
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
KEEP = 0.3

_CLASSES = np.full(256, 7)
_CLASSES[128:] = 0
_CLASSES[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
_CLASSES[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_CLASSES[[ord(c) for c in "0123456789"]] = 3
_CLASSES[[9, 10, 11, 12, 13, 32]] = 4
_CLASSES[[ord(c) for c in ".,;:'\"()-?"]] = 5
_CLASSES[[ord(c) for c in "!|"]] = 6


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; a null text is empty and an empty one gives zeros."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * STATISTICS
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = np.bincount(_CLASSES, weights=counts, minlength=8) / n
    p = counts[counts > 0] / n
    words = text.split()
    m = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    top = seen.most_common(1)[0][1] if seen else 0
    same = sum(map(str.__eq__, words, words[1:]))
    lines = text.split("\n")
    bigrams = len(set(zip(words, words[1:])))
    titled = sum(map(str.istitle, words))
    capital = sum(map(str.isupper, words))
    plain = sum(map(str.isalpha, words))
    marked = counts[[ord(c) for c in "#$%&*"]].sum()
    packed = len(zlib.compress(raw, 1))
    return [
        np.log1p(n),
        np.log1p(len(words)),
        lengths.mean(),
        lengths.std(),
        np.log1p(lengths.max()),
        *shares,
        float(-(p * np.log(p)).sum()),
        len(seen) / m,
        np.log1p(len(seen)) / np.log1p(m),
        top / m,
        same / m,
        bigrams / m,
        titled / m,
        capital / m,
        plain / m,
        marked / n,
        marked / m,
        counts[ord("|")] / m,
        counts[ord("!")] / m,
        counts[ord(".")] / m,
        len(set(lines)) / len(lines),
        np.log1p(m / len(lines)),
        min(packed / n, 2.0),
    ]


STATISTICS = 30


def describe(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), STATISTICS)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = fourier(stats, self.mean, self.scale) @ self.weights
        return np.clip(np.interp(raw, self.edges, self.values), 0.0, 1.0)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Cosine features of the standardised statistics, and a constant."""
    draw = np.random.default_rng(SEED)
    directions = draw.normal(size=(STATISTICS, FEATURES)) / (WIDTH * np.sqrt(STATISTICS / 10))
    phases = draw.uniform(0, 2 * np.pi, FEATURES)
    x = np.clip((stats - mean) / scale, -6, 6)
    z = np.sqrt(2.0 / FEATURES) * np.cos(x @ directions + phases)
    return np.hstack([z, x / 6, np.ones((len(x), 1))])


def _stack(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), STATISTICS)


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % FOLDS


def with_statistics(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series(list(describe(texts)))

    return docs.select(*keep, stats(F.col(text_col)).alias("stats"))


def pool(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Isotonic fit (pool adjacent violators) of bin means, weighted by counts; one value per bin."""
    blocks: list[list[float]] = []
    for s, c in zip(sums, counts):
        blocks.append([s, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, c2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + c2, blocks[-1][2] + k2]
    return np.concatenate([np.full(k, s / c) for s, c, k in blocks])


def fit(described: DataFrame, labels: DataFrame) -> Model | None:
    """Model from rows (id, stats) and (doc_id, quality); rows whose fold is ``HELD_OUT`` are never read as labels.

    Several labels of one id are averaged, null labels and null ids are left out. Without labelled rows of both folds
    there is no model (None).
    """
    truth = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    truth = truth.groupBy(F.col("doc_id").alias("id")).agg(F.avg("quality").alias("truth"))
    known = described.join(truth, "id")
    moments = known.select(F.posexplode("stats").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("scale"))
    rows = sorted(moments.collect())
    if not rows:
        return None
    mean = np.array([r["mean"] for r in rows])
    scale = np.array([r["scale"] if r["scale"] > 1e-9 else 1.0 for r in rows])
    size = FEATURES + STATISTICS + 1

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size + 1))
        for frame in frames:
            if len(frame):
                z = fourier(_stack(frame["stats"]), mean, scale)
                total += z.T @ np.hstack([z, frame["truth"].to_numpy(float)[:, None]])
        yield pd.DataFrame({"at": np.arange(size), "row": [r.tobytes() for r in total]})

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [key[0]], "row": [sum(np.frombuffer(r) for r in frame["row"]).tobytes()]})

    of_fold = fold(F.col("id"))
    parts = known.filter(of_fold != CALIBRATION).select("stats", "truth").mapInPandas(partial, "at long, row binary")
    summed = sorted(parts.groupBy("at").applyInPandas(add, "at long, row binary").collect())
    normal = np.array([np.frombuffer(r["row"]) for r in summed])
    if not len(normal) or not normal[-1, -2]:
        return None
    weights = np.linalg.solve(normal[:, :-1] / normal[-1, -2] + RIDGE / size * np.eye(size), normal[:, -1] / normal[-1, -2])

    @F.pandas_udf(T.IntegerType())
    def binned(stats: pd.Series) -> pd.Series:
        raw = fourier(_stack(stats), mean, scale) @ weights
        return pd.Series(np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype("int32"))

    counted = (
        known.filter(of_fold == CALIBRATION)
        .select(binned("stats").alias("bin"), "truth")
        .groupBy("bin")
        .agg(F.sum("truth").alias("sum"), F.count(F.lit(1)).alias("rows"))
    )
    bins = sorted(counted.collect())
    if not bins:
        return None
    values = pool(np.array([r["sum"] for r in bins], float), np.array([r["rows"] for r in bins], float))
    centres = LOW + (np.array([r["bin"] for r in bins]) + 0.5) * (HIGH - LOW) / BINS
    # A slope too small to move a decision keeps scores of one block apart.
    values = values * (1 - 1e-4) + 1e-4 * np.clip((centres - LOW) / (HIGH - LOW), 0, 1)
    return Model(mean, scale, weights, centres, values)


def score(text: Column, model: Model | None) -> Column:
    """Score column of whole texts; 0.5 for all when there is no model."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(describe(texts)))

    return scored(text)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row doc_id, held_out, score, predicted. A null id is not held out; repeated rows get equal scores."""
    held = Staging(docs.sparkSession, "quality")
    described = held.keep(with_statistics(docs, "text", F.col("doc_id").alias("id")), "statistics")
    model = fit(described, labels)
    if model is None:
        points = F.lit(0.5)
    else:

        @F.pandas_udf(T.DoubleType())
        def scored(stats: pd.Series) -> pd.Series:
            return pd.Series(model.score(_stack(stats)))

        points = scored("stats")
    rated = described.select(F.col("id").alias("doc_id"), F.coalesce(fold(F.col("id")) == HELD_OUT, F.lit(False)).alias("held_out"), points.alias("score"))
    return rated.withColumn("predicted", F.when(F.col("score") >= KEEP, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns stay as they are."""
    held = Staging(docs.sparkSession, "quality")
    described = held.keep(with_statistics(docs, "text", F.col("doc_id").alias("id")), "statistics")
    model = fit(described, labels)
    held.drop()
    return docs.filter(score(F.col("text"), model) >= KEEP)
