"""Site clusters: k-means with a silhouette choice of k, principal components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotline import fixed
from slotline.session import stage

BLOCK_ROWS = 2048


def silhouette_squared(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """Mean silhouette under squared Euclidean distance, linear in the number of rows.

    The mean squared distance from a point to a cluster follows from the cluster's size, sum vector
    and sum of squared norms, so only one row per cluster is shared (clusters are few).
    """
    norm = sum((F.col(c) * F.col(c) for c in features), F.lit(0.0))
    stats = df.groupBy(F.col(label).alias("c")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(c) for c in features]).alias("s"),
        F.sum(norm).alias("q"),
    )
    every = stats.agg(F.collect_list(F.struct("c", "n", "s", "q"))).scalar()
    x = F.array(*[F.col(c) for c in features])

    def total(p):
        dot = F.aggregate(F.zip_with(x, p["s"], lambda a, b: a * b), F.lit(0.0), lambda u, v: u + v)
        return p["n"] * norm + p["q"] - 2 * dot

    own = F.filter(F.col("_all"), lambda p: p["c"] == F.col(label))[0]
    inner = F.when(own["n"] > 1, F.greatest(total(own), F.lit(0.0)) / (own["n"] - 1))
    outer = F.array_min(
        F.transform(
            F.filter(F.col("_all"), lambda p: p["c"] != F.col(label)),
            lambda p: F.greatest(total(p), F.lit(0.0)) / p["n"],
        )
    )
    value = F.when(
        F.col("_a").isNull(), F.lit(0.0)
    ).otherwise(F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0)))
    return (
        df.withColumn("_all", every)
        .withColumn("_a", inner)
        .withColumn("_b", outer)
        .agg(F.avg(value).alias("silhouette"))
    )


def _block_sums(features: list[str], classes: list):
    """Distance sums from the rows of one block to each cluster of another block."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out_columns = ["_by", "_id", "_label", "_sums"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=out_columns)
        a, b = left[features].to_numpy(float), right[features].to_numpy(float)
        member = (right["_label"].to_numpy()[:, None] == np.asarray(classes)[None, :]).astype(float)
        sums = np.zeros((len(a), len(classes)))
        for i in range(0, len(b), 256):
            part = b[i : i + 256]
            gap = np.sqrt(((a[:, None, :] - part[None, :, :]) ** 2).sum(axis=2))
            sums += gap @ member[i : i + 256]
        return pd.DataFrame(
            {"_by": left["_by"], "_id": left["_id"], "_label": left["_label"], "_sums": list(sums)}
        )

    return run


def silhouette_euclidean(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    key: str,
    by: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean silhouette under plain Euclidean distance, exact; one row per ``by`` (labelling) if given.

    The measure needs every distance between two sites, so the cost grows with the square of the number of
    sites (not of readings); ``silhouette_squared`` is the linear measure for large site tables. Rows are
    cut into blocks and each task handles one pair of blocks, from which only per-cluster sums leave.
    """
    rows = stage(
        df.select(
            (F.col(by) if by else F.lit(0)).alias("_by"),
            F.col(key).cast("string").alias("_id"),
            F.col(label).cast("int").alias("_label"),
            *features,
        ),
        "labelled",
    )
    classes = sorted(r[0] for r in rows.select("_label").distinct().collect())  # one value per cluster
    blocks = max(1, -(-rows.count() // block_rows))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    placed = rows.withColumn("_own", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))
    asking = placed.withColumn("_other", F.explode(every))
    giving = placed.withColumnRenamed("_own", "_other").withColumn("_own", F.explode(every))
    pair = ["_by", "_own", "_other"]
    sums = (
        asking.groupBy(*pair)
        .cogroup(giving.groupBy(*pair))
        .applyInPandas(
            _block_sums(list(features), classes),
            f"_by {dict(rows.dtypes)['_by']}, _id string, _label int, _sums array<double>",
        )
    )
    per_row = sums.groupBy("_by", "_id", "_label").agg(
        *[F.sum(F.col("_sums")[i]).alias(f"_s{i}") for i in range(len(classes))]
    )
    # One row per labelling.
    sizes = rows.groupBy("_by").agg(
        *[F.count_if(F.col("_label") == c).alias(f"_n{i}") for i, c in enumerate(classes)]
    )
    own, others, mates = [], [], []
    for i, c in enumerate(classes):
        mine = F.col("_label") == c
        own.append(F.when(mine, F.try_divide(F.col(f"_s{i}"), F.col(f"_n{i}") - 1)))
        others.append(F.when(~mine, F.try_divide(F.col(f"_s{i}"), F.col(f"_n{i}"))))
        mates.append(F.when(mine, F.col(f"_n{i}")))
    value = F.when(F.coalesce(*mates) <= 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))
    )
    scored = (
        per_row.join(F.broadcast(sizes), "_by")
        .withColumn("_a", F.coalesce(*own))
        .withColumn("_b", F.array_min(F.array(*others)))
        .groupBy("_by")
        .agg(F.avg(value).alias("silhouette"))
    )
    return scored.withColumnRenamed("_by", by) if by else scored.drop("_by")


def standardised(profiles: DataFrame, features: Sequence[str], output: str = "scaled") -> DataFrame:
    """Centred columns with unit population spread; a constant column becomes 0."""
    picks = []
    for c in features:
        picks += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    frame = profiles.agg(F.struct(*picks)).scalar()
    scaled = {}
    for c in features:
        m, s = F.col("_f")[f"m_{c}"], F.col("_f")[f"s_{c}"]
        scaled[f"z_{c}"] = F.when(s > 0, (F.col(c) - m) / s).otherwise(0.0)
    return profiles.withColumn("_f", frame).withColumns(scaled).drop("_f")


STARTS, SEEDED, STEPS, TOLERANCE = 20, 4096, 300, 1e-8


def _first_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of ``sample``, each drawn in proportion to its squared distance from those before."""
    centres = [sample[rng.integers(len(sample))]]
    for _ in range(k - 1):
        gap = ((sample[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2).min(axis=1)
        total = gap.sum()
        centres.append(sample[rng.choice(len(sample), p=gap / total) if total > 0 else rng.integers(len(sample))])
    return np.array(centres)


def kmeans(rows: DataFrame, features: Sequence[str], ks: Sequence[int], starts: int = STARTS, seed: int = fixed.SEED) -> dict[int, dict]:
    """For every k the centres of the cheapest of ``starts`` starts, its cost and the costs of all: all starts of all k in the same passes.

    One pass over the rows sums rows, squared distances and coordinates by (k, start, cluster); only these sums, whose number the call fixes, come to the
    driver. Runs that no longer move are left out of the next pass. First centres come from at most ``SEEDED`` rows, those with the
    smallest hash; the passes see all rows. A cluster that loses all rows keeps its centre.
    """
    names = list(features)
    order = F.xxhash64(F.lit(seed), *[F.col(c) for c in names])
    sample = rows.select(*names).orderBy(order, *names).limit(SEEDED).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    runs = {(k, s): _first_centres(sample, k, rng) for k in ks for s in range(starts)}
    costs: dict[tuple[int, int], float] = {}
    schema = "k int, start int, cluster int, n long, cost double, sums array<double>"

    def summed(moving: dict[tuple[int, int], np.ndarray]) -> list:
        def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = {run: (np.zeros(len(c), np.int64), np.zeros(len(c)), np.zeros(c.shape)) for run, c in moving.items()}
            for frame in frames:
                x = frame.to_numpy(float)
                for i in range(0, len(x), BLOCK_ROWS):
                    part = x[i : i + BLOCK_ROWS]
                    for run, centres in moving.items():
                        gap = ((part[:, None, :] - centres[None]) ** 2).sum(axis=2)
                        own = gap.argmin(axis=1)
                        n, cost, sums = out[run]
                        np.add.at(n, own, 1)
                        np.add.at(cost, own, gap[np.arange(len(part)), own])
                        np.add.at(sums, own, part)
            told = [(*run, j, int(n[j]), float(cost[j]), sums[j].tolist()) for run, (n, cost, sums) in out.items() for j in range(len(n)) if n[j]]
            yield pd.DataFrame(told, columns=[c.split()[0] for c in schema.split(", ")])

        parts = rows.select(*names).mapInPandas(one, schema)
        sums = F.array(*[F.sum(F.col("sums")[i]) for i in range(len(names))])
        return parts.groupBy("k", "start", "cluster").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), sums.alias("sums")).collect()

    moving = dict(runs)
    for _ in range(STEPS):
        moved, spent = {run: c.copy() for run, c in moving.items()}, dict.fromkeys(moving, 0.0)
        for r in summed(moving):
            run = (r["k"], r["start"])
            moved[run][r["cluster"]] = np.array(r["sums"]) / r["n"]
            spent[run] += r["cost"]
        costs.update(spent)
        runs.update(moving)
        moving = {run: c for run, c in moved.items() if np.abs(c - moving[run]).max() > TOLERANCE}
        if not moving:
            break
    out = {}
    for k in ks:
        best = min(range(starts), key=lambda s: (costs[k, s], s))
        out[k] = {"centres": runs[k, best], "cost": costs[k, best], "costs": [costs[k, s] for s in range(starts)]}
    return out


def nearest(rows: DataFrame, features: Sequence[str], centres: np.ndarray, output: str = "cluster") -> DataFrame:
    """``rows`` with the number of the nearest centre, the first of equals."""
    gaps = F.array(*[reduce(lambda a, b: a + b, [(F.col(c) - F.lit(float(v))) * (F.col(c) - F.lit(float(v))) for c, v in zip(features, centre)]) for centre in centres])
    return rows.withColumn("_gaps", gaps).withColumn(output, (F.array_position("_gaps", F.array_min("_gaps")) - 1).cast("int")).drop("_gaps")


def choose_clusters(
    profiles: DataFrame,
    key: str = "system_code",
    features: Sequence[str] = tuple(fixed.PROFILE_FEATURES),
    largest_k: int = 5,
    measure: str = "squared",
) -> tuple[DataFrame, dict]:
    """k-means for k = 2..min(5, n - 1); the best silhouette wins, the smaller k on a tie."""
    names = [f"z_{c}" for c in features]
    wide = VectorAssembler(inputCols=names, outputCol="features")
    rows = stage(standardised(profiles, features))
    n = rows.count()
    if n < 3:
        raise ValueError("clustering needs at least three sites")
    ready = wide.transform(rows)
    fits = kmeans(rows, names, list(range(2, min(largest_k, n - 1) + 1)))
    candidates = {k: nearest(ready, names, fit["centres"]) for k, fit in fits.items()}
    # All labellings in one frame, judged together.
    every = reduce(
        DataFrame.unionByName,
        [df.select(key, "cluster", *names, F.lit(k).alias("k")) for k, df in candidates.items()],
    )
    if measure == "euclidean":
        values = {r["k"]: r["silhouette"] for r in silhouette_euclidean(every, "cluster", names, key, "k").collect()}
    else:
        values = {
            k: silhouette_squared(df, "cluster", names).first()["silhouette"] for k, df in candidates.items()
        }
    best_k = min(values, key=lambda k: (-values[k], k))
    best = (values[best_k], best_k, candidates[best_k])
    projected, explained = components(best[2], "features")
    return (
        projected.drop("features", *names),
        {"optimal_clusters": best[1], "silhouette_score": best[0], "explained_variance_ratio_sum": explained},
    )


def components(df: DataFrame, vector: str = "features", k: int = 2) -> tuple[DataFrame, float]:
    """First components of centred vectors; each is signed so its largest loading is positive."""
    centred = StandardScaler(inputCol=vector, outputCol="_c", withMean=True, withStd=False).fit(df).transform(df)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    loadings = model.pc.toArray()
    signs = [float(np.sign(loadings[np.argmax(np.abs(loadings[:, j])), j]) or 1.0) for j in range(k)]
    coords = vector_to_array("_p")
    out = model.transform(centred)
    for j in range(k):
        out = out.withColumn(f"pca_{j + 1}", coords[j] * signs[j])
    return out.drop("_c", "_p"), float(sum(model.explainedVariance))
