"""Model inputs, metrics, spatial folds, tree ensembles, cross-validation and additive attributions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite, ratio


def metrics(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """r2, rmse and mae in one pass."""
    e = F.col(observed) - F.col(predicted)
    s = df.agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(observed).alias("v"))
    return s.select((1 - F.col("sse") / (F.col("n") * F.col("v"))).alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae", "n")


def block_of(x: str, y: str, size: float) -> Column:
    return F.concat_ws("_", F.floor(F.col(x) / size).cast("string"), F.floor(F.col(y) / size).cast("string"))


def spatial_folds(df: DataFrame, x: str, y: str, size: float = 300_000.0, folds: int = 5) -> DataFrame:
    """Whole blocks to folds, the largest first, each to the fold with the fewest rows so far.

    The driver sees one row for each block, whose number the extent of the map bounds.
    """
    blocked = df.withColumn("block", block_of(x, y, size))
    sizes = sorted(((r["count"], r["block"]) for r in blocked.groupBy("block").count().collect()), key=lambda s: (-s[0], s[1]))
    filled, pairs = [0] * folds, []
    for n, block in sizes:
        k = min(range(folds), key=lambda i: (filled[i], i))
        filled[k] += n
        pairs.append((block, k))
    table = df.sparkSession.createDataFrame(pairs, "block string, fold int")
    return blocked.join(table, "block")


def seeded_split(df: DataFrame, key: str, test_percent: int = 30, seed: int = 42) -> DataFrame:
    """is_test by a hash of the key: stable whatever the order or the number of partitions."""
    return df.withColumn("is_test", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100)) < test_percent)


def forest(features: list[str], target: str, trees: int = 300, least: int = 5, depth: int = 20, seed: int = 42) -> list:
    return [VectorAssembler(inputCols=features, outputCol="features"), RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, minInstancesPerNode=least, featureSubsetStrategy="all", maxDepth=depth, seed=seed)]


def boosted(features: list[str], target: str, trees: int = 800, rate: float = 0.03, depth: int = 5, seed: int = 42) -> list:
    return [VectorAssembler(inputCols=features, outputCol="features"), GBTRegressor(featuresCol="features", labelCol=target, maxIter=trees, stepSize=rate, maxDepth=depth, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)]


def fit(stages: list, df: DataFrame) -> PipelineModel:
    from pyspark.ml import Pipeline

    return Pipeline(stages=stages).fit(df)


def cross_validate(df: DataFrame, stages: list, target: str, folds: int = 5) -> DataFrame:
    """Metrics of each fold, and a row with their mean and sd (fold is null)."""
    held = None
    for k in range(folds):
        model = fit(stages, df.where(F.col("fold") != k))
        part = model.transform(df.where(F.col("fold") == k)).select(F.lit(k).alias("fold"), F.col(target).alias("observed"), F.col("prediction"))
        held = part if held is None else held.unionByName(part)
    e = F.col("observed") - F.col("prediction")
    s = held.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"), F.var_pop("observed").alias("v"))
    each = s.select("fold", (1 - F.col("sse") / (F.col("n") * F.col("v"))).alias("r2"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae", F.lit(None).cast("double").alias("r2_sd"))
    mean = each.agg(F.lit(None).cast("int").alias("fold"), F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.stddev_samp("r2").alias("r2_sd"))
    return each.unionByName(mean)


#: Days that a period's features need at least, and hours that a day does.
LEAST_DAYS, LEAST_HOURS = {"pre": 10, "festival": 5}, 18


def dynamic_features(daily: DataFrame, hourly: DataFrame, value: str, least_days: int) -> DataFrame:
    """For each cell: variation of daily sums, ratio of day to night hours, and the amplitude within days.

    daily holds the sums of grid_id and local_date, hourly the values of each local_hour. Values that are null,
    infinite or negative are left out. Null where there is too little: least_days days for the variation, least_days times
    LEAST_HOURS hours for the ratio, least_days days of LEAST_HOURS hours for both amplitudes; also where the
    denominator is zero.
    """
    known = lambda df: df.withColumn("_v", finite(F.col(value).cast("double"))).where("_v >= 0")
    days = known(daily).groupBy("grid_id").agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"), F.count("_v").alias("n_days"))
    hours = known(hourly)
    is_day = F.col("local_hour").between(8, 19)
    part = hours.groupBy("grid_id").agg(
        F.avg(F.when(is_day, F.col("_v"))).alias("day_mean"), F.avg(F.when(~is_day, F.col("_v"))).alias("night_mean"),
        F.count_if(is_day).alias("day_hours"), F.count_if(~is_day).alias("night_hours"), F.avg("_v").alias("hour_mean"),
    )
    within = hours.groupBy("grid_id", "local_date").agg(F.countDistinct("local_hour").alias("hours"), (F.max("_v") - F.min("_v")).alias("amplitude"))
    swing = within.where(F.col("hours") >= LEAST_HOURS).groupBy("grid_id").agg(F.avg("amplitude").alias("mean_amplitude"), F.countDistinct("local_date").alias("n_hour_days"), F.min("hours").alias("least_hours"))
    both = days.join(part, "grid_id", "full_outer").join(swing, "grid_id", "left")
    enough = F.col("n_hour_days") >= least_days
    return both.select(
        "grid_id", "n_days", F.when(F.col("n_days") >= least_days, ratio(F.col("sd"), F.col("mean"))).alias("cv"), "day_hours", "night_hours",
        F.when(F.col("day_hours") + F.col("night_hours") >= least_days * LEAST_HOURS, ratio(F.col("day_mean"), F.col("night_mean"))).alias("day_night_ratio"),
        "n_hour_days", "least_hours", F.when(enough, F.col("mean_amplitude")).alias("mean_amplitude"), F.when(enough, ratio(F.col("mean_amplitude"), F.col("hour_mean"))).alias("relative_amplitude"),
    )


def _paths(node, base: list, out: list) -> None:
    """Leaves of a JVM regression tree: prediction, share of rows and the splits on the way."""
    if node.subtreeDepth() == 0:
        out.append((node.prediction(), node.impurityStats().count(), base))
        return
    split, left = node.split(), node.leftChild()
    total, at = node.impurityStats().count(), split.featureIndex()
    share = left.impurityStats().count() / total
    _paths(left, [*base, (at, -np.inf, split.threshold(), share)], out)
    _paths(node.rightChild(), [*base, (at, split.threshold(), np.inf, 1 - share)], out)


def tree_leaves(model) -> list[tuple[float, list[tuple[float, list]]]]:
    """(weight, leaves) of each tree; a leaf is its value and, for each feature on its path, (feature, low, high, cover share)."""
    trees = []
    weights = list(model.treeWeights)
    scale = 1 / sum(weights) if isinstance(model, type(model)) and "Forest" in type(model).__name__ else 1.0
    for tree, weight in zip(model.trees, weights, strict=True):
        leaves: list = []
        _paths(tree._java_obj.rootNode(), [], leaves)
        merged = []
        for value, _, path in leaves:
            by: dict[int, list] = {}
            for at, lo, hi, share in path:
                old = by.get(at, [-np.inf, np.inf, 1.0])
                by[at] = [max(lo, old[0]), min(hi, old[1]), old[2] * share]
            merged.append((value, [(k, *v) for k, v in by.items()]))
        trees.append((weight * scale, merged))
    return trees


def _subset_weights(shares: np.ndarray, ones: np.ndarray, skip: int) -> np.ndarray:
    """For each row, the sum over subsets of the other features of weight(size) times the product of what each gives."""
    n, d = ones.shape
    poly = np.zeros((n, d))
    poly[:, 0] = 1
    used = 0
    for j in range(d):
        if j == skip:
            continue
        used += 1
        for k in range(used, 0, -1):
            poly[:, k] = poly[:, k] * shares[j] + poly[:, k - 1] * ones[:, j]
        poly[:, 0] *= shares[j]
    from math import comb

    weights = np.array([1 / (d * comb(d - 1, k)) for k in range(d)])
    return poly @ weights


def attributions(df: DataFrame, model, features: list[str], key: str) -> DataFrame:
    """Path-dependent additive attributions of a tree ensemble: key, base_value and one column for each feature.

    A leaf adds its value times the exact average, over orders of the features on its path, of what each feature
    changes; features not yet known follow both branches in the shares of the training rows.
    """
    trees = tree_leaves(model)
    base = sum(w * sum(v * float(np.prod([p[3] for p in path])) for v, path in leaves) for w, leaves in trees)
    schema = pa.schema([(key, pa.int64()), ("base_value", pa.float64()), *[(f, pa.float64()) for f in features]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))], axis=1)
            out = np.zeros_like(x)
            for weight, leaves in trees:
                for value, path in leaves:
                    if not path:
                        continue
                    shares = np.array([p[3] for p in path])
                    ones = np.stack([((x[:, at] > lo) & (x[:, at] <= hi)).astype(float) for at, lo, hi, _ in path], axis=1)
                    for j, (at, *_rest) in enumerate(path):
                        out[:, at] += weight * value * _subset_weights(shares, ones, j) * (ones[:, j] - shares[j])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(x), base)), *(pa.array(out[:, i]) for i in range(len(features)))], schema=schema)

    kept = df.select(F.col(key).cast("long").alias(key), *[F.col(f).cast("double").alias(f) for f in features])
    return kept.mapInArrow(run, f"{key} long, base_value double, " + ", ".join(f"{f} double" for f in features))


def mean_absolute(attributed: DataFrame, features: list[str]) -> DataFrame:
    """feature and mean_abs, the largest first."""
    long = attributed.unpivot([], features, "feature", "value")
    return long.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature")
