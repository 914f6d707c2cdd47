"""Per-batch standardisation (PRJ1, AGG10) and PCA projection (PRJ2).

Statistics come from exact per-tick sums (count, sum x, sum x^2): one partial
aggregation, then a broadcast join of one row per tick. A window over the
points would shuffle every point by tick (and put a hot tick in one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.points import MAX_TICKS


def batch_stats(points: DataFrame, keys: list[str], dims: int, features: str = "features") -> DataFrame:
    """(keys, n, mean_d, std_d): sample std (n-1); 0 when undefined or constant."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for d in range(dims):
        x = F.col(features)[d]
        aggs += [F.sum(x).alias(f"_s1_{d}"), F.sum(x * x).alias(f"_s2_{d}")]
    st = points.groupBy(*keys).agg(*aggs)
    cols = [*keys, "n"]
    for d in range(dims):
        s1, s2, n = F.col(f"_s1_{d}"), F.col(f"_s2_{d}"), F.col("n")
        var = (s2 - s1 * s1 / n) / (n - F.lit(1))
        cols += [(s1 / n).alias(f"mean_{d}"),
                 F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(F.lit(0.0)).alias(f"std_{d}")]
    return st.select(*cols)


def standardize(points: DataFrame, keys: list[str], dims: int, features: str = "features") -> DataFrame:
    """Replace `features` by its z-score within each key (the reference's
    withMean/withStd scaler fitted on each batch); zero std gives 0."""
    stats = batch_stats(points, keys, dims, features).drop("n")
    # one row per tick: fetched once (bounded by MAX_TICKS) and broadcast back
    rows = stats.limit(MAX_TICKS + 1).collect()
    if len(rows) > MAX_TICKS:
        raise ValueError(f"more than {MAX_TICKS} batches")
    small = points.sparkSession.createDataFrame(rows, stats.schema)
    joined = points.join(F.broadcast(small), keys)
    z = []
    for d in range(dims):
        x, m, s = F.col(features)[d], F.col(f"mean_{d}"), F.col(f"std_{d}")
        z.append(F.when(s > 0, (x - m) / s).otherwise(F.lit(0.0)))
    drop = [f"mean_{d}" for d in range(dims)] + [f"std_{d}" for d in range(dims)]
    return joined.withColumn(features, F.array(*z)).drop(*drop)


def pca_project(points: DataFrame, k: int, features: str = "features", out: str = "pcs") -> DataFrame:
    """PRJ2: top-k principal components with pyspark.ml.PCA, projected rows.
    The projection multiplies uncentred rows, like RowMatrix.multiply."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    vec = points.withColumn("_v", array_to_vector(F.col(features)))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vec)
    return model.transform(vec).withColumn(out, vector_to_array("_p")).drop("_v", "_p")
