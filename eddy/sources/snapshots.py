"""Snapshot and center sinks/sources (SRC5-SRC10).

Snapshots are one Parquet table partitioned by (kind, tick): kind is
'cumulative' (everything since the start, what horizon queries subtract) or
'window' (the sliding-window model). Writes use dynamic partition overwrite,
so re-running a tick after a failure replaces exactly that tick's partition.
Reads filter on the partition columns and are pruned to the needed ticks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import centroid
from . import fs

# What an empty read returns.
MODEL_ROWS = ("mc_id bigint, n bigint, cf1x array<double>, cf2x array<double>, cf1t bigint, cf2t bigint, "
              "last_tick bigint, kind string, tick bigint")


def write_snapshots(df: DataFrame, path: str, kind: str) -> None:
    """SRC5/SRC6: write model rows (tick, mc_id, CF...) as partition kind=<kind>."""
    (df.withColumn("kind", F.lit(kind))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("kind", "tick").parquet(path))


def read_snapshots(spark: SparkSession, path: str, kind: str | None = None,
                   ticks: list[int] | None = None) -> DataFrame:
    """SRC7/SRC8: reads only the folders of the kind and ticks asked for; an empty
    frame when nothing matches or nothing was written yet."""
    root = path.rstrip("/")
    if kind is not None and ticks is not None:
        paths = [f"{root}/kind={kind}/tick={int(t)}" for t in ticks]
    else:
        paths = [f"{root}/kind={kind}" if kind is not None else root]
    paths = [p for p in paths if fs.exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], MODEL_ROWS)
    df = spark.read.option("basePath", root).parquet(*paths)
    if ticks is not None:
        df = df.where(F.col("tick").isin([int(t) for t in ticks]))
    return df.withColumn("tick", F.col("tick").cast("bigint"))


def centers(snaps: DataFrame, keys: tuple[str, ...] = ("tick",)) -> DataFrame:
    """PRJ4/STR12: centers of the micro-clusters with n > 0."""
    return snaps.where(F.col("n") > 0).select(*keys, "mc_id", centroid("cf1x", "n").alias("center"))


def write_report(snaps: DataFrame, path: str) -> None:
    """SRC10 as text files, one folder per tick; writing a tick again replaces it."""
    (report(snaps).select("tick", F.col("line").alias("value")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("tick").text(path))


def centers_text(cents: DataFrame, run: int) -> DataFrame:
    """SRC9 line form: `c1,c2,..._run`."""
    return cents.select("tick", F.concat(F.concat_ws(",", F.transform("center", lambda x: x.cast("string"))),
                                         F.lit(f"_{run}")).alias("value"))


def write_centers(cents: DataFrame, path: str, run: int) -> None:
    """SRC9: center lines, one folder per run and tick; writing a tick again replaces it."""
    (centers_text(cents, run).withColumn("run", F.lit(run)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run", "tick").text(path))


def _numbers(c, digits: int | None) -> F.Column:
    shown = lambda x: (x if digits is None else x.cast(f"decimal(38,{digits})")).cast("string")
    return F.concat_ws(",", F.transform(c, shown))


def report(snaps: DataFrame, digits: int | None = None) -> DataFrame:
    """SRC10: one line per micro-cluster (ids, CF2X, CF1X, CF2T, CF1T, N) and the
    total n of its snapshot. Sums print as full doubles, or with a fixed number of
    decimals."""
    from pyspark.sql import Window
    ids = F.concat_ws(",", F.transform("ids", lambda x: x.cast("string")))
    line = F.concat(F.lit("ids=["), ids, F.lit("] cf2x=["), _numbers("cf2x", digits), F.lit("] cf1x=["), _numbers("cf1x", digits),
                    F.lit("] cf2t="), F.col("cf2t").cast("string"), F.lit(" cf1t="), F.col("cf1t").cast("string"),
                    F.lit(" n="), F.col("n").cast("string"))
    return snaps.select("tick", "mc_id", "n", line.alias("line"),
                        F.sum("n").over(Window.partitionBy("tick")).alias("snapshot_n"))
