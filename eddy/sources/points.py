"""Point sources: tables to points(point_id, tick, features) and text parsing.

Fixed derivations (values that must match the oracle SQL):
  lineitem  features = [l_quantity, floor(l_discount*100+0.5), floor(l_tax*100+0.5)]
            tick     = year(l_shipdate) - 1994
  events    features = [floor(value*100+0.5), hour(ts)]
            tick     = dense rank of the day of ts (empty days give no tick)
  embeddings features = floor(x*1e6+0.5) per component, one model per label
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Upper bound on distinct days of a replayed table (about 270 years).
MAX_TICKS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _round_int(c) -> F.Column:
    return F.floor(c + F.lit(0.5)).cast("double")


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """three integer-valued dimensions, tick = ship year - 1994.

    lineitem has no unique row id, so these points carry no point_id; the
    operators that order points (outlier walk, replay) run on events instead.
    """
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.year("l_shipdate") - F.lit(1994)).cast("bigint").alias("tick"),
        F.array(
            F.col("l_quantity").cast("double"),
            _round_int(F.col("l_discount") * 100),
            _round_int(F.col("l_tax") * 100),
        ).alias("features"),
    )


def day_ticks(days: DataFrame, day_col: str = "day") -> DataFrame:
    """Dense rank of the distinct days as a small broadcast table.

    A window over the points would pull every row into one task. The distinct
    days are bounded by the calendar (checked against MAX_TICKS), so they are
    fetched once, numbered in order and joined back by broadcast.
    """
    spark = days.sparkSession
    rows = days.select(day_col).distinct().orderBy(day_col).limit(MAX_TICKS + 1).collect()
    if len(rows) > MAX_TICKS:
        raise ValueError(f"more than {MAX_TICKS} distinct days")
    schema = T.StructType([days.schema[day_col], T.StructField("tick", T.LongType())])
    ranked = spark.createDataFrame([(r[0], i + 1) for i, r in enumerate(rows)], schema)
    return F.broadcast(ranked)


def tick_list(df: DataFrame, col: str = "tick") -> list[int]:
    """Sorted distinct ticks of a frame (bounded by MAX_TICKS, checked)."""
    rows = df.select(col).distinct().orderBy(col).limit(MAX_TICKS + 1).collect()
    if len(rows) > MAX_TICKS:
        raise ValueError(f"more than {MAX_TICKS} ticks")
    return [int(r[0]) for r in rows]


EV_DIMS = 2


def events_points(spark: SparkSession, sf_dir: str, with_type: bool = False, with_box: bool = False):
    """[cents of value, hour of ts]; point_id = event_id; tick = day rank.

    One aggregate per day (bounded by the calendar) yields both the day ranks
    and the per-dimension min/max, so the bounding box of the stream costs no
    extra scan. With with_box=True returns (points, box).
    """
    ev = table(spark, sf_dir, "events")
    cols = [
        F.col("event_id").alias("point_id"),
        F.to_date("ts").alias("day"),
        F.array(_round_int(F.col("value") * 100), F.hour("ts").cast("double")).alias("features"),
    ]
    if with_type:
        cols.append(F.col("event_type"))
    base = ev.select(*cols)
    aggs = []
    for d in range(EV_DIMS):
        aggs += [F.min(F.col("features")[d]).alias(f"lo{d}"), F.max(F.col("features")[d]).alias(f"hi{d}")]
    rows = base.groupBy("day").agg(*aggs).orderBy("day").limit(MAX_TICKS + 1).collect()
    if len(rows) > MAX_TICKS:
        raise ValueError(f"more than {MAX_TICKS} distinct days")
    schema = T.StructType([base.schema["day"], T.StructField("tick", T.LongType())])
    ranked = spark.createDataFrame([(r["day"], i + 1) for i, r in enumerate(rows)], schema)
    pts = base.join(F.broadcast(ranked), "day").drop("day")
    if not with_box:
        return pts
    box = [(min(r[f"lo{d}"] for r in rows), max(r[f"hi{d}"] for r in rows)) for d in range(EV_DIMS)]
    return pts, box


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 components scaled to integers; label is the model key."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("point_id"),
        F.col("label").cast("bigint").alias("label"),
        F.transform("embedding", lambda x: _round_int(x.cast("double") * F.lit(1e6))).alias("features"),
    )


# ---------------------------------------------------------------- text (SRC3)

def points_to_text(points: DataFrame, features: str = "features") -> DataFrame:
    """Print integer-valued features as `a,b,...` (the stream message body)."""
    return points.withColumn(
        "value", F.concat_ws(",", F.transform(features, lambda x: x.cast("bigint").cast("string"))))


def parse_points(lines: DataFrame, dims: int, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Parse comma-separated doubles (SRC3).

    Returns (good, quarantine): rows whose every field parses to a finite
    double and whose length is `dims` go to `good` with `features`; the rest
    keep their text in `quarantine` with a reason. Nothing is dropped silently.
    """
    fields = F.transform(F.split(F.trim(F.col(value)), ","), lambda x: F.trim(x).try_cast("double"))
    # one element to explode: what follows reads the parsed column and does not parse again
    parsed = lines.select("*", F.explode(F.array(fields)).alias("features"))
    bad_field = F.exists("features", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    reason = (F.when(F.col(value).isNull(), F.lit("null"))
              .when(F.size("features") != dims, F.lit("dimension"))
              .when(bad_field, F.lit("not a finite number")))
    flagged = parsed.withColumn("reject_reason", reason)
    good = flagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    quarantine = flagged.where(F.col("reject_reason").isNotNull()).drop("features")
    return good, quarantine
