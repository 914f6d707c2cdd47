"""Operator 11 [native]: mixing sources to target weights by hash-threshold histograms.

A source's target is its weight's share of all words, at most `repeats` times its own size; what the
cap leaves over is shared again by weight until no target is above its cap (`targets`). A target of
b whole sizes and a rest takes every document b times, and once more the documents whose key lies
under the source's threshold, so that mixes of growing budgets are nested. Thresholds are found
without sorting documents:

1. words are summed by (source, leading 15 bits of the key); running sums over the at most 32,768
   buckets of a source find the one in which its budget ends;
2. only that bucket is summed again, by its next 15 bits, until a bucket of one document is left: the
   first that does not fit. The same search goes on behind it among the documents that fit in what is
   left, until that is at most 1 / `PRECISION` of the target or nothing fits. The last document that
   did not fit is taken if the sum comes nearer to the target with it than without;
3. one filter over the documents compares keys with thresholds.

So documents are taken in the order of their keys whenever they fit. A key is the leading 60 bits of
md5 over doc_id and text, then 60 bits over the row's number in the written key table: rows of equal
id and text (any number of them) are told apart by it, and it does not matter which of them is taken.
Sources are kept as a table of one row each; it is broadcast if `BROADCAST_SOURCES` hold it, else it
is joined under `SALTS` salts, so that a hot source is split. The driver sees sums and counts only.

Defined cases: a null text has no words; documents without words are taken 0 times; a null source is
a source of its own, the last one; without any words all targets are 0. Columns of the documents with
the names of the operator's own are kept by `mix` only if asked for under other names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, ready, table, written

WORD = r"[^\x20\x09-\x0D]+"
REPEATS = 3
PRECISION = 1000
BROADCAST_SOURCES = 20_000
SALTS = 64
_DIGIT = 15           # four digits of the content key, then four of the row key
_BARS = 1 << _DIGIT


def weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """(source, source_size) with `weight`: 1, 2, ... `cycle`, repeating, by code point, null last."""
    ranked = numbered(sources, F.asc_nulls_last("source"))
    return ranked.withColumn("weight", (F.col("id") % cycle + 1).cast("bigint")).drop("id")


def targets(sources: DataFrame, share: float = 1.0, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, weight) with `target`: shares of `share` of all words by weight, capped
    at `repeats` sizes. Every round caps all sources above their cap; two sums come to the driver."""
    every = sources.withColumn("_cap", (F.col("source_size") * repeats).cast("decimal(38,0)"))
    total = every.agg(F.sum("source_size")).first()[0] or 0
    budget = min(int(total * share), repeats * total)
    left, heavy, capped = budget, None, F.lit(False)
    while True:
        free = every.agg(F.sum(F.when(~capped, F.col("weight"))).alias("w"),
                         F.sum(F.when(capped, F.col("_cap")).otherwise(0)).alias("c"),
                         F.count(F.when(capped, 1)).alias("k")).first()
        left, w = budget - int(free["c"] or 0), int(free["w"] or 0)
        if free["k"] == heavy or w == 0:
            break
        heavy = free["k"]
        capped = F.col("_cap") * F.lit(w).cast("decimal(18,0)") < F.col("weight").cast("decimal(18,0)") * F.lit(left).cast("decimal(18,0)")
    fair = F.lit(float(left)) * F.col("weight").cast("double") / F.lit(float(max(w, 1)))
    return every.withColumn("target", F.when(capped, F.col("_cap").cast("double")).otherwise(fair)).drop("_cap")


def keyed(docs: DataFrame, keep: dict[str, F.Column]) -> DataFrame:
    """The kept columns with source, size and key (k1, k2), written once."""
    content = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"),
                             F.coalesce("text", F.lit(""))).cast("binary"))
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col("source").alias("source"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
                       F.conv(F.substring(content, 1, 15), 16, 10).cast("bigint").alias("k1"),
                       F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4).alias("k2"))
    return written(rows)


def _meet(rows: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """Rows with the state of their source, without a hot key."""
    state = state.withColumnRenamed("source", "_of")
    if small:
        return rows.join(F.broadcast(state), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    salted = state.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (rows.withColumn("_s", F.pmod("k1", F.lit(SALTS)).cast("int"))
            .join(salted, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_s") == F.col("_salt"))).drop("_of", "_s", "_salt"))


def _next_state(rows: DataFrame, state: DataFrame, small: bool) -> DataFrame:
    """One histogram of every open source's current bucket, and the sources' states after it."""
    open_ = state.where(~F.col("done"))
    shift = 45 - _DIGIT * (F.col("level") % 4)
    part = lambda k, s: F.call_function("shiftrightunsigned", k, s.cast("int"))
    digit = F.when(F.col("level") < 4, part(F.col("k1"), shift)).otherwise(part(F.col("k2"), shift)).bitwiseAND(F.lit(_BARS - 1))
    inside = F.when(F.col("level") < 4, part(F.col("k1"), shift + _DIGIT) == F.col("prefix")).otherwise(
        (F.col("k1") == F.col("high")) & (part(F.col("k2"), shift + _DIGIT) == F.col("prefix")))
    after = (F.col("k1") > F.col("lo.k1")) | ((F.col("k1") == F.col("lo.k1")) & (F.col("k2") > F.col("lo.k2")))
    candidates = _meet(rows, open_.select("source", "lo", "cap", "level", "prefix", "high"), small).where(
        (F.col("size") > 0) & (F.col("size") <= F.col("cap")) & after & inside)
    bars = candidates.groupBy("source", digit.cast("bigint").alias("digit")).agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"), F.min(F.struct("k1", "k2")).alias("first"))
    run = Window.partitionBy("source").orderBy("digit")          # at most _BARS rows a source
    bars = bars.withColumn("before", F.sum("words").over(run) - F.col("words")).withColumnRenamed("source", "_of")
    over = (open_.select("source", "need").join(bars, F.col("source").eqNullSafe(F.col("_of")))
            .groupBy("_of").agg(F.min(F.when(F.col("before") + F.col("words") > F.col("need"),
                                             F.struct("digit", "words", "docs", "first", "before"))).alias("bar"),
                                F.sum("words").alias("all_words")))
    met = state.join(over, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
    bar, need = F.col("bar"), F.col("need") - F.col("bar.before")
    fits = ~F.col("done") & bar.isNull()                         # all that is left fits
    found = ~F.col("done") & (F.col("bar.docs") == 1)            # the first document that does not fit
    deeper = ~F.col("done") & (F.col("bar.docs") > 1)
    top = F.struct(F.lit(1 << 60).alias("k1"), F.lit(0).cast("bigint").alias("k2"))
    span = F.struct("lo", F.when(fits, top).otherwise(F.col("bar.first")).alias("hi"), F.col("cap").alias("cap"))
    enough = need * PRECISION <= F.col("target")
    down = F.col("prefix") * _BARS + F.col("bar.digit")
    return met.select(
        "source", "source_size", "target", "base",
        F.when(fits | found, F.concat("spans", F.array(span))).otherwise(F.col("spans")).alias("spans"),
        F.when(found | deeper, need).when(fits, F.col("need") - F.coalesce("all_words", F.lit(0)))
        .otherwise(F.col("need")).alias("need"),
        F.when(found, F.floor(need).cast("bigint")).otherwise(F.col("cap")).alias("cap"),
        F.when(found, F.col("bar.first")).otherwise(F.col("lo")).alias("lo"),
        F.when(found, F.struct(F.col("bar.first").alias("key"), F.col("bar.words").alias("size"))).otherwise(F.col("skipped")).alias("skipped"),
        F.when(deeper, F.col("level") + 1).when(found, F.lit(0)).otherwise(F.col("level")).alias("level"),
        F.when(found | (deeper & (F.col("level") == 3)), F.lit(0).cast("bigint")).when(deeper, down).otherwise(F.col("prefix")).alias("prefix"),
        F.when(deeper & (F.col("level") == 3), down).otherwise(F.col("high")).alias("high"),
        F.when(found, enough).otherwise(F.col("done") | fits).alias("done"))


def mix(docs: DataFrame, share: float = 1.0, repeats: int = REPEATS, keep: dict[str, F.Column] | None = None,
        cycle: int = 3, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The kept columns (`doc_id` where none are named) of every document with size, source_size,
    target and `copies`, the times that the mix takes it."""
    spark = ready(docs.sparkSession)
    keep = {"doc_id": F.col("doc_id")} if keep is None else keep
    rows = keyed(docs, keep)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(targets(written(weights(sizes, cycle)), share, repeats))
    small = sources.limit(broadcast_sources + 1).count() <= broadcast_sources
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    key = F.struct(F.lit(-1).cast("bigint").alias("k1"), F.lit(-1).cast("bigint").alias("k2"))
    spans = "array<struct<lo:struct<k1:bigint,k2:bigint>,hi:struct<k1:bigint,k2:bigint>,cap:bigint>>"
    state = sources.withColumn("base", F.least(whole, F.lit(repeats).cast("bigint"))).select(
        "source", "source_size", "target", "base", F.array().cast(spans).alias("spans"),
        (F.col("target") - F.col("base") * F.col("source_size")).alias("need"),
        F.lit((1 << 62)).cast("bigint").alias("cap"), key.alias("lo"),
        F.lit(None).cast("struct<key:struct<k1:bigint,k2:bigint>,size:bigint>").alias("skipped"),
        F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("high"))
    state = written(state.withColumn("done", F.col("need") < 1))
    while not state.where(~F.col("done")).isEmpty():
        state = written(_next_state(rows, state, small))
    # the last one that did not fit, where it brings the sum nearer
    near = F.col("skipped").isNotNull() & (F.col("skipped.size") - F.col("need") < F.col("need"))
    state = state.select("source", "source_size", "target", "base", "spans", F.when(near, F.col("skipped.key")).alias("more"))
    k1, k2 = F.col("k1"), F.col("k2")
    under = F.exists("spans", lambda s: (F.col("size") <= s["cap"])
                     & ((k1 > s["lo"]["k1"]) | ((k1 == s["lo"]["k1"]) & (k2 > s["lo"]["k2"])))
                     & ((k1 < s["hi"]["k1"]) | ((k1 == s["hi"]["k1"]) & (k2 < s["hi"]["k2"]))))
    last = F.coalesce((k1 == F.col("more.k1")) & (k2 == F.col("more.k2")), F.lit(False))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("base") + (under | last).cast("bigint"))
    return _meet(rows, state, small).select(*keep, "size", "source_size", "target", copies.cast("bigint").alias("copies"))


def op11_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents mixed by source: the words that the mix takes of each."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: Targets by the order of cap over weight; documents by a fold over each source's list in key order.
OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS k
  FROM documents),
s AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
c AS (
  SELECT *, coalesce(sum(3 * source_size) OVER w, 0) AS caps_before, coalesce(sum(weight) OVER w, 0) AS weights_before,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights
  FROM s WINDOW w AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT *, 3 * source_size * (all_weights - weights_before) < weight * (total - caps_before) AS capped FROM c),
f AS (
  SELECT total - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0) AS rest,
         coalesce(sum(weight) FILTER (NOT capped) OVER (), 1) AS free, * FROM l),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
         ELSE CAST(rest AS DOUBLE) * CAST(weight AS DOUBLE) / CAST(free AS DOUBLE) END AS target FROM f),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS base FROM t),
r AS (
  SELECT d.doc_id, d.size, b.source, b.source_size, b.target, b.base,
         row_number() OVER (PARTITION BY d.source ORDER BY d.k) AS place
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
x AS (
  SELECT source, list_reduce(list(struct_pack(size := size, place := place, need := target - base * source_size, goal := target,
      cap := CAST(1 AS BIGINT) << 61, done := target - base * source_size < 1, skipped := CAST(0 AS BIGINT),
      skipped_size := CAST(0 AS BIGINT), taken := CAST([] AS BIGINT[])) ORDER BY place),
    lambda a, d: CASE
      WHEN a.done OR d.size = 0 OR d.size > a.cap THEN a
      WHEN d.size <= a.need THEN struct_pack(size := a.size, place := a.place, need := a.need - d.size, goal := a.goal, cap := a.cap,
        done := a.done, skipped := a.skipped, skipped_size := a.skipped_size, taken := list_append(a.taken, d.place))
      ELSE struct_pack(size := a.size, place := a.place, need := a.need, goal := a.goal, cap := CAST(floor(a.need) AS BIGINT),
        done := a.need * 1000 <= d.goal, skipped := d.place, skipped_size := d.size, taken := a.taken) END) AS a
  FROM (SELECT size, place, source, target, base, source_size FROM r
        UNION ALL SELECT 0, 0, source, target, base, source_size FROM b) GROUP BY source)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST(r.size * (r.base + CASE WHEN list_contains(x.a.taken, r.place)
         OR (x.a.skipped = r.place AND x.a.skipped_size - x.a.need < x.a.need) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r JOIN x ON r.source IS NOT DISTINCT FROM x.source
"""
