"""Operator 4: exact top-k inner-product search by a three-phase uniform threshold.

Components become integers floor(256 x). A score is the sum of `LISTS` partial scores, one for each
slice of the dimensions, so each slice is a score list. With block tables of vectors and queries:

1. every vector block gives, for each query and list, its k highest entries; they are scored in full
   and the k-th best score over all blocks is the query's cutoff, a lower bound of the k-th result;
2. the cutoff goes back to the blocks with the queries. An entry whose score reaches it has, in at
   least one list, a partial score of cutoff / LISTS, so entries below that in every list are left;
3. of the others those whose upper bound (unseen lists at the threshold) reaches the cutoff are scored
   exactly, and each block gives its k best; the best k of all blocks are the result.

Queries are the stated set, in blocks of about `QUERY_ROWS`; they are broadcast only when all of them
take at most `BROADCAST_BYTES`, else vector blocks meet query blocks in a join on the block number.

Defined cases: vectors that are null, empty, or hold a null or non-finite component, and rows without
a vec_id, take no part; only vectors of equal length meet; equal rows count once; rows that share a
vec_id are never each other's result; ties go to the smaller vec_id; a query that meets nothing has no
row. Scores are exact as long as they fit in 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ready, table

LISTS = 4
VECTOR_ROWS = 4096
QUERY_ROWS = 1024
BROADCAST_BYTES = 16_000_000


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, dims, v) of the vectors that take part."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform(column, lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    return (vectors.where(F.col(id_col).isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0) & fine)
            .select(F.col(id_col).cast("bigint").alias("id"), F.size(column).alias("dims"), v.alias("v")).distinct())


def _matrix(values: pa.ListArray, dims: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def vector_blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(dims, ids, data): blocks of at most `rows` vectors of equal length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dims: int) -> pa.RecordBatch:
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dims)))
            return pa.RecordBatch.from_arrays(
                [pa.array([dims], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                 pa.array([data.astype("<i8").tobytes()], pa.binary())], ["dims", "ids", "data"])
        for b in batches:
            sizes = b.column(1).to_numpy()
            for dims in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == dims))
                for at in range(0, part.num_rows, rows):
                    some = part.slice(at, rows)
                    if sum(len(i) for i, _ in held.get(dims, [])) + some.num_rows > rows:
                        yield block(dims)
                    held.setdefault(dims, []).append((some.column(0).to_numpy(), _matrix(some.column(2), dims)))
        for dims in list(held):
            yield block(dims)
    return vectors.select("id", "dims", "v").mapInArrow(run, "dims int, ids binary, data binary")


def query_blocks(queries: DataFrame) -> DataFrame:
    """(dims, qblock, qids, qdata, qcut) of (id, dims, v, qblock, cutoff)."""
    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("id", kind="stable")
        return pd.DataFrame({"dims": [df["dims"].iloc[0]], "qblock": [df["qblock"].iloc[0]],
                             "qids": [df["id"].to_numpy("<i8").tobytes()],
                             "qdata": [np.stack(df["v"].to_list()).astype("<i8").tobytes()],
                             "qcut": [df["cutoff"].to_numpy("<i8").tobytes()]})
    return queries.groupBy("dims", "qblock").applyInPandas(one, "dims int, qblock int, qids binary, qdata binary, qcut binary")


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score descending, id)."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        among = np.flatnonzero(score >= least)
    else:
        among = np.arange(len(score))
    return among[np.lexsort((ids[among], -score[among]))[:k]]


def _slices(dims: int) -> list[slice]:
    edges = np.linspace(0, dims, min(LISTS, dims) + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _pairs(b: pa.RecordBatch) -> Iterator[tuple]:
    """(vector ids, lists of partial scores, query ids, cutoffs) of each row of met blocks."""
    for r in b.to_pylist():
        dims = r["dims"]
        ids, q = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["qids"], "<i8")
        x, y = np.frombuffer(r["data"], "<i8").reshape(-1, dims), np.frombuffer(r["qdata"], "<i8").reshape(-1, dims)
        if float(np.abs(x).max()) * float(np.abs(y).max()) * dims < 2 ** 52:
            x, y = x.astype("<f8"), y.astype("<f8")     # exact, and a BLAS product
        for at in range(0, len(q), 128):
            lists = np.stack([y[at:at + 128, s] @ x[:, s].T for s in _slices(dims)])
            yield ids, lists, q[at:at + 128], np.frombuffer(r["qcut"], "<i8")[at:at + 128]


RESULT = "query_id bigint, vec_id bigint, score bigint"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    q, v, s = (np.concatenate(x) if x else np.zeros(0, "<i8") for x in (zip(*out) if out else ((), (), ())))
    return pa.RecordBatch.from_arrays([pa.array(q.astype("<i8")), pa.array(v.astype("<i8")), pa.array(s.astype("<i8"))],
                                      ["query_id", "vec_id", "score"])


def _first_phase(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, lists, queries, _ in _pairs(b):
                out, keep = [], min(k + 1, len(ids))   # one more, for the query itself
                heads = np.argpartition(-lists, keep - 1, axis=2)[:, :, :keep]
                for i, q in enumerate(queries.tolist()):
                    seen = np.unique(heads[:, i])
                    seen = seen[ids[seen] != q]
                    total = lists[:, i, seen].sum(0)
                    best = seen[_top(total, ids[seen], k)]
                    out.append((np.full(len(best), q), ids[best], lists[:, i, best].sum(0)))
                yield _rows(out)
    return run


def _other_phases(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, lists, queries, cutoffs in _pairs(b):
                out, m = [], len(lists)
                least = cutoffs.astype("<f8")[:, None] / m
                sent = lists >= least                       # entries each list sends
                for i, q in enumerate(queries.tolist()):
                    some = np.flatnonzero(sent[:, i].any(0))
                    bound = np.where(sent[:, i, some], lists[:, i, some], least[i]).sum(0)
                    some = some[(bound >= cutoffs[i] - 1e-6 * abs(float(cutoffs[i]))) & (ids[some] != q)]
                    total = lists[:, i, some].sum(0)
                    fits = total >= cutoffs[i]
                    some, total = some[fits], total[fits]
                    best = _top(total, ids[some], k)
                    out.append((np.full(len(best), q), ids[some[best]], total[best]))
                yield _rows(out)
    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", column: str = "embedding",
          query_rows: int = QUERY_ROWS, vector_rows: int = VECTOR_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best of all other vectors. `is_query` is a
    condition on the column `id`."""
    spark = ready(vectors.sparkSession)
    every = integer_vectors(vectors, id_col, column)
    size = every.where(is_query).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dims"), F.lit(0)).alias("d")).first()
    blocks = max(1, -(-size["n"] // query_rows))
    queries = every.where(is_query).withColumn("qblock", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packed = cut(vector_blocks(every, vector_rows))

    def meet(asked: DataFrame) -> DataFrame:
        if size["d"] * 8 <= BROADCAST_BYTES:
            asked = F.broadcast(asked)
        dealt = packed.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return dealt.join(asked, ["dims", "qblock"])

    asked = query_blocks(queries.withColumn("cutoff", F.lit(0).cast("bigint")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    heads = meet(asked).mapInArrow(_first_phase(k), RESULT).distinct()
    # fewer than k entries set no cutoff: every score passes
    cutoffs = (heads.withColumn("r", F.row_number().over(best)).where(F.col("r") == k)
               .select(F.col("query_id").alias("id"), F.col("score").alias("cutoff")))
    lowest = F.lit(-(1 << 62)).cast("bigint")
    asked = query_blocks(cut(queries.join(cutoffs, "id", "left").withColumn("cutoff", F.coalesce("cutoff", lowest))))
    found = meet(asked).mapInArrow(_other_phases(k), RESULT).distinct()
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op4_topk_search(spark, sf_dir: str) -> DataFrame:
    """The 5 best of every vector whose id is divisible by 50, among all others."""
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(50)) == 0)


OP4_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
