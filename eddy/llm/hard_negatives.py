"""Operator 12: hard negatives by a secondary-sort shuffle.

A vector's score with an anchor is the inner product of their integer components; an anchor's rows are
ordered by score descending, then id. Its positives are its first `positives` other rows of its label.
For each of them the first `negatives` rows of another label count whose score lies between `low` / 100
of the positive's and the positive's own.

Vectors are packed into blocks sorted by label, anchors into blocks of `ANCHOR_ROWS`; a pair of blocks
is one matrix product, so no pair becomes a row:

1. anchors meet the rows of their label: each block gives its best `positives` rows of an anchor;
2. anchors, with the upper ends of their windows, meet the rows of other labels: each block gives, for
   each window, its first `negatives` rows. What is first in all rows is first in its block;
3. both go, keyed (anchor, descending score, id), through one exchange by anchor and are sorted within
   their partition. One pass over an anchor's rows opens a window at each positive and sends the
   negatives that follow, until all windows are full or passed; it holds the open windows and at most
   `negatives` rows of equal score, never an anchor's rows.

Steps 1 and 2 together compute each score once. An anchor has at most positives * (negatives + 1) rows
a block in the exchange. Anchors are broadcast in groups of at most `BROADCAST_BYTES`, one job a group.

Defined cases: rows with a null id, label or vector, an empty vector or a null or non-finite component
take no part; only vectors of equal length meet; equal rows (id, label and vector; the vector by a
64-bit hash) count once; different rows that share an id all take part, each an anchor of its own, and
are never each other's result; ties go to the smaller id; an anchor without positives or a positive
without negatives gives no row. Scores are exact while 100 times them fits in 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready, table, written

VECTOR_ROWS = 4096
ANCHOR_ROWS = 512
BROADCAST_BYTES = 16_000_000
RESULT = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
          "negative_score bigint")
_ENTRY = "anchor_id bigint, anchor_no bigint, neg_score bigint, vec_id bigint, row_no bigint, positive boolean"
_NAMES = [f.split()[0] for f in _ENTRY.split(", ")]


def labelled_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                     label: Column | None = None) -> DataFrame:
    """(id, label, dims, row_no, v) of the rows that take part; components become floor(256 x)."""
    label = F.col("label") if label is None else label
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform(vector_col, lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    return (rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fine)
            .select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
                    F.size(vector_col).alias("dims"), v.alias("v")).where("label IS NOT NULL")
            .select("id", "label", "dims", F.xxhash64("label", "v").alias("row_no"), "v"))


def _sorted_block(dims: int, parts: list[tuple]) -> pa.RecordBatch:
    """One block: its distinct rows by (label, id, row_no)."""
    ids, labels, nos, data = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((nos, ids, labels))
    ids, labels, nos, data = ids[order], labels[order], nos[order], data[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (nos[1:] != nos[:-1])
    return pa.RecordBatch.from_arrays(
        [pa.array([dims], pa.int32())] + [pa.array([np.ascontiguousarray(x[new], "<i8").tobytes()], pa.binary())
                                          for x in (ids, labels, nos, data)], ["dims", "ids", "labels", "nos", "data"])


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(dims, ids, labels, nos, data): blocks of at most `rows` rows of equal length, sorted by label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            sizes = b.column(2).to_numpy()
            for dims in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == dims))
                for at in range(0, part.num_rows, rows):
                    some = part.slice(at, rows)
                    if sum(len(p[0]) for p in held.get(dims, [])) + some.num_rows > rows:
                        yield _sorted_block(dims, held.pop(dims))
                    data = some.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                    held.setdefault(dims, []).append((some.column(0).to_numpy(), some.column(1).to_numpy(),
                                                      some.column(3).to_numpy(), data))
        for dims in list(held):
            yield _sorted_block(dims, held.pop(dims))
    return vectors.select("id", "label", "dims", "row_no", "v").mapInArrow(
        run, "dims int, ids binary, labels binary, nos binary, data binary")


def _numbers(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8")


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if float(np.abs(anchors).max()) * float(np.abs(rows).max()) * rows.shape[1] < 2 ** 52:
        return (anchors.astype("<f8") @ rows.astype("<f8").T).astype("<i8")       # exact, and a BLAS product
    return anchors @ rows.T


def _first(score: np.ndarray, ids: np.ndarray, nos: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by (score descending, id, row number)."""
    if len(score) > 4 * k:
        among = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        among = np.arange(len(score))
    return among[np.lexsort((nos[among], ids[among], -score[among]))[:k]]


def _entries(out: list[tuple], positive: bool) -> pa.RecordBatch:
    cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, "<i8")] * 5
    return pa.RecordBatch.from_arrays([pa.array(c.astype("<i8")) for c in cols] + [pa.array(np.full(len(cols[0]), positive))], _NAMES)


def _meet_blocks(batches: Iterator[pa.RecordBatch], same_label: bool, pick) -> Iterator[pa.RecordBatch]:
    """For each met pair of blocks and each label of its anchors: scores with the rows of this label, or
    of all others, and what `pick` takes of one anchor's scores."""
    for b in batches:
        for r in b.to_pylist():
            ids, labels, nos, a_ids, a_labels, a_nos = (_numbers(r[c]) for c in ("ids", "labels", "nos", "a_ids", "a_labels", "a_nos"))
            x, y = _numbers(r["data"]).reshape(len(ids), -1), _numbers(r["a_data"]).reshape(len(a_ids), -1)
            ends = _numbers(r["a_ends"]).reshape(len(a_ids), -1)
            out = []
            for label in np.unique(a_labels).tolist():
                lo, hi = np.searchsorted(labels, label, "left"), np.searchsorted(labels, label, "right")
                at = slice(lo, hi) if same_label else np.r_[0:lo, hi:len(ids)]
                i_, n_, x_ = ids[at], nos[at], x[at]
                if not len(i_):
                    continue
                asked = np.flatnonzero(a_labels == label)
                for lot in range(0, len(asked), 64):
                    some = asked[lot:lot + 64]
                    for j, score in zip(some.tolist(), _scores(y[some], x_)):
                        fine = np.flatnonzero(i_ != a_ids[j])
                        took = fine[pick(score[fine], i_[fine], n_[fine], ends[j])]
                        k = len(took)
                        out.append((np.full(k, a_ids[j]), np.full(k, a_nos[j]), -score[took], i_[took], n_[took]))
            yield _entries(out, same_label)


def _best_rows(k: int):
    def run(batches):
        return _meet_blocks(batches, True, lambda score, ids, nos, ends: _first(score, ids, nos, k))
    return run


def _window_rows(k: int, low: int):
    def pick(score, ids, nos, ends):
        took = []
        for top in np.unique(ends[ends != _NO_END]).tolist():
            inside = np.flatnonzero((score <= top) & (100 * score >= low * top))
            took.append(inside[_first(score[inside], ids[inside], nos[inside], k)])
        return np.unique(np.concatenate(took)) if took else np.zeros(0, "<i8")

    def run(batches):
        return _meet_blocks(batches, False, pick)
    return run


_NO_END = np.iinfo("<i8").min


def _stream(positives: int, negatives: int, low: int, only_positives: bool):
    """One pass over rows sorted by (anchor, descending score, id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, last, windows, seen, level, tied = None, None, [], 0, None, []
        for b in batches:
            out = []
            for a, no, neg, vec, row, positive in zip(*(c.to_pylist() for c in b.columns)):
                if (a, no) != anchor:
                    anchor, last, windows, seen, level, tied = (a, no), None, [], 0, None, []
                if (neg, vec, row, positive) == last:
                    continue                                     # an equal row of another block
                last, score = (neg, vec, row, positive), -neg
                if score != level:
                    level, tied = score, []
                if positive:
                    if seen == positives:
                        continue
                    seen += 1
                    if only_positives:
                        out.append((a, no, score))
                        continue
                    window = [vec, score, 0]
                    windows.append(window)
                    # rows of this very score with smaller ids
                    open_now, coming = [window], tied if 100 * score >= low * score else []
                else:
                    open_now = windows = [w for w in windows if w[2] < negatives and 100 * score >= low * w[1]]
                    coming = [vec]
                    if len(tied) < negatives:
                        tied.append(vec)
                for w in open_now:
                    for n in coming:
                        if w[2] < negatives:
                            w[2] += 1
                            out.append((a, w[0], w[2], n, w[1], score))
            if out:
                cols = list(zip(*out))
                if only_positives:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["anchor_id", "anchor_no", "score"])
                else:
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                                     ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])
    return run


def _secondary_sort(entries: DataFrame) -> DataFrame:
    """Every anchor's entries in one partition, by descending score and id."""
    return (entries.repartition(F.col("anchor_id"), F.col("anchor_no"))
            .sortWithinPartitions("anchor_id", "anchor_no", "neg_score", "vec_id", "row_no"))


def _anchor_blocks(anchors: DataFrame, positives: int) -> DataFrame:
    """(dims, a_ids, a_labels, a_nos, a_data, a_ends) of (id, label, dims, row_no, v, ends)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            df = b.to_pandas()
            for dims, part in df.groupby("dims"):
                for at in range(0, len(part), ANCHOR_ROWS):
                    p = part.iloc[at:at + ANCHOR_ROWS]
                    ends = np.full((len(p), positives), _NO_END, "<i8")
                    for i, e in enumerate(p["ends"]):
                        if e is not None:
                            ends[i, :len(e)] = e
                    blobs = [p["id"].to_numpy("<i8"), p["label"].to_numpy("<i8"), p["row_no"].to_numpy("<i8"),
                             np.stack(p["v"].to_list()).astype("<i8"), ends]
                    yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in blobs],
                                                     ["dims", "a_ids", "a_labels", "a_nos", "a_data", "a_ends"])
    return anchors.select("id", "label", "dims", "row_no", "v", "ends").mapInArrow(
        run, "dims int, a_ids binary, a_labels binary, a_nos binary, a_data binary, a_ends binary")


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, low: int = 80, id_col: str = "vec_id",
         vector_col: str = "embedding", label: Column | None = None, vector_rows: int = VECTOR_ROWS,
         broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). `is_anchor` is a
    condition on the column `id`, `label` the label as an expression over `rows`."""
    ready(rows.sparkSession)
    every = labelled_vectors(rows, id_col, vector_col, label)
    packed = written(blocks(every, vector_rows))
    anchors = written(every.where(is_anchor).dropDuplicates(["id", "row_no", "dims"]))
    size = anchors.agg(F.sum(F.col("dims").cast("bigint") * 8 + 64).alias("b")).first()["b"] or 0
    groups = max(1, -(-size // broadcast_bytes))
    found = None
    for g in range(groups):
        group = anchors.where(F.pmod(F.xxhash64("id", "row_no"), F.lit(groups)) == g)

        def meet(some: DataFrame) -> DataFrame:
            return packed.join(F.broadcast(_anchor_blocks(some, positives)), "dims").select(
                "ids", "labels", "nos", "data", "a_ids", "a_labels", "a_nos", "a_data", "a_ends")

        asked = group.withColumn("ends", F.lit(None).cast("array<bigint>"))
        near = written(meet(asked).mapInArrow(_best_rows(positives), _ENTRY))
        tops = (_secondary_sort(near).mapInArrow(_stream(positives, negatives, low, True), "anchor_id bigint, anchor_no bigint, score bigint")
                .groupBy("anchor_id", "anchor_no").agg(F.collect_list("score").alias("ends")))
        windows = written(group.join(tops, (F.col("id") == F.col("anchor_id")) & (F.col("row_no") == F.col("anchor_no")))
                          .drop("anchor_id", "anchor_no"))
        hard = meet(windows).mapInArrow(_window_rows(negatives, low), _ENTRY)
        part = _secondary_sort(near.unionByName(hard)).mapInArrow(_stream(positives, negatives, low, False), RESULT)
        part = part if groups == 1 else written(part)
        found = part if found is None else found.unionByName(part)
    return found


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100, among all rows."""
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(100)) == 0, label=moved)


OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS al, a.e AS ae, c.vec_id, c.label = a.label AS same,
         CAST(list_sum([a.e[i] * c.e[i] FOR i IN range(1, len(a.e) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(c.e) = len(a.e)),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id, al, ae ORDER BY score DESC, vec_id) AS place FROM s WHERE same)
  WHERE place <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.al, p.ae, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.al = p.al AND s.ae = p.ae AND NOT s.same
    AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 5
"""
