"""Operator 7: token ids packed into rows of fixed length by best-fit decreasing.

Documents are encoded (byte-level BPE), cut losslessly into pieces of at most `length` tokens, and
packed: pieces in decreasing size (ties by document and piece) each go to the row with the least room
that still fits, found in a segment tree over room sizes. A written row holds the padded ids, the
cumulative lengths of its segments and the position of each token in its segment, which starts at 0
with every segment.

Documents are dealt to groups by a hash of the document, about `GROUP_DOCS` to a group, and a group is
packed on its own; the number of groups follows from the number of documents only, so the result does
not depend on how the input is stored. Ids travel as 16-bit integers where the vocabulary allows.

Defined cases: null and empty texts have no token and no segment; a document longer than a row gives
several pieces, in order; equal documents are packed alike but apart; rows that share a doc_id are
told apart by their content, else by nothing, which does not matter to the rows made.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import default_vocabulary, encoded
from .common import ready, table

LENGTH = 2048
GROUP_DOCS = 1500
PAD = 50256


class RoomTree:
    """Segment tree over room sizes 0 .. length: which sizes have a row with just that room."""

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.some = bytearray(2 * self.width)
        self.rows: dict[int, list[int]] = defaultdict(list)

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.width
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of the least room of at least `size`, which leaves the tree."""
        i = size + self.width
        while not self.some[i]:                 # up, to the next subtree on the right
            while i & 1:
                i >>= 1
                if i == 0:
                    return None
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:                # past the right end of the level
                return None
        while i < self.width:                   # down, leftmost
            i = 2 * i if self.some[2 * i] else 2 * i + 1
        room = i - self.width
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.some[i] = 0
            i >>= 1
            while i and not (self.some[2 * i] or self.some[2 * i + 1]):
                self.some[i] = 0
                i >>= 1
        return room, row


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of pieces; `sizes` (each at most `length`) may come in any order, ties keep theirs."""
    tree, rows = RoomTree(length), []
    for p in sorted(range(len(sizes)), key=lambda p: -sizes[p]):
        got = tree.take(sizes[p])
        if got is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = got
        rows[row].append(p)
        if room > sizes[p]:
            tree.add(room - sizes[p], row)
    return rows


def encoded_groups(docs: DataFrame, vocabulary: str, groups: int) -> DataFrame:
    """(group, doc_id, ids): ids as 16-bit integers, empty documents left out."""
    src = docs.select(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(groups)).cast("int").alias("grp"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw in encoded(batches, "text", vocabulary):
            ids = [np.frombuffer(x, "<u4") for x in raw]
            keep = [i for i, x in enumerate(ids) if len(x)]
            part = b.take(pa.array(keep, pa.int64()))
            small = all(int(ids[i].max()) < 1 << 16 for i in keep)
            if not small:
                raise ValueError("the vocabulary needs more than 16 bits an id")
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([ids[i].astype("<u2").tobytes() for i in keep], pa.binary())],
                ["grp", "doc_id", "ids"])

    return src.mapInArrow(run, "grp int, doc_id bigint, ids binary")


ROW = ("grp int, row int, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, positions binary, "
       "doc_ids array<bigint>, offsets array<int>")


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, pad: int = PAD,
         group_docs: int = GROUP_DOCS) -> DataFrame:
    """Packed rows: `ids` (length 16-bit ids, padded), `cu_seqlens` (0, then each segment's end),
    `positions` (16 bits a token, starting at 0 in each segment and in the padding), and each
    segment's document and its offset in the document's tokens."""
    spark = ready(docs.sparkSession)
    if length >= 1 << 16:
        raise ValueError("positions hold 16 bits")
    groups = max(1, -(-docs.count() // group_docs))

    def one(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["doc_id", "ids"], kind="stable", na_position="first")
        pieces, owner, offset = [], [], []
        for doc, raw in zip(df["doc_id"].tolist(), df["ids"].tolist()):
            ids = np.frombuffer(raw, "<u2")
            for at in range(0, len(ids), length):
                pieces.append(ids[at:at + length])
                owner.append(None if pd.isna(doc) else int(doc))
                offset.append(at)
        out = []
        for row, members in enumerate(best_fit_decreasing([len(p) for p in pieces], length)):
            ids, positions = np.full(length, pad, "<u2"), np.zeros(length, "<u2")
            ends = [0]
            for p in members:
                ids[ends[-1]:ends[-1] + len(pieces[p])] = pieces[p]
                positions[ends[-1]:ends[-1] + len(pieces[p])] = np.arange(len(pieces[p]))
                ends.append(ends[-1] + len(pieces[p]))
            positions[ends[-1]:] = np.arange(length - ends[-1])
            out.append((int(df["grp"].iloc[0]), row, ends[-1], len(members), ids.tobytes(), ends, positions.tobytes(),
                        [owner[p] for p in members], [offset[p] for p in members]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")])

    rows = encoded_groups(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"),
                          vocabulary or default_vocabulary(), groups)
    return rows.groupBy("grp").applyInPandas(one, ROW)


def write(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet."""
    packed.write.mode("overwrite").parquet(path)


def op7_token_packing(spark, sf_dir: str) -> DataFrame:
    """Packed rows of all `documents`, with digests of the id matrix row and the position resets."""
    out = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("grp", "row", "n_tokens", "n_segments", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("positions", 256).alias("positions_sha256"),
                      F.array_join(F.col("cu_seqlens").cast("array<string>"), ",").alias("cu_seqlens"),
                      F.array_join(F.col("doc_ids").cast("array<string>"), ",", "null").alias("doc_ids"))
