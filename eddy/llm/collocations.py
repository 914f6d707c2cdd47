"""Operator 13: phrase collocations by direct-address tiles of frequency-ranked ids.

Per language: n word occurrences, f(phrase) contiguous occurrences within pieces, overlaps included.
Candidates are the phrases of 2 to `longest` words with f of at least `least`.

1. One pass cuts the texts into words and writes blocks of one language: the block's distinct words
   with their counts, and its words in order as places in that list, pieces kept apart.
2. The counts of all blocks give f and n; words with f of at least `least` are ranked by frequency, and
   the blocks are written again with ranks for words.
3. Level by level, a phrase of m words is a pair (rank of its first m - 1 words, rank of its last
   word), counted only where its last m - 1 words are frequent too. The pair space is split into tiles
   of `TILE` x `TILE` ranks. In a block, a tile with many pairs is counted by a dense bincount at direct
   addresses; the pairs of all other tiles (and of the ranks beyond the addressed tiles) are sorted
   coordinates. A pair's code is its address in tile order, so that the sorted codes of a group of tiles
   take about a byte each in the exchange. A group's sums are merged in memory; one of more than
   `MERGED` pairs is sent on as rows, which Spark sums. Sums that reach `least` are ranked by frequency
   again, and their ranks are the first halves of the next level's pairs.
4. A frequent phrase carries the counts of all its heads and tails from its two shorter phrases, so that
   cuts need no further look into the texts; scores are integer quotients of 38-digit decimals.

The dictionary of a level goes to the blocks by broadcast while it has at most `broadcast_rows` entries
(words: also bytes); a larger one is joined with the blocks' own distinct pairs instead, its `HEAD` most
frequent entries apart, so that no key is hot: the entry of rank h is in at most n / h blocks. The same
split serves the look-ups of step 4. Sums are combined before every exchange; nothing is collected but
dictionaries within that bound.

Defined cases: a null text is empty, a null language `und`; documents without words add nothing; equal
rows count each; ties by rank go to the smaller phrase in UTF-8 byte order; any number of languages.
More than 2^31 frequent phrases of one length raise an error (100 occurrences each: over 2 * 10^11 words).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, numbered, ready, table, written

LEAST = 100
LONGEST = 5
TOP = 2000
TILE = 256
ADDRESSED = 255             # tiles a side with an address; what lies beyond is counted as coordinates
DENSE = 2048                # pairs of a block from which a tile is counted densely
BLOCK_CHARS = 2_000_000
CHUNK = 2_000_000           # pairs that are counted at once
MERGED = 4_000_000          # distinct pairs of a group that are held at once
GROUPS = 4096
HEAD = 65_536
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32_000_000

_PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]+")
_STOP = b" \n "             # stands between pieces; no word holds a line feed


def _words(text: str) -> list[bytes]:
    """The words of a text, with a line feed between pieces."""
    clean = _PIECE_END.sub(_STOP, text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER))
    return re.split(rb"[ \t]+", clean)


def word_blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, lang, words, counts, seq): seq holds places in words as 32-bit integers, -1 between pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size, number, part = 0, 0, TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for lang in list(held):
                words = np.array(held.pop(lang), object)
                codes, distinct = pd.factorize(words)
                counts = np.bincount(codes, minlength=len(distinct))
                new = np.arange(len(distinct), dtype="<i4")
                gaps = np.array([w == b"\n" or not w for w in distinct], bool)
                new[~gaps], new[gaps] = np.arange((~gaps).sum()), -1
                seq = new[codes]
                # empty strings at the ends of a split are no words and no gaps
                empty = np.array([not w for w in distinct], bool)
                if empty.any():
                    seq = seq[~empty[codes]]
                keep = distinct[~gaps]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 33) + number], pa.int64()), pa.array([lang]),
                     pa.array([[w.decode("utf-8", "surrogatepass") for w in keep]], pa.list_(pa.string())),
                     pa.array([counts[~gaps].tolist()], pa.list_(pa.int64())),
                     pa.array([seq.astype("<i4").tobytes()], pa.binary())], ["block", "lang", "words", "counts", "seq"])
                number += 1

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                text = text.as_py()
                if not text:
                    continue
                out = held.setdefault(lang, [])
                out.extend(_words(text))
                out.append(b"\n")
                size += len(text)
                if size >= block_chars:
                    yield from flush()
                    size = 0
        yield from flush()
    return docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(
        run, "block bigint, lang string, words array<string>, counts array<bigint>, seq binary")


# ------------------------------------------------------------- dictionaries

def look_up(rows: DataFrame, entries: DataFrame, on: Column, rank: str = "id") -> DataFrame:
    """`rows` joined with a ranked table, whose `HEAD` most frequent entries are broadcast: a key of the
    others is never hot. `on` is a condition between columns of both."""
    head = rows.join(F.broadcast(entries.where(F.col(rank) < HEAD)), on)
    return head.unionByName(rows.join(entries.where(F.col(rank) >= HEAD), on))


def _apply(pairs: np.ndarray, codes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ranks of codes, -1 where a code is not frequent; `codes` is sorted."""
    if not len(codes):
        return np.full(len(pairs), -1, "<i8")
    at = np.minimum(np.searchsorted(codes, pairs), len(codes) - 1)
    return np.where(codes[at] == pairs, ids[at], -1)


_SIDE = 23                  # bits of a tile's row and column


def addresses(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Codes of pairs: tile row, tile column, place in the tile."""
    first, second = first.astype("<i8"), second.astype("<i8")
    return ((((first // TILE) << _SIDE) | (second // TILE)) << 16) | ((first % TILE) * TILE + second % TILE)


def _pairs(p: np.ndarray, w: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a phrase of m words may be frequent, and the codes of its pairs. p holds the
    ranks of the phrases of m - 1 words that start at each place, w those of the words."""
    n = len(w) - m + 1
    if n <= 0:
        return np.zeros(0, "<i8"), np.zeros(0, "<i8")
    at = np.flatnonzero((p[:n] >= 0) & (p[1:n + 1] >= 0))
    return at, addresses(p[at], w[at + m - 1])


def _climb(w: np.ndarray, p: np.ndarray, m: int, steps: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, int]:
    """Ranks of the phrases of m words and more at each place, by the dictionaries of the steps."""
    for codes, ids in steps:
        m += 1
        at, pairs = _pairs(p, w, m)
        p = np.full(len(w), -1, "<i8")
        p[at] = _apply(pairs, codes, ids)
    return p, m


def count_tiles(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, sorted, and their counts."""
    rows, cols = np.minimum(codes >> (16 + _SIDE), ADDRESSED), np.minimum((codes >> 16) & ((1 << _SIDE) - 1), ADDRESSED)
    side = ADDRESSED + 1
    tile = (rows * side + cols).astype("<u2")
    codes = codes[np.argsort(tile, kind="stable")]
    sizes = np.bincount(tile, minlength=side * side)
    ends = np.cumsum(sizes)
    found, sparse = [], []
    for t in np.flatnonzero(sizes).tolist():
        some = codes[ends[t] - sizes[t]:ends[t]]
        if len(some) < DENSE or t // side == ADDRESSED or t % side == ADDRESSED:
            sparse.append(some)
            continue
        counts = np.bincount(some & 65535, minlength=TILE * TILE)
        cells = np.flatnonzero(counts)
        found.append((((some[0] >> 16) << 16) | cells, counts[cells]))
    if sparse:
        found.append(np.unique(np.concatenate(sparse), return_counts=True))
    return _summed(found)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by code of (codes, counts), sorted."""
    if not parts:
        return np.zeros(0, "<i8"), np.zeros(0, "<i8")
    codes, counts = (np.concatenate(x).astype("<i8") for x in zip(*parts))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, "<i8")
    return codes[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _packed(numbers: np.ndarray) -> bytes:
    """64-bit integers, compressed byte plane by byte plane."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<i8").view("u1").reshape(-1, 8).T).tobytes(), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), "u1").reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def _tile_groups(codes: np.ndarray, counts: np.ndarray, groups: int) -> pa.RecordBatch:
    """(grp, codes, counts) with the sorted codes of a group of tiles as differences."""
    with np.errstate(over="ignore"):
        group = (((codes >> 16).astype("<u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(groups)
    order = np.argsort(group.astype("<u2"), kind="stable")
    codes, counts, group = codes[order], counts[order], group[order]
    edges = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(codes)].tolist() if len(codes) else [0]
    rows = [(int(group[lo]), _packed(np.diff(codes[lo:hi], prepend=0)), _packed(counts[lo:hi])) for lo, hi in zip(edges, edges[1:])]
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())],
                                      ["grp", "codes", "counts"])


def _merged_groups(least: int, most: int):
    """Sums of groups that stand one after the other: those of at least `least` of a group that is held
    whole, all sums so far of one that is not."""
    def rows(codes, counts):
        return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["code", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, split = None, [], 0, False

        def close():
            codes, counts = _summed(held)
            if not split:
                codes, counts = codes[counts >= least], counts[counts >= least]
            return rows(codes, counts)

        for b in batches:
            for grp, codes, counts in zip(*(c.to_pylist() for c in b.columns)):
                if grp != at:
                    yield close()
                    at, held, size, split = grp, [], 0, False
                held.append((np.cumsum(_unpacked(codes)), _unpacked(counts)))
                size += len(held[-1][0])
                if size > most:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > most // 2:
                        yield rows(*held[0])
                        held, size, split = [], 0, True
        yield close()
    return run


class Ranked:
    """Blocks with the ranks of their words and, at each place, of the phrase of m words that starts
    there. Small dictionaries wait as broadcasts until the next pass over the blocks."""

    def __init__(self, blocks: DataFrame, m: int, steps: list):
        self.blocks, self.m, self.steps = blocks, m, steps

    def _each(self):
        """An iterator maker: (row, w, p, m) of each block."""
        m0, steps = self.m - len(self.steps), self.steps

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            dictionaries = [s.value for s in steps]
            for b in batches:
                for r in b.to_pylist():
                    w = np.frombuffer(r["w"], "<i4")
                    p = np.frombuffer(r["p"], "<i8") if r["p"] is not None else w.astype("<i8")
                    yield r, w, *_climb(w, p, m0, dictionaries)
        return run

    def frequent(self, least: int, words: int) -> DataFrame:
        """(code, a) of the phrases of m + 1 words with a of at least `least`; `words` are all words."""
        groups, each = max(1, min(GROUPS, -(-words // MERGED))), self._each()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for _, w, p, m in each(batches):
                held.append(_pairs(p, w, m + 1)[1])
                size += len(held[-1])
                if size >= CHUNK:
                    yield _tile_groups(*count_tiles(np.concatenate(held)), groups)
                    held, size = [], 0
            if size:
                yield _tile_groups(*count_tiles(np.concatenate(held)), groups)

        parts = self.blocks.mapInArrow(run, "grp int, codes binary, counts binary")
        sums = parts.repartition("grp").sortWithinPartitions("grp").mapInArrow(_merged_groups(least, MERGED), "code bigint, n bigint")
        return sums.groupBy("code").agg(F.sum("n").alias("a")).where(F.col("a") >= least)

    def climb(self, entries: DataFrame, rows: int, broadcast_rows: int) -> "Ranked":
        """The blocks with the ranks of the phrases of m + 1 words from (code, id)."""
        sc, each = entries.sparkSession.sparkContext, self._each()
        if rows <= broadcast_rows:
            some = entries.select("code", "id").toPandas().sort_values("code")
            step = sc.broadcast((some["code"].to_numpy("<i8"), some["id"].to_numpy("<i8")))
            return Ranked(self.blocks, self.m + 1, self.steps + [step])

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r, w, p, m in each(batches):
                pairs = _pairs(p, w, m + 1)[1]
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([r["w"]], pa.binary()),
                                                  pa.array([p.astype("<i8").tobytes()], pa.binary()),
                                                  pa.array([np.unique(pairs).tolist()], pa.list_(pa.int64()))],
                                                 ["block", "w", "p", "codes"])
        now = written(self.blocks.mapInArrow(keep, "block bigint, w binary, p binary, codes array<bigint>"))
        coded = entries.select(F.col("code").alias("of"), "id")
        own = look_up(now.select("block", F.explode("codes").alias("code")), coded, F.col("code") == F.col("of"))
        lists = own.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("code", "id"))).alias("own"))
        met = now.drop("codes").join(lists, "block", "left").select(
            "block", "w", "p", F.col("own.code").alias("codes"), F.col("own.id").alias("ids"))

        def apply(batches: Iterator[pa.RecordBatch], m=self.m) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    w, p = np.frombuffer(r["w"], "<i4"), np.frombuffer(r["p"], "<i8")
                    p, _ = _climb(w, p, m, [(np.array(r["codes"] or [], "<i8"), np.array(r["ids"] or [], "<i8"))])
                    yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([r["w"]], pa.binary()),
                                                      pa.array([p.tobytes()], pa.binary())], ["block", "w", "p"])
        return Ranked(written(met.mapInArrow(apply, "block bigint, w binary, p binary")), self.m + 1, [])


def ranked_blocks(blocks: DataFrame, words: DataFrame, rows: int, size: int, broadcast_rows: int) -> Ranked:
    """The blocks with ranks for words, from (lang, word, id) with `rows` entries of `size` bytes."""
    def encode(seq: bytes, ids: np.ndarray) -> bytes:
        seq = np.frombuffer(seq, "<i4")
        return np.where(seq >= 0, ids[np.maximum(seq, 0)], -1).astype("<i4").tobytes() if len(ids) else seq.tobytes()

    schema = "block bigint, w binary, p binary"
    if rows <= broadcast_rows and size <= BROADCAST_BYTES:
        listed = words.select("lang", "word", "id").toPandas()
        by_lang = {lang: dict(zip(g["word"], g["id"])) for lang, g in listed.groupby("lang")}
        shared = words.sparkSession.sparkContext.broadcast(by_lang)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    ranks = shared.value.get(r["lang"], {})
                    ids = np.array([ranks.get(w, -1) for w in r["words"]], "<i4")
                    yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([encode(r["seq"], ids)], pa.binary()),
                                                      pa.array([None], pa.binary())], ["block", "w", "p"])
        return Ranked(written(blocks.select("block", "lang", "words", "seq").mapInArrow(run, schema)), 1, [])
    own = blocks.select("block", F.col("lang").alias("l"), F.posexplode("words").alias("place", "x"))
    met = look_up(own, words.select("lang", "word", "id"), (F.col("l") == F.col("lang")) & (F.col("x") == F.col("word")))
    lists = met.groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("own"))
    joined = blocks.select("block", F.size("words").alias("k"), "seq").join(lists, "block", "left").select(
        "block", "k", "seq", F.col("own.place").alias("places"), F.col("own.id").alias("ids"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.full(r["k"], -1, "<i4")
                ids[np.array(r["places"] or [], "<i8")] = np.array(r["ids"] or [], "<i4")
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([encode(r["seq"], ids)], pa.binary()),
                                                  pa.array([None], pa.binary())], ["block", "w", "p"])
    return Ranked(written(joined.mapInArrow(run_joined, schema)), 1, [])


# ------------------------------------------------------------------- phrases

def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_chars: int = BLOCK_CHARS,
                     broadcast_rows: int = BROADCAST_ROWS) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases of 1, 2, ... `longest` words, and (lang, n).

    A table has id (rank by frequency), lang, words, a, heads and tails (the counts of its first and
    last 1, 2, ... words) and, from 2 words on, first and tail (the ranks of the two phrases it extends)."""
    spark = ready(docs.sparkSession)
    blocks = written(word_blocks(docs, block_chars))
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("e")).groupBy(
        "lang", F.col("e.words").alias("word")).agg(F.sum("e.counts").alias("a"))
    sizes = written(blocks.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("n"))
                    .groupBy("lang").agg(F.sum("n").alias("n")))
    words = written(numbered(each.where(F.col("a") >= least), F.desc("a"), "lang", "word"))
    seen = words.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("word") + F.lit(64)).alias("size")).first()
    ranked = ranked_blocks(blocks, words, seen["rows"], seen["size"] or 0, broadcast_rows)
    none = F.array().cast("array<bigint>")
    every = sizes.agg(F.sum("n")).first()[0] or 0
    levels = [words.select("id", "lang", F.array("word").alias("words"), "a", none.alias("heads"), none.alias("tails"))]
    tile, place = F.shiftright("code", 16), F.col("code").bitwiseAND(F.lit(65535))
    first = F.shiftright(tile, _SIDE) * TILE + F.shiftright(place, 8)
    second = tile.bitwiseAND(F.lit((1 << _SIDE) - 1)) * TILE + place.bitwiseAND(F.lit(TILE - 1))
    for m in range(2, longest + 1):
        entries = written(numbered(ranked.frequent(least, every), F.desc("a"), "code"))
        rows = entries.count()
        if rows >= 1 << 31:
            raise ValueError(f"{rows} frequent phrases of {m} words")
        pairs = entries.select("id", "a", "code", first.alias("first"), second.alias("second"))
        short = levels[-1]
        left = short.select(F.col("id").alias("_l"), "lang", F.col("words").alias("_w"), F.col("a").alias("_a"), "heads",
                            *([F.col("tail").alias("_t")] if m > 2 else []))
        right = short.select(F.col("id").alias("tail"), F.element_at("words", -1).alias("_last"), F.col("a").alias("_b"), "tails",
                             *([F.col("first").alias("_f"), F.col("second").alias("_s")] if m > 2 else []))
        # the tail: the same last word after the tail of the first half
        on = (F.col("_t") == F.col("_f")) & (F.col("second") == F.col("_s")) if m > 2 else F.col("second") == F.col("tail")
        both = look_up(look_up(pairs, left, F.col("first") == F.col("_l"), "_l"), right, on, "tail")
        levels.append(written(both.select(
            "id", "lang", F.concat("_w", F.array("_last")).alias("words"), "a", F.concat("heads", F.array("_a")).alias("heads"),
            F.concat("tails", F.array("_b")).alias("tails"), "first", "second", "tail")))
        if not rows:
            break
        if m < longest:
            ranked = ranked.climb(entries, rows, broadcast_rows)
    return levels, sizes


def scored(levels: list[DataFrame], sizes: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer phrase of equal count holds."""
    out = None
    for m in range(1, len(levels)):
        found = levels[m]
        if m + 1 < len(levels):
            longer = levels[m + 1]
            same = look_up(longer.select("first", "tail", F.col("a").alias("_a")).select(
                F.explode(F.array("first", "tail")).alias("_of"), "_a"),
                found.select("id", "a"), (F.col("_of") == F.col("id")) & (F.col("_a") == F.col("a"))).select("id").distinct()
            found = found.join(same, "id", "left_anti")
        out = found.select("lang", "words", "a", "heads", "tails") if out is None else out.unionByName(
            found.select("lang", "words", "a", "heads", "tails"))
    wide = lambda c: c.cast("decimal(38,0)")
    met = look_up(written(out), _ranked_sizes(sizes), F.col("lang") == F.col("_of")).drop("_of", "id")
    # tails are by length: the rest of a phrase of m words after k is its last m - k words
    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(
        k.alias("k"), F.element_at("heads", k).alias("l"), F.element_at("tails", F.size("words") - k).alias("r")))
    product = wide(F.lit(1000)) * wide(F.col("a")) * wide(F.col("n"))
    worst = F.array_min(F.transform(cuts, lambda c: F.struct(
        F.call_function("div", product, wide(c["l"]) * wide(c["r"])).cast("bigint").alias("score"), c["k"].alias("k"),
        c["l"].alias("l"), c["r"].alias("r"))))
    return (met.withColumn("_c", worst)
            .select("lang", F.array_join("words", " ").alias("phrase"), "a", F.col("_c.l").alias("l"), F.col("_c.r").alias("r"),
                    "n", F.col("_c.score").alias("score")))


def _ranked_sizes(sizes: DataFrame) -> DataFrame:
    """(lang as _of, n, id): languages ranked by their size."""
    return numbered(sizes.withColumnRenamed("lang", "_of"), F.desc("n"), "_of")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, block_chars: int = BLOCK_CHARS,
                 broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top`."""
    levels, sizes = frequent_phrases(docs, least, longest, block_chars, broadcast_rows)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored(levels, sizes).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of 2 to 5 words of each language."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece,
         regexp_extract_all(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(coalesce(text, ''), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS m))),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
c AS (
  SELECT * FROM f WHERE m >= 2 AND NOT EXISTS (
    SELECT 1 FROM f g WHERE g.lang = f.lang AND g.m > f.m AND g.a >= f.a AND contains(' ' || g.phrase || ' ', ' ' || f.phrase || ' '))),
k AS (
  SELECT lang, m, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
         array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (
  SELECT k.lang, k.phrase, k.a, x.a AS l, y.a AS r, n.n, k.k,
         CAST((CAST(1000 AS HUGEINT) * k.a * n.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.head JOIN f y ON y.lang = k.lang AND y.phrase = k.rest
    JOIN n ON n.lang = k.lang),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS worst FROM s) WHERE worst = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM w)
SELECT lang, rank, phrase, a, l, r, n, score FROM t WHERE rank <= 2000
"""
