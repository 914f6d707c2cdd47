"""Operator 1: benchmark decontamination with an FM-index per shard of the documents.

A task reads its documents in shards of about `SHARD_WORDS` words, numbers the shard's words, builds
the FM-index of the word sequence and searches all benchmark windows at once by backward search.
Matching rows are located by sampled suffix positions; overlapping occurrences of a document merge
into spans. A document longer than a shard is indexed in pieces that overlap by a window less one
word, so each occurrence lies whole in a piece. Nothing is shuffled.

The benchmark is the stated query set: it is sent to the tasks in blocks of at most `BLOCK_CHARS`
characters, and documents pass all blocks in one stage, each pass merging its hits.

Words: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Window: `window` consecutive words
of an item; an item of fewer words, but not none, is one window.

Defined cases: null or wordless texts have no words and no hits; null or wordless items have no
window; items with equal texts are both reported; a null item_id is reported as `null`; repeated
documents are judged alike, row by row; other columns pass through. With an empty benchmark nothing
is hit.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, table, text_batches
from .fm_index import FMIndex

WINDOW = 10
SHARD_WORDS = 300_000
BLOCK_CHARS = 16_000_000
#: Keeps 0-9, a-z and every byte from 0x80 on, lower-cases A-Z, blanks the rest.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def item_windows(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[tuple[bytes, ...], list[str]]:
    """Each distinct window with the ids of its items."""
    out = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            out[tuple(words[k:k + window])].add(item)
    return {w: sorted(ids) for w, ids in out.items()}


def benchmark_blocks(bench: DataFrame, window: int, block_chars: int) -> Iterator[dict]:
    """Windows of the benchmark, block after block."""
    block, chars = [], 0
    rows = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").toLocalIterator()
    for r in rows:
        block.append((r["item"], r["text"]))
        chars += len(r["text"] or "")
        if chars > block_chars:
            yield item_windows(block, window)
            block, chars = [], 0
    if block:
        yield item_windows(block, window)


def shard_hits(texts: list[list[bytes]], windows: dict, shard_words: int) -> dict[int, list[tuple[int, int, int]]]:
    """Row -> occurrences (first word, length, number of the window)."""
    keys = list(windows)
    longest = max((len(k) for k in keys), default=1)
    by_size = defaultdict(list)
    for i, k in enumerate(keys):
        by_size[len(k)].append(i)
    hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    pieces = [(row, at, w[at:at + shard_words]) for row, w in enumerate(texts)
              for at in range(0, max(len(w) - longest + 1, 1) if w else 0, max(shard_words - longest + 1, 1))]
    a = 0
    while a < len(pieces):
        b, n = a, 0
        while b < len(pieces) and (b == a or n + len(pieces[b][2]) <= shard_words):
            n += len(pieces[b][2])
            b += 1
        part = pieces[a:b]
        a = b
        flat = np.empty(n, object)
        flat[:] = [w for _, _, ws in part for w in ws]
        codes, names = pd.factorize(flat)
        number = dict(zip(names.tolist(), range(1, len(names) + 1)))
        cuts = np.cumsum([len(ws) for _, _, ws in part])[:-1]
        index = FMIndex(np.split(codes.astype("<i8") + 1, cuts))
        for size, members in by_size.items():
            for at in range(0, len(members), 200_000):
                some = members[at:at + 200_000]
                lo, hi = index.search(np.array([[number.get(w, 0) for w in keys[i]] for i in some], "<i8"))
                found = np.flatnonzero(hi > lo)
                count = (hi - lo)[found]
                owner = np.repeat(found, count)
                rows = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
                for c in range(0, len(rows), 500_000):
                    place = index.locate(rows[c:c + 500_000])
                    piece = np.searchsorted(index.starts, place, "right") - 1
                    for p, w, o in zip(piece.tolist(), (place - index.starts[piece]).tolist(), owner[c:c + 500_000].tolist()):
                        hits[part[p][0]].append((part[p][1] + w, size, some[o]))
    return hits


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def find(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
         block_chars: int = BLOCK_CHARS, cut: bool = False) -> DataFrame:
    """`docs` with n_words, hit_words (array of [first, end) word numbers, merged) and hit_items
    (array of item ids as strings, sorted). With `cut`, texts lose their hit words as in `cut_spans`, in
    the pass that finds them."""
    spark = ready(docs.sparkSession)
    made = ["n_words", "hit_words", "hit_items"]
    rest = [c for c in docs.columns if c not in made]
    out = docs.select(*rest, F.lit(0).cast("bigint").alias("n_words"),
                      F.expr("cast(array() as array<array<int>>)").alias("hit_words"),
                      F.expr("cast(array() as array<string>)").alias("hit_items"))
    kinds = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in out.columns)
    blocks = [spark.sparkContext.broadcast(w) for w in benchmark_blocks(bench, window, block_chars)]
    blocks = blocks or [spark.sparkContext.broadcast({})]
    for k, shipped in enumerate(blocks):
        last = cut and k == len(blocks) - 1
        out = _search(out, shipped, rest, schema, shard_words, blocks if last else [])
    return out


def _search(docs: DataFrame, shipped, rest: list[str], schema: str, shard_words: int, cut: list) -> DataFrame:
    """`cut`: the blocks of all windows, if the hit words go."""
    width = len(rest)
    at_text = rest.index("text")

    def flush(held: list[tuple[pa.RecordBatch, list]], windows: dict) -> Iterator[pa.RecordBatch]:
        hits = shard_hits([w for _, ws in held for w in ws], windows, shard_words)
        names, row = list(windows), 0
        for b, ws in held:
            spans, items = b.column(width + 1).to_pylist(), b.column(width + 2).to_pylist()
            for i in range(b.num_rows):
                got = hits.get(row + i)
                if got:
                    spans[i] = [list(x) for x in merged([tuple(x) for x in spans[i]] + [(p, p + n) for p, n, _ in got])]
                    items[i] = sorted({*items[i], *(x for w in {w for _, _, w in got} for x in windows[names[w]])})
            row += b.num_rows
            kept = list(b.columns[:width])
            if cut and any(spans):
                texts = kept[at_text].to_pylist()
                for i in np.flatnonzero([bool(x) for x in spans]).tolist():
                    texts[i] = without(texts[i], [tuple(x) for x in spans[i]], [s.value for s in cut])
                kept[at_text] = pa.array(texts, kept[at_text].type)
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([len(w) for w in ws], pa.int64()),
                 pa.array(spans, b.column(width + 1).type), pa.array(items, b.column(width + 2).type)], b.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shipped.value
        held, n = [], 0
        for b, texts in text_batches(batches, "text"):
            words = [words_of(t) for t in texts]
            held.append((b, words))
            n += sum(map(len, words))
            if n >= shard_words:
                yield from flush(held, windows)
                held, n = [], 0
        if held:
            yield from flush(held, windows)

    return docs.mapInArrow(run, schema)


def cut_spans(found: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """`found` (of `find`) with every hit word taken out of its text, along with what stands between
    the words of a span. Where the cut brings words together that form a window again, those go as
    well. Texts without a hit are returned as they are."""
    spark = found.sparkSession
    shipped = [spark.sparkContext.broadcast(frozenset(w)) for w in benchmark_blocks(bench, window, BLOCK_CHARS)]
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in found.columns)
    at_text, at_hits = found.columns.index("text"), found.columns.index("hit_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dirty = np.flatnonzero(pc.list_value_length(b.column(at_hits)).to_numpy(zero_copy_only=False) > 0)
            if not len(dirty):
                yield b
                continue
            texts = b.column(at_text).to_pylist()
            for i in dirty.tolist():
                texts[i] = without(texts[i], [tuple(x) for x in b.column(at_hits)[i].as_py()], [s.value for s in shipped])
            cols = list(b.columns)
            cols[at_text] = pa.array(texts, cols[at_text].type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return found.mapInArrow(run, schema)


def without(text: str, spans: list[tuple[int, int]], blocks: list[frozenset]) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    while spans:
        places = [m.span() for m in WORD.finditer(raw.translate(WORD_BYTES))]
        keep, at = [], 0
        for lo, hi in spans:
            keep.append(raw[at:places[lo][0]])
            at = places[hi - 1][1]
        raw = b"".join([*keep, raw[at:]])
        words = raw.translate(WORD_BYTES).split()
        sizes = {len(w) for b in blocks for w in b} if len(words) else set()
        spans = merged([(k, k + n) for n in sizes for k in range(len(words) - n + 1)
                        if any(tuple(words[k:k + n]) in b for b in blocks)])
    return raw.decode("utf-8", "surrogatepass")


def judged(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of `find`'s rows."""
    n_hit = F.aggregate("hit_words", F.lit(0).cast("bigint"), lambda s, x: s + (x[1] - x[0]).cast("bigint"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Which words of every document lie inside a benchmark window."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(find(docs, table(spark, sf_dir, "benchmark")))


WORDS_SQL = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS_SQL.format('text')}, []) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {WORDS_SQL.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item, unnest([array_to_string(w[k:k+9], ' ') FOR k IN range(1, greatest(len(w) - 9, 1) + 1)]) AS t,
               least(len(w), 10) AS n FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT dw.r, dw.k, dw.n, win.item FROM dw JOIN win ON win.n = dw.n AND win.t = array_to_string(w[k:k+dw.n-1], ' ')),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
