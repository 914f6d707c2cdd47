"""Operator 9: near-duplicate lines by a segment-partition edit join, DataFrame functions only.

Lines are what `\\n` separates. A line that is not blank goes if an equal line stands earlier, and one
of at least `min_chars` characters also if one within `tau` edits (code points) does; earlier means
smaller (doc_id, line number). Shorter blank lines always stay.

A line is cut into tau + 1 segments, as even as they go; of two lines within tau edits one keeps a
segment of the other whole. So every distinct line enters its segments under (length, number,
content), and looks up, for each length it may meet, the substrings at the places where that segment
can have moved (a shift below its number, and with the rest of the edits left for what follows).
An edit changes at most two of a line's letter counts by one, so lines meet only if their counts of 16
letters (modulo 16, in one 64-bit integer) differ by at most 2 tau in sum. Meetings are verified, after
what both lines begin and end with is cut off, by a bit-parallel automaton over the band of 2 tau + 1
diagonals: bit k of word d says that the first i + k - tau characters of one line are within d edits of
the first i of the other.

Equal lines are counted together before anything is joined, so a line that fills a third of all rows
is one row. Only line hashes (64 bits) are shuffled; texts are fetched for lines that met.

Defined cases: a null text counts as empty, an empty text is one empty line; a null doc_id orders
first; the lines of rows with equal doc_id and equal line numbers count as one line if they are
equal, and are ordered by their hash if not; texts of any length are split whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ready, table

TAU = 2
MIN_CHARS = 20
LETTERS = "etaoinsrhdlucmgp"
#: Hashes (8 bytes each) that may be broadcast to pick lines out of the texts; beyond it a shuffle join does it.
BROADCAST_LINES = 2_000_000


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of every line."""
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return docs.select("doc_id", F.posexplode(split).alias("line_no", "line"))


def _segment(length: Column, i: int, tau: int) -> tuple[Column, Column]:
    """(start, size) of segment i of a line of that length; the last ones are the longer ones."""
    n = tau + 1
    size = F.floor(length / n).cast("int")
    longer = length % n
    return (size * i + F.greatest(F.lit(0), i - (n - longer)).cast("int"),
            size + F.when(F.lit(i) >= n - longer, 1).otherwise(0))


def _key(line: Column, start: Column, size: Column, i: int, length: Column) -> Column:
    return F.xxhash64(F.substring(line, start + 1, size), F.lit(i), length)


def segment_keys(line: Column, tau: int) -> list[Column]:
    """Keys under which a line is entered."""
    n = F.length(line)
    return [_key(line, *_segment(n, i, tau), i, n) for i in range(tau + 1)]


def probe_keys(line: Column, tau: int) -> list[Column]:
    """Keys under which a line looks for lines at most as long as itself."""
    n = F.length(line)
    out = []
    for less in range(tau + 1):
        other = n - less
        for i in range(tau + 1):
            start, size = _segment(other, i, tau)
            out += [_key(line, start + s, size, i, other) for s in range(-tau, tau + 1)
                    if abs(s) <= i and abs(s - less) <= tau - i]
    return out


def within(a: Column, b: Column, tau: int) -> Column:
    """Whether the edit distance of two strings is at most tau: banded, bit-parallel. `a` and `b` are
    arrays of characters whose sizes differ by at most tau; each is evaluated once."""
    both = F.array(F.struct(a.alias("a"), b.alias("b")))
    return F.get(F.transform(both, lambda p: _within(p["a"], p["b"], tau)), F.lit(0))


def _common_prefix(a: Column, b: Column) -> Column:
    """Length of what two strings begin with alike, by halving steps."""
    least = F.least(F.length(a), F.length(b))

    def step(at: Column, size: Column) -> Column:
        fits = (at + size <= least) & (F.substring(a, at + 1, size) == F.substring(b, at + 1, size))
        return F.when(fits, at + size).otherwise(at)
    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), F.lit(0), step)


def differing(a: Column, b: Column) -> Column:
    """struct(a, b): the strings without their common beginning and end, reversed."""
    def rest(p: Column) -> Column:
        n = _common_prefix(p["a"], p["b"])
        return F.get(F.transform(F.array(n), lambda n: F.struct(
            F.reverse(F.substring(p["a"], n + 1, F.length(p["a"]))).alias("a"),
            F.reverse(F.substring(p["b"], n + 1, F.length(p["b"]))).alias("b"))), F.lit(0))

    def middle(p: Column) -> Column:
        n = _common_prefix(p["a"], p["b"])
        return F.get(F.transform(F.array(n), lambda n: F.struct(
            F.substring(p["a"], n + 1, F.length(p["a"])).alias("a"),
            F.substring(p["b"], n + 1, F.length(p["b"])).alias("b"))), F.lit(0))
    pair = F.array(F.struct(a.alias("a"), b.alias("b")))
    return F.get(F.transform(F.transform(pair, rest), middle), F.lit(0))


def close(a: Column, b: Column, tau: int) -> Column:
    """Whether two strings whose lengths differ by at most tau are within tau edits."""
    def verdict(p: Column) -> Column:
        chars = [F.filter(F.split(p[x], ""), lambda c: c != "") for x in "ab"]
        return within(*chars, tau)
    return F.get(F.transform(F.array(differing(a, b)), verdict), F.lit(0))


def letter_counts(line: Column) -> Column:
    """Counts of 16 letters, modulo 16 each, in one integer."""
    out = F.lit(0).cast("bigint")
    for k, letter in enumerate(LETTERS):
        n = F.length(line) - F.length(F.replace(line, F.lit(letter), F.lit("")))
        out = out.bitwiseOR(F.shiftleft((n % 16).cast("bigint"), 4 * k))
    return out


def _count_distance(x: Column, y: Column) -> Column:
    """A lower bound of the sum of the counts' differences."""
    total = F.lit(0).cast("bigint")
    for k in range(len(LETTERS)):
        d = F.abs(F.shiftrightunsigned(x, 4 * k).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(y, 4 * k).bitwiseAND(F.lit(15)))
        total = total + F.least(d, 16 - d)
    return total


def _within(a: Column, b: Column, tau: int) -> Column:
    width = 2 * tau + 1
    full = (1 << width) - 1

    def word(d: int) -> int:
        return sum(1 << (tau + j) for j in range(d + 1))

    def step(state: Column, c: Column) -> Column:
        i = state["i"]
        equal = sum((F.coalesce((F.get(a, i + (k - tau)) == c).cast("int"), F.lit(0)) * (1 << k) for k in range(width)), F.lit(0))

        def after(m: Column) -> Column:
            new = [state["r0"].bitwiseAND(m)]
            for d in range(1, tau + 1):
                was = state[f"r{d - 1}"]
                new.append(state[f"r{d}"].bitwiseAND(m).bitwiseOR(was).bitwiseOR(F.shiftright(was, 1))
                           .bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(full)))
            return F.struct((i + 1).alias("i"), *(r.alias(f"r{d}") for d, r in enumerate(new)))
        # more than tau edits already: nothing comes back
        return F.when(state[f"r{tau}"] == 0, state).otherwise(F.get(F.transform(F.array(equal), after), F.lit(0)))

    start = F.struct(F.lit(0).alias("i"), *(F.lit(word(d)).alias(f"r{d}") for d in range(tau + 1)))
    end = F.aggregate(b, start, step, lambda s: s[f"r{tau}"])
    return F.call_function("shiftright", end, F.size(a) - F.size(b) + tau).bitwiseAND(F.lit(1)) == 1


def _picked(lines: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """`lines` joined with the checkpointed table `wanted`, broadcast if it is small."""
    return lines.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_LINES else wanted, on)


def dropped_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, h, near) of every line that goes; near: for an earlier line within tau edits
    of it, not for an equal one."""
    ready(docs.sparkSession)
    line = F.col("line")
    every = lines_of(docs).where(line.rlike(r"\S") | (F.length(line) >= min_chars)).withColumn("h", F.xxhash64(line, F.lit(0)))
    lines = every.where(F.length(line) >= min_chars)
    keys = F.array(*segment_keys(line, tau), *probe_keys(line, tau))
    # one row for each distinct line: its first place, and its keys
    first = lines.select("h", F.struct("doc_id", "line_no").alias("at"), keys.alias("keys"), letter_counts(line).alias("counts")).groupBy("h").agg(
        F.min("at").alias("at"), F.first("keys").alias("keys"), F.first("counts").alias("counts"))
    entered = first.select("h", "counts", F.explode(F.slice("keys", 1, tau + 1)).alias("key"))
    asked = first.select(F.col("h").alias("g"), F.col("counts").alias("g_counts"), F.explode(F.slice("keys", tau + 2, len(probe_keys(line, tau)))).alias("key"))
    fits = (F.col("h") != F.col("g")) & (_count_distance(F.col("counts"), F.col("g_counts")) <= 2 * tau)
    met = cut(entered.hint("shuffle_hash").join(asked, "key").where(fits)
              .select(F.least("h", "g").alias("a"), F.greatest("h", "g").alias("b")).distinct())
    # texts of the lines that met
    wanted = cut(met.select(F.col("a").alias("h")).union(met.select("b")).distinct())
    texts = cut(_picked(lines.select("h", "line", "doc_id", "line_no"), wanted, "h").groupBy("h").agg(
        F.min(F.struct("doc_id", "line_no")).alias("at"), F.first("line").alias("line")))
    left, right = (texts.select(F.col("h").alias(x), F.col("at").alias(f"{x}_at"), F.col("line").alias(f"{x}_line")) for x in "ab")
    pairs = met.join(left, "a").join(right, "b")
    linked = pairs.where((F.abs(F.length("a_line") - F.length("b_line")) <= tau)
                         & close(F.col("a_line"), F.col("b_line"), tau))
    later = F.when((F.col("a_at") < F.col("b_at")) | ((F.col("a_at") == F.col("b_at")) & (F.col("a") < F.col("b"))),
                   F.col("b")).otherwise(F.col("a"))
    near = linked.select(later.alias("h")).distinct().withColumn("near", F.lit(True))
    # lines of any length that stand more than once keep their first place
    more = every.groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1")
    known = cut(more.select("h", "at").join(near, "h", "full").select("h", "at", F.coalesce("near", F.lit(False)).alias("near")))
    places = _picked(every.select("h", "doc_id", "line_no"), known, "h")
    return places.where(F.col("near") | ~F.struct("doc_id", "line_no").eqNullSafe(F.col("at"))).select(
        "doc_id", "line_no", "h", "near")


def _by_document(drops: DataFrame) -> DataFrame:
    return drops.groupBy(F.col("doc_id").alias("__doc")).agg(
        F.array_sort(F.collect_set("line_no")).alias("dropped"),
        F.array_sort(F.collect_set(F.when(F.col("near"), F.col("line_no")))).alias("dropped_near"),
        F.collect_set(F.struct("line_no", "h")).alias("__lines"))


def line_dedup(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """`docs` with the lines that go taken out of `text` (other columns as they are, n_chars of the new
    text if there is one). A document of which only blanks are left goes; untouched ones are unchanged."""
    drops = _by_document(dropped_lines(docs, tau, min_chars)).select("__doc", "__lines")
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.filter(parts, lambda x, i: ~F.array_contains(
        F.col("__lines"), F.struct(i.alias("line_no"), F.xxhash64(x, F.lit(0)).alias("h"))))
    out = docs.join(drops, docs["doc_id"].eqNullSafe(drops["__doc"]), "left").withColumn(
        "text", F.when(F.col("__lines").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")))
    out = out.where(F.col("__lines").isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__lines").isNotNull(), F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: n_lines, n_dropped, n_near (dropped for a near line only), dropped (line numbers)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drops = _by_document(dropped_lines(docs)).drop("__lines")
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("bigint").alias("n_lines")
    rows = docs.select("doc_id", n_lines)
    empty = F.expr("cast(array() as array<int>)")
    return rows.join(drops, rows["doc_id"].eqNullSafe(drops["__doc"]), "left").select(
        "doc_id", "n_lines", F.size(F.coalesce("dropped", empty)).cast("bigint").alias("n_dropped"),
        F.size(F.coalesce("dropped_near", empty)).cast("bigint").alias("n_near"),
        F.array_join(F.coalesce("dropped", empty).cast("array<string>"), ",").alias("dropped"))
