"""Operator 6: secrets in texts, with regular expressions and sliding-window entropy, DataFrame
functions only.

Base kinds (leftmost, non-overlapping per kind): assign, access, hex. A span's place follows from
splitting the text at the kind's matches and summing the lengths of what lies before.

The method adds spans of kind `entropy`: runs of at least `WINDOW` characters of one class (hex digits
or base-64 signs). A window slides over the run; the counts of its characters change by one that
enters and one that leaves, and with them the sum of f(c) = c log2 c, so that the window's Shannon
entropy, log2(w) - sum / w, is known at each step. The span reaches from the first window at or above
the class's threshold to the end of the last. A run on the allow list, or one that touches a base
span, adds nothing; of two classes that find the same place the base-64 run counts. f is kept in
2^-20 units as an integer, so no rounding gathers.

Defined cases: a null text is empty; an empty text has no span; other columns are not read; equal
rows give equal rows; lengths count code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
          r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: A greedy run that is long enough is found alike with its least length in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
UNIT = 1 << 20
#: class -> (its signs, least entropy in bits)
CLASSES = {
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
    "hexrun": ("0123456789ABCDEFabcdef", 3.0),
}
RUNS = {"base64": r"[A-Za-z0-9+/_=-]{20,}", "hexrun": r"[0-9A-Fa-f]{20,}"}
#: Runs that are no secrets: without a digit or without a letter, UUIDs, placeholders.
ALLOWED = (r"^[^0-9]*$", r"^[^A-Za-z]*$",
           r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
           r"(?i)example|sample|dummy|placeholder|changeme|abcdefgh|01234567")


def _units(c: int) -> int:
    return round(c * math.log2(c) * UNIT) if c else 0


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, part): every match's place and the text of the group."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), part.alias("part"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,part:string>>)")

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(F.coalesce(end, start).alias("at"), F.when(end.isNull(), s["out"]).otherwise(
            F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["part"].alias("part"))))).alias("out"))

    got = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(pattern), got).otherwise(none)


def _codes(run: Column, signs: str) -> Column:
    """Each character's number among the signs."""
    return F.transform(F.sequence(F.lit(1), F.length(run)),
                       lambda i: F.call_function("locate", F.substring(run, i, F.lit(1)), F.lit(signs)))


def hot_span(run: Column, signs: str, bits: float, window: int = WINDOW) -> Column:
    """struct(lo, hi) of the run's hot part, lo = -1 if no window is hot."""
    most = math.floor(window * (math.log2(window) - bits) * UNIT)
    f = F.array(*(F.lit(_units(c)) for c in range(window + 2)))
    zero = F.array_repeat(F.lit(0), len(signs))

    def bump(counts: Column, code: Column, by: int) -> Column:
        return F.transform(counts, lambda x, j: F.when(j == code - 1, x + by).otherwise(x))

    def walk(codes: Column) -> Column:
        def step(s: Column, code: Column) -> Column:
            i = s["i"]
            had = F.get(s["counts"], code - 1)
            entered = F.struct(bump(s["counts"], code, 1).alias("counts"), (s["sum"] + F.get(f, had + 1) - F.get(f, had)).alias("sum"),
                               F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(0)).alias("out"))

            def leave(e: Column) -> Column:
                has = F.get(e["counts"], e["out"] - 1)
                total = F.when(e["out"] > 0, e["sum"] + F.get(f, has - 1) - F.get(f, has)).otherwise(e["sum"])
                hot = (i >= window - 1) & (total <= most)
                return F.struct((i + 1).alias("i"), total.alias("sum"),
                                F.when(e["out"] > 0, bump(e["counts"], e["out"], -1)).otherwise(e["counts"]).alias("counts"),
                                F.when(hot & (s["lo"] < 0), i - (window - 1)).otherwise(s["lo"]).alias("lo"),
                                F.when(hot, i + 1).otherwise(s["hi"]).alias("hi"))
            return F.get(F.transform(F.array(entered), leave), F.lit(0))
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum"), zero.alias("counts"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))
        return F.aggregate(codes, start, step, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi")))
    return F.get(F.transform(F.array(_codes(run, signs)), walk), F.lit(0))


def _span(kind: int, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


def _as_spans(column: str, kind: int) -> Column:
    return F.transform(column, lambda x: _span(kind, x["start"], x["end"]))


def _entropy_spans(text: Column, pattern: str, signs: str, bits: float) -> Column:
    """Hot parts of the runs that touch no span of `base` and are not allowed."""
    def plain(x: Column) -> Column:
        fine = ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        for allowed in ALLOWED:
            fine = fine & ~x["part"].rlike(allowed)
        return fine
    hot = F.transform(F.filter(matches(text, pattern), plain),
                      lambda x: F.struct(x["start"].alias("start"), hot_span(x["part"], signs, bits).alias("hot")))
    return F.transform(F.filter(hot, lambda x: x["hot"]["lo"] >= 0),
                       lambda x: _span(3, x["start"] + x["hot"]["lo"], x["start"] + x["hot"]["hi"]))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `base` and `added`: arrays of (start, kind, end), ordered; kind counts in KINDS."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__assign", F.filter(matches(t, ASSIGN, 2), lambda x: F.length(x["part"]) >= 6))
    out = out.withColumn("__access", matches(t, ACCESS)).withColumn("__hex", matches(t, HEX))
    out = out.withColumn("base", F.array_sort(F.concat(*(
        _as_spans(f"__{k}", n) for n, k in enumerate(KINDS[:3])))))
    for name, (signs, bits) in CLASSES.items():
        out = out.withColumn(f"__{name}", _entropy_spans(t, RUNS[name], signs, bits))
    lone = F.filter("__hexrun", lambda x: ~F.exists("__base64", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    out = out.withColumn("added", F.array_sort(F.concat("__base64", lone)))
    return out.drop("__assign", "__access", "__hex", "__base64", "__hexrun")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of `documents`."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *map(_count, range(3)), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        written(F.array_sort(F.concat("base", "added"))).alias("spans"))
