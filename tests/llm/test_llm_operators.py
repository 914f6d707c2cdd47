"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, no rows and
clashing column names, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddy.llm import (byte_bpe, decontaminate, jaccard_join, language_id, license_scan, line_dedup, lm_scoring,
                      secret_scan, token_packing, topk_search)
from eddy.llm.common import cut
from eddy.llm.shingles import shingle_sets

from test_numpy_parts import brute_licenses

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rnd = random.Random(9)
    vocab = {"en": "the of and stone river under light with from".split(), "de": "der die und über stein fluß mit aus größe".split()}
    rows = []
    for k in range(70):
        lang = ("en", "de")[k % 2]
        text = "\n".join(" ".join(rnd.choice(vocab[lang]) + rnd.choice(["", "s", "en"]) for _ in range(rnd.randint(4, 14)))
                         for _ in range(rnd.randint(1, 4)))
        rows.append([k, text, lang, "s", len(text)])
    rows += [[100, rows[3][1], "de", "s", 1], [101, rows[3][1] + "x", "de", "s", 1], [3, rows[3][1], "de", "s", 1],
             [102, None, "en", None, None], [103, "", None, "s", 0], [104, "!!! 123", "en", "s", 7],
             [None, rows[4][1], "en", "s", 3], [105, "word " * 5000, "en", "hot", 25000], [106, " \n\t\n", "en", "s", 3]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    """The corpus with columns whose names operators use themselves."""
    df = spark.createDataFrame(corpus(), DOCS)
    return df.select("*", F.lit(1).alias("ids"), F.lit("x").alias("node"), F.lit(2).alias("h"), F.lit(3).alias("score"),
                     F.lit(4).alias("base"), F.lit(5).alias("notices"), F.lit(6).alias("hit_words"), F.lit(7).alias("line_no"))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ------------------------------------------------------------------ 1

def brute_hits(rows, items):
    windows = decontaminate.item_windows(items)
    out = []
    for doc, text in rows:
        w = decontaminate.words_of(text)
        hit, found = set(), set()
        for x, ids in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k:k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found |= set(ids)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontaminate(spark, docs, none):
    rows = corpus()
    items = [(1, rows[0][1]), (2, " ".join(rows[1][1].split()[:4])), (10, rows[1][1]), (3, None), (4, "..."), (None, "word " * 12)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_hits([(r[0], r[1]) for r in rows], [("null" if i is None else str(i), t) for i, t in items])
    for kw in ({}, {"shard_words": 40}, {"block_chars": 10}):
        assert rows_of(decontaminate.judged(decontaminate.find(docs, bench, **kw))) == want
    assert rows_of(decontaminate.judged(decontaminate.find(none, bench))) == []
    clean = decontaminate.judged(decontaminate.find(docs, bench.limit(0)))
    assert clean.where("contaminated").count() == 0 and clean.count() == len(rows)
    cut = decontaminate.cut_spans(decontaminate.find(docs, bench), bench)
    assert decontaminate.judged(decontaminate.find(cut.drop("hit_words"), bench)).where("contaminated").count() == 0
    for kw in ({}, {"block_chars": 10}):            # cut in the pass that finds
        fused = decontaminate.find(docs, bench, cut=True, **kw)
        assert rows_of(fused.select("doc_id", "text", "n_words", "hit_words", "hit_items")) == rows_of(
            cut.select("doc_id", "text", "n_words", "hit_words", "hit_items"))
    same = {r.text for r in cut.where(F.size("hit_words") == 0).collect()}
    assert same <= {r[1] for r in rows}


# ------------------------------------------------------------------ 2

def brute_components(rows):
    sets = {}
    for doc, text in rows:
        sets.setdefault(doc, []).append(set(shingle_sets([text])[0].tolist()))
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (max(map(len, s)), root(d)) for d, s in sets.items()}


def test_jaccard_join(docs, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == brute_components([(r[0], r[1]) for r in corpus() if r[0] is not None])
    assert jaccard_join.near_duplicates(none).count() == 0


def test_jaccard_join_of_copies_and_a_common_passage(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(15):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 5, 6, 8, 9, 12, 15, 20, 30, 60, 200]))]
        for _ in range(rnd.randint(2, 12)):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 25))):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(words)))
    passage = " ".join(rnd.choice(vocab) for _ in range(40))
    rows += [(2000 + k, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(5, 14))) + " " + passage) for k in range(120)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_components(rows)


def test_jaccard_join_of_a_wide_group(spark, monkeypatch):
    """Copies of one text with so many edits that few are linked with any one of them; a finer cut."""
    rnd = random.Random(12)
    base, rows = [f"w{i}" for i in range(120)], []
    for k in range(260):
        words = list(base)
        for at in rnd.sample(range(120), rnd.randint(0, 3)):
            words[at] = f"x{rnd.randrange(10_000)}"
        rows.append((k, " ".join(words)))
    df, want = spark.createDataFrame(rows, "doc_id bigint, text string"), brute_components(rows)
    for longest in (jaccard_join.PAIRED, 40):
        monkeypatch.setattr(jaccard_join, "PAIRED", longest)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()} == want


# ------------------------------------------------------------------ 3

def test_license_scan(docs, none):
    got = license_scan.scan(docs).select("doc_id", "text", "notices").collect()
    assert len(got) == len(corpus())
    assert all({n.name for n in r.notices} == brute_licenses(r.text) for r in got)
    assert license_scan.scan(none).count() == 0


def test_license_scan_counts_a_notice_once(spark):
    texts = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License",
             "Licensed under the GNU General Public License. And now, some ten or more quite other words: GNU General Public License v2"]
    out = license_scan.specific(license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))
    assert [[n.name for n in r.notices] for r in out.orderBy("doc_id").collect()] == [["GPL-3.0"], ["GPL"], ["GPL", "GPL-2.0"]]


# ------------------------------------------------------------------ 4

def test_topk_search(spark):
    rnd = random.Random(8)
    rows = [(k, [rnd.choice([-1.5, -0.25, 0.0, 0.3, 0.999]) for _ in range(6)], k % 3) for k in range(160)]
    rows += [(200 + k, [0.5] * 6, 0) for k in range(30)]                # one very common vector
    rows += [(300, None, 1), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (400, [float("nan")] * 6, 1), (401, [float("inf")] * 6, 1),
             (None, [0.1] * 6, 1), (450, [1.0, 2.0], 1), (451, [1.0, 2.0], 1), (500, [], 1), (50, rows[50][1], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("score", F.lit(1))
    fine = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v, _ in rows
                   if i is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    want = []
    for q, x in fine:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in fine if c != q and len(x) == len(y))[:5]
            want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    for kw in ({}, {"query_rows": 2, "vector_rows": 16}):
        got = topk_search.top_k(df, F.pmod(F.col("id"), F.lit(50)) == 0, **kw)
        assert rows_of(got) == sorted(want, key=str)
    assert topk_search.top_k(df.limit(0), F.col("id") == 0).count() == 0


# ------------------------------------------------------------------ 5

def test_language_id(docs, none):
    model = language_id.fit_on(docs)
    out = {(r.doc_id, r.text): r for r in language_id.identify(docs, model).collect()}
    for doc, text, lang, *_ in corpus():
        r = out[doc, text]
        if not text or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif doc is not None and doc < 70:
            assert r.lang_pred == lang and 0.5 < r.score <= 1
    assert language_id.identify(none, model).count() == 0
    assert language_id.fit_on(none) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_language_id_held_out(spark):
    out = language_id.op5_language_id(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


# ------------------------------------------------------------------ 6

def brute_secrets(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in re.finditer(secret_scan.ASSIGN, text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base.sort()
    added, w = {}, secret_scan.WINDOW
    for name, (signs, bits) in secret_scan.CLASSES.items():
        added[name] = []
        for m in re.finditer(secret_scan.RUNS[name], text):
            if any(a < m.end() and m.start() < b for a, _, b in base) or any(re.search(p, m[0]) for p in secret_scan.ALLOWED):
                continue
            hot = [k for k in range(len(m[0]) - w + 1)
                   if -sum(c / w * math.log2(c / w) for c in Counter(m[0][k:k + w]).values()) >= bits - 1e-6]
            if hot:
                added[name].append((m.start() + hot[0], 3, m.start() + hot[-1] + w))
    lone = [x for x in added["hexrun"] if not any(a < x[2] and x[0] < b for a, _, b in added["base64"])]
    return base, sorted(base + added["base64"] + lone)


def test_secret_scan(spark, docs, none):
    rnd = random.Random(7)
    signs = "ABCDEFabcdefghijk0123456789+/_=-"
    texts = [None, "", "password", 'Api_Key" : "abc', "token: token: abcdefgh", "é😀 secret=“x” PASSWD = 'hunter22' end",
             "AKIA" + "A1" * 9 + " AKIAshort " + "0123456789abcdef" * 3, "f81d4fae-7dec-11d0-a765-00a0c91e6bf6",
             "a" * 60, "token=abcdef" * 40, "01234567 " * 10]
    texts += [" ".join("".join(rnd.choice(signs) for _ in range(rnd.randint(5, 60))) for _ in range(6)) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").select("*", F.lit(1).alias("base"), F.lit(2).alias("added"))
    for r in secret_scan.scan(df).collect():
        base, every = brute_secrets(r.text)
        assert [tuple(x) for x in r.base] == base
        assert sorted([tuple(x) for x in r.base] + [tuple(x) for x in r.added]) == every
    assert secret_scan.scan(docs).count() == len(corpus()) and secret_scan.scan(none).count() == 0


# ------------------------------------------------------------------ 7

def test_token_packing(docs, none):
    enc = byte_bpe.Encoder(byte_bpe.default_vocabulary())
    want = sorted(tuple(np.frombuffer(enc.encode([r[1]])[0], "<u4").tolist()) for r in corpus() if r[1])
    rows = token_packing.pack(docs, length=128, group_docs=30).collect()
    pieces = {}
    for r in rows:
        ids, pos = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.positions, "<u2")
        assert len(ids) == len(pos) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 128
        assert (ids[r.n_tokens:] == token_packing.PAD).all()
        for s, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:])):
            assert pos[a:b].tolist() == list(range(b - a))
            pieces.setdefault((r.grp, r.doc_ids[s]), []).append((r.offsets[s], ids[a:b].tolist()))
    total = Counter(t for p in pieces.values() for _, ids in p for t in ids)
    assert total == Counter(t for w in want for t in w)
    whole = [tuple(t for _, ids in sorted(p) for t in ids) for (_, doc), p in pieces.items() if doc not in (3,)]
    assert set(whole) <= set(want)
    assert token_packing.pack(none).count() == 0


def test_packing_does_not_depend_on_the_layout(docs):
    one = rows_of(token_packing.pack(docs.coalesce(1), length=128, group_docs=30))
    assert one == rows_of(token_packing.pack(docs.repartition(7), length=128, group_docs=30))


# ------------------------------------------------------------------ 8

def test_lm_scoring(docs, none):
    rows = corpus()
    train = lambda d: d is None or zlib.crc32(str(d).encode()) % 7 != 2
    words = [(d, [w.decode() for w in lm_scoring.words_of(t)] + ["\n"]) for d, t, *_ in rows]
    c = Counter(w for d, ws in words if train(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), len(ws), sum(w in c for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for d, ws in words)
    src = docs.drop("score").withColumn("train", ~lm_scoring.is_held_out("doc_id", 7, 2))
    out = lm_scoring.score(src).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert {r.train_tokens for r in out} == {n} and all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert lm_scoring.score(none.withColumn("train", F.lit(True))).count() == 0
    untrained = lm_scoring.score(src.withColumn("train", F.lit(False))).collect()
    assert {(r.n_known, r.train_tokens) for r in untrained} == {(0, 0)} and all(abs(r.base_score) < 1e-9 for r in untrained)


def test_lm_scoring_of_blocks_of_equal_rows(spark):
    """A table united with itself: the second half's blocks hold the rows of the first in the same order."""
    one = spark.createDataFrame([(k, f"a b w{k}", True) for k in range(6)], "doc_id bigint, text string, train boolean")
    out = lm_scoring.score(one.union(one)).collect()
    total = math.log10(48 + 9 + 1)        # 12 texts of 4 tokens; a, b, the end and six words
    want = 3 * math.log10(13) + math.log10(3) - 4 * total
    assert len(out) == 12
    assert {(r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out} == {(4, 4, round(want, 6))}


def test_model_beats_the_unigram_base(spark):
    rows = lm_scoring.op8_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_rare_words_of_a_class_are_told_apart_by_their_contexts(spark):
    """Forty words with one ending, too rare for classes of their own, half of them after `left` and half after `right`."""
    rows = [" ".join(f"f{k}" for k in range(130))] * 50
    rows += [f"{('left', 'right')[k // 20]} w{k}zz" for k in range(40)] * 6
    train = [(i, t, True) for i, t in enumerate(rows)]
    held = [(10_000 + 2 * k + side, f"{('left', 'right')[side]} w{k}zz", False) for k in range(40) for side in (0, 1)]
    out = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(train + held, "doc_id bigint, text string, train boolean")).collect()}
    assert len({round(out[d].base_score, 9) for d, *_ in held}) == 1 and {out[d].n_known for d, *_ in held} == {3}
    seen = [out[10_000 + 2 * k + k // 20].score for k in range(40)]
    other = [out[10_000 + 2 * k + 1 - k // 20].score for k in range(40)]
    assert sum(seen) / 40 > sum(other) / 40 + 0.2


# ------------------------------------------------------------------ 9

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_banded_automaton(spark):
    rnd = random.Random(2)
    pairs = []
    for _ in range(300):
        a = [rnd.choice("abé😀") for _ in range(rnd.randint(0, 14))]
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randint(0, len(b))
            b[k:k + rnd.randint(0, 1)] = rnd.choice(["", "a", "é"])
        pairs.append(("".join(a), "".join(b)))
    for tau in (1, 2, 3):
        near = [(a, b) for a, b in pairs if abs(len(a) - len(b)) <= tau]
        df = spark.createDataFrame(near, "a string, b string")
        got = df.select("a", "b", line_dedup.within(F.split("a", ""), F.split("b", ""), tau).alias("x")).collect()
        assert all(r.x == (distance(r.a, r.b) <= tau) for r in got if r.a and r.b)
        got = df.select("a", "b", line_dedup.close(F.col("a"), F.col("b"), tau).alias("x")).collect()
        assert all(r.x == (distance(r.a, r.b) <= tau) for r in got)
        bound = line_dedup._count_distance(line_dedup.letter_counts(F.col("a")), line_dedup.letter_counts(F.col("b")))
        assert all(r.x <= 2 * distance(r.a, r.b) for r in df.select("a", "b", bound.alias("x")).collect())


def brute_drops(rows, tau=line_dedup.TAU, least=line_dedup.MIN_CHARS):
    places = sorted(((-1, 0) if d is None else (0, d), k, line) for d, t in rows for k, line in enumerate((t or "").split("\n")) if len(line) >= least)
    first = {}
    for d, k, line in places:
        first.setdefault(line, (d, k))
    out = set()
    for d, k, line in places:
        near = any(o != line and first[o] < first[line] and abs(len(o) - len(line)) <= tau and distance(o, line) <= tau for o in first)
        if near or first[line] != (d, k):
            out.add((None if d[0] else d[1], k))
    return out


def test_line_dedup(spark, docs, none):
    rnd = random.Random(1)
    base = ["".join(rnd.choice("abcdefgé ") for _ in range(rnd.randint(18, 40))) for _ in range(12)]
    rows = [(r[0], r[1]) for r in corpus()]
    for k in range(60):
        lines = []
        for _ in range(4):
            line = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                line[rnd.randrange(len(line))] = rnd.choice(["", "x", "yz"])
            lines.append("".join(line))
        rows.append((1000 + k, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit(1).alias("line"), F.lit(2).alias("key"), F.lit(3).alias("h"))
    got = {(r.doc_id, r.line_no) for r in line_dedup.dropped_lines(df).collect()}
    assert got == brute_drops(rows)
    kept = {r.doc_id: r.text for r in line_dedup.line_dedup(df).where("doc_id >= 1000").collect()}
    for d, t in rows:
        if d is not None and d >= 1000:
            left = [x for k, x in enumerate(t.split("\n")) if (d, k) not in got]
            assert kept.get(d) == ("\n".join(left) if any(x.strip() for x in left) else None)
    assert line_dedup.line_dedup(none).count() == 0 and line_dedup.line_dedup(docs).columns == docs.columns


def test_line_dedup_of_short_lines(spark):
    """Equal lines go at any length, near ones only from MIN_CHARS on; blank lines stay."""
    long = "a line of more than twenty characters"
    rows = [(1, f"short\n\n{long}\n\n  \nend."), (2, f"{long}\nshort\n\nshort\nother"), (3, f"shorts\n{long}\n\nend."), (4, f"end.\n{long}\n\n\t"),
            (None, "other")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.line_no, r.near) for r in line_dedup.dropped_lines(df).collect()}
    assert got == {(2, 0, False), (2, 1, False), (2, 3, False), (2, 4, False), (3, 1, False), (3, 3, False), (4, 0, False), (4, 1, False)}
    kept = {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect()}
    assert kept == {None: "other", 1: rows[0][1], 3: "shorts\n"}


# ----------------------------------------------------------------- 10

def test_small_link_tables_take_few_tasks(spark):
    """Whatever the number of shuffle partitions: each task of a round writes files of its own."""
    from eddy.llm.graph import components
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    was = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("16", "false")):
            spark.conf.set(n, v)
        found = components(spark.createDataFrame([(i, i + 1) for i in range(0, 60, 2)], "a bigint, b bigint"))
        assert found.rdd.getNumPartitions() == 1
        assert {(r.node, r.component) for r in found.collect()} == {(i, i - i % 2) for i in range(60)}
    finally:
        for n, v in zip(names, was):
            spark.conf.set(n, v)


def test_digests_take_one_python_worker_a_task(docs):
    out = byte_bpe.digests(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    both = byte_bpe.decode(byte_bpe.encode(docs)).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    assert sorted(map(str, out.collect())) == sorted(map(str, both.collect()))


def test_byte_bpe(docs, none):
    out = byte_bpe.decode(byte_bpe.encode(docs, offsets=True)).select("doc_id", "n_tokens", "ids", "decoded").collect()
    assert sorted(bytes(r.decoded) for r in out) == sorted((r[1] or "").encode() for r in corpus())
    assert all(len(r.ids) == 4 * r.n_tokens for r in out)
    assert byte_bpe.digests(none).count() == 0


# ------------------------------------------------------------------ size estimates of rounds

def estimate_bits(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_rounds_do_not_square_the_size_estimate(spark):
    """A table joined with its own last form, round after round: the estimate doubled its digits each time."""
    t = spark.range(20).withColumnRenamed("id", "a")
    for _ in range(8):
        t = cut(t.join(t.withColumnRenamed("a", "b"), F.col("a") == F.col("b")).select("a"))
    assert estimate_bits(t) <= 64
    assert sorted(r.a for r in t.collect()) == list(range(20))


def test_component_rounds_do_not_square_the_size_estimate(spark):
    """The links of the pipeline's near-duplicate stage: a chain takes several rounds, each joined with the last."""
    from eddy.llm.graph import components
    found = components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint").coalesce(1))
    assert estimate_bits(found) <= 64
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(41)}
