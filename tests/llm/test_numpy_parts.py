"""The numpy kernels against plain Python."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from eddy.llm import byte_bpe, decontaminate, fm_index, jaccard_join, license_scan, lm_scoring, token_packing
from eddy.llm.shingles import shingle_sets


def test_fm_index_search_and_locate():
    rnd = np.random.default_rng(0)
    docs = [rnd.integers(1, 6, rnd.integers(0, 60)) for _ in range(40)] + [np.array([2, 3] * 20)] * 5
    index = fm_index.FMIndex(docs)
    patterns = np.array([[rnd.integers(0, 8) for _ in range(3)] for _ in range(200)])
    for p, lo, hi in zip(patterns, *index.search(patterns)):
        want = sorted((i, k) for i, d in enumerate(docs) for k in range(len(d) - 2) if list(d[k:k + 3]) == list(p))
        at = index.locate(np.arange(lo, hi))
        doc = np.searchsorted(index.starts, at, "right") - 1
        assert sorted(zip(doc.tolist(), (at - index.starts[doc]).tolist())) == want


def test_fm_index_without_documents():
    assert len(fm_index.suffix_order(np.zeros(0, "<i8"))) == 0


@pytest.mark.parametrize("shard", [25, 60, 10_000])
def test_decontamination_in_pieces_of_any_size(shard):
    rnd = random.Random(1)
    vocab = [f"w{i}" for i in range(30)]
    items = [(str(k), " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 3, 10, 14])))) for k in range(12)]
    windows = decontaminate.item_windows(items)
    texts = []
    for _ in range(30):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 80))]
        words[10:10] = rnd.choice(items)[1].split()
        texts.append(" ".join(words))
    docs = [decontaminate.words_of(t) for t in texts]
    got = decontaminate.shard_hits(docs, windows, shard)
    keys = list(windows)
    for r, w in enumerate(docs):
        want = {(k, len(x), x) for x in keys for k in range(len(w) - len(x) + 1) if tuple(w[k:k + len(x)]) == x}
        assert {(a, n, keys[i]) for a, n, i in got.get(r, [])} == want


def test_words_and_cutting():
    assert decontaminate.words_of("Ab-c É9_x\x7f") == [b"ab", b"c", "É9".encode(), b"x"]
    windows = decontaminate.item_windows([("1", "a b c")])
    text = "x A, b! c. y a b z"
    assert decontaminate.without(text, [(1, 4)], [frozenset(windows)]) == "x . y a b z"
    # the words that the cut brings together form the item again
    assert decontaminate.without("a a b c b c", [(1, 4)], [frozenset(windows)]).split() == []


def test_signatures_never_miss():
    """Pairs at the threshold share a signature at every level, whatever the set size."""
    rnd = np.random.default_rng(5)
    for level in range(3):
        for size in [*range(1, 30), 45, 90, 200]:
            for _ in range(6):
                a = rnd.integers(0, 1 << 62, size).astype("<u8")
                drop = rnd.integers(0, size // 4 + 1)
                b = np.concatenate([a[drop:], rnd.integers(0, 1 << 62, rnd.integers(0, size // 5 + 1)).astype("<u8")])
                x, y = set(a.tolist()), set(b.tolist())
                if 100 * len(x & y) < 75 * len(x | y):
                    continue
                which, sig = jaccard_join.signatures([np.unique(a), np.unique(b)], level)
                assert set(sig[which == 0].tolist()) & set(sig[which == 1].tolist())


class Captured:
    """Stands for the DataFrame that `meet` maps; keeps the function."""

    def repartition(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def packed_sets(sets):
    nodes = np.arange(len(sets), dtype="<i8")
    rows = [(b, 1, keys, e, None, None) for at in range(0, len(sets), 200)
            for b, keys, e in jaccard_join.pack(sets[at:at + 200], nodes[at:at + 200], 0, 1)]
    return jaccard_join._packed_rows(rows)


def test_meeting_holds_little_more_than_it_was_sent():
    """Most signatures are no other set's; unpacking all of them at once took several times the memory."""
    rnd = np.random.default_rng(15)
    batch = packed_sets([np.unique(rnd.integers(0, 1 << 62, 400).astype("<u8")) for _ in range(6000)])
    run = jaccard_join.meet(Captured(), 1)
    tracemalloc.start()
    assert not [b for b in run(iter([batch])) if b.num_rows]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * batch.nbytes


def test_meeting_by_ranges_loses_no_list(monkeypatch):
    """Lists are the same however few entries are unpacked at a time."""
    rnd = np.random.default_rng(16)
    base = [rnd.integers(0, 1 << 62, 60).astype("<u8") for _ in range(20)]
    sets = [np.unique(base[i % 20][rnd.random(60) < 0.95]) for i in range(600)]
    which, sig = jaccard_join.signatures(sets, 0)
    want = {}
    for w, x in zip(which.tolist(), sig.tolist()):
        want.setdefault(x >> 16, set()).add(w)          # one bucket: 48 bits tell signatures apart
    want = {tuple(sorted(v)) for v in want.values() if len(v) > 1}
    for entries in (1 << 17, 1000, 7):
        monkeypatch.setattr(jaccard_join, "RANGE", entries)
        rows = [r for b in jaccard_join.meet(Captured(), 1)(iter([packed_sets(sets)])) for r in b.to_pylist()]
        assert {(r["a"], r["b"]) for r in rows if r["kind"] == 1} == {(v[0], x) for v in want for x in v[1:]}
        assert sorted(tuple(r["members"]) for r in rows if r["kind"] == 2) == sorted(v for v in want if len(v) > 2)


def test_sketch_is_a_lower_bound():
    rnd = np.random.default_rng(6)
    sets = [np.unique(rnd.integers(0, 900, n).astype("<u8")) for n in (0, 3, 50, 200, 300, 700, 900)]
    words = jaccard_join.sketch_words(np.array([len(s) for s in sets]))
    bits = [np.unpackbits(x.view("u1"), bitorder="little") for x in np.split(jaccard_join.sketches(sets), np.cumsum(words)[:-1])]
    for x, a in zip(bits, sets):
        for y, b in zip(bits, sets):
            n = min(len(x), len(y))
            fold = [z.reshape(-1, n).sum(0) % 2 for z in (x, y)]
            assert (fold[0] != fold[1]).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def sifted_to_the_end(sets, c):
    """Rounds of `_sifted` in which no given pair is linked; the pairs of each round."""
    size = np.array([len(s) for s in sets])
    words, bits = jaccard_join.sketch_words(size), jaccard_join.sketches(sets)
    flat = np.insert(bits, np.cumsum(words) - words, size)
    hi = np.cumsum(words + 1)
    node, rounds = np.arange(len(sets)) * 3 - 50, []
    known, most, more = [np.zeros(0, "<i8") for _ in sets], 1, True
    while True:
        last = not more
        found, more = jaccard_join._sifted(node, c, flat, hi - words - 1, hi, known, most)
        assert not (last and len(found))        # a list that held nothing back has nothing left
        if not len(found):
            return node, rounds
        rounds.append(found)
        assert np.array_equal(c[np.searchsorted(node, found[:, :2])], found[:, 2:])
        for a, b in found[:, :2].tolist():
            at = int(np.searchsorted(node, a))
            known[at] = np.append(known[at], b)
        most *= 4


def test_sifting_in_rounds_gives_every_pair_once():
    rnd = np.random.default_rng(8)
    base = rnd.integers(0, 1 << 62, 300).astype("<u8")
    sets = [np.unique(np.concatenate([rnd.choice(base, 200, replace=False), rnd.integers(0, 1 << 62, 5).astype("<u8")])) for _ in range(60)]
    sets += [np.unique(rnd.integers(0, 1 << 62, 200).astype("<u8")) for _ in range(20)]
    sets += [np.unique(np.concatenate([base, rnd.integers(0, 1 << 62, k).astype("<u8")])) for k in range(40)]
    c = np.concatenate([np.arange(60), np.arange(20) % 3 + 100, 200 + np.arange(40) // 4])
    node, rounds = sifted_to_the_end(sets, c)
    given = [tuple(p[:2]) for r in rounds for p in r.tolist()]
    assert len(given) == len(set(given)) and all(a < b for a, b in given)
    for k, r in enumerate(rounds):
        assert len(r) <= 4 ** k * len(set(c.tolist()))
    # nothing that might be linked is left out
    of = {int(n): k for k, n in enumerate(node)}
    linked = {(int(node[i]), int(node[j])) for i in range(len(sets)) for j in range(i + 1, len(sets)) if c[i] != c[j]
              and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert linked and linked <= set(given)
    assert all(c[of[a]] != c[of[b]] for a, b in given)


def test_shingles():
    a, b, c, none, empty = shingle_sets(["a b c d e f", "A  b\tc d e", "a b", None, " \n"])
    assert len(a) == 2 and len(b) == 1 and b[0] in a and len(c) == 1 and not len(none) and not len(empty)


def test_bpe_equals_the_library_on_odd_texts():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers as P
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = byte_bpe.Encoder(byte_bpe.default_vocabulary())
    rnd = random.Random(1)
    signs = "aB1 \n\t\r\x85\xa0　  é漢😀'sll.,<|endoftext|>\x1c​ ñ٣ⅷ²"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    texts += ["", " ", "  ", " a", "a ", "<|endoftext|>", "x" * 3000]
    _, table = byte_bpe.decoder(byte_bpe.default_vocabulary())
    for t, raw in zip(texts, enc.encode(texts)):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == want.encode_ordinary(t)
        assert b"".join(table[i] for i in ids) == t.encode()
        spans = byte_bpe.char_offsets(raw, byte_bpe.default_vocabulary())
        assert len(spans) == len(ids) and (not ids or (spans[0, 0] == 0 and spans[-1, 1] == len(t)))
    assert enc.encode([None]) == [b""]


def test_a_word_is_encoded_once(monkeypatch):
    """Also when it comes in other pieces and calls; beyond the bound, pieces not asked for of late are forgotten."""
    enc = byte_bpe.Encoder(byte_bpe.default_vocabulary())
    asked, model = [], enc.model
    enc.model = type("Counting", (), {"tokenize": lambda self, w: asked.append(w) or model.tokenize(w)})()
    for t in ("x wörd", "x wörd, Wörd", "y wörd. wörd,", "x wörd. wörd"):
        enc.encode([t])
    assert len(asked) == len(set(asked))
    monkeypatch.setattr(enc.spaced, "most", 10)
    plain = byte_bpe.Encoder(byte_bpe.default_vocabulary())
    for i in range(200):
        t = f"x often w{i} v{i}"
        assert enc.encode([t]) == plain.encode([t])
        assert len(enc.spaced) <= 10 and len(enc.spaced.before) <= 10 + 5
    assert asked.count("Ġoften") == 1


def test_marks_and_line_feeds_are_cut_without_the_pattern():
    """Words with marks, at the ends of lines or not, are cut by substrings into pieces that are known already."""
    enc = byte_bpe.Encoder(byte_bpe.default_vocabulary())
    asked, words = [], enc.words
    enc.words = lambda piece: asked.append(piece) or words(piece)
    enc.encode(["one two, wörd!! one.\nNext wörd.\nWörd, next"])
    assert all(set(piece) <= set(",!.\n") for piece in asked)


def test_lines_and_marks_give_the_pattern_matches():
    """Against one match of the pattern after the other, on texts of letters, marks and all kinds of white space."""
    plain, enc = byte_bpe.Encoder(byte_bpe.default_vocabulary()), byte_bpe.Encoder(byte_bpe.default_vocabulary())
    rnd = random.Random(21)
    kinds = ["a", "Bc", "wörd", "7", "²", "x1", ".", ",", "!!", "'s", "'", "_", "\u0301", " ", " ", " ", "  ", "\n", "\n", "\n\n", "\t", "\r\n",
             "\x85", "\u2003", "\u2028", "\x1c", "漢", "ª", "Ⅷ"]
    for n in range(3000):
        t = "".join(rnd.choices(kinds, k=rnd.randint(1, 14)))
        want = b"".join(plain._word(plain._chars(w)) for w in plain.words(t))
        assert enc.encode([t]) == [want], repr(t)


def test_a_task_leaves_no_pieces_in_its_worker():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two, two", None]})
    path = byte_bpe.default_vocabulary()
    for _, ids in byte_bpe.encoded(iter([batch]), "text", path):
        assert len(ids) == 2 and byte_bpe.encoder(path).spaced
    enc = byte_bpe.encoder(path)
    assert not (enc.spaced or enc.spaced.before or enc.bare or enc.bare.before)


def test_best_fit_decreasing():
    rnd = random.Random(2)
    for n in (0, 1, 5, 400):
        sizes = [rnd.randint(1, 100) for _ in range(n)]
        rows = token_packing.best_fit_decreasing(sizes, 100)
        assert sorted(p for r in rows for p in r) == list(range(n))
        rooms, taken = [], 0
        for s in sorted(sizes, reverse=True):       # the plain rule
            fits = [i for i, x in enumerate(rooms) if x >= s]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= s
            else:
                rooms.append(100 - s)
        assert sorted(100 - sum(sizes[p] for p in r) for r in rows) == sorted(rooms)


def test_license_scan_equals_brute_force():
    rnd = random.Random(4)
    vocab = [f"v{i}" for i in range(50)]
    registry = license_scan.Registry(license_scan.TEMPLATES)
    texts = [None, "", "!!"]
    for k in range(60):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        name, notice = license_scan.TEMPLATES[k % len(license_scan.TEMPLATES)]
        own = notice.split()
        if k % 3 == 0:
            own[rnd.randrange(len(own))] = "other"
        words[rnd.randint(0, len(words)):0] = own
        texts.append(" ".join(words))
    for t, got in zip(texts, registry.scan(texts)):
        assert {n for n, _, _ in got} == brute_licenses(t)


@pytest.mark.parametrize("text, want", [
    ("Licensed under the MIT License", {"MIT"}), ("it is licensed under the GNU General Public License v3.", {"GPL", "GPL-3.0"}),
    ("under the terms of the GNU Lesser General Public License", {"LGPL"}), ("Licensed under CC BY 4.0", {"CC-BY-4.0"}),
    ("Released under the ISC License", {"ISC"}), ("licensed under the Eclipse Public License", {"EPL"}),
    ("licensed under the GNU Affero General Public License", {"AGPL"}), ("Licensed under CC0 1.0 Universal", {"CC0-1.0"}),
    ("This is free and unencumbered software released into the public domain.", {"Unlicense"})])
def test_usual_wordings_of_licenses(text, want):
    got, = license_scan.Registry(license_scan.TEMPLATES).scan(["Some words go before. " + text + " And some after."])
    assert {n for n, _, _ in got} == want


def test_license_bodies_are_found_whole_and_by_their_own_name():
    from eddy.llm.license_texts import BODIES
    registry = license_scan.Registry(license_scan.TEMPLATES)
    for (name, text), got in zip(BODIES, registry.scan([t for _, t in BODIES])):
        # bodies name the licences they allow besides; a long passage is found by its own name
        long = [(n, e - a) for n, a, e in got if e - a >= 60]
        assert all(name in n.split("/") or n == name.split("-")[0] for n, _ in long), name
        assert sum(k for _, k in long) >= 0.9 * (len(license_scan.WORD.findall(text)) - 5), name
        middle = " ".join(text.split()[30:170])
        assert any(name in n.split("/") for n, _, _ in registry.scan([middle])[0]), name


def brute_licenses(text):
    """Names of templates of which some window of the text holds the needed share."""
    def grams(words, n):
        return [tuple(words[k:k + n]) for k in range(len(words) - n + 1)]
    doc = license_scan.WORD.findall(text.casefold()) if text else []
    out = set()
    for name, notice in license_scan.TEMPLATES:
        words = license_scan.WORD.findall(notice.casefold())
        n = min(license_scan.SHINGLE, len(words))
        want = set(grams(words, n))
        size = 1 << (len(want) - 1).bit_length()
        step = max(1, size // 4)
        own = grams(doc, n)
        for lo in range(0, max(-(-(len(own) - size) // step), 0) * step + 1, step):
            if own and len(want & set(own[lo:lo + size + step])) >= license_scan.CONTAINMENT * len(want):
                out.add(name)
    return out


def test_language_model_normalises_and_learns():
    rnd = random.Random(3)
    known = lm_scoring.Classes({int(lm_scoring.word_hash([w])[0]): i for i, w in enumerate([b"a", b"b", lm_scoring.END])},
                               np.zeros(3 + lm_scoring.BINS), np.zeros(3 + lm_scoring.BINS),
                               np.concatenate([[500, 500, 100], np.zeros(lm_scoring.BINS)]), 1100, 3)
    texts = [" ".join("ab"[k % 2] for k in range(20)) for _ in range(400)]
    t = lm_scoring.Trainer(known)
    end = 2
    for _ in range(15):
        codes, names, counts = lm_scoring.tokens_of(texts)
        t.learn(known.of(names)[codes], counts, end)
    y = known.of(names)[codes]
    ctx = lm_scoring.contexts(y, counts, end)
    got = lm_scoring.class_log_probabilities(t.w, ctx, y)
    unigram = np.log10((known.mass + 1) / (known.mass + 1).sum())[y]
    assert got.mean() > unigram.mean() + 0.1
    every = [lm_scoring.class_log_probabilities(t.w, ctx[:, :5], np.full(5, c)) for c in range(len(known.mass))]
    assert np.allclose((10.0 ** np.stack(every)).sum(0), 1, atol=1e-4)


def test_own_vectors_are_normalised_over_the_words_of_a_group():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 62, 300).astype("<u8")
    bins = rng.integers(0, 2, 300)
    group = lm_scoring.groups(words, bins)
    assert all(len(set(bins[group == g].tolist())) == 1 for g in set(group.tolist())) and 4 <= len(set(group.tolist())) <= 6
    at = rng.normal(0, 1, (300, lm_scoring.DIM))
    code = np.repeat(np.arange(300), 5)
    times = np.tile([1, 2, 1, 1, -1], 300)
    times[code == 7] = -1                              # a word without training tokens
    means = (at[code] + rng.normal(0, 0.5, (1500, lm_scoring.DIM))).astype("<f4")
    c, q, d = lm_scoring.own_vectors(code, times, means, group)
    assert c[7] == 0 and c[8] == 5 and np.abs(q).sum(1).astype(bool)[c > 0].all()
    got = lm_scoring.gains(code, means, group, c, q, d)
    assert (got[code == 7] == 0).all() and got[(times < 0) & (code != 7)].mean() > 0.3
    of = np.flatnonzero((group == group[0]) & (c > 0))
    share = (c[of] + 1) / (c[of] + 1).sum()
    for context in means[:20]:
        every = lm_scoring.gains(of, np.repeat(context[None], len(of), 0), group, c, q, d)
        assert abs((share * 10 ** every).sum() - 1) < 1e-3
