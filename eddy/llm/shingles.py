"""Word shingles as 64-bit hashes: the sets that near-duplicate operators compare."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash

from .common import ASCII_LOWER

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], "<u8")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = x.astype("<u8", copy=True)
    for by, mult in ((31, 0x7FB5D329728EA185), (29, 0x81DADEF4BC2DD44D)):
        x ^= x >> np.uint64(by)
        x *= np.uint64(mult)
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []


def word_hashes(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the documents' word counts."""
    counts = np.array([len(d) for d in docs], "<i8")
    flat = np.empty(int(counts.sum()), object)
    flat[:] = [w for d in docs for w in d]
    if not len(flat):
        return np.zeros(0, "<u8"), counts
    codes, uniques = pd.factorize(flat)
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, uniques), "<u8", len(uniques))
    return table[codes], counts


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of `words` consecutive words; with fewer words the whole
    sequence is one shingle, without words there is none."""
    hashes, counts = word_hashes([words_of(t) for t in texts])
    ends = np.cumsum(counts)
    out = []
    if len(hashes) >= words:
        runs = np.repeat(np.array([words], "<u8") * _ODD[-1], len(hashes) - words + 1)
        for k in range(words):
            runs += mix(hashes[k:len(hashes) - words + 1 + k] + _ODD[k]) * _ODD[k]
        runs = mix(runs)
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= words:
            out.append(np.unique(runs[end - n:end - words + 1]))
        elif n:
            part = np.array([np.uint64(n)], "<u8") * _ODD[-1]
            for k, h in enumerate(hashes[end - n:end]):
                part = part + mix(np.array([h], "<u8") + _ODD[k]) * _ODD[k]
            out.append(mix(part))
        else:
            out.append(np.zeros(0, "<u8"))
    return out
