"""Operator 10: byte-level BPE encoding and decoding with the tokenizers library.

`encode` maps Arrow batches of texts to packed token ids. A text is first cut where the vocabulary's
pre-tokenizer always cuts (before a single space that precedes a non-space, and around white
space); pieces are encoded by the library's model when a worker first meets them, then looked up.
`decode` turns ids back into bytes by reversing the vocabulary's byte-to-character table. `digests` does both in
one pass.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to no bytes; a
text of any length is encoded whole; equal texts give equal ids; extra columns pass through.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, table, text_batches

#: Unicode White_Space, as the pre-tokenizer's \s (Python's own \s also holds U+001C to U+001F).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space that stands beside other white space, or at an end.
CROWDED = re.compile(f" [{SPACE}]|[{SPACE}] |^ | $")
PIECE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: White space other than the space and the line feed.
RARE_ASCII = "\t\v\f\r"
RARE = RARE_ASCII + "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200b)))

#: Pieces kept between slices (half of them from before the last turn), and the longest one kept.
CACHE_PIECES = 600_000
CACHE_CHARS = 48


#: Whether Python's unsigned integers are ids as written.
NATIVE = array("I").itemsize == 4 and sys.byteorder == "little"


#: Characters that are no letter, digit, space or apostrophe: the pattern takes a run of them after letters as one match.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def rare(text: str) -> bool:
    return any(map(text.__contains__, RARE_ASCII if text.isascii() else RARE))


def crowded(text: str) -> bool:
    """Whether `CROWDED` matches; substrings answer it for texts without rarer white space."""
    if rare(text):
        return CROWDED.search(text) is not None
    return "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " "


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """The reversed byte table: printable bytes stand for themselves, the others, in order, for
    the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: What the byte table has for a space. Letters of ASCII stand for themselves.
SPACE_CHAR = next(c for c, b in byte_of_char().items() if b == 32)


def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id. Added tokens stand for their own text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    table_ = byte_of_char()
    vocab = spec["model"]["vocab"]
    added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    out = [b""] * (max([*vocab.values(), *added]) + 1)
    for token, i in vocab.items():
        out[i] = added[i] if i in added else bytes(table_[c] for c in token)
    for i, content in added.items():
        out[i] = content
    return out


class Pieces(dict):
    """Ids of pieces by piece, made when first asked for. When `turn` finds more than `most` of them, those asked
    for since the turn before are kept and the others forgotten."""

    def __init__(self, make, most: int):
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= CACHE_CHARS:
            self[piece] = ids
        return ids

    def turn(self) -> None:
        if 2 * len(self) > self.most:
            self.before = dict(self)
            self.clear()

    def forget(self) -> None:
        self.before = {}
        self.clear()


class Encoder:
    """Texts to little-endian unsigned 32-bit ids. Holds bounded tables of encoded pieces: `spaced` those after one
    space, by what follows it, `bare` the others."""

    def __init__(self, path: str, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path).model
        self.words = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.chars = {b: c for c, b in byte_of_char().items()}
        self.spaced = Pieces(self._after_space, CACHE_PIECES)
        self.bare = Pieces(self._ids, CACHE_PIECES // 8)

    def _after_space(self, rest: str) -> bytes:
        """Ids of a space and `rest`; if these are letters the two are one match of the pattern, and marks after
        them another one."""
        if rest.isalpha():
            return self._word(SPACE_CHAR + rest if rest.isascii() else self._chars(" " + rest))
        head = rest.rstrip(MARKS)
        if head.isalpha():
            return self.spaced[head] + self.bare[rest[len(head):]]
        return self._ids(" " + rest)

    def _ids(self, piece: str) -> bytes:
        """Ids of the pattern's matches in a piece."""
        if piece.isalpha():
            return self._word(piece if piece.isascii() else self._chars(piece))
        head = piece.rstrip(MARKS)
        if head.isalpha():
            return self.bare[head] + self.bare[piece[len(head):]]
        words = self.words(piece)
        if len(words) == 1:
            return self._word(self._chars(piece))
        return b"".join([self.spaced[w[1:]] if w[0] == " " and w[1:].isalpha() else self.bare[w] for w in words])

    def _chars(self, word: str) -> str:
        return word.encode("utf-8").decode("latin-1").translate(self.chars)

    def _word(self, chars: str) -> bytes:
        """Ids of one match in the byte-to-character form, by the library's BPE model."""
        ids = [t.id for t in self.model.tokenize(chars)]
        return array("I", ids).tobytes() if NATIVE else np.array(ids, "<u4").tobytes()

    def _one(self, text: str) -> bytes:
        """The text is cut where the pre-tokenizer cuts as well: where each space stands alone between other
        characters at every space, and at line feeds that do too; else by the white-space rules."""
        if crowded(text):
            return b"".join(map(self.bare.__getitem__, PIECE.findall(text)))
        if "\n" not in text or "\n\n" in text or text[0] == "\n" or text[-1] == "\n" or rare(text):
            return self._line(text)
        return self.bare["\n"].join(map(self._line, text.split("\n")))

    def _line(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        return b"".join([self.bare[first], *map(self.spaced.__getitem__, rest)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = [self._one(t) if t else b"" for t in texts]
        self.spaced.turn()
        self.bare.turn()
        return out


_ENCODERS: dict[str, Encoder] = {}
_BYTES: dict[str, tuple[np.ndarray, list[bytes]]] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batches: Iterator[pa.RecordBatch], column: str, path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the ids of a column's texts. The tables of pieces end with the task: the worker
    may serve other steps next, which would not have their memory."""
    enc = encoder(path)
    try:
        for b, texts in text_batches(batches, column):
            yield b, enc.encode(texts)
    finally:
        enc.spaced.forget()
        enc.bare.forget()
        pa.default_memory_pool().release_unused()


def decoder(path: str) -> tuple[np.ndarray, list[bytes]]:
    if path not in _BYTES:
        table_ = token_bytes(path)
        _BYTES[path] = np.array([len(b) for b in table_], "<i8"), table_
    return _BYTES[path]


def bytes_of(ids: bytes, table_: list[bytes]) -> bytes:
    return b"".join(map(table_.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def char_offsets(ids: bytes, path: str) -> np.ndarray:
    """Start and end (exclusive) in characters of every token, as an n x 2 array. A character that
    several tokens share counts for each of them."""
    widths, table_ = decoder(path)
    seq = np.frombuffer(ids, "<u4")
    ends = np.cumsum(widths[seq])
    data = np.frombuffer(b"".join([table_[i] for i in seq]), "u1")
    lead = np.cumsum((data & 0xC0) != 0x80)  # characters begun up to each byte
    if not len(seq):
        return np.zeros((0, 2), "<i4")
    return np.stack([lead[ends - widths[seq]] - 1, lead[ends - 1]], 1).astype("<i4")


def encode(docs: DataFrame, vocabulary: str | None = None, text: str = "text", offsets: bool = False) -> DataFrame:
    """The other columns of `docs`, with the text replaced by `ids` (binary, unsigned 32-bit
    little-endian), `n_tokens`, and with `offsets` also `char_offsets` (binary, int32 pairs)."""
    ready(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    made = {"ids", "n_tokens", "char_offsets"}
    rest = [c for c in docs.columns if c != text and c not in made]
    src = docs.select(*rest, F.col(text).alias("__text"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in rest] + ["ids binary", "n_tokens bigint"]
                       + ["char_offsets binary"] * offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ids in encoded(batches, "__text", path):
            cols = [b.column(i) for i in range(len(rest))]
            cols += [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if offsets:
                cols.append(pa.array([char_offsets(x, path).tobytes() for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, rest + ["ids", "n_tokens"] + ["char_offsets"] * offsets)

    return src.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Adds `decoded` (the bytes of `ids`). Bytes are joined before anything reads them as UTF-8,
    so a character split over tokens comes back whole; null ids give no bytes."""
    ready(encoded.sparkSession)
    path = vocabulary or default_vocabulary()
    rest = [c for c in encoded.columns if c != "decoded"]
    src = encoded.select(*rest)
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in rest] + ["decoded binary"])
    at_ids = rest.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table_ = decoder(path)
        for b in batches:
            step = 500
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                out = [bytes_of(x.as_py() or b"", table_) for x in part.column(at_ids)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], rest + ["decoded"])

    return src.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document. A task encodes a slice and decodes its
    ids in one Python worker; only the digests leave it."""
    ready(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    src = docs.select("doc_id", "text")
    made = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table_ = decoder(path)
        for b, ids in encoded(batches, "text", path):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha256(x).hexdigest() for x in ids]),
                 pa.array([sha256(bytes_of(x, table_)).hexdigest() for x in ids])], made)

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encodes every whole text of `documents` and decodes the ids."""
    return digests(table(spark, sf_dir, "documents"))
