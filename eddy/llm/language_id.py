"""Operator 5: language identification by a string kernel.

Feature of a text: which n-grams (n = 1 .. `orders`) of its lower-cased letters occur; every other
character reads as a space. Two texts' kernel is the number of n-grams that both hold (blended
spectrum, presence), normalised to the cosine. A bounded sample of labelled texts gives the Nystrom
landmarks; on the landmark features a one-versus-rest kernel ridge regression is solved in closed
form. Scoring is two matrix products a batch: texts x landmarks, then x languages.

Only the fit is bounded (parameters `per_language`, `max_train_chars`, `landmarks`): it takes
labelled texts in the order of a hash of their id, evenly by language. Every text is scored whole.

Defined cases: a text that is null or holds no letter gets `und` and score 0; equal texts get equal
answers; with no labelled text at all every answer is `und`; a tie goes to the language first in
order. N-grams are hashed into 2^20 buckets; two that share a bucket count as one.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import is_held_out, ready, table, text_batches

UNKNOWN = "und"
BUCKETS = 1 << 20
_MULT = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))


@dataclasses.dataclass(frozen=True)
class FitParams:
    """Bounds and settings of the fit."""
    orders: int = 3
    landmarks: int = 192
    per_language: int = 400
    max_train_chars: int = 20_000
    ridge: float = 1e-2


@dataclasses.dataclass
class Model:
    """`slot[b]`: the feature of bucket b or -1. `marks`: landmarks x features, rows of length 1.
    `back`: (landmarks + 1) x languages, the last row being the bias."""
    languages: list[str]
    orders: int
    slot: np.ndarray
    marks: np.ndarray
    back: np.ndarray


_LETTERS: list[np.ndarray] = []


def letter_codes() -> np.ndarray:
    """Code point -> code of its lower-cased letter, 0 for what is no letter."""
    if not _LETTERS:
        out = np.zeros(0x110000, "<u4")
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(out)
    return _LETTERS[0]


def gram_buckets(texts: list[str], orders: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the row and the bucket of every n-gram that starts in a text."""
    gap = "\n" * max(orders - 1, 1)
    codes = np.frombuffer(gap.join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(t) for t in texts], "<i8")
    rows = np.repeat(np.arange(len(texts), dtype="<i4"), lengths)
    starts = np.arange(len(rows)) + np.repeat(np.arange(len(texts)) * len(gap), lengths)
    mapped = letter_codes()[codes]
    for n in range(1, orders + 1):
        h = np.full(len(mapped) - n + 1, n * 40503, "<u4")
        for k in range(n):
            h ^= mapped[k:len(mapped) - n + 1 + k]
            h *= _MULT[k % len(_MULT)]
            h ^= h >> np.uint32(15)
        yield rows, h[starts] & np.uint32(BUCKETS - 1)


def presence(texts: list[str], orders: int, slot: np.ndarray, width: int) -> np.ndarray:
    """Rows of length 1 over the features, or 0 where a text holds none."""
    x = np.zeros((len(texts), width + 1), "<f4")
    for rows, buckets in gram_buckets(texts, orders):
        x[rows, slot[buckets]] = 1  # -1, no feature, goes to the last column
    x = x[:, :width]
    norm = np.sqrt(x.sum(1, keepdims=True))
    return np.divide(x, norm, out=x, where=norm > 0)


def fit(texts: list[str], langs: list[str], p: FitParams) -> Model | None:
    """Kernel ridge regression on the Nystrom features of `texts` (in a fixed order)."""
    languages = sorted(set(langs))
    if not languages:
        return None
    by = {g: [i for i, x in enumerate(langs) if x == g] for g in languages}
    # landmarks, dealt evenly by language
    turns = sorted((k, g, i) for g, own in by.items() for k, i in enumerate(own))
    chosen = [i for _, _, i in turns[:max(p.landmarks, len(languages))]]
    seen = np.zeros(BUCKETS, bool)
    for _, buckets in gram_buckets([texts[i] for i in chosen], p.orders):
        seen[buckets] = True
    width = int(seen.sum())
    slot = np.full(BUCKETS, -1, "<i4")
    slot[seen] = np.arange(width)
    marks = presence([texts[i] for i in chosen], p.orders, slot, width)
    kernel = np.concatenate([presence(texts[a:a + 128], p.orders, slot, width) @ marks.T
                             for a in range(0, len(texts), 128)]).astype("<f8")
    among = (marks @ marks.T).astype("<f8")
    value, vector = np.linalg.eigh(among)
    keep = value > 1e-6 * max(value.max(), 1e-12)
    root = vector[:, keep] / np.sqrt(value[keep])          # kernel -> Nystrom features
    feats = np.concatenate([kernel @ root, np.ones((len(texts), 1))], 1)
    weight = np.array([len(texts) / (len(languages) * len(by[x])) for x in langs])  # languages count alike
    target = np.where(np.array(langs)[:, None] == np.array(languages)[None], 1.0, -1.0)
    gram = (feats * weight[:, None]).T @ feats
    gram[np.arange(len(gram) - 1), np.arange(len(gram) - 1)] += p.ridge * len(texts) / 100
    solved = np.linalg.lstsq(gram, (feats * weight[:, None]).T @ target, rcond=None)[0]
    back = np.concatenate([root @ solved[:-1], solved[-1:]])
    return Model(languages, p.orders, slot, marks, back.astype("<f4"))


def predict(model: Model | None, texts: list[str | None], rows: int = 192) -> tuple[list[str], list[float]]:
    """Language and score of each text, the score being the winning one-versus-rest output taken
    from [-1, 1] to [0, 1]."""
    lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return lang, score
    ask = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    for a in range(0, len(ask), rows):
        part = ask[a:a + rows]
        x = presence([texts[i] for i in part], model.orders, model.slot, model.marks.shape[1])
        out = (x @ model.marks.T) @ model.back[:-1] + model.back[-1]
        best = out.argmax(1)
        for i, b, s in zip(part, best.tolist(), out[np.arange(len(part)), best].tolist()):
            lang[i], score[i] = model.languages[b], min(1.0, max(0.0, (s + 1) / 2))
    return lang, score


def training_sample(labelled: DataFrame, p: FitParams) -> list[tuple[str, str]]:
    """At most `per_language` texts a language (over 16 salted groups), in the order of a hash."""
    salts = 16
    src = (labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                          & (F.length("text") <= p.max_train_chars) & F.col("text").rlike(r"\p{L}"))
           .select("lang", "text", F.xxhash64("doc_id", "text").alias("__h"))
           .withColumn("__salt", F.pmod("__h", F.lit(salts))))
    w = Window.partitionBy("lang", "__salt").orderBy("__h", "text")
    rows = (src.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max(1, p.per_language // salts))
            .select("__r", "__salt", "lang", "text").collect())
    return [(r.text, r.lang) for r in sorted(rows, key=lambda r: (r["__r"], r["__salt"], r["lang"], r["text"]))]


def fit_on(labelled: DataFrame, p: FitParams = FitParams()) -> Model | None:
    sample = training_sample(labelled, p)
    return fit([t for t, _ in sample], [g for _, g in sample], p)


def identify(docs: DataFrame, model: Model | None, text: str = "text",
             lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """`docs` with the predicted language and its score (columns of those names are replaced)."""
    spark = ready(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (lang_col, score_col)]
    shipped = spark.sparkContext.broadcast(model)  # bounded: landmarks x their n-grams
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"`{lang_col}` string", f"`{score_col}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b, texts in text_batches(batches, text, max_chars=600_000, max_rows=192):
            lang, score = predict(m, texts)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             [*rest, lang_col, score_col])

    return docs.select(*rest).mapInArrow(run, schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text of `documents`; learns where crc32 mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held = docs.withColumn("held_out", is_held_out("doc_id", 4, 2))
    model = fit_on(held.where(~F.col("held_out")))
    return identify(held.select("doc_id", "held_out", "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score")
