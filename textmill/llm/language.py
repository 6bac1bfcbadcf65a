"""Operator 3: language identification by string kernels.

A text is the set of its lower-cased character n-grams of lengths 1 to 3 (a blended spectrum, presence
only). The kernel of two texts is the size of their sets' intersection over the geometric mean of
their sizes, within the grams of the landmark texts. Kernel ridge regression, one language against
the rest, is solved in the Nyström space of the landmarks. Texts are scored in batches: a presence
matrix times the landmarks' matrix gives the kernels, and those times the coefficients the scores.

The classifier is fitted on about ``sample`` labelled rows (a documented bound), of those whose crc32(doc_id)
mod 4 is not 2 and whose text has at most ``LONGEST`` characters: an equal part for each language, at least
``LEAST_ROWS`` of each, or all its rows if it has fewer, in the order of a hash of doc_id and text; rows beyond
``SAMPLE_CHARS`` characters in all, shared out by language, are left out of the fit, but for a language's first one.
All languages are learned: each gives at least ``MARKS`` landmarks, and the model is as large as they need. Predictions see the text
alone, and the whole of it.

Defined cases: a null text, or one without letters, is ``und`` with score 0; null and repeated doc_ids
are rows like any others (a null doc_id is neither held out nor learned from); without labelled rows
every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm import common

SAMPLE, LANDMARKS, RIDGE = 3000, 192, 1e-3
LEAST_ROWS, MARKS = 8, 4
LONGEST, SAMPLE_CHARS = 100_000, 20_000_000
#: Texts that are scored by one matrix product.
BATCH = 128
#: Cells of a presence matrix that is held as a whole; the products are the same either way.
DENSE = 4_000_000
#: A character is its code point if it is a letter and 0 if not; three of them and the lengths' offsets fit 63 bits.
CLASSES = 0x110000
UNKNOWN = "und"


class Landmarks(NamedTuple):
    """vocabulary: the grams that landmarks have, sorted; at, of: the landmarks of gram i are of[at[i]:at[i + 1]]; size: grams of each landmark; dense: the same as a matrix, if it is small."""

    vocabulary: np.ndarray
    at: np.ndarray
    of: np.ndarray
    size: np.ndarray
    dense: np.ndarray | None


class Model(NamedTuple):
    """labels; marks; weights: landmarks by labels."""

    labels: list[str]
    marks: Landmarks
    weights: np.ndarray


@lru_cache(1)
def letters() -> np.ndarray:
    table = np.zeros(CLASSES, np.int32)
    for c in range(CLASSES):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = c
    return table


def gram_sets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct n-grams of each text, sorted, and whether it has a letter."""
    raw = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int64)
    kind = letters()[np.frombuffer(b"".join(raw), np.uint32)].astype(np.int64)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    code, base = kind, 0
    for n in (1, 2, 3):
        if n > 1:
            code = code[: max(0, len(kind) - n + 1)] * CLASSES + kind[n - 1 :]
        for i, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
            found[i].append(np.unique(code[lo : max(lo, hi - n + 1)]) + base)
        base += CLASSES**n
    letter = np.array([len(f[0]) > 0 and f[0][-1] > 0 for f in found], bool)
    return [np.concatenate(f) for f in found], letter


def landmarks_of(sets: list[np.ndarray]) -> Landmarks:
    grams = np.concatenate(sets)
    size = np.array([len(x) for x in sets])
    order = np.argsort(grams, kind="stable")
    vocabulary, first = np.unique(grams[order], return_index=True)
    of, dense = np.repeat(np.arange(len(sets), dtype=np.int32), size)[order], None
    if len(vocabulary) * len(sets) <= DENSE:
        dense = np.zeros((len(vocabulary), len(sets)), np.float32)
        dense[np.searchsorted(vocabulary, grams[order]), of] = 1
    return Landmarks(vocabulary, np.append(first, len(grams)), of, size, dense)


def kernels(marks: Landmarks, sets: list[np.ndarray]) -> np.ndarray:
    """Texts by landmarks: the product of the two presence matrices, sparse unless the landmarks' one is small, over the roots of the sizes."""
    column = [np.searchsorted(marks.vocabulary, s) for s in sets]
    column = [c[marks.vocabulary[np.minimum(c, len(marks.vocabulary) - 1)] == s] for c, s in zip(column, sets, strict=True)]
    known = np.array([len(c) for c in column])
    column = np.concatenate(column)
    row, m = np.repeat(np.arange(len(sets)), known), len(marks.size)
    if marks.dense is not None:
        there = np.zeros((len(sets), len(marks.vocabulary)), np.float32)
        there[row, column] = 1
        common_ = there @ marks.dense
    else:
        lo, n = marks.at[column], marks.at[column + 1] - marks.at[column]
        row = np.repeat(row, n)
        mark = marks.of[np.arange(len(row)) + np.repeat(lo - np.cumsum(n) + n, n)]
        common_ = np.bincount(row * m + mark, minlength=len(sets) * m).reshape(len(sets), m)
    return (common_ / np.sqrt(np.maximum(known[:, None], 1) * np.maximum(marks.size, 1))).astype(np.float32)


def fit(langs: list[str], sets: list[np.ndarray], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """A model from labelled gram sets; the landmarks are dealt evenly to the languages, at least MARKS to each that has as many texts.

    Ridge regression in the landmarks' space: with the kernels K of all texts and M of the landmarks among
    themselves, the coefficients solve (K'K + ridge n M) w = K'y.
    """
    if not langs:
        return None
    labels, y = np.unique(np.array(langs, object), return_inverse=True)
    order = np.argsort(y, kind="stable")
    turn = np.empty(len(y), int)
    turn[order] = np.arange(len(y)) - np.searchsorted(y[order], y[order])
    chosen = np.lexsort((y, turn))[: max(landmarks, MARKS * len(labels))]
    marks = landmarks_of([sets[i] for i in chosen])
    k = np.concatenate([kernels(marks, sets[i : i + BATCH]) for i in range(0, len(sets), BATCH)]).astype(np.float64)
    goal = np.zeros((len(y), len(labels)))
    goal[np.arange(len(y)), y] = 1
    left = k.T @ k + ridge * len(y) * k[chosen]
    left[np.diag_indices(len(left))] += 1e-9 * np.trace(left) / len(left)
    w = np.linalg.solve(left, k.T @ goal)
    return Model(labels.tolist(), marks, w.astype(np.float32))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from a bounded sample of the labelled rows that are not held out."""
    learn = docs.select("doc_id", "text", "lang").where("lang is not null and pmod(crc32(cast(doc_id as string)), 4) <> 2").where(F.length("text") <= LONGEST)
    counts = learn.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    if not counts:
        return None
    part = max(LEAST_ROWS, -(-sample // len(counts)))
    shares = docs.sparkSession.createDataFrame([(r.lang, int(min(1.0, 2 * part / r.n) * (1 << 30)) + 1) for r in counts], "learned string, share long")
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30))
    picked = learn.withColumn("drawn", drawn).join(F.broadcast(shares), F.col("lang") == F.col("learned")).where("drawn < share")  # a row for each language, which the model holds anyway
    first = Window.partitionBy("lang").orderBy("drawn", F.col("doc_id").cast("string"), "text")  # about 2 * part rows of a language
    chars = F.sum(F.length("text")).over(first.rowsBetween(Window.unboundedPreceding, 0))
    picked = picked.withColumn("place", F.row_number().over(first)).withColumn("chars", chars)
    picked = picked.where((F.col("place") <= part) & ((F.col("place") == 1) | (F.col("chars") <= SAMPLE_CHARS // len(counts))))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, letter = gram_sets([x or "" for x in batch.column("text").to_pylist()])
        keep = pa.array(letter)
        return pa.RecordBatch.from_arrays([batch.column("lang").filter(keep), pa.array([x.tobytes() for x in found], pa.binary()).filter(keep)], names=["lang", "grams"])

    rows = common.by_batch(picked.select("lang", "text"), sets, "lang string, grams binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.grams)))
    order = np.random.default_rng(7).permutation(len(rows))
    return fit([rows[i].lang for i in order], [np.frombuffer(rows[i].grams, np.int64) for i in order])


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred and score; and the columns in keep."""
    own = docs.sparkSession.sparkContext.broadcast(model)

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, texts = own.value, [x or "" for x in batch.column("text").to_pylist()]
        best, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        for lo in range(0, len(texts) if m else 0, BATCH):
            sets, letter = gram_sets(texts[lo : lo + BATCH])
            s = kernels(m.marks, sets) @ m.weights
            top = s.argmax(1)
            best[lo : lo + BATCH][letter] = np.array(m.labels, object)[top[letter]]
            score[lo : lo + BATCH][letter] = np.clip(s[np.arange(len(s)), top], 0, 1)[letter]
        cols = [batch.column(c) for c in dict.fromkeys(("doc_id", "held_out", *keep))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(best, pa.string()), pa.array(score)], names=[*dict.fromkeys(("doc_id", "held_out", *keep)), "lang_pred", "score"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    d = docs.withColumn("held_out", held).select(*dict.fromkeys(("doc_id", "held_out", "text", *keep)))
    kinds = dict(d.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in dict.fromkeys(("doc_id", "held_out", *keep)))
    return common.by_batch(d, label, f"{schema}, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return predict(docs, train(docs))
