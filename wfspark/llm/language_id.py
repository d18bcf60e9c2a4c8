"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every run of anything else becomes one space, and the n-grams of
1 to 3 code points are hashed into a fixed number of buckets. Training counts buckets by language over all
labelled rows (numpy in each task, sums in Spark); only the matrix of languages by buckets comes to the
driver and is broadcast. Scoring adds log probabilities a document at a time over Arrow batches.

Rows with a null language or text teach nothing. A null text, or one without a letter, is `und` with score 0; so is
every row where nothing was learned. Equal log probabilities: the language first in order. Repeated rows are scored each.
Texts of any length are read whole; extra columns are ignored, whatever their names, but for those to carry; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wfspark.llm.codepoints import lower_letters, points
from wfspark.llm.columns import Texts, frugal, runs, texts

BUCKETS = 1 << 15
UNKNOWN = "und"
_SPACE = np.uint32(0x20)
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def grams(t: Texts, buckets: int, sizes: tuple[int, ...] = (1, 2, 3)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of every n-gram of a run, in order, and the index of each document's first."""
    chars, at = points(t)
    low = lower_letters()[chars]
    is_letter = low != 0
    low[~is_letter] = _SPACE
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    first_char = np.searchsorted(at, t.offsets)
    inner = first_char[:-1][first_char[:-1] < len(keep)]
    keep[inner] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    low, first = low[keep], kept[first_char]
    for n in sizes:
        count = len(low) - n + 1
        if count <= 0:
            yield np.empty(0, np.int64), np.zeros(len(t) + 1, np.int64)
            continue
        h = np.full(count, n, np.uint32)
        for k in range(n):
            h = (h ^ low[k : k + count]) * _FACTORS[k]
            h ^= h >> np.uint32(15)
        last = np.repeat(first[1:], np.diff(first))[:count]  # the n-gram must end in its document
        ok = np.arange(count) + n <= last
        if n == 1:
            ok &= low != _SPACE
        place = np.concatenate([[0], np.cumsum(ok)])
        yield (h[ok] & np.uint32(buckets - 1)).astype(np.int64), place[np.minimum(first, count)]


class LanguageModel:
    """Log probabilities, languages by buckets, with log priors."""

    def __init__(self, languages: list[str], priors: np.ndarray, logs: np.ndarray):
        self.languages, self.priors, self.logs = languages, priors, logs

    def score(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language of each document (-1: none) and its posterior probability."""
        total = np.tile(self.priors, (len(t), 1))
        seen = np.zeros(len(t), np.int64)
        for n, (at, first) in enumerate(grams(t, self.logs.shape[1]), 1):
            sizes = np.diff(first)
            full = np.flatnonzero(sizes)
            if n == 1:
                seen = sizes
            for k in range(len(self.languages) if len(full) else 0):
                total[full, k] += np.add.reduceat(self.logs[k][at], first[full])
        if not self.languages:
            return np.full(len(t), -1), np.zeros(len(t))
        best = total.argmax(axis=1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        score = 1 / odds.sum(axis=1)
        return np.where(seen > 0, best, -1), np.where(seen > 0, score, 0.0)


def train(docs: DataFrame, buckets: int = BUCKETS, smoothing: float = 0.5, most_languages: int = 1000) -> LanguageModel:
    """Counts every labelled row. ``docs``: text and lang. The matrix has a row for each distinct value of lang; more than ``most_languages`` of them are an
    error, as labels that are no languages would fill every worker."""
    known = docs.select("lang").where("lang is not null").distinct()
    if known.limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"lang has more than {most_languages} values")

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        table, rows = np.zeros((0, buckets), np.int64), []
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lang in langs:
                if names.setdefault(lang, len(names)) == len(rows):
                    rows.append(0)
                rows[names[lang]] += 1
            if len(names) > len(table):
                table = np.vstack([table, np.zeros((len(names) - len(table), buckets), np.int64)])
            code = np.array([names[lang] for lang in langs], np.int64)
            for i, j, t in runs(texts(batch.column(0))):
                for at, first in grams(t, buckets):
                    cell = np.repeat(code[i:j], np.diff(first)) * buckets + at
                    if table.size <= 1 << 22:
                        table += np.bincount(cell, minlength=table.size).reshape(table.shape)
                    else:  # many languages: a run meets few of the cells
                        ids, n = np.unique(cell, return_counts=True)
                        table.ravel()[ids] += n
        for lang, k in names.items():
            at = np.flatnonzero(table[k])
            # the bucket -1 holds the number of rows
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * (len(at) + 1)), "bucket": pa.array(np.append(at, -1)), "n": pa.array(np.append(table[k, at], rows[k]))})

    rows = docs.select("text", "lang").where("text is not null and lang is not null")
    found = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found["lang"].to_pylist()))
    table, priors = np.zeros((len(languages), buckets)), np.ones(len(languages))
    if languages:
        code = {lang: k for k, lang in enumerate(languages)}
        row = np.array([code[x] for x in found["lang"].to_pylist()])
        bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
        is_rows = bucket < 0
        priors[row[is_rows]] = n[is_rows]
        table[row[~is_rows], bucket[~is_rows]] = n[~is_rows]
    table += smoothing
    logs = np.log(table / table.sum(axis=1, keepdims=True)) if languages else table
    return LanguageModel(languages, np.log(priors / priors.sum()) if languages else np.zeros(0), logs)


def language_id(docs: DataFrame, model: LanguageModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score of each document, with the columns named in ``carry`` after them."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.priors, model.logs))
    chosen = docs.select("doc_id", "text", *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)])
    extra = "".join(f", carried_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(*shared.value)
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for i, j, t in runs(texts(batch.column(1))):
                best, score = model.score(t)
                cells = {"doc_id": batch.column(0).slice(i, j - i), "lang_pred": pa.array(names[best], pa.string()), "score": pa.array(score)}
                yield pa.RecordBatch.from_pydict(cells | {f"carried_{k}": batch.column(2 + k).slice(i, j - i) for k in range(len(carry))})

    out = chosen.mapInArrow(run, "doc_id long, lang_pred string, score double" + extra)
    return out.select("doc_id", "lang_pred", "score", *[F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry)])


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo the number of folds."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
