"""Quality rules by repetition coverage.

Words are `[^\\x20\\x09-\\x0D]+`. For each of several n-gram lengths a rolling hash of
every word window marks the windows found twice or more in the text; the measure is
the share of word characters (code points) that lie inside such windows. Lines that equal an
earlier line are measured the same way. All of it is numpy on Arrow batches; no shuffle.

Null and empty texts have no words and fail the base rule. Repeated rows and ties are
judged row by row, texts of any length whole; extra columns of the input are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wfspark.llm.columns import SPACE, Texts, byte_class, covered, frugal, mix, repeated, runs, span_hashes, spans, sums, texts, whole_windows, window_hashes

#: The symbols `[#*$%&|<>]`.
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_NEWLINE = byte_class((0x0A, 0x0A))


@dataclass(frozen=True)
class QualityRules:
    """Thresholds. ``coverage``: n-gram length -> most percent of word characters inside repeated n-grams."""

    min_words: int = 20
    repeat_window: int = 8
    max_repeat_words_pct: int = 30
    coverage: dict[int, int] = field(default_factory=lambda: {3: 60, 5: 45, 13: 30})
    max_dup_line_chars_pct: int = 30
    max_symbols_pct: int = 25


def schema(rules: QualityRules) -> str:
    grams = "".join(f", dup{n}_chars long" for n in rules.coverage)
    return f"doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long{grams}, base_failed boolean, kept boolean"


def _lines(t: Texts, is_char: np.ndarray, words_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeated lines per document, and the word characters in them."""
    starts, ends = spans(t, _NEWLINE)
    has_word = np.searchsorted(words_at, ends) > np.searchsorted(words_at, starts)
    starts, ends = starts[has_word], ends[has_word]
    first = t.per_document(starts)
    if not len(starts):
        return np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
    keys = span_hashes(t.data, starts, ends) ^ mix(t.document_of(starts).astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    chars = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(is_char, out=chars[1:])
    return sums(again, first), sums(np.where(again, chars[ends] - chars[starts], 0), first)


def measure(t: Texts, rules: QualityRules) -> dict[str, np.ndarray]:
    """The measures of each document of one run."""
    starts, ends = spans(t)
    first = t.per_document(starts)
    is_char = ~SPACE[t.data] & ((t.data & 0xC0) != 0x80)
    chars = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(is_char, out=chars[1:])
    lengths = chars[ends] - chars[starts]
    hashes = span_hashes(t.data, starts, ends)
    salt = mix(np.repeat(np.arange(1, len(t) + 1, dtype=np.uint64), np.diff(first)))

    def inside(n: int) -> np.ndarray:
        grams = window_hashes(hashes, n)
        if not len(grams):
            return np.zeros(len(hashes), bool)
        ok = whole_windows(first, n, len(hashes))
        twice = np.zeros(len(grams), bool)
        twice[ok] = repeated(grams[ok] ^ salt[: len(grams)][ok])
        return covered(twice, n, len(hashes))

    out = {
        "n_words": np.diff(first),
        "word_chars": sums(lengths, first),
        "n_symbols": sums(_SYMBOLS[t.data], t.offsets),
    }
    out["n_dup_lines"], dup_line_chars = _lines(t, is_char, starts)
    out["n_repeat_words"] = sums(inside(rules.repeat_window), first)
    out["dup_line_chars"] = dup_line_chars
    for n in rules.coverage:
        out[f"dup{n}_chars"] = sums(np.where(inside(n), lengths, 0), first)
    base = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_words_pct * out["n_words"])
    bad = (100 * dup_line_chars > rules.max_dup_line_chars_pct * out["word_chars"]) | (100 * out["n_symbols"] > rules.max_symbols_pct * out["word_chars"])
    for n, most in rules.coverage.items():
        bad |= 100 * out[f"dup{n}_chars"] > most * out["word_chars"]
    return out | {"base_failed": base, "kept": ~(base | bad)}


def quality_rules(docs: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """One row per document with every measure, ``base_failed`` and ``kept``."""
    rules = rules or QualityRules()

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, t in runs(texts(batch.column(1))):
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(i, j - i)} | {k: pa.array(v) for k, v in measure(t, rules).items()})

    return docs.select("doc_id", "text").mapInArrow(run, schema(rules))
