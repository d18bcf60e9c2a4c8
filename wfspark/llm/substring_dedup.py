"""Substring deduplication over fixed-length token windows.

Every window of n words has a Rabin-Karp hash. A task first settles the windows that meet
inside one run of its documents: of each hash only the smallest document is left to ask about, so a passage that a third of
all documents share costs one entry a run, not one a document. Those entries are dealt by hash range
as packed arrays and counted there: a window is a repeat where its hash also starts in a
document with a smaller id. The repeats go back to their documents by id, where adjoining windows merge
into maximal removal intervals.

Words are `[^\\x20\\x09-\\x0D]+`; null and empty texts have none, an empty table gives no rows. Texts of any length are read whole. Windows never cross
documents and are judged on the input. Rows with one doc_id don't repeat each other, so repeated rows stay alike; of equal windows the one of the
smallest doc_id stays. Extra columns are ignored, whatever their names, but for those to carry. Two different windows count as one if their 64-bit
hashes agree (expected 0.0005 pairs in 10^8 windows).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wfspark.llm.columns import CHUNK, Texts, covered, frugal, member, mix, ranges, runs, span_hashes, spans, sums, texts, whole_windows, window_hashes
from wfspark.llm.dealing import bucket_bits, cuts, dealt_on, first_bits
from wfspark.llm.sources import written

WINDOW = 13
_PACKED = "bucket int, settled boolean, docs binary, counts binary, found binary"
def windows(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, each document's first word, and the hash of every window (with those across documents)."""
    starts, ends = spans(t)
    return starts, ends, t.per_document(starts), window_hashes(span_hashes(t.data, starts, ends), n)


def intervals(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true items that don't cross documents: document, start and end counted from its first item."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    begin, end = edge == 1, edge == -1
    inner = first[1:-1]
    inner = inner[(inner > 0) & (inner < len(mask))]
    both = inner[mask[inner] & mask[inner - 1]]
    begin[both] = True
    end[both] = True
    s, e = np.flatnonzero(begin), np.flatnonzero(end)
    doc = np.searchsorted(first, s, side="right") - 1
    return doc, s - first[doc], e - first[doc]


def _grouped(docs: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct documents, how many values each has, and the values in that order."""
    order = np.argsort(docs, kind="stable")
    ids, counts = np.unique(docs, return_counts=True)
    return ids, counts, found[order]


def _pack(bucket: int, settled: bool, docs: np.ndarray, found: np.ndarray) -> dict:
    ids, counts, found = _grouped(docs, found)
    return {"bucket": bucket, "settled": settled, "docs": ids.astype(np.int64).tobytes(), "counts": counts.astype(np.int32).tobytes(), "found": found.tobytes()}


def _entries(ids: np.ndarray, t: Texts, n: int, bits: int) -> list[dict]:
    """Packed rows of one run whose documents are in order of their ids."""
    starts, _, first, hashes = windows(t, n)
    if not len(hashes):
        return []
    at = np.flatnonzero(whole_windows(first, n, len(starts)))
    keys = hashes[at]
    doc = ids[np.repeat(np.arange(len(t)), np.diff(first))[at]]
    order = np.argsort(keys, kind="stable")
    keys, doc, at = keys[order], doc[order], at[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    smallest = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    gone = np.zeros(len(hashes), bool)
    gone[at[doc > smallest]] = True
    rows = []
    if gone.any():
        which, s, e = intervals(covered(gone, n, len(starts)), first)
        rows.append(_pack(int(which[0] + starts[0]) & ((1 << bits) - 1), True, ids[which], (s << 32 | e).astype(np.uint64)))
    keys, doc = keys[new], doc[new]
    rows += [_pack(bucket, False, doc[a:b], keys[a:b]) for bucket, a, b in cuts(keys, bits)]
    return rows


_ARROW = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("docs", pa.binary()), ("counts", pa.binary()), ("found", pa.binary())])
_REPEATS = pa.schema([("doc_id", pa.int64()), ("settled", pa.bool_()), ("found", pa.binary())])


def _split(ids: np.ndarray, counts: np.ndarray, found: np.ndarray, settled: bool) -> pa.RecordBatch:
    ends = np.cumsum(counts)
    values = [found[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([settled] * len(ids), pa.bool_()), pa.array(values, pa.binary())], schema=_REPEATS)


def _unpacked(cells: list[tuple]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes and documents of packed rows."""
    docs = [np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.int32)) for _, _, d, c, _ in cells]
    return np.concatenate([np.frombuffer(row[4], np.uint64) for row in cells]), [np.concatenate(docs)]


def _count(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats of one bucket by document; settled rows pass."""
    docs, found = [], []
    for batch in batches:
        for settled, d, c, f in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
            ids, counts, values = np.frombuffer(d, np.int64), np.frombuffer(c, np.int32), np.frombuffer(f, np.uint64)
            if settled:
                yield _split(ids, counts, values, True)
            else:
                docs.append(np.repeat(ids, counts))
                found.append(values)
    if not docs:
        return
    doc, keys = np.concatenate(docs), np.concatenate(found)
    order = np.argsort(keys)
    keys, doc = keys[order], doc[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    smallest = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.append(begin, len(keys))))
    gone = doc > smallest
    if gone.any():
        yield _split(*_grouped(doc[gone], keys[gone]), False)


def repeats(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, settled, found: hashes of repeated windows, or (settled) word intervals as start << 32 | end."""
    bits = bucket_bits(docs)
    first = first_bits(bits)

    @frugal
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0)))
            ids = batch.column(0).to_numpy()
            for i, j, t in runs(texts(batch.column(1)), 8 * CHUNK):
                rows = _entries(ids[i:j], t, n, first)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _count(list(batches))

    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    dealt = dealt_on(rows.mapInArrow(deal, _PACKED), _ARROW, bits, _unpacked, lambda bucket, keys, values: tuple(_pack(bucket, False, values[0], keys).values()), lambda row: row[1])
    return dealt.groupBy("bucket").applyInArrow(count, "doc_id long, settled boolean, found binary")


def _removed(t: Texts, first: np.ndarray, hashes: np.ndarray, n: int, found: pa.Array, settled: pa.Array) -> np.ndarray:
    """Which words of a run go. found, settled: lists of binary values of each document."""
    n_words = first[-1]
    salt = mix(np.arange(1, len(t) + 1, dtype=np.uint64))

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        column = column.fill_null([]) if column.null_count else column
        values, sizes = column.flatten(), column.value_lengths().to_numpy(zero_copy_only=False)
        joined = np.frombuffer(b"".join(values.to_pylist()), np.uint64)
        each = values.cast(pa.binary()) if len(values) else values
        lengths = pc.binary_length(each).to_numpy(zero_copy_only=False) // 8 if len(values) else np.empty(0, np.int64)
        return np.repeat(np.repeat(np.arange(len(t)), sizes), lengths), joined

    doc, keys = flat(found)
    gone = np.zeros(len(hashes), bool)
    if len(keys) and len(hashes):
        ok = whole_windows(first, n, n_words)
        own = np.repeat(salt, np.diff(first))[: len(hashes)]
        gone[ok] = member((hashes ^ own)[ok], np.unique(keys ^ salt[doc]))
    mask = covered(gone, n, n_words) if len(hashes) else np.zeros(n_words, bool)
    doc, packed = flat(settled)
    if len(doc):
        change = np.zeros(n_words + 1, np.int64)
        np.add.at(change, first[doc] + (packed >> np.uint64(32)).astype(np.int64), 1)
        np.add.at(change, first[doc] + (packed & np.uint64(0xFFFFFFFF)).astype(np.int64), -1)
        mask |= np.cumsum(change[:-1]) > 0
    return mask


def _kept_words(t: Texts, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Kept words of each document joined by one space."""
    sizes = (ends - starts + 1)[keep]
    data = np.append(t.data, np.uint8(0x20))[ranges(starts[keep], sizes)]
    data[np.cumsum(sizes) - 1] = 0x20
    place = np.concatenate([[0], np.cumsum(np.where(keep, ends - starts + 1, 0))])[first]
    return [data[a : max(a, b - 1)].tobytes() for a, b in zip(place[:-1].tolist(), place[1:].tolist())]


def _cut(t: Texts, starts: np.ndarray, mask: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Texts without the removed words; white space before each kept word stays as it was."""
    doc, s, e = intervals(mask, first)
    change = np.zeros(len(t.data) + 1, np.int8)
    begin = starts[first[doc] + s]
    last = first[doc] + e
    end = np.where(last < first[doc + 1], np.append(starts, len(t.data))[last], t.offsets[doc + 1])
    change[begin] += 1
    np.subtract.at(change, end, 1)
    keep = np.cumsum(change[:-1]) == 0
    place = np.concatenate([[0], np.cumsum(keep)])[t.offsets]
    data = t.data[keep]
    return [data[a:b].tobytes() for a, b in zip(place[:-1].tolist(), place[1:].tolist())]


def substring_dedup(docs: DataFrame, n: int = WINDOW, digest: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed and, with ``digest``, kept_sha256 (kept words joined by one space), else the text
    that is left; then the columns named in ``carry``. Every input row comes back once."""
    found = written(repeats(docs, n), "repeats")
    by_doc = found.groupBy(F.col("doc_id").alias("of")).agg(
        F.collect_list(F.when(~F.col("settled"), F.col("found"))).alias("found"), F.collect_list(F.when(F.col("settled"), F.col("found"))).alias("settled")
    )
    rows = docs.select("doc_id", "text", *[F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)])
    joined = rows.join(by_doc, rows["doc_id"] == by_doc["of"], "left").drop("of")
    extra = "".join(f", carried_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(carry))
    name = "kept_sha256" if digest else "text"

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {x: k for k, x in enumerate(batch.schema.names)}
            for i, j, t in runs(texts(batch.column(at["text"]))):
                part = batch.slice(i, j - i)
                starts, ends, first, hashes = windows(t, n)
                mask = _removed(t, first, hashes, n, part.column(at["found"]), part.column(at["settled"]))
                if digest:
                    left = [hashlib.sha256(x).hexdigest() for x in _kept_words(t, starts, ends, ~mask, first)]
                else:
                    left = [x.decode() for x in _cut(t, starts, mask, first)]
                cells = {"doc_id": part.column(at["doc_id"]), "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(sums(mask, first), pa.int64()), name: pa.array(left, pa.string())}
                yield pa.RecordBatch.from_pydict(cells | {f"carried_{k}": part.column(at[f"carried_{k}"]) for k in range(len(carry))})

    out = joined.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string{extra}")
    return out.select("doc_id", "n_words", "n_removed", name, *[F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry)])
