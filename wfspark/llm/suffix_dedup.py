"""Exact substring deduplication by merged Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id, or same document and earlier). No
machine can hold one transform of the corpus, so suffixes are gathered where they may matter:

1. Of every 50-byte gram, the one with the least hash in a window of ``LENGTH`` bytes is the window's anchor: equal windows have equal
   anchors. Neighbouring windows with one anchor form a context (their bytes together). Equal contexts of one run of
   documents collapse at once to the earliest, so a passage that a third of all documents share counts once a run; the rest are dealt by anchor.
2. Contexts that are alone with their anchor repeat nothing. Equal ones collapse to the earliest; the others go whole. Where an anchor
   has different contexts, one of each is cut once more, by the gram of the greatest hash, dealt by both grams and settled likewise.
   What is left are different strings that share both grams.
3. A task makes a shard of its strings: their Burrows-Wheeler transform and where they come from. For each key range the shards' transforms are
   merged by interleave refinement for ``LENGTH`` rounds, without sorting suffixes again. Suffixes that are still
   in one block share ``LENGTH`` bytes: all but the earliest are repeats.
4. Repeats go back to their documents by id and merge into maximal intervals.

Null texts are empty. Rows that share a doc_id stand for one document, whose text is the least of theirs; each of them gets its result.
Texts of any length are read in blocks; matches never cross documents. Of equal strings the one that starts first stays, by doc_id and then by
place. Extra columns are ignored, whatever their names; an empty table gives no rows. Contexts are
compared by 64-bit hashes, anchors too (an anchor's collision only costs time).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wfspark.llm import bwt
from wfspark.llm.columns import BLOCK, CHUNK, Texts, byte_hashes, frugal, mix, ranges, runs, texts
from wfspark.llm.dealing import bucket_bits, cuts, dealt_on, first_bits
from wfspark.llm.sources import discard, written

LENGTH, GRAM = 100, 50
_MOST_STRINGS = 2000
_U = np.uint64


def _window_least(values: np.ndarray, n: int) -> np.ndarray:
    """Least value of every n neighbours: of a block's tail and the next one's head."""
    padded = np.concatenate([values, np.full(-len(values) % n, ~_U(0))]).reshape(-1, n)
    head = np.minimum.accumulate(padded, axis=1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: len(values) - n + 1], head[n - 1 : len(values)])


def contexts(t: Texts, greatest: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows with one anchor, in order: first window, number of windows, the anchor's hash, the hash of their bytes.
    Windows cross neither documents nor blocks of the run."""
    out: list[tuple[np.ndarray, ...]] = []
    n = len(t.data)
    for low in range(0, max(n - LENGTH + 1, 0), BLOCK):
        part = t.data[low : low + BLOCK + LENGTH - 1]
        total, down = byte_hashes(part)
        grams = mix((total[GRAM:] - total[:-GRAM]) * down[: len(part) - GRAM + 1])
        ranked = ~grams if greatest else grams
        ranked = (ranked >> _U(24) << _U(24)) | np.arange(len(ranked), dtype=np.uint64)
        anchor = (_window_least(ranked, LENGTH - GRAM + 1) & _U(0xFFFFFF)).astype(np.int64)
        starts = low + np.arange(len(anchor))
        doc = t.document_of(starts)
        ok = starts + LENGTH <= t.offsets[doc + 1]
        anchor[~ok] = -1
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
        count = np.diff(np.append(first, len(anchor)))
        good = anchor[first] >= 0
        first, count = first[good], count[good]
        end = first + count + LENGTH - 1
        whole = mix((total[end] - total[first]) * down[first] + count.astype(np.uint64))
        out.append((low + first, count, grams[anchor[first]], whole))
    return tuple(map(np.concatenate, zip(*out))) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals of each document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    # ends so far within a document: documents are set apart by more than any end
    rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * far)
    new = np.concatenate([[True], (start[1:] + rank[1:] * far > reach[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], reach[last] - rank[last] * far


_FOUND = pa.schema([("doc_id", pa.int64()), ("wanted", pa.bool_()), ("found", pa.binary()), ("keys", pa.binary())])
_FOUND_SQL = "doc_id long, wanted boolean, found binary, keys binary"


def _by_document(doc: np.ndarray, found: np.ndarray, keys: np.ndarray | None = None) -> pa.RecordBatch:
    """Packed values of each document: intervals, or contexts (start << 8 | windows) with their anchors."""
    order = np.argsort(doc, kind="stable")
    ids, first = np.unique(doc[order], return_index=True)
    cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(doc)]))
    found = found[order]
    packed = [found[a:b].tobytes() for a, b in cuts]
    keyed = [keys[order][a:b].tobytes() for a, b in cuts] if keys is not None else [None] * len(cuts)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([keys is not None] * len(ids), pa.bool_()), pa.array(packed, pa.binary()), pa.array(keyed, pa.binary())], schema=_FOUND)


def _intervals(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    doc, start, end = _merged(doc, start, end)
    return _by_document(doc, start.astype(np.uint64) << _U(32) | end.astype(np.uint64))


_DEALT = pa.schema([("bucket", pa.int32()), ("settled", pa.binary()), ("doc", pa.binary()), ("start", pa.binary()), ("count", pa.binary()), ("anchor", pa.binary()), ("whole", pa.binary())])
_DEALT_SQL = "bucket int, settled binary, doc binary, start binary, count binary, anchor binary, whole binary"


def _packed(bucket: int, key: np.ndarray, values: list[np.ndarray]) -> tuple:
    doc, start, count, whole = values
    return (bucket, None, *(c.tobytes() for c in (doc.astype(np.int64), start.astype(np.uint32), count.astype(np.uint8), key, whole)))


def _unpacked(cells: list[tuple]) -> tuple[np.ndarray, list[np.ndarray]]:
    doc, start, count, key, whole = (np.concatenate([np.frombuffer(row[2 + k], kind) for row in cells]) for k, kind in enumerate((np.int64, np.uint32, np.uint8, np.uint64, np.uint64)))
    return key, [doc, start, count, whole]


def _deal(doc: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray, whole: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Packed contexts of one run, dealt by key, without those that equal an earlier one of the run; rows must be in order of document and start."""
    if not len(start):
        return
    order = np.argsort(whole, kind="stable")
    new = np.concatenate([[True], whole[order[1:]] != whole[order[:-1]]])
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = (doc[order] != doc[first]) | (start[order] != start[first])
    gone = order[~new & later]
    rows: list[tuple] = []
    if len(gone):
        d, s, e = _merged(doc[gone], start[gone], start[gone] + count[gone] + LENGTH - 1)
        rows.append((int(d[0] + s[0]) & ((1 << bits) - 1), np.stack([d, s, e]).astype(np.int64).tobytes(), *[b""] * 5))
    keep = order[new]
    keep = keep[np.argsort(key[keep], kind="stable")]
    for bucket, a, b in cuts(key[keep], bits):
        own = keep[a:b]
        rows.append(_packed(bucket, key[own], [doc[own], start[own], count[own], whole[own]]))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DEALT)], schema=_DEALT)


def _settle(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range of keys: intervals of contexts that equal an earlier one, and the different ones that share a key."""
    parts: list[list[np.ndarray]] = [[], [], [], [], []]
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(1, 7)]
        for settled, *cells in zip(*columns):
            if settled is not None:
                yield _intervals(*np.frombuffer(settled, np.int64).reshape(3, -1))
            else:
                for part, cell, kind in zip(parts, cells, (np.int64, np.uint32, np.uint8, np.uint64, np.uint64)):
                    part.append(np.frombuffer(cell, kind))
    if not parts[0]:
        return
    doc, start, count, anchor, whole = map(np.concatenate, parts)
    start, count = start.astype(np.int64), count.astype(np.int64)
    order = np.lexsort((start, doc, whole, anchor))
    doc, start, count, anchor, whole = doc[order], start[order], count[order], anchor[order], whole[order]
    new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    new = new_anchor | np.concatenate([[True], whole[1:] != whole[:-1]])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    gone = ~new & ((doc != doc[first]) | (start != start[first]))
    if gone.any():
        yield _intervals(doc[gone], start[gone], start[gone] + count[gone] + LENGTH - 1)
    classes = np.bincount(np.cumsum(new_anchor) - 1, weights=new)
    open_ = new & (classes[np.cumsum(new_anchor) - 1] > 1)
    if open_.any():
        yield _by_document(doc[open_], start[open_].astype(np.uint64) << _U(8) | count[open_].astype(np.uint64), anchor[open_])


_SHARDS = pa.schema([("bucket", pa.int32()), ("before", pa.binary()), ("sizes", pa.binary()), ("doc", pa.binary()), ("start", pa.binary())])
_SHARDS_SQL = "bucket int, before binary, sizes binary, doc binary, start binary"


def _shards(doc: np.ndarray, start: np.ndarray, strings: Texts, key: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Transforms of the given strings, one for each range of keys."""
    if not len(doc):
        return
    bucket = (key >> _U(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    raw, at = strings.data.tobytes(), strings.offsets
    rows = []
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        for k in range(0, len(own), _MOST_STRINGS):
            some = own[k : k + _MOST_STRINGS]
            before = bwt.transform([raw[x:y] for x, y in zip(at[some].tolist(), at[some + 1].tolist())])
            rows.append((int(bucket[some[0]]), before.tobytes(), (at[some + 1] - at[some]).astype(np.int64).tobytes(), doc[some].astype(np.int64).tobytes(), start[some].astype(np.int64).tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SHARDS)], schema=_SHARDS)


def _merge(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats of one range of keys."""
    rows = [row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(1, 5)))]
    rows = [(np.frombuffer(b, np.uint8), *(np.frombuffer(x, np.int64) for x in rest)) for b, *rest in rows]
    source, block = bwt.merge([r[0] for r in rows], [len(r[1]) for r in rows], LENGTH)
    own = np.split(np.argsort(source, kind="stable"), np.cumsum([len(r[0]) for r in rows])[:-1])
    blocks, docs, places = [], [], []
    for (before, sizes, doc, start), at in zip(rows, own):
        for k, rank in enumerate(bwt.ranks(before, sizes)):
            if k >= LENGTH and (ok := rank >= 0).any():
                blocks.append(block[at[rank[ok]]])
                docs.append(doc[ok])
                places.append(start[ok] + sizes[ok] - k)
    block, doc, place = map(np.concatenate, (blocks, docs, places))
    order = np.lexsort((place, doc, block))
    block, doc, place = block[order], doc[order], place[order]
    new = np.concatenate([[True], block[1:] != block[:-1]])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    gone = (doc != doc[first]) | (place != place[first])
    if gone.any():
        yield _intervals(doc[gone], place[gone], place[gone] + LENGTH)


def _lists(column: pa.Array) -> list[list[bytes]]:
    return [x or [] for x in column.to_pylist()]


def suffix_dedup(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and, with ``digest``, kept_sha256, else the bytes that are left and the removed spans (start, end)."""
    bits = bucket_bits(docs)
    coarse = first_bits(bits)
    given = docs.select("doc_id", "text")
    twice = given.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    read = given.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text")).union(given.where("doc_id is null")) if twice else given

    @frugal
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0)))
            ids = batch.column(0).to_numpy()
            for i, j, t in runs(texts(batch.column(1)), 8 * CHUNK):
                start, count, anchor, whole = contexts(t)
                index = t.document_of(start)
                # anchors are least hashes, so small numbers: mixed, they spread over all buckets
                yield from _deal(ids[i:j][index], start - t.offsets[index], count, mix(anchor), whole, coarse)

    @frugal
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _settle(list(batches))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Texts, np.ndarray]]:
        """Document, start, bytes and key of the contexts asked for, in order of document and start, by runs of documents."""
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(0)))
            ids = batch.column(0).to_numpy()
            for i, j, t in runs(texts(batch.column(1)), 8 * CHUNK):
                part = batch.slice(i, j - i)
                packed = [np.frombuffer(b"".join(x), np.uint64) for x in _lists(part.column(2))]
                keys = np.concatenate([np.frombuffer(b"".join(x), np.uint64) for x in _lists(part.column(3))])
                of, every = np.repeat(np.arange(len(t)), [len(p) for p in packed]), np.concatenate(packed)
                order = np.lexsort((every, of))
                of, every, keys = of[order], every[order], keys[order]
                start, size = (every >> _U(8)).astype(np.int64), (every & _U(0xFF)).astype(np.int64) + LENGTH - 1
                yield ids[i:j][of], start, Texts(t.data[ranges(t.offsets[of] + start, size)], np.concatenate([[0], np.cumsum(size)])), keys

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, start, strings, key in wanted(batches):
            first, count, greatest, whole = contexts(strings, greatest=True)
            of = strings.document_of(first)
            yield from _deal(doc[of], start[of] + first - strings.offsets[of], count, mix(key[of] ^ greatest), whole, coarse)

    @frugal
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in wanted(batches):
            yield from _shards(*part, bits)

    @frugal
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _merge(list(batches))

    def with_text(found: DataFrame) -> DataFrame:
        asked = found.where("wanted").groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("found", "keys")).alias("asked"))
        asked = asked.select("of", F.col("asked.found").alias("found"), F.col("asked.keys").alias("keys"))
        return read.join(asked, F.col("doc_id") == F.col("of")).select("doc_id", "text", "found", "keys")

    dealt = read.where("doc_id is not null and text is not null").mapInArrow(deal, _DEALT_SQL)
    on = lambda rows: dealt_on(rows, _DEALT, bits, _unpacked, _packed, lambda row: row[1] is not None)
    alike = written(on(dealt).groupBy("bucket").applyInArrow(settle, _FOUND_SQL), "alike")
    parts = with_text(alike).mapInArrow(cut, _DEALT_SQL)
    closer = written(on(parts).groupBy("bucket").applyInArrow(settle, _FOUND_SQL), "closer")
    shards = with_text(closer).mapInArrow(shard, _SHARDS_SQL)
    compared = written(shards.groupBy("bucket").applyInArrow(merge, _FOUND_SQL), "compared")
    settled = alike.union(closer)
    gone = settled.where("not wanted").union(compared).groupBy(F.col("doc_id").alias("of")).agg(F.collect_list("found").alias("found"))
    gone = written(gone, "gone")
    discard(alike, closer, compared)
    joined = read.join(gone, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "found")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary, spans array<struct<start:bigint,end:bigint>>")

    @frugal
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, t in runs(texts(batch.column(1)), 4 * CHUNK):
                lists = _lists(batch.column(2).slice(i, j - i))
                packed = [np.frombuffer(b"".join(x), np.uint64) for x in lists]
                doc = np.repeat(np.arange(len(t)), [len(p) for p in packed])
                every = np.concatenate(packed)
                doc, start, end = _merged(doc, (every >> _U(32)).astype(np.int64), (every & _U(0xFFFFFFFF)).astype(np.int64))
                change = np.zeros(len(t.data) + 1, np.int8)
                change[t.offsets[doc] + start] += 1
                change[t.offsets[doc] + end] -= 1
                keep = np.cumsum(change[:-1], dtype=np.int8) == 0
                place = np.concatenate([[0], np.cumsum(keep)])[t.offsets]
                left = t.data[keep]
                pieces = [left[a:b].tobytes() for a, b in zip(place[:-1].tolist(), place[1:].tolist())]
                sizes = np.diff(t.offsets)
                cells = {"doc_id": batch.column(0).slice(i, j - i), "n_bytes": pa.array(sizes), "n_removed": pa.array(sizes - np.diff(place)), "n_spans": pa.array(np.bincount(doc, minlength=len(t)).astype(np.int64))}
                if digest:
                    cells["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in pieces], pa.string())
                else:
                    each = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(t)))])
                    spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
                    cells |= {"kept": pa.array(pieces, pa.binary()), "spans": pa.ListArray.from_arrays(pa.array(each, pa.int32()), spans)}
                yield pa.RecordBatch.from_pydict(cells)

    out = joined.mapInArrow(remove, schema)
    if not twice:
        return out
    rows = given.where("doc_id is not null").select(F.col("doc_id").alias("of"))
    return rows.join(out, F.col("of") == F.col("doc_id")).drop("of").union(out.where("doc_id is null"))
