"""Packed rows dealt to buckets by the high bits of their keys, a few bits at a time.

A run of documents cuts its keys into at most 2**LEVEL cells, however many buckets there are. For more buckets the cells are dealt on: tasks gather the cells
of a bucket up to ``GATHERED`` bytes and cut them by the next bits. So the work of a row and the size of a cell don't change with the input.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wfspark.llm.columns import frugal

#: Text that one bucket stands for, and the least number of buckets.
BUCKET_BYTES, LEAST_BITS = 16 << 20, 8
LEVEL = 10
GATHERED = 64 << 20
#: Packed rows of one coarse bucket that a dealing task takes.
TASK_BYTES = 256 << 20


def bucket_bits(docs: DataFrame) -> int:
    """Bits of the bucket numbers: they follow the input's size as the optimizer knows it, whatever it is."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    bits = LEAST_BITS
    while BUCKET_BYTES << bits < size and bits < 30:
        bits += 1
    return bits


def first_bits(bits: int) -> int:
    return min(bits, LEVEL)


def cuts(keys: np.ndarray, bits: int, prefix: int = 0, prefix_bits: int = 0) -> Iterator[tuple[int, int, int]]:
    """Bucket, first and end of the sorted keys of each bucket that has any; all keys begin with ``prefix``."""
    numbers = (keys << np.uint64(prefix_bits) >> np.uint64(64 - bits)).astype(np.int64) if prefix_bits else (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])) if len(keys) else np.empty(0, np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
        yield prefix << bits | int(numbers[a]), a, b


Unpack = Callable[[list[tuple]], tuple[np.ndarray, list[np.ndarray]]]
Pack = Callable[[int, np.ndarray, list[np.ndarray]], tuple]


def dealt_on(rows: DataFrame, schema: pa.Schema, bits: int, unpack: Unpack, pack: Pack, settled: Callable[[tuple], bool]) -> DataFrame:
    """Rows that were dealt by their first bits, dealt by all ``bits``. ``unpack``: cells of one bucket to keys and what goes with them, ``pack``: a row of
    keys of one bucket; rows that are ``settled`` stay as they are. The first column is the bucket."""
    done, kinds = first_bits(bits), rows.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    while done < bits:
        more = min(bits - done, LEVEL)

        def split(batches: Iterator[pa.RecordBatch], done: int = done, more: int = more) -> Iterator[pa.RecordBatch]:
            held: defaultdict[int, list[tuple]] = defaultdict(list)
            size = 0

            def out(found: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

            def flush() -> Iterator[pa.RecordBatch]:
                for bucket, cells in held.items():
                    keys, values = unpack(cells)
                    order = np.argsort(keys, kind="stable")
                    keys, values = keys[order], [v[order] for v in values]
                    yield out([pack(b, keys[i:j], [v[i:j] for v in values]) for b, i, j in cuts(keys, more, bucket, done)])
                held.clear()

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if settled(row):
                        yield out([row])
                    else:
                        held[row[0]].append(row)
                        size += sum(len(x) for x in row if isinstance(x, bytes))
                if size > GATHERED:
                    yield from flush()
                    size = 0
            yield from flush()

        @frugal
        def run(batches: Iterator[pa.RecordBatch], split=split) -> Iterator[pa.RecordBatch]:
            yield from split(batches)

        parts = max(1, (BUCKET_BYTES << (bits - done)) // TASK_BYTES)
        rows = rows.repartition("bucket", F.pmod(F.xxhash64(*rows.columns[1:]), F.lit(parts))).mapInArrow(run, kinds)
        done += more
    return rows
