"""Exact Jaccard join of word n-gram sets as a blocked sparse matrix product.

A document is a row of the incidence matrix of documents by n-grams. Documents with one set are one class, stood for by the
smallest doc_id. Two sets of sizes m <= n can only be as similar as m / n, and sets as similar as the
threshold must share one of their first few n-grams in any fixed order; the order here is rarest first, by a fixed-size sketch of
document frequencies (whatever the sketch's error, no pair is lost). A class that has as many n-grams to itself as its head is
long is done before: no other can be similar enough. Classes that may be alike by these two bounds are gathered
into candidate components, so that each set travels once. Of a component of more than ``BLOCK`` classes every class is first compared with one
class that it shares most of its first n-grams with, about ``BLOCK`` rows a task; what these stars link is settled among itself. Then the
component is cut by sizes and into blocks of about ``BLOCK`` rows that hold one settled group or unsettled classes, and each pair of blocks that are
not of one settled group is multiplied: a task takes the two parts of the matrix, a slice of columns at a time, adds up the overlap
counts, and drops pairs below the bound for their sizes. A group of g near copies of one text so costs g / ``BLOCK`` products; classes of one
component that stay unlinked still meet in pairs of blocks. A task gives the links that span what it found, not all
pairs; connected components of the links give the groups.

Null texts and texts without a word have empty sets and link with nothing. Repeated rows fall into one class; rows that share a doc_id but not
a set are documents of their own. A similarity of just the threshold links. Texts of any length are read whole; extra columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wfspark.llm.columns import CHUNK, Texts, frugal, mix, runs, span_hashes, spans, texts, window_hashes
from wfspark.llm.components import components
from wfspark.llm.dealing import bucket_bits, cuts, dealt_on, first_bits
from wfspark.llm.sources import discard, settled_jobs, written

CELLS = 1 << 21
_SLICES = 64
BLOCK = 512
_COLUMNS = 4096
HOT = 1000
_SEEDS = (0x1234567, 0x89ABCDEF)


@dataclass(frozen=True)
class Similarity:
    n: int = 3
    percent: int = 90


def shingle_sets(t: Texts, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each document of a run, ASCII capitals lowered; a shorter text is one n-gram."""
    data = t.data.copy()
    upper = (data >= 0x41) & (data <= 0x5A)
    data[upper] += 32
    t = Texts(data, t.offsets)
    starts, ends = spans(t)
    first = t.per_document(starts).tolist()
    words = span_hashes(data, starts, ends)
    grams = window_hashes(words, n)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _sketch(docs: DataFrame, like: Similarity) -> np.ndarray:
    """Document frequencies of n-grams summed by cell: CELLS numbers whatever the input."""
    width = CELLS // _SLICES

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for _, _, t in runs(texts(batch.column(0))):
                sets = shingle_sets(t, like.n)
                cells += np.bincount((np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)
        if cells.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(_SLICES), pa.int32()), "cells": pa.array([cells[k * width : (k + 1) * width].tobytes() for k in range(_SLICES)])})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = np.zeros(width, np.uint64), 0
        for batch in batches:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                total += np.frombuffer(cells.as_buffer(), np.uint32)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "cells": pa.array([np.minimum(total, 0xFFFF).astype(np.uint16).tobytes()])})

    kind = "part int, cells binary"
    with settled_jobs(docs.sparkSession):
        sums = docs.select("text").where("text is not null").mapInArrow(count, kind).groupBy("part").applyInArrow(add, kind).toArrow()
    out = np.zeros(CELLS, np.uint16)
    for part, cells in zip(sums["part"].to_pylist(), sums["cells"].to_pylist()):
        out[part * width : (part + 1) * width] = np.frombuffer(cells, np.uint16)
    return out


def _digests(docs: DataFrame, like: Similarity) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set, and the n-grams of which similar sets share one."""
    shared = docs.sparkSession.sparkContext.broadcast(_sketch(docs, like))

    @frugal
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for i, j, t in runs(texts(batch.column(1))):
                names, heads = [[], []], []
                sets = shingle_sets(t, like.n)
                for s in sets:
                    for k, seed in enumerate(_SEEDS):
                        names[k].append(int(_name(s, seed)))
                    size = len(s) - -(-like.percent * len(s) // 100) + 1 if len(s) else 0
                    order = np.lexsort((s, counts[(s & np.uint64(CELLS - 1)).astype(np.int64)]))
                    heads.append(s[order[:size]].view(np.int64))
                place = np.cumsum([0, *map(len, heads)])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(i, j - i),
                        "n_shingles": pa.array(map(len, sets), pa.int64()),
                        "name_a": pa.array(np.array(names[0], np.uint64).view(np.int64)),
                        "name_b": pa.array(np.array(names[1], np.uint64).view(np.int64)),
                        "head": pa.ListArray.from_arrays(pa.array(place, pa.int32()), pa.array(np.concatenate(heads))),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(digest, "doc_id long, n_shingles long, name_a long, name_b long, head array<long>")


_PACKED = "bucket int, names binary, counts binary, grams binary"
_GRAMS = pa.schema([("bucket", pa.int32()), ("names", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())])


def _grams_packed(bucket: int, grams: np.ndarray, values: list[np.ndarray]) -> tuple:
    """n-grams by the set that has them: names, how many each has, and those."""
    names, counts = np.unique(values[0], return_counts=True)
    return bucket, names.tobytes(), counts.astype(np.int32).tobytes(), grams[np.argsort(values[0], kind="stable")].tobytes()


def _grams_unpacked(cells: list[tuple]) -> tuple[np.ndarray, list[np.ndarray]]:
    names = [np.repeat(np.frombuffer(n, np.uint64), np.frombuffer(c, np.int32)) for _, n, c, _ in cells]
    return np.concatenate([np.frombuffer(row[3], np.uint64) for row in cells]), [np.concatenate(names)]


def _name(s: np.ndarray, seed: int) -> np.ndarray:
    return mix(s ^ mix(s + np.uint64(seed))).sum()


def _own_grams(docs: DataFrame, like: Similarity) -> DataFrame:
    """name_a and own: how many n-grams of each distinct set no other set has.

    A set that keeps as many to itself as its head is long can't be similar enough to any other. Each run of documents gives an n-gram once, with
    the name of its set or 0 for several; entries are dealt by n-gram as packed arrays, and only counts come back."""
    bits = bucket_bits(docs)
    first_ = first_bits(bits)

    @frugal
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, t in runs(texts(batch.column(0)), 8 * CHUNK):
                sets = {int(_name(s, _SEEDS[0])): s for s in shingle_sets(t, like.n) if len(s)}
                if not sets:
                    continue
                name = np.repeat(np.array(list(sets), np.uint64), [len(s) for s in sets.values()])
                gram = np.concatenate(list(sets.values()))
                order = np.argsort(gram, kind="stable")
                gram, name = gram[order], name[order]
                first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
                once = np.diff(np.append(first, len(gram))) == 1
                gram, name = gram[first], np.where(once, name[first], np.uint64(0))
                rows = [_grams_packed(bucket, gram[a:b], [name[a:b]]) for bucket, a, b in cuts(gram, first_)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _GRAMS)], schema=_GRAMS)

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, grams = [], []
        for batch in batches:
            for n, c, g in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                names.append(np.repeat(np.frombuffer(n, np.uint64), np.frombuffer(c, np.int32)))
                grams.append(np.frombuffer(g, np.uint64))
        name, gram = np.concatenate(names), np.concatenate(grams)
        order = np.argsort(gram)
        gram, name = gram[order], name[order]
        first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        low, high = np.minimum.reduceat(name, first), np.maximum.reduceat(name, first)
        ids, counts = np.unique(low[(low == high) & (low != 0)], return_counts=True)
        yield pa.RecordBatch.from_pydict({"name_a": pa.array(ids.view(np.int64), pa.int64()), "own": pa.array(counts, pa.int64())})

    packed = dealt_on(docs.select("text").where("text is not null").mapInArrow(deal, _PACKED), _GRAMS, bits, _grams_unpacked, _grams_packed, lambda row: False)
    return packed.groupBy("bucket").applyInArrow(count, "name_a long, own long").groupBy("name_a").agg(F.sum("own").alias("own"))


def _sets(docs: DataFrame, like: Similarity) -> DataFrame:
    """of, name_a and grams: doc_id, the name of its set, and the set."""

    @frugal
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, t in runs(texts(batch.column(1))):
                sets = shingle_sets(t, like.n)
                names = np.array([_name(s, _SEEDS[0]) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_pydict({"of": batch.column(0).slice(i, j - i), "name": pa.array(names), "grams": pa.array([s.tobytes() for s in sets], pa.binary())})

    taken = docs.select("doc_id", "text").mapInArrow(take, "of long, name long, grams binary")
    return taken.groupBy("of", "name").agg(F.first("grams").alias("grams"))


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of ``left`` and ``right`` (indices) are similar enough: overlap counts of the incidence matrices, a slice of columns at a time."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets)
    names, which = np.unique(every, return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(which, kind="stable")
    which, row = which[order], row[order]
    overlap = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(names), _COLUMNS):
        a, b = np.searchsorted(which, (low, low + _COLUMNS))
        part = np.zeros((len(sets), min(_COLUMNS, len(names) - low)), np.float32)
        part[row[a:b], which[a:b] - low] = 1
        overlap += part[left] @ part[right].T
    m, n = sizes[left][:, None], sizes[right][None, :]
    shared = np.rint(overlap).astype(np.int64)
    return (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & (100 * shared >= percent * (m + n - shared))


def _spanning(ids: np.ndarray, left: np.ndarray, right: np.ndarray, similar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what ``similar`` joins: each id with the smallest of its group."""
    label = np.arange(len(ids))
    big = len(ids)
    while True:
        new = label.copy()
        np.minimum.at(new, left, np.where(similar, label[right][None, :], big).min(axis=1, initial=big))
        np.minimum.at(new, right, np.where(similar, new[left][:, None], big).min(axis=0, initial=big))
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(ids)))
    return ids[own], ids[label[own]]


def _candidates(entries: DataFrame, like: Similarity) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The entries whose n-gram several classes have, the smallest class of each n-gram and band of sizes, and links (a, b) after which any two classes
    that share a head n-gram and are of similar enough sizes lie in one component.

    At one n-gram, classes in one narrow band of sizes are linked with the smallest id of the band, and neighbouring bands with one another
    where the largest size below and the smallest above are close enough: if two classes are, so are all steps between them."""
    meeting = entries.groupBy("gram").agg(F.count("*").alias("size")).where("size > 1").select(F.col("gram").alias("at"))
    band = F.floor(F.log("n") / F.lit(-np.log1p(min(like.percent - 100, -1) / 1000)))
    met = written(entries.join(meeting, F.col("gram") == F.col("at")).select("gram", "node", "n", band.alias("band")), "met", light=True)
    bands = met.groupBy("gram", "band").agg(F.min("node").alias("least"), F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("size"))
    inside = met.join(bands.where("size > 1").select("gram", "band", "least"), ["gram", "band"]).select(F.col("node").alias("a"), F.col("least").alias("b"))
    below = Window.partitionBy("gram").orderBy("band")
    across = bands.select("gram", "low", F.col("least").alias("a"), F.lag("least").over(below).alias("b"), F.lag("high").over(below).alias("under"))
    across = across.where(100 * F.col("under") >= like.percent * F.col("low")).select("a", "b")
    pairs = written(inside.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared")), "pairs", light=True)
    return met, pairs, pairs.select("a", "b").union(across.where("a <> b")).distinct()


_LINKS = "a long, b long"


def _compared(dealt: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links within each group of ``dealt`` (keys, node, is_high, grams): between its low and its high rows, or among all where none is high."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, high = [], [], []
        for batch in batches:
            ids += batch.column("node").to_pylist()
            high += batch.column("is_high").to_pylist()
            sets += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("grams")]
        order = np.argsort(ids, kind="stable")
        ids, sets, high = np.array(ids)[order], [sets[k] for k in order], np.array(high)[order]
        left, right = (np.flatnonzero(~high), np.flatnonzero(high)) if high.any() else (np.arange(len(ids)),) * 2
        if len(left) and len(right):
            a, b = _spanning(ids, left, right, linked(sets, left, right, percent))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.select(*keys, "node", "is_high", "grams").groupBy(*keys).applyInArrow(multiply, _LINKS)


def _dealt_by(node: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(node), F.col(blocks)).cast("int")


def _star_links(large: DataFrame, pairs: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """Links between the classes of large components and the class that each shares most of its first n-grams with."""
    own = pairs.join(large.select(F.col("node").alias("a")), "a", "left_semi")
    stars = own.groupBy(F.col("a").alias("node")).agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("hub"))
    parts = stars.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rays = stars.join(parts, "hub").select("hub", _dealt_by("node", "parts").alias("part"), "node", F.lit(True).alias("is_high"))
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hub").alias("node"), F.lit(False).alias("is_high"))
    return _compared(rays.union(hubs).join(sets, "node"), ["hub", "part"], like.percent)


def _cut_by_size(large: DataFrame, settled: DataFrame, like: Similarity) -> DataFrame:
    """component, node, group (the settled one, or the class itself) and sizes. A class goes with the band of its size and with the band below; sizes two
    bands apart are too far from one another."""
    band = F.floor(F.log("n") / F.lit(-np.log(min(like.percent, 99) / 100))).cast("int")
    named = settled.select(F.col("id").alias("node"), F.col("component").alias("settled"))
    return large.join(named, "node", "left").select("component", "node", F.coalesce("settled", "node").alias("group"), F.explode(F.array(band, band - 1)).alias("sizes"))


def _block_pairs(cut: DataFrame) -> DataFrame:
    """component, sizes, low, high, node, is_high: large components cut by size and into blocks, each with the blocks that it is to be compared with.
    ``cut``: what ``_cut_by_size`` gives."""
    counts = cut.groupBy("component", "sizes", "group").agg(F.count("*").alias("size"))
    whole = counts.groupBy("component", "sizes").agg(F.count("*").alias("groups"), F.sum(F.when(F.col("size") < BLOCK, F.col("size")).otherwise(0)).alias("rest")).where("groups > 1")
    parts = counts.join(whole, ["component", "sizes"]).withColumn("own", F.when(F.col("size") >= BLOCK, F.col("group")))
    parts = parts.withColumn("blocks", F.ceil(F.when(F.col("size") >= BLOCK, F.col("size")).otherwise(F.col("rest")) / BLOCK).cast("int"))
    placed = cut.join(parts.select("component", "sizes", "group", "own", "blocks"), ["component", "sizes", "group"])
    placed = placed.select("component", "sizes", "node", "own", _dealt_by("node", "blocks").alias("block"))
    blocks = parts.select("component", "sizes", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).distinct()
    blocks = blocks.withColumn("number", F.row_number().over(Window.partitionBy("component", "sizes").orderBy("own", "block")))
    low = blocks.select("component", "sizes", F.col("own").alias("low_own"), F.col("number").alias("low"))
    high = blocks.select("component", "sizes", F.col("own").alias("high_own"), F.col("number").alias("high"))
    tasks = low.join(high, ["component", "sizes"]).where("low <= high and not (low_own is not null and low_own <=> high_own)").select("component", "sizes", "low", "high")
    numbered = placed.join(blocks.withColumnRenamed("own", "of"), (F.col("own").eqNullSafe(F.col("of"))) & (placed["block"] == blocks["block"]) & (placed["component"] == blocks["component"]) & (placed["sizes"] == blocks["sizes"]))
    numbered = numbered.select(placed["component"], placed["sizes"], "node", "number")
    at = lambda side, flag: numbered.withColumnRenamed("number", side).join(tasks, ["component", "sizes", side]).select("component", "sizes", "low", "high", "node", F.lit(flag).alias("is_high"))
    return at("low", False).union(at("high", True).where("low < high"))


def jaccard_join(docs: DataFrame, like: Similarity | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) of every row."""
    like = like or Similarity()
    digests = written(_digests(docs, like), "digests")
    full = digests.where("n_shingles > 0")
    narrow = full.groupBy("name_a", "name_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    # a class is known by its smallest doc_id; only where several classes have the same one, by the hash of its name
    shared_ids = narrow.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    node = F.xxhash64("name_a", "name_b") if shared_ids else F.col("rep")
    classes = full.groupBy("name_a", "name_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("head").alias("head")).withColumn("node", node)
    own_grams = written(_own_grams(docs, like), "own")
    classes = classes.join(own_grams, "name_a", "left").where(F.coalesce("own", F.lit(0)) < F.size("head"))
    entries = written(classes.select("node", "n", F.explode("head").alias("gram")), "entries", light=True)
    met, pairs, edges = _candidates(entries, like)
    found = components(edges)
    together = written(found.select("id", "component").union(found.select("component", "component").distinct()), "together", light=True)
    discard(met, found)
    members = together.select(F.col("id").alias("node"), "component").join(classes.select("node", "rep", "name_a", "n"), "node")
    sized = members.groupBy("component").agg(F.count("*").alias("members"))
    members = written(members.join(sized, "component"), "members", light=True)
    wanted = docs.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    taken = _sets(wanted, like)
    sets = written(taken.join(members.select("node", "rep", "name_a"), (F.col("of") == F.col("rep")) & (F.col("name") == F.col("name_a"))).select("node", "grams"), "sets")
    small = members.where(F.col("members") <= BLOCK).select("component", "node", F.lit(False).alias("is_high")).join(sets, "node")
    links = close = written(_compared(small, ["component"], like.percent), "close")
    used = [close]
    large = members.where(F.col("members") > BLOCK).select("component", "node", "n")
    if large.limit(1).count():
        stars = written(_star_links(large, pairs, sets, like), "stars")
        settled = components(stars)
        cut = written(_cut_by_size(large, settled, like), "cut", light=True)
        rest = written(_compared(_block_pairs(cut).join(sets, "node"), ["component", "sizes", "low", "high"], like.percent), "rest")
        links = close.union(stars).union(rest)
        used += [stars, settled, cut, rest]
    groups = components(links)
    discard(own_grams, entries, pairs, together, members, sets, *used)
    named = narrow.withColumn("node", node).join(groups, F.col("node") == F.col("id"), "left").select("name_a", "name_b", "rep", "copies", F.coalesce("component", "node").alias("component"))
    if shared_ids:
        named = named.join(named.groupBy("component").agg(F.min("rep").alias("least")), "component").select("name_a", "name_b", "copies", F.col("least").alias("component"))
    named = written(named.select("name_a", "name_b", "copies", "component"), "named", light=True)
    discard(groups)
    return _labelled(digests, named)


def _labelled(digests: DataFrame, named: DataFrame) -> DataFrame:
    """Every row with the component of its class. Classes with over a ``HOT``th of all rows are few, so they go to every task, and their copies don't
    gather in one; the others are joined by name."""
    many = F.lit(max(HOT, digests.count() // HOT))
    hot = named.where(F.col("copies") > many).select(F.col("name_a").alias("hot_a"), F.col("name_b").alias("hot_b"), F.col("component").alias("hot"))
    rows = digests.select("doc_id", "n_shingles", "name_a", "name_b")
    rows = rows.join(F.broadcast(hot), (F.col("name_a") == F.col("hot_a")) & (F.col("name_b") == F.col("hot_b")), "left").drop("hot_a", "hot_b")
    known = rows.where(F.col("hot").isNotNull()).select("doc_id", "n_shingles", F.col("hot").alias("component_id"))
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rest = rows.where("hot is null and n_shingles > 0").join(named.where(F.col("copies") <= many), ["name_a", "name_b"], "left")
    return known.union(alone).union(rest.select("doc_id", "n_shingles", F.col("component").alias("component_id")))
