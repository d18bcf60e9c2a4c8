"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled text: one of windows that toxic documents use in many different
contexts and ordinary ones hardly do, one of the commonest windows of ordinary documents. Every window of a text (a lower-cased word in its
boundaries; of a run of letters longer than that, the bytes from each of its code points on) is compressed with both. How far the two lengths lie
apart for a window of its size is weighed by how often labelled toxic and ordinary text shows the same lengths; a logistic curve
over a document's weights gives the score. The lengths that set those weights come from
dictionaries that the document had no part in.

Fitting reads whole texts of at most ``Fit.docs_per_class`` labelled rows of each class, chosen by the hash of doc_id among the rows that have a text, as
long as they come to no more than ``Fit.most_bytes`` together (the first one whatever its size); class frequencies are counted over
all labelled rows. Scoring covers every byte of every text, however long. Null and empty texts score as a text without a window;
without labels of both classes every score is the share of toxic labels (0 without labels). Repeated rows are scored each, equal texts equally;
a score of just 0.5 predicts 1. Extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wfspark.llm.columns import Texts, byte_class, frugal, member, mix, ranges, runs, span_hashes, spans, texts

_OUTSIDE = ~byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Stands behind each window and at the end of both dictionaries: the compressor does not look for matches in the last bytes of its input.
_CARRIER = b"0123456789ABCDEFGHIJKLMNOPQRSTUV"
_LONGEST = 24
_PREFIXES = range(4, 13)


@dataclass(frozen=True)
class Fit:
    docs_per_class: int = 1500
    #: Text of one class that comes to the driver.
    most_bytes: int = 1 << 26
    #: Entries of each dictionary.
    entries: int = 12_000
    #: A toxic prefix: least contexts, least ratio of its rates, least log-likelihood ratio statistic.
    least_contexts: int = 3
    least_ratio: float = 6.0
    least_evidence: float = 20.0
    ridge: float = 1e-2


def lowered(t: Texts) -> Texts:
    """A copy with A-Z lowered and spaces for the punctuation of U+00A0 to U+00BF, U+2000 to U+207F and U+3000 to U+303F."""
    data = t.data.copy()
    upper = (data >= 0x41) & (data <= 0x5A)
    data[upper] += 32
    for lead, seconds, length in ((0xC2, (0xA0, 0xBF), 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80, 0x80), 3)):
        at = np.flatnonzero(t.data[:-1] == lead)
        at = at[(t.data[at + 1] >= seconds[0]) & (t.data[at + 1] <= seconds[1])]
        for k in range(length):
            data[at + k] = 0x20
    return Texts(data, t.offsets)


def windows(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the windows of a lowered run, and each document's first window."""
    starts, ends = spans(t, _OUTSIDE)
    long = ends - starts > _LONGEST
    if long.any():
        opens = np.concatenate([(t.data & 0xC0) != 0x80, [True]])  # a code point begins
        at = ranges(starts[long], (ends - starts)[long])
        stop = np.repeat(ends[long], (ends - starts)[long])
        ok = opens[at]
        at, stop = at[ok], np.minimum(at[ok] + _LONGEST, stop[ok])
        for _ in range(3):
            stop -= ~opens[stop]
        starts, ends = np.concatenate([starts[~long], at]), np.concatenate([ends[~long], stop])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    return starts, ends, t.per_document(starts)


class Dictionary:
    """A compressor with one dictionary, precomputed once for a process."""

    def __init__(self, content: bytes):
        options = dict(window_log=17, chain_log=16, hash_log=17, search_log=6, min_match=3, target_length=64, strategy=zstd.STRATEGY_BTOPT)
        params = zstd.ZstdCompressionParameters(**options, write_checksum=0, write_content_size=0, write_dict_id=0)
        self.compressor = zstd.ZstdCompressor(compression_params=params, dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT))

    def lengths(self, items: list[bytes]) -> np.ndarray:
        sizes = np.array([len(x) for x in items], np.uint64)
        if not len(sizes):
            return np.empty(0, np.int64)
        segments = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1).astype("<u8").tobytes()
        found = self.compressor.multi_compress_to_buffer(zstd.BufferWithSegments(b"".join(items), segments), threads=1)
        return np.fromiter((len(found[k]) for k in range(len(found))), np.int64, len(found))


def _framed(data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [b" " + data[a:b] + b" " for a, b in zip(starts.tolist(), ends.tolist())]


def _content(items: list[bytes], entries: int) -> bytes:
    """The commonest windows, the commonest last, where offsets are shortest."""
    ranked = sorted(Counter(items).items(), key=lambda x: (-x[1], x[0]))[:entries]
    return b"".join(x for x, _ in reversed(ranked)) + _CARRIER


_SIZES, _LENGTHS = _LONGEST + 3, 64


def _cells(sizes: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """One number for a window's size and its two compressed lengths."""
    return (np.minimum(sizes, _SIZES - 1) * _LENGTHS + np.minimum(ordinary, _LENGTHS - 1)) * _LENGTHS + np.minimum(toxic, _LENGTHS - 1)


class Sample:
    """Labelled documents on the driver, cut into windows."""

    def __init__(self, t: Texts, toxic: np.ndarray):
        self.t, self.toxic = lowered(t), toxic
        self.starts, self.ends, self.first = windows(self.t)
        self.doc = np.repeat(np.arange(len(t)), np.diff(self.first))
        self.hashes = span_hashes(self.t.data, self.starts, self.ends)
        after = np.append(self.hashes[1:], np.uint64(0))
        last = self.first[1:][np.diff(self.first) > 0] - 1
        after[last] = mix(self.doc[last].astype(np.uint64))
        self.after = after

    def toxic_windows(self, docs: np.ndarray, fit: Fit) -> np.ndarray:
        """Windows of the given toxic documents that begin with a prefix typical of toxic text. A prefix counts once for each window
        that follows it, so copies of one document add nothing."""
        chosen = np.zeros(len(self.starts), bool)
        size = self.ends - self.starts
        inside = docs[self.doc]
        for n in _PREFIXES:
            at = np.flatnonzero(size >= n)
            h = span_hashes(self.t.data, self.starts[at], self.starts[at] + n)
            pair = mix(h ^ mix(self.after[at]))
            counts = []
            for label in (1, 0):
                own = inside[at] & (self.toxic[self.doc[at]] == label)
                _, k = np.unique(pair[own], return_index=True)
                counts.append((*np.unique(h[own][k], return_counts=True), max(1, len(k))))
            (keys, t, nt), (others, o_counts, no) = counts
            o = np.zeros(len(keys))
            both = member(keys, others)
            o[both] = o_counts[np.searchsorted(others, keys[both])]
            p = (t + o) / (nt + no)
            evidence = 2 * (t * np.log(t / (nt * p)) + np.where(o > 0, o * np.log(np.maximum(o, 1) / (no * p)), 0))
            ratio = (t / nt) / ((o + 0.5) / no)
            good = keys[(t >= fit.least_contexts) & (ratio >= fit.least_ratio) & (evidence >= fit.least_evidence)]
            chosen[at] |= member(h, good)
        return chosen

    def dictionaries(self, docs: np.ndarray, fit: Fit) -> tuple[bytes, bytes]:
        """Contents of the ordinary and the toxic dictionary from the given documents."""
        typical = self.toxic_windows(docs, fit)
        inside, label = docs[self.doc], self.toxic[self.doc]
        data = self.t.data.tobytes()
        make = lambda own: _content(_framed(data, self.starts[own], self.ends[own]), fit.entries)
        return make(inside & (label == 0) & ~typical), make(inside & (label == 1) & typical)

    def cells(self, contents: tuple[bytes, bytes]) -> np.ndarray:
        keys, at, which = np.unique(self.hashes, return_index=True, return_inverse=True)
        return _window_cells(self.t.data.tobytes(), self.starts[at], self.ends[at], [Dictionary(c) for c in contents])[which]


def _window_cells(data: bytes, starts: np.ndarray, ends: np.ndarray, pair: list[Dictionary]) -> np.ndarray:
    items = [x + _CARRIER for x in _framed(data, starts, ends)]
    return _cells(ends - starts + 2, *(d.lengths(items) for d in pair))


def _features(weights: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each document: a constant, the log of its summed weights, and their sum by the root of its windows."""
    total = np.concatenate([[0.0], np.cumsum(weights)])
    s, n = np.maximum(total[first[1:]] - total[first[:-1]], 0), np.diff(first)
    return np.stack([np.ones(len(n)), np.log1p(s), s / np.sqrt(n + 1)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    b = np.zeros(x.shape[1])
    penalty = ridge * len(y) / 100 * np.diag([0.0] + [1.0] * (x.shape[1] - 1)) + 1e-9 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ b)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b


@dataclass
class ToxicityModel:
    """Dictionaries, the weight of every cell that has one, and the curve's coefficients."""

    contents: tuple[bytes, bytes]
    cell_weights: dict[int, float]
    curve: np.ndarray
    prior: float

    def start(self) -> ToxicityModel:
        self.pair = [Dictionary(c) for c in self.contents]
        self.known: dict[int, float] = {}
        return self

    def score(self, t: Texts) -> np.ndarray:
        if not len(self.curve):
            return np.full(len(t), self.prior)
        t = lowered(t)
        starts, ends, first = windows(t)
        keys, at, which = np.unique(span_hashes(t.data, starts, ends), return_index=True, return_inverse=True)
        keys = keys.tolist()
        if len(self.known) > 250_000:  # memory, not results
            self.known.clear()
        new = [k for k, key in enumerate(keys) if key not in self.known]
        cells = _window_cells(t.data.tobytes(), starts[at[new]], ends[at[new]], self.pair)
        self.known.update((keys[k], self.cell_weights.get(c, 0.0)) for k, c in zip(new, cells.tolist()))
        weights = np.array([self.known[k] for k in keys], float)[which] if len(keys) else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(_features(weights, first) @ self.curve, -30, 30)))


def _cell_weights(cells: np.ndarray, label: np.ndarray) -> dict[int, float]:
    """Log ratio of a cell's rates in toxic and ordinary text, where toxic text clearly shows it more."""
    n1, n0 = max(1, (label == 1).sum()), max(1, (label == 0).sum())
    ids, which = np.unique(cells, return_inverse=True)
    t = np.bincount(which[label == 1], minlength=len(ids))
    o = np.bincount(which[label == 0], minlength=len(ids))
    w = np.log((t + 0.5) / n1) - np.log((o + 0.5) / n0)
    good = (w > 1) & (t >= 3)
    return dict(zip(ids[good].tolist(), w[good].tolist()))


def _within(rows: list, most: int) -> list[tuple[int, int]]:
    """doc_id and class of the first rows whose sizes come to ``most`` together; the first row in any case."""
    total = np.cumsum([r["size"] for r in rows])
    return sorted({(r["doc_id"], r["toxic"]) for k, r in enumerate(rows) if not k or total[k] <= most})


def train(docs: DataFrame, labels: DataFrame, fit: Fit | None = None) -> ToxicityModel:
    """``docs``: doc_id and text; ``labels``: doc_id and toxic (0 or 1) of the rows that may be learned from.
    The sample is chosen by ids and sizes; ``docs_per_class`` ids of each class at most go to the texts, and no text is shuffled."""
    fit = fit or Fit()
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    unfitted = ToxicityModel((b"", b""), {}, np.empty(0), prior)
    if len(counts) < 2:
        return unfitted
    usable = docs.select("doc_id", F.octet_length("text").alias("size")).where("size > 0").join(rows, "doc_id")
    first = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id", "size").limit(fit.docs_per_class) for k in (0, 1)]
    chosen = [_within(part.collect(), fit.most_bytes) for part in first]
    if not all(chosen):
        return unfitted
    picked = docs.sparkSession.createDataFrame([r for part in chosen for r in part], "doc_id long, toxic int")
    texts_ = docs.select("doc_id", "text").where(F.octet_length("text") > 0).join(F.broadcast(picked), "doc_id")
    sample = texts_.orderBy("toxic", F.xxhash64("doc_id"), "text").select("text", "toxic").toArrow()
    toxic = sample["toxic"].to_numpy()
    s = Sample(texts(sample["text"]), toxic)
    half = np.arange(len(toxic)) % 2 == 0
    cells = np.zeros(len(s.doc), np.int64)
    for own in (half, ~half):
        mine = own[s.doc]
        cells[mine] = s.cells(s.dictionaries(~own, fit))[mine]
    weights = _cell_weights(cells, toxic[s.doc])
    x = _features(np.array([weights.get(c, 0.0) for c in cells.tolist()]), s.first)
    curve = _logistic(x, toxic.astype(float), fit.ridge)
    share = (toxic == 1).mean()
    curve[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return ToxicityModel(s.dictionaries(np.ones(len(toxic), bool), fit), weights, curve, prior)


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score and predicted of each document."""
    shared = docs.sparkSession.sparkContext.broadcast((model.contents, model.cell_weights, model.curve, model.prior))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(*shared.value).start()
        for batch in batches:
            for i, j, t in runs(texts(batch.column(1))):
                score = model.score(t)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, j - i), "score": pa.array(score, pa.float64()), "predicted": pa.array(score >= 0.5).cast(pa.int32())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
