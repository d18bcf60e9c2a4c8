"""Byte-level BPE by prefix dynamic programming.

For a byte string every prefix has exactly one valid last token: the token t, ending there,
whose start is 0 or whose predecessor (the last token of the prefix before it) may stand
next to t in an encoding. ``PrefixEncoder`` keeps that token for each prefix, so it can
append bytes exactly, take the encoding of any prefix, and after an edit recompute only until
the stored tokens agree again. Whether two tokens may stand side by side is found by
unwinding their last merges, never by running merges.

Texts are first cut into the tokenizer's pieces, here with numpy over code points; each
distinct piece of a batch is encoded once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wfspark.llm.codepoints import BLANK, LETTER, classes, points
from wfspark.llm.columns import Texts, frugal, ranges, runs, span_hashes, texts


#: Bounds of what one worker remembers: pairs of tokens, pieces, and the bytes of the pieces' ids (about 60 MB together).
MOST_PAIRS, MOST_PIECES, MOST_BYTES = 200_000, 200_000, 8 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Tokens by rank, each with the two tokens of its last merge (single bytes: themselves)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.tokens = {r: t for t, r in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self._beside: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.parts[rank] = self._last_merge(token, rank)

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        get = self.ranks.get
        for cut in range(1, len(token)):
            left, right = get(token[:cut]), get(token[cut:])
            if left is not None and right is not None and left < rank and right < rank and self._apart(left, right, rank):
                return left, right
        return rank, rank

    def _apart(self, left: int, right: int, below: int) -> bool:
        """True if no merge of a rank under ``below`` joins the right edge of left to the left edge of right
        before both are complete: the two are unwound from the later merge to the earlier."""
        get, tokens, parts = self.ranks.get, self.tokens, self.parts
        while True:
            joined = get(tokens[left] + tokens[right])
            if joined is not None and joined < below:
                return False
            # undo whichever was merged last; of equal tokens the right one, as merges run from the left
            inner_left, inner_right = parts[left][1], parts[right][0]
            if inner_left != left and (left > right or inner_right == right):
                left, below = inner_left, left
            elif inner_right != right:
                right, below = inner_right, right + 1
            else:
                return True

    def beside(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left`` in an encoding?"""
        key = left << 32 | right
        found = self._beside.get(key)
        if found is None:
            if len(self._beside) >= MOST_PAIRS:  # memory, not results: they are found again
                self._beside.clear()
            found = self._beside[key] = self._apart(left, right, 1 << 62)
        return found


class PrefixEncoder:
    """The last token of every prefix of a byte string (``last[i]`` ends at byte i; ``last[0]`` is unused)."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: tokens of the prefixes so far stay as they are."""
        v, last, data = self.vocabulary, self.last, self.data
        get, known, beside, longest = v.ranks.get, v._beside, v.beside, v.longest
        begin = len(data)
        data += more
        floor = max(0, begin - longest)
        recent = bytes(data[floor:])
        for end in range(begin + 1 - floor, len(recent) + 1):
            for start in range(max(0, end - longest), end):
                token = get(recent[start:end])
                if token is None:
                    continue
                if start + floor == 0:
                    break
                before = last[start + floor]
                fits = known.get(before << 32 | token)
                if fits or fits is None and beside(before, token):
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            last.append(token)

    def keep(self, size: int) -> None:
        """Drop all but the first ``size`` bytes; their tokens stay."""
        del self.data[size:], self.last[size + 1 :]

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` for the bytes from start to end; returns how many prefixes were computed anew.
        Past the edit it stops once a longest token's length of prefixes in a row agree with the old ones."""
        old, tail = self.last[end + 1 :], bytes(self.data[end:])
        self.keep(start)
        self.append(new)
        same, done = 0, len(new)
        for k in range(len(tail)):
            self.append(tail[k : k + 1])
            done += 1
            same = same + 1 if self.last[-1] == old[k] and len(self.vocabulary.tokens[old[k]]) <= k + 1 else 0
            if same >= self.vocabulary.longest:
                self.data += tail[k + 1 :]
                self.last += old[k + 1 :]
                break
        return done

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the prefix that ends at ``end`` (default: of all)."""
        at, out = len(self.data) if end is None else end, []
        last, tokens = self.last, self.vocabulary.tokens
        while at:
            token = last[at]
            out.append(token)
            at -= len(tokens[token])
        out.reverse()
        return out


def piece_starts(t: Texts) -> np.ndarray:
    """Byte positions where the pattern's matches begin; a match never crosses documents."""
    if not len(t.data):
        return np.empty(0, np.int64)
    chars, at = points(t)
    n = len(chars)
    kind = classes()[chars]
    opens = np.zeros(n + 1, bool)  # a document begins
    opens[np.searchsorted(at, t.offsets)] = True
    opens[n] = True
    run = opens.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    space = chars == 0x20
    blank = kind == BLANK
    starts = run[:n].copy()
    # a blank run before something else gives up its last code point: as the other's prefix if it is a space, else by itself
    before = np.flatnonzero(run[1:] & ~opens[1:] & blank)
    starts[before] = True
    joined = before[space[before]]
    starts[joined + 1] = False
    # contractions: an apostrophe alone in its run, without a space before, and the letters that follow
    quote = np.flatnonzero((chars == 0x27) & run[:n] & run[1:] & ~opens[1:])
    quote = quote[starts[quote] & (quote + 1 < n)]
    quote = quote[kind[quote + 1] == LETTER]
    if len(quote):
        one = chars[quote + 1]
        two = chars[np.minimum(quote + 2, n - 1)]
        has_two = (quote + 2 < n) & ~opens[np.minimum(quote + 2, n)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = has_two & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
        for which, length in ((quote[short], 2), (quote[long & ~short], 3)):
            starts[which + 1] = False
            rest = which + length
            rest = rest[rest < n]
            starts[rest] |= True
        # what follows a contraction is a piece of its own unless a joined space or run boundary already says so
    return at[np.flatnonzero(starts)]


class Codec:
    """Encodes and decodes runs of documents; one for each Python worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.vocabulary = Vocabulary(ranks)
        size = max(self.vocabulary.tokens, default=-1) + 1
        self.lengths = np.zeros(size, np.int64)
        for r, token in self.vocabulary.tokens.items():
            self.lengths[r] = len(token)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.zeros(self.begins[-1], np.uint8)
        for r, token in self.vocabulary.tokens.items():
            self.bytes[self.begins[r] : self.begins[r + 1]] = np.frombuffer(token, np.uint8)
        self.known: dict[int, bytes] = {}
        self.known_bytes = 0

    def forget(self) -> None:
        """Let go of all but the vocabulary."""
        self.known, self.known_bytes = {}, 0
        self.vocabulary._beside.clear()

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the index of each document's first id (one more at the end)."""
        starts = piece_starts(t)
        ends = np.append(starts[1:], len(t.data)) if len(starts) else starts
        keys, where, which = np.unique(span_hashes(t.data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) > MOST_PIECES or self.known_bytes > MOST_BYTES:  # memory, not results
            self.known, self.known_bytes = {}, 0
        keys = keys.tolist()
        new = [i for i, key in enumerate(keys) if key not in self.known]
        data = t.data.tobytes()
        self._learn(sorted((data[starts[k] : ends[k]], keys[i]) for i, k in zip(new, where[new].tolist())))
        found = [self.known[key] for key in keys]
        flat = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(sizes) - sizes
        ids = flat[ranges(first[which], sizes[which])] if len(starts) else flat
        total = np.concatenate([[0], np.cumsum(sizes[which])]) if len(starts) else np.zeros(1, np.int64)
        return ids, total[t.per_document(starts)]

    def _learn(self, pieces: list[tuple[bytes, int]]) -> None:
        """Ids of new pieces. In order, each piece keeps what it shares with the one before and appends the rest."""
        encoder, before = PrefixEncoder(self.vocabulary), b""
        for piece, key in pieces:
            shared, most = 0, min(len(piece), len(before))
            while shared < most and piece[shared] == before[shared]:
                shared += 1
            encoder.keep(shared)
            encoder.append(piece[shared:])
            found = self.known[key] = np.array(encoder.ids(), np.uint32).tobytes()
            self.known_bytes += len(found)
            before = piece

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after another."""
        return self.bytes[ranges(self.begins[ids], self.lengths[ids])]


@lru_cache(1)
def _codec(path: str) -> Codec:
    return Codec(load_ranks(path))


SCHEMA = "doc_id long, ids array<int>, decoded binary"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encoded(t: Texts, codec: Codec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, first = codec.encode(t)
    out = codec.decode(ids)
    ends = np.concatenate([[0], np.cumsum(codec.lengths[ids])])[first]
    if len(out) != len(t.data) or not np.array_equal(out, t.data):
        # two pieces of one run with one hash: encode piece by piece, without the shared table
        starts = piece_starts(t)
        stops = np.append(starts[1:], len(t.data))
        parts = [PrefixEncoder(codec.vocabulary, t.data[a:b].tobytes()).ids() for a, b in zip(starts, stops)]
        ids = np.array([i for p in parts for i in p], np.uint32)
        sizes = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        first = sizes[t.per_document(starts)]
        out = codec.decode(ids)
        ends = np.concatenate([[0], np.cumsum(codec.lengths[ids])])[first]
    return ids, first, out, ends


def bpe_encode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """Token ids of each whole text and the bytes they decode to; with ``digest`` their counts and SHA-256.

    The rank file must be readable where Python workers run. A null text counts as empty and has no ids; repeated rows are
    encoded each; extra columns are ignored; an empty table gives no rows. Texts of any length are encoded whole.
    """

    def cells(ids: np.ndarray, first: np.ndarray, out: np.ndarray, ends: np.ndarray) -> dict[str, pa.Array]:
        if not digest:
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
            return {"ids": lists, "decoded": pa.array([out[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())}
        sha = lambda x, at: pa.array([hashlib.sha256(x[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])], pa.string())
        return {"n_tokens": pa.array(np.diff(first), pa.int64()), "ids_sha256": sha(ids.astype("<u4"), first), "decoded_sha256": sha(out, ends)}

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        try:
            for batch in batches:
                for i, j, t in runs(texts(batch.column(1))):
                    yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i, j - i)} | cells(*_encoded(t, codec)))
        finally:  # workers are used again by other tasks
            codec.forget()

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST if digest else SCHEMA)
