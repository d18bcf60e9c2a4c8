"""Burrows-Wheeler transforms of string collections, and their merge by interleave refinement.

Symbols are byte + 1 (UTF-8 has no byte 255); 0 ends a string, and the ends are ordered as the strings are.
"""

from __future__ import annotations

import numpy as np


def transform(strings: list[bytes]) -> np.ndarray:
    """The transform of one shard's strings: the symbol before every suffix, in suffix order (0 before a whole string)."""
    sizes = np.array([len(s) for s in strings], np.int64)
    width = int(sizes.max(initial=0)) + 1
    flat = np.zeros((len(strings), width), np.uint8)
    inside = np.arange(width) < sizes[:, None]
    flat[inside] = np.frombuffer(b"".join(strings), np.uint8) + 1
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    padded = np.concatenate([flat.ravel(), np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)
    suffixes = np.ascontiguousarray(rows[owner * width + offset])
    suffixes[np.arange(width) > (sizes[owner] - offset)[:, None]] = 0
    order = np.argsort(suffixes.view(f"S{width}").ravel(), kind="stable")
    before = flat[owner[order], offset[order] - 1]
    before[offset[order] == 0] = 0
    return before


def ranks(before: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each offset from the end (0: the end itself), the rank of that suffix of every string (-1: the string is shorter),
    found by walking the transform back from the ends."""
    step = _step(before)
    at, out = np.arange(len(sizes)), []
    for k in range(int(sizes.max(initial=0)) + 1):
        out.append(np.where(k <= sizes, at, -1))
        at = np.where(k < sizes, step[at], 0)
    return out


def _step(before: np.ndarray) -> np.ndarray:
    """The row of each suffix that is one symbol longer."""
    step = np.empty(len(before), np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(len(before))
    return step


def merge(shards: list[np.ndarray], ends: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes after refinement to ``depth`` symbols, and the block of each: suffixes in one block share their
    first ``depth`` symbols. ``ends``: strings of each shard.

    A round takes the shards' symbols in the present interleave and deals them out stably by symbol, which orders the suffixes by one
    symbol more; a common prefix is as long as the rounds that two neighbours stayed in one block. Two rounds are done as one, by pairs of a symbol and
    the one before it: what the first of them puts at the strings' ends is known, as ends keep the order of the strings."""
    n, n_ends = sum(map(len, shards)), sum(ends)
    names = np.arange(len(shards), dtype=np.min_scalar_type(len(shards)))  # 8 bits where they do: the sort goes by digits
    source, closing = np.repeat(names, [len(s) for s in shards]), np.repeat(names, ends)
    small = np.int32 if n + n_ends < 1 << 31 else np.int64
    one = np.concatenate(shards)
    two = np.concatenate([s[_step(s)] for s in shards]).astype(np.uint16) << np.uint16(8) | one
    after_end = np.concatenate([s[:e] for s, e in zip(shards, ends)]).astype(np.uint16) << np.uint16(8)
    block, other_block, other_source, new = np.zeros(n, small), np.empty(n, small), np.empty_like(source), np.ones(n, bool)
    end_blocks = np.arange(n, n + n_ends, dtype=small)

    def first_places(keys: np.ndarray) -> np.ndarray:
        """Keys come in the same numbers every round, so the first place of each is known."""
        found = np.cumsum(np.bincount(keys))[:-1]
        return found[found < n]

    single, paired = first_places(one), first_places(np.concatenate([two[one > 0], after_end]))
    for pair in [True] * (depth // 2) + [False] * (depth % 2):
        current = np.empty(n, np.uint16 if pair else np.uint8)
        current[np.argsort(source, kind="stable")] = two if pair else one
        if pair:  # after one symbol, whole strings stand at the ends
            whole = np.flatnonzero(current & np.uint16(0xFF) == 0)
            current[whole], source[whole], block[whole] = after_end, closing, end_blocks
        dealt = np.argsort(current, kind="stable")
        np.take(source, dealt, out=other_source, mode="clip")
        source, other_source = other_source, source
        source[:n_ends] = closing
        np.take(block, dealt, out=other_block, mode="clip")
        np.not_equal(other_block[1:], other_block[:-1], out=new[1:])
        new[paired if pair else single] = True
        new[: n_ends + 1] = True
        np.cumsum(new, out=block)
        block -= 1
        if block[-1] == n - 1:
            break
    return source, block
