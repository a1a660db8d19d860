"""Words and rolling word hashes of Arrow text batches, as numpy arrays.

Words are maximal runs of bytes outside the ASCII white space
``[\\x20\\x09-\\x0D]``; as that set is ASCII, byte runs are code-point runs in
UTF-8. A word's hash takes its bytes eight at a time through a 64-bit mixer, all
words of a batch at once; a word of more than LONG_WORD bytes is hashed by
BLAKE2b. An n-gram's hash is a prefix-sum polynomial modulo 2**64 over its
words' hashes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SEEDS = (U(0x6A09E667F3BCC909), U(0xBB67AE8584CAA73B))
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
LONG_WORD = 512
KEPT_POWERS = 1 << 18
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (splitmix)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, U)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        held = (made[0], made[1])
        if size <= KEPT_POWERS:
            _POWERS[base] = held
    return held


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * _powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def _ranges(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    inverse = _powers(base, len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U))


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges; ``which`` names one of two independent functions."""
    sizes = ends - starts
    h = mix(sizes.astype(U) ^ _SEEDS[which])
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    alive = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
    done = 0
    while len(alive):
        take = eight[starts[alive] + done] & _LOW_BYTES[np.minimum(sizes[alive] - done, 8)]
        h[alive] = mix((h[alive] ^ mix(take + _SEEDS[which])) + U(done + 1))
        done += 8
        alive = alive[sizes[alive] > done]
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[k]: ends[k]].tobytes(), digest_size=8, person=bytes([which])).digest()
        h[k] = U(int.from_bytes(digest, "little"))
    return h


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null(b"" if pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type) else "")
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    raw = text.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[text.offset: text.offset + len(text) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch: byte ranges, and per document the range of its words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # first[d]..first[d + 1] are the words of document d

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def range_hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        return byte_hashes(self.data, starts, ends, which)

    def hashes(self, which: int = 0) -> np.ndarray:
        return self.range_hashes(self.starts, self.ends, which)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray | None = None) -> Words:
    """Maximal runs of word bytes; ``is_word`` is a table of 256 flags (default: not white space)."""
    inside = (~SPACE if is_word is None else is_word)[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = True
        before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = True
        after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, size: int | np.ndarray, starts: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the ``size`` consecutive words from each start (ends must lie inside the array)."""
    base = _BASES[1 - which]
    return _ranges(_prefix(hashes, base), starts, starts + size, base)


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window of ``size`` words inside one document, and the documents' ranges in that list."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    ranges = np.concatenate(([0], np.cumsum(counts)))
    starts = np.arange(ranges[-1]) + np.repeat(first[:-1] - ranges[:-1], counts)
    return starts, ranges


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and the documents' ranges.

    A document with fewer words than ``size`` has its whole word sequence as
    its one shingle; one without words has none.
    """
    h = w.hashes()
    starts, ranges = window_starts(w.first, size)
    values = grams(h, size, starts)
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    whole = dict(zip(short.tolist(), grams(h, w.counts[short], w.first[short]), strict=True)) if len(short) else {}
    sets = []
    for d in range(len(w.first) - 1):
        if d in whole:
            sets.append(np.array([whole[d]], U))
            continue
        s = np.sort(values[ranges[d]: ranges[d + 1]])
        if len(s) > 1:
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        sets.append(s)
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, U)), np.concatenate(([0], np.cumsum(sizes)))
