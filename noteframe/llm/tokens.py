"""Words of many texts at once, as arrays: where they are and 64-bit hashes of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_random = np.random.default_rng(20240101)
#: One odd random number for each byte value, and the odd base of the hash with its inverse modulo 2**64.
BYTE = _random.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)

#: Bytes of words, where words are runs of letters and digits (all bytes beyond ASCII count as letters).
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Bytes of words, where words are split at ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n at least; kept, and doubled when too short."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """p with p[i] the sum of BYTE[data[j]] * BASE**j over j < i; span_hashes gives hashes of substrings from it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal for equal bytes, wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(INVERSE, len(prefix))[starts] + (ends - starts).astype(np.uint64))


class Group:
    """Some texts' bytes end to end, each followed by a space, and the words in them."""

    def __init__(self, texts: list[bytes], letters: np.ndarray):
        self.data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        self.bytes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.bytes + 1) - self.bytes - 1
        inside = letters[self.data]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.prefix = prefix_hashes(self.data)
        self.words = span_hashes(self.prefix, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.begin)  # number of the first word of each text
        self.count = np.diff(self.first, append=len(self.starts))
        self.owner = np.repeat(np.arange(len(texts)), self.count)

    def combined(self, offsets: list[int], salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words at which the span of `offsets` lies within one text, and a hash of the words at the offsets."""
        at, hashes = combined(self.words, offsets, salt)
        within = np.flatnonzero(self.owner[at] == self.owner[at + offsets[-1]])
        return at[within], hashes[within]


def combined(words: np.ndarray, offsets: list[int], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sequence of words at which the span of `offsets` fits, and a hash of the words at the offsets."""
    n = len(words) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(n, salt, np.uint64)
    for k, o in enumerate(offsets):
        total += words[o : n + o] * powers(BASE, 64)[k + 1]
    return np.arange(n), mix(total)


def groups(batch: pa.RecordBatch, size: int, column: str = "text"):
    """The batch cut into slices of about `size` bytes of text; a longer text is alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    number = np.cumsum(lengths) // size
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(lengths)), strict=True):
        yield batch.slice(int(a), int(b - a))
    pa.default_memory_pool().release_unused()  # workers stay, and what they don't use others need
