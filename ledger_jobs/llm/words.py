"""Words of many texts at once, as numpy arrays of positions and hashes.

A word is a run of bytes that are not white space (space, tab to carriage return); words never
cross from one text into the next.  Hashes take eight bytes of a word at a time and end with an
avalanche step; they do not depend on the process, the task or the order of rows.  Two lanes with
different constants give 128 bits.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa

from ledger_jobs.llm.common import text_bytes

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
U = np.uint64


#: Longer words are left to blake2b, a word at a time.
LONG_WORD = 1 << 12
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


@cache
def _odd(lane: int) -> tuple[np.uint64, np.uint64]:
    rng = np.random.default_rng(7919 + lane)
    one, two = rng.integers(0, 2**64, 2, dtype=np.uint64) | U(1)
    return one, two


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer: every bit of the input reaches every bit of the output."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words:
    """``start``/``end``: byte positions of each word; ``first``: index of each text's first word
    (one entry more than texts); ``raw``: the bytes the positions refer to."""

    def __init__(self, arr: pa.Array, lower: bool = False, space: np.ndarray = _SPACE):
        raw, offsets = text_bytes(arr)
        self.raw, self.offsets = (_LOWER[raw] if lower else raw), offsets
        solid = ~space[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(raw), bool)
        after = np.empty(len(raw), bool)
        if len(raw):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = solid[:-1], solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lane: int = 0, most: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first ``most`` bytes: eight bytes at a time."""
        first, second = _odd(lane)
        stop = self.end if most is None else np.minimum(self.end, self.start + most)
        left = stop - self.start
        h = left.astype(np.uint64) * first
        padded = np.concatenate((self.raw, np.zeros(8, np.uint8)))
        eight = np.ndarray((len(self.raw),), "<u8", padded.data, strides=(1,))
        at, k = np.arange(len(h)), 0
        while len(at):
            if 8 * k >= LONG_WORD:
                for i in at.tolist():
                    data = self.raw[self.start[i] : stop[i]].tobytes()
                    h[i] ^= U(int.from_bytes(hashlib.blake2b(data, digest_size=8, key=b"%d" % lane).digest(), "little"))
                break
            block = eight[self.start[at] + 8 * k] & _MASK[np.minimum(left[at] - 8 * k, 8)]
            h[at] = h[at] * second + (block ^ (block >> U(29))) * first
            h[at] ^= h[at] >> U(32)
            k += 1
            at = at[left[at] > 8 * k]
        return mix(h)


def by_row(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Order of the rows, and of the hashes inside each."""
    order = np.argsort(h)
    small = row[order].astype(np.uint16) if not len(row) or row.max() < 1 << 16 else row[order]
    return order[np.argsort(small, kind="stable")]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hash of the ``n`` words from each position; the last n-1 places are short.

    Built from powers of two, so that 20 words take five steps.
    """
    if len(h) < n:
        return np.zeros(0, np.uint64)
    base = U(0x9E3779B97F4A7C15) | U(1)
    out, have, width, power = None, 0, 1, base
    cur = h.copy()
    rest = n
    total = len(h) - n + 1
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                piece = cur[have : have + total]
                out = piece.copy() if out is None else out * power + piece
                have += width
            rest >>= 1
            if rest:
                cur = cur[: len(cur) - width] * power + cur[width:]
                width *= 2
                power = power * power
    return mix(out)
