"""Vectorised words and word hashes over blocks of whole texts (numpy, used inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multiplier of the polynomial over bytes; its powers have inverses modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_powers: dict[str, np.ndarray] = {}

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _separating(drop: set[int], lower: bool) -> bytes:
    return bytes(32 if c in drop else (_LOWER[c] if lower else c) for c in range(256))


#: Lower-case A-Z; words are runs of [0-9a-z] and of anything beyond ASCII.
ALNUM = _separating({c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122 or 65 <= c <= 90)}, True)
#: Lower-case A-Z; words are what white space (space, tab to carriage return) separates.
SPACED = _separating({32, *range(9, 14)}, True)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of h."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up), np.cumprod(down)
    return _powers["up"][:n], _powers["down"][:n]


def blocks(texts: list, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about `size` bytes as UTF-8, each with the index of its first text; null counts as empty."""
    run: list[bytes] = []
    first = held = 0
    for i, text in enumerate(texts):
        run.append(b"" if text is None else text.encode())
        held += len(run[-1]) + 1
        if held >= size or len(run) >= 2048:
            yield first, run
            run, first, held = [], i + 1, 0
    if run:
        yield first, run


class Words:
    """The words of a block: `lo`/`hi` byte offsets in `data`, `at[i]:at[i+1]` the words of text i, `hash` per word."""

    def __init__(self, raw: list[bytes], table: bytes):
        self.data = (b"\n".join(raw) + b"\n").translate(table)
        arr = np.frombuffer(self.data, np.uint8)
        edge = np.flatnonzero(np.diff((arr != 32).view(np.int8), prepend=np.int8(0)))
        self.lo, self.hi = edge[0::2], edge[1::2]
        ends = np.cumsum([len(x) + 1 for x in raw])
        self.at = np.concatenate([[0], np.searchsorted(self.lo, ends)])
        up, down = _tables(len(arr))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((arr.astype(np.uint64) + _U(1)) * up)])
        self.hash = mix((sums[self.hi] - sums[self.lo]) * down[self.lo] + (self.hi - self.lo).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.lo)

    def word(self, i: int) -> bytes:
        return self.data[self.lo[i] : self.hi[i]]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k-1 positions have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    weight = mix(np.arange(1, k + 1, dtype=np.uint64)) | _U(1)  # unrelated odd weights, so that order counts
    for j in range(k):
        total += h[j : j + n] * weight[j]
    return mix(total + _U(k))
