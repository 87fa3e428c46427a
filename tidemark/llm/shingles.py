"""Word shingles of many texts at once, hashed with numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8, person=b"shingle").digest() for i in range(256)), "<u8").copy()
#: Texts are hashed in chunks of about so many bytes; temporaries take some 60 bytes for each.
CHUNK = 1 << 18
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1, modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


class _Line:
    """Words joined by single spaces: any run of them is hashed from running sums over the bytes, so it is never built."""

    def __init__(self, words: list[bytes]):
        raw = np.frombuffer(b" ".join(words), np.uint8)
        gaps = np.flatnonzero(raw == 32)
        self.starts, self.ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * _power(_BASE, len(raw)), out=self.sums[1:])
        self.back = _power(_INVERSE, len(raw))

    def runs(self, first: int, n: int, width: int) -> np.ndarray:
        """Hashes of all runs of `width` words among the n words from `first` on."""
        a, b = self.starts[first : first + n - width + 1], self.ends[first + width - 1 : first + n]
        return mixed((self.sums[b] - self.sums[a]) * self.back[a])


def _runs(texts: list[str | None], width: int, chunk: int) -> Iterator[np.ndarray]:
    """For every text the hashes of its runs of `width` words, in order; a text of fewer words gives the hash of all of them, if any.

    Words are what ASCII white space separates, with A-Z lower-cased.
    """
    at = 0
    while at < len(texts):
        words: list[bytes] = []
        counts: list[int] = []
        size = 0
        while at < len(texts) and (not counts or size + len(texts[at] or "") <= chunk):
            own = (texts[at] or "").encode("utf-8", "surrogatepass").lower().split()
            size += len(texts[at] or "")
            words += own
            counts.append(len(own))
            at += 1
        if size > chunk and len(words) > width:  # one long text: piece by piece
            step = max(width, chunk * len(words) // size)
            parts = [words[a : a + step + width - 1] for a in range(0, len(words) - width + 1, step)]
            yield np.concatenate([_Line(part).runs(0, len(part), width) for part in parts])
            continue
        line, first = _Line(words) if words else None, 0
        for n in counts:
            yield line.runs(first, n, min(width, n)) if n else np.empty(0, np.uint64)
            first += n


def shingle_sets(texts: list[str | None], width: int = 5, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """For every text the sorted distinct hashes of its `width`-word shingles; none for null, empty and blank texts."""
    return map(np.unique, _runs(texts, width, chunk))


def signature(hashes: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For every text the hashes of its words in order; none for null and blank texts."""
    return _runs(texts, 1, CHUNK)
