"""Words and spans of texts, shared by the operators of this package."""

from __future__ import annotations

import hashlib
import re

import numpy as np

_WORD = re.compile(r"\w+")
_ASCII = "".join(chr(i) if chr(i).isalnum() or chr(i) == "_" else " " for i in range(128))
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores; [] for a missing text."""
    if not text:
        return []
    low = text.lower()
    if low.isascii():  # the same words, found faster
        return low.translate(_ASCII).split()
    return _WORD.findall(low)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word, remembered between texts up to a bound."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value

    def of(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))


def shingles(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; a shorter text is one run."""
    n = len(hashed)
    if n == 0:
        return hashed
    size = min(size, n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for i in range(size):
        out = mix(out * _MULTIPLY + hashed[i:n - size + 1 + i])
    return out


def join_spans(spans: list[tuple[int, int, str, int]]) -> str:
    """kind:start:end by start, then order of kinds; spans are (start, order, kind, end)."""
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def free_name(df, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
