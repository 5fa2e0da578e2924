"""Hashed character n-grams over letters, as numpy arrays; used by the language and quality operators."""

from __future__ import annotations

import numpy as np

_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once a process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letter_line(text: str) -> np.ndarray:
    """Lowered letters as code points, each gap between words one 0, with a 0 at both ends; empty: no letter."""
    codes = codes_of(text.lower())
    is_letter = letters()[codes]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    keep = is_letter | np.r_[False, is_letter[:-1]]
    line = np.where(is_letter, codes, 0)[keep].astype(np.uint64)
    return np.r_[line[:0], np.zeros(1, np.uint64), line, np.zeros(1 if line[-1] else 0, np.uint64)]


def hashes(line: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """64-bit hashes of all n-grams of the line of the given sizes, but those with a gap inside."""
    out = []
    for n in sizes:
        if len(line) < n:
            continue
        h = np.full(len(line) - n + 1, n, np.uint64)
        gap = np.zeros(len(h), bool)
        for i in range(n):
            part = line[i : i + len(h)]
            h = h + (part + np.uint64(1)) * _PRIMES[i] * np.uint64(2 * i + 1)
            h = h ^ (h >> np.uint64(31))
            if 0 < i < n - 1:
                gap |= part == 0
        out.append(mixed(h[~gap]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
