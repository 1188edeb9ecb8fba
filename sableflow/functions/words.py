"""Words and word runs of whole batches of texts as hashes, without a Python loop over words.

A word is a maximal run of letters, digits and combining marks, case ignored; each Chinese character, kana or kanji is
a word by itself. The hashes depend on nothing but the characters, so they agree between runs, workers and machines.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_TOP = 0x33480


def is_single(o: int) -> bool:
    """Chinese characters, kana and kanji."""
    return 0x3400 <= o <= 0x4DBF or 0x4E00 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0x20000 <= o < _TOP or 0x3041 <= o <= 0x30FF and o != 0x30FB or 0x31F0 <= o <= 0x31FF or 0xFF66 <= o <= 0xFF9D or o in (0x3005, 0x3006, 0x3007)


@cache
def classes() -> np.ndarray:
    """By code point: 0 no word, 1 part of a word, 2 a word by itself."""
    out = np.zeros(0x110000, np.uint8)
    for o in range(0x30000):
        c = unicodedata.category(chr(o))
        if c[0] in "LM" or c == "Nd":
            out[o] = 1
            if c[0] == "L" and is_single(o):
                out[o] = 2
    out[0x3007] = 2
    out[0x30000:_TOP] = 2
    return out


@cache
def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log2
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, p, np.uint64)]) for p in (_P, _P_INV))


def mix64(x: np.ndarray) -> np.ndarray:
    """A public finaliser of 64-bit integers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: hash, number of the text, first and last+1 character in the joined lower-cased texts of each word."""
    lowered = [t.lower() for t in texts]
    codes = code_points("\n".join(lowered) + "\n")
    cls = classes()[codes]
    part, single = cls == 1, cls == 2
    before = np.r_[False, part[:-1]]
    first = np.flatnonzero(part & ~before | single)
    after = np.r_[part[1:], False]
    last = np.flatnonzero(part & ~after | single) + 1
    powers, inverse = _powers(max(20, int(len(codes)).bit_length()))
    total = np.r_[np.uint64(0), np.cumsum(codes.astype(np.uint64) * powers[: len(codes)])]
    h = mix64((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in lowered])
    return h, np.searchsorted(ends, first, "right"), first, last


_MULT = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def run_hashes(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of n consecutive words."""
    m = len(h) - n + 1
    if m <= 0:
        return h[:0], owner[:0]
    x = np.zeros(m, np.uint64)
    for i in range(n):
        x += (h[i : i + m] ^ np.uint64(_MULT[-1 - i % 5])) * np.uint64(_MULT[i % 5] + 2 * (i // 5))
    own = owner[:m] == owner[n - 1 :]
    return mix64(x[own]), owner[:m][own]


def chunks(texts: list[str], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Cuts a batch into slices of about `most` characters; a longer text makes a slice of its own."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            out.append((start, i))
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        out.append((start, len(texts)))
    return out
