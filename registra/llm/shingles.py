"""Word shingles as sorted arrays of 64-bit hashes, computed with array arithmetic over one stretch of a text after another."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np

#: Fixed value: an odd multiplier with well mixed bits (2^64 / golden ratio).
BASE = 0x9E3779B97F4A7C15
#: Bytes with A-Z folded and \x09-\x0D as blanks.
FOLD = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words whose shingles are hashed at once, and bytes of a word beyond which its digest stands for it: both bound the memory of a stretch.
STRETCH = 1 << 14
LONG_WORD = 256


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < size."""
    out = []
    for step in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(size, step, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(p))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all bits (the public 64-bit finaliser of MurmurHash3, whose constants are fixed values)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def flat_words(text: str | None) -> bytes:
    """The folded words of a text with one blank between them; a very long word is its digest after a zero byte."""
    flat = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).strip(b" ")
    if b"  " in flat:
        flat = re.sub(rb" {2,}", b" ", flat)
    if re.search(rb"[^ ]{%d}" % LONG_WORD, flat):
        flat = re.sub(rb"[^ ]{%d,}" % LONG_WORD, lambda m: b"\0" + hashlib.blake2b(m[0], digest_size=16).hexdigest().encode(), flat)
    return flat


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """The distinct hashes of a text's n-word shingles, ascending; of a shorter text, that of all its words; without words, none."""
    flat = flat_words(text)
    if not flat:
        return np.empty(0, np.uint64)
    data = np.frombuffer(flat, np.uint8)
    gaps = np.flatnonzero(data == 32)
    words = len(gaps) + 1
    n = min(n, words)
    found = []
    for first in range(0, words - n + 1, STRETCH):
        last = min(first + STRETCH, words - n + 1) + n - 2  # the last word of the stretch
        begin, end = int(gaps[first - 1]) + 1 if first else 0, int(gaps[last]) if last < words - 1 else len(data)
        inner = gaps[first:last] - begin
        found.append(hashed(data[begin:end], inner, n))
    return np.unique(np.concatenate(found)) if len(found) > 1 else np.unique(found[0])


def hashed(data: np.ndarray, gaps: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n-word shingle of a stretch, ``gaps`` being where its blanks are."""
    up, down = powers(1 << max(16, len(data).bit_length()))
    with np.errstate(over="ignore"):
        upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=upto[1:])
        start, end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
        start, end = start[: len(start) - n + 1], end[n - 1 :]
        # Shifted back to position 0, equal words give equal sums wherever they stand.
        return mixed((upto[end] - upto[start]) * down[start])


def set_digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
