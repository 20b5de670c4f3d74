"""Numbers and word features that the linear models read from a whole text."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

#: Byte classes: 0 lower, 1 upper, 2 digit, 3 blank, 4 newline, 5 usual punctuation, 6 other symbols, 7 beyond ASCII.
_CLASS = np.array([4 if c == 10 else 3 if c in (9, 11, 12, 13, 32) else 0 if 97 <= c < 123 else 1 if 65 <= c < 91 else 2 if 48 <= c < 58 else 7 if c > 127 else 5 if chr(c) in ".,;:?'-" else 6 for c in range(256)], np.uint8)
STATS = 24


def text_stats(text: str) -> np.ndarray:
    """STATS numbers between about 0 and 10 that say what a text looks like; an empty text's are 0."""
    b = text.encode("utf-8", "surrogatepass")
    out = np.zeros(STATS)
    if not b:
        return out
    a = np.frombuffer(b, np.uint8)
    n = len(b)
    out[:8] = np.bincount(_CLASS[a], minlength=8) / n
    words = b.split()
    lines = b.split(b"\n")
    if words:
        m = len(words)
        seen = Counter(words)
        top = seen.most_common(1)[0][1]
        size = np.fromiter(map(len, words), np.int64, m)
        ends = np.fromiter((w[-1] for w in words), np.uint8, m)
        heads = np.fromiter((w[0] for w in words), np.uint8, m)
        out[8:18] = (
            np.log1p(m) / 2,
            len(seen) / m,
            top / m,
            sum(map(bytes.__eq__, words, words[1:])) / m,
            size.mean() / 4,
            size.std() / 4,
            np.log1p(size.max()) / 2,
            (_CLASS[ends] == 6).mean(),
            (_CLASS[ends] == 5).mean(),
            (_CLASS[heads] == 1).mean(),
        )
        out[18] = (size == 1).mean()
        out[19] = len(seen) / (1 + m**0.8)
    out[20] = np.log1p(n) / 3
    out[21] = len(set(lines)) / len(lines)
    out[22] = np.log1p(n / len(lines)) / 3
    out[23] = (a[1:] == a[:-1]).mean() if n > 1 else 0
    return out


def word_features(text: str) -> set[int]:
    """Hashes of the text's words and of their first four and five letters, lower case."""
    words = set(text.lower().split())
    words = {w.strip(".,;:!?\"'()*") for w in words}
    found = words | {w[:4] + "\0" for w in words} | {w[:5] + "\1" for w in words}
    return {zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in found}


def expand(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Standardised numbers, clipped, with their squares and hinges: what a linear model is fitted on."""
    z = np.clip((x - mean) / std, -6, 6)
    return np.concatenate((np.ones((len(z), 1)), z, z**2 / 4, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)), axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
