"""Simple-8b: integers in 64-bit words whose top four bits say how many values of which width follow.

encode() packs greedily.  Selector 0 is the escape: the next word holds one raw 64-bit value.  A
block is at most BLOCK values and starts at a word of its own, so any block decodes alone;
decode() unpacks all words of one selector at once.  Empty input gives no words.
"""

from __future__ import annotations

import functools

import numpy as np

BLOCK = 4096
#: Fixed values of the format: (values a word, bits a value) of selectors 1 to 14.
PACKED = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]


def blocks_of(lengths: np.ndarray) -> np.ndarray:
    """Sizes of the blocks of documents of these lengths: each document starts one."""
    lengths = np.asarray(lengths, np.int64)
    n = -(-lengths // BLOCK)
    sizes = np.full(int(n.sum()), BLOCK, np.int64)
    some = n > 0
    sizes[np.cumsum(n)[some] - 1] = lengths[some] - (n[some] - 1) * BLOCK
    return sizes


#: The widths that words can hold, ascending; PAD zeros after a block let its last word be filled up.
WIDTHS = sorted(b for _, b in PACKED)
LIMITS = np.array([1 << b for b in WIDTHS], np.uint64)
PAD = 60


@functools.lru_cache(maxsize=1)
def _narrow() -> np.ndarray:
    """How many of WIDTHS are too narrow for each value of up to 20 bits."""
    return np.searchsorted(LIMITS, np.arange(1 << 20, dtype=np.uint64), "right").astype(np.uint8)


def _most(x: np.ndarray) -> dict[int, np.ndarray]:
    """Maximum of each `count` values from every place on, for every count of PACKED."""
    out = {1: x}

    def join(count: int, a: int, b: int) -> None:
        # what follows the end counts as zero
        out[count] = out[a].copy()
        np.maximum(out[count][:-a], out[b][a:], out=out[count][:-a])

    for count, a, b in ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 7), (20, 10, 10), (30, 15, 15), (60, 30, 30)):
        join(count, a, b)
    return out


def encode(values: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the word at which each block of the given sizes starts (one block by default)."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    sizes = np.array([n] if sizes is None else sizes, np.int64)
    sizes = sizes[sizes > 0]
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # blocks are laid out with zeros between them, so no word sees the next block
    firsts = np.cumsum(sizes + PAD) - sizes - PAD
    total = int(firsts[-1] + sizes[-1]) + PAD
    padded = np.zeros(total, np.uint64)
    place = np.arange(n) + np.repeat(np.arange(len(sizes)) * PAD, sizes)
    padded[place] = v
    need = np.zeros(total, np.uint8)  # how many of WIDTHS are too narrow
    need[place] = _narrow()[v.astype(np.intp)] if int(v.max()) < 1 << 20 else np.searchsorted(LIMITS, v, "right")
    most = _most(need)
    # a later selector takes fewer and wider values, so what fits one fits all later ones
    best = np.ones(total, np.uint8)  # the selector that takes most values from here; 0: escape
    for count, bits in PACKED:
        best += most[count] > WIDTHS.index(bits)
    best[best > len(PACKED)] = 0
    step, codes, at = [1, *(c for c, _ in PACKED)], best.tobytes(), []
    for i, end in zip(firsts.tolist(), (firsts + sizes).tolist()):
        while i < end:
            at.append(i)
            i += step[codes[i]]
    at = np.array(at)
    chosen = best[at]
    escapes = np.cumsum(chosen == 0)
    place = np.arange(len(at)) + escapes - (chosen == 0)
    words = np.zeros(len(at) + int(escapes[-1]), np.uint64)
    for s in np.unique(chosen):
        here = chosen == s
        where = at[here]
        if not s:
            words[place[here] + 1] = padded[where]
            continue
        count, bits = PACKED[s - 1]
        word = np.full(len(where), int(s) << 60, np.uint64)
        for k in range(count):
            word |= padded[where + k] << np.uint64(bits * k)
        words[place[here]] = word
    return words, place[np.searchsorted(at, firsts)]


def decode(words: np.ndarray, sizes: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """All values of the blocks of these sizes; starts: the word at which each block starts."""
    words = np.ascontiguousarray(words, np.uint64)
    sizes = np.asarray(sizes, np.int64)
    sizes = sizes[sizes > 0]
    starts = np.zeros(1, np.int64) if starts is None else np.asarray(starts, np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(sel == 0).tolist():  # the word after an escape is a value, whatever its top bits
        if not raw[i]:
            raw[i + 1] = True
    counts = np.array([1, *(c for c, _ in PACKED), 0])[sel]
    counts[raw] = 0
    before = np.cumsum(counts) - counts
    spans = np.diff(np.append(starts, len(words)))
    first = np.cumsum(sizes) - sizes
    at = before - np.repeat(before[starts], spans) + np.repeat(first, spans)  # where each word's values go
    end = np.repeat(first + sizes, spans)
    out = np.zeros(total, np.uint64)
    for s in np.unique(sel[~raw]):
        here = np.flatnonzero((sel == s) & ~raw)
        if not s:
            out[at[here]] = words[here + 1]
            continue
        count, bits = PACKED[s - 1]
        mask, word, base, room = np.uint64((1 << bits) - 1), words[here], at[here], end[here] - at[here]
        whole = int(room.min())
        for k in range(count):
            values = (word >> np.uint64(bits * k)) & mask
            if k < whole:
                out[base + k] = values
            else:  # only the last word of a block is not full
                ok = room > k
                out[base[ok] + k] = values[ok]
    return out
