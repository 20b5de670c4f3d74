"""Splitting texts into pre-tokens with numpy, and encoding each distinct pre-token once.

The byte-level and the word tokenizer files split a text into runs of letters, of digits, of
white space and of anything else before they merge pairs.  The runs are found here from one
class per character; the tokenizers library then encodes every distinct pre-token once per
worker and a bounded cache keeps the ids.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from array import array

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
CACHE_PIECES = 600_000  # pre-tokens that a worker keeps
#: Unicode's white space.
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: printable ones stay, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    category = unicodedata.category
    major = {"L": LETTER, "N": NUMBER}
    for i in range(sys.maxunicode + 1):
        out[i] = major.get(category(chr(i))[0], OTHER)
    out[SPACES] = SPACE
    # letters and digits younger than this Python's tables: the library itself says which it knows
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    for m in regex.finditer(r"[\p{L}\p{N}]", "".join(chr(i) for i in np.flatnonzero(out == OTHER) if not 0xD800 <= i < 0xE000)):
        ends = [b for _, (_, b) in split(f"a{m[0]}1")]
        out[ord(m[0])] = LETTER if ends == [2, 3] else NUMBER if ends == [1, 3] else OTHER
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _contractions(points: np.ndarray, may_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of 's 't 'm 'd 're 've 'll where a match can start at the apostrophe."""
    at = np.flatnonzero((points == 39) & may_start)
    at = at[at + 1 < len(points)]
    if not len(at):
        return at, at
    one = points[at + 1]
    two = points[np.minimum(at + 2, len(points) - 1)]
    two = np.where(at + 2 < len(points), two, 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
    keep = short | long
    return at[keep], (at + np.where(short, 2, 3))[keep]


def byte_level_bounds(text: str) -> np.ndarray:
    """Offsets at which the pre-tokens of the byte-level file start, and the text's length."""
    n = len(text)
    if not n:
        return np.zeros(1, np.int64)
    points = code_points(text)
    kind = classes()[points]
    space = kind == SPACE
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    blank = points == 32
    # a blank before a word belongs to the word; the last of several white-space characters stands alone
    last = space.copy()
    last[:-1] &= ~space[1:]
    last[-1] = False
    start |= last
    follows = np.zeros(n, bool)
    follows[1:] = blank[:-1] & ~space[1:]
    start &= ~follows
    if "'" in text:
        may = np.ones(n, bool)
        may[1:] = (kind[:-1] != OTHER) & ~blank[:-1]
        a, b = _contractions(points, may)
        start[a] = True
        for k in (1, 2):
            inside = a + k
            start[inside[inside < b]] = False
        start[b[b < n]] = True
        # a word's letters may go on right after the contraction; a blank run keeps its own rule
        after = b[b < n]
        start[after] = True
    return np.append(np.flatnonzero(start), n)


def byte_level_pieces(text: str) -> list[str]:
    bounds = byte_level_bounds(text).tolist()
    return [text[a:b] for a, b in zip(bounds, bounds[1:])]


@functools.lru_cache(maxsize=1)
def newer_letters() -> tuple[dict[int, str], int, np.ndarray]:
    """The characters that this Python's tables normalize otherwise than the library (younger scripts), the first of
    them, and which code points they are.  Case is only in the first two planes."""
    from tokenizers import normalizers

    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000 and c != 10]
    theirs = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str("\n".join(every)).split("\n")
    own = "\n".join(every)
    own = unicodedata.normalize("NFC", own).replace("Σ", "σ").lower().split("\n")
    table = {ord(c): t for c, t, o in zip(every, theirs, own) if t != o}
    among = np.zeros(sys.maxunicode + 1, bool)
    among[list(table)] = True
    return table, min(table, default=sys.maxunicode + 1), among


def word_normal(text: str) -> str:
    """NFC and lower case, character by character, as the word file's normalizer has it."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        table, first, among = newer_letters()
        points = code_points(text)
        text = text.translate(table) if points.max() >= first and among[points].any() else text
    return text.lower()


def word_pieces(text: str) -> list[str]:
    """Pre-tokens of the word file: letters, single digits, runs of the rest, no white space."""
    text = word_normal(text)
    n = len(text)
    if not n:
        return []
    points = code_points(text)
    kind = classes()[points]
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    if "'" in text:
        may = np.ones(n, bool)
        may[1:] = kind[:-1] != OTHER
        a, b = _contractions(points, may)
        start[a] = True
        for k in (1, 2):
            inside = a + k
            start[inside[inside < b]] = False
        start[b[b < n]] = True
    at = np.flatnonzero(start)
    keep = kind[at] != SPACE
    ends = np.append(at[1:], n)
    return [text[x:y] for x, y in zip(at[keep].tolist(), ends[keep].tolist())]


class Pieces(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers, worked out when first asked for."""

    def __init__(self, merge):
        self.merge, self.letters = merge, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", [t.id for t in self.merge(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts; each distinct pre-token is encoded once while it is cached.

    path: a tokenizer file.  kind: "byte" or "word", the way that file splits texts.  Special
    tokens' strings inside a text become the special token, which is the library's default.
    """

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = {"byte": byte_level_pieces, "word": word_pieces}[kind]
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cache = Pieces(self.tokenizer.model.tokenize)

    def segments(self, text: str) -> list[tuple[bool, str]]:
        """(is special token, string) in the text's order."""
        found = [s for s in self.special if s in text]
        parts = [(False, text)]
        for s in found:
            cut = []
            for special, part in parts:
                if special:
                    cut.append((True, part))
                    continue
                for k, x in enumerate(part.split(s)):
                    if k:
                        cut.append((True, s))
                    if x:
                        cut.append((False, x))
            parts = cut
        return parts

    def count(self, piece: str) -> int:
        """How many pieces a pre-token has; nothing is kept."""
        return len(self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(byte_letters())))

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        coded = self.cache.__getitem__
        if "<|" not in text:
            return b"".join(map(coded, self.split(text)))
        out = []
        for special, part in self.segments(text):
            out += [array("I", [self.special[part]]).tobytes()] if special else map(coded, self.split(part))
        return b"".join(out)


@functools.lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path, kind)
