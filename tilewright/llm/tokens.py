"""Words and n-grams of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Of each byte, whether it belongs to a word: all but ASCII white space.
SOLID = np.array([c not in b" \t\n\x0b\x0c\r" for c in range(256)])
#: Of each byte of a lower-cased text, whether it is an ASCII letter or digit or part of a character beyond ASCII.
LETTER = np.array([48 <= c <= 57 or 97 <= c <= 122 or c > 127 for c in range(256)])
#: Characters of scripts written without spaces (Thai, Lao, Burmese, Khmer, Chinese, Japanese) and their punctuation.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3000-\u30ff\u3100-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff0f\uff1a-\uff20\uff61-\uff9f\U00020000-\U0003ffff])")
_POWERS: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    out = h >> np.uint64(30)
    out ^= h
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        base = 0x9E3779B97F4A7C15
        size = max(n, 1 << 19)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)])) for x in (np.uint64(base), np.uint64(pow(base, -1, 1 << 64)))]
    return _POWERS[0][:n], _POWERS[1][:n]


def lowered(text: str) -> bytes:
    """A text in lower case, with spaces around each character of scripts that have none: each is a word."""
    raw = (low := text.lower()).encode("utf-8", "surrogatepass")
    if raw.isascii() or np.frombuffer(raw, np.uint8).max(initial=0) < 0xE0:  # nothing from U+0800 on
        return raw
    return _UNSPACED.sub(r" \1 ", low).encode("utf-8", "surrogatepass")


class Words:
    """The words of a list of byte strings: hash (64 bits) of each, and starts, where each string's words begin (one more at the end).

    All strings are laid one after the other. Words are found by comparing neighbouring bytes, and hashed as differences of a running sum of
    bytes times powers of an odd number, so no word is touched by itself.
    """

    def __init__(self, raw: list[bytes], inside: np.ndarray = SOLID):
        buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        edge = np.empty(len(buf) + 1, bool)
        solid = inside[buf]
        edge[0], edge[-1] = len(solid) and solid[0], len(solid) and solid[-1]
        np.not_equal(solid[1:], solid[:-1], out=edge[1:-1])
        edges = np.flatnonzero(edge)
        self.first, last = edges[::2], edges[1::2]  # bytes
        up, down = powers(len(buf) + 1)
        total = np.empty(len(buf) + 1, np.uint64)
        total[0] = 0
        value = buf.astype(np.uint64)
        value += np.uint64(1)
        value *= up[:-1]
        np.cumsum(value, out=total[1:])
        h = total[last]
        h -= total[self.first]
        h *= down[self.first]
        h += (last - self.first).astype(np.uint64)
        self.hash, self.buf = mixed(h), buf
        size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        self.text_at = np.concatenate([[0], np.cumsum(size)])  # bytes
        self.starts = np.searchsorted(self.first, self.text_at)


def owners(starts: np.ndarray) -> np.ndarray:
    """For runs between starts (one more at the end), the run of each item."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def grams_of(words: np.ndarray, starts: np.ndarray, n: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words of each run between starts, and where each run's windows begin. whole: of a shorter run that has a
    word, one window of all its words, with its number of words in the hash."""
    size = np.diff(starts)
    h = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        h *= MIX
        h += words[i : len(words) - n + 1 + i] if len(h) else h
    h = mixed(h)
    count = np.maximum(size - n + 1, 0)
    if whole:
        count = np.where((size > 0) & (size < n), 1, count)
    at = np.concatenate([[0], np.cumsum(count)])
    use = np.ones(len(h), bool)
    # windows that reach over the end of a run
    ends = starts[1:-1]
    for i in range(1, n):
        over = ends - i
        over = over[(over >= 0) & (over < len(h))]
        use[over] = False
    if not whole:
        return h[use], at
    out = np.empty(at[-1], np.uint64)
    short = np.flatnonzero((size > 0) & (size < n))
    mask = np.zeros(at[-1], bool)
    mask[at[short]] = True
    out[~mask] = h[use]
    for i in short.tolist():
        g = np.uint64(0)
        with np.errstate(over="ignore"):
            for w in words[starts[i] : starts[i + 1]]:
                g = g * MIX + w
            out[at[i]] = g + np.uint64(size[i])
    if len(short):
        out[at[short]] = mixed(out[at[short]] ^ MIX)
    return out, at


def occurrences(items: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Each owner's items (owners ascend), with the second, third ... of equal ones made different: multisets as sets, in the same places.

    Items of an owner count as equal if 40 bits of their hashes are, which is enough for sketches.
    """
    if not len(items):
        return items
    key = (owner.astype(np.uint64) << np.uint64(40)) | (items >> np.uint64(24))
    order = np.argsort(key)
    key = key[order]
    same = np.concatenate([[False], key[1:] == key[:-1]])
    more = np.flatnonzero(same)
    if not len(more):
        return items
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(key))))
    out = items.copy()
    out[order[more]] = mixed(items[order[more]] + (more - head[more]).astype(np.uint64) * MIX)
    return out
