"""Fuzzy line dedup: bands of normalised lines as blocks to join on, SimHash and edit similarity to verify, one occurrence per connected group.

SimHash blocks can't find lines at an edit similarity of 0.8: such lines differ in a fifth of their bits, so blocks that most of them share would be
a few bits long. The blocks are therefore MinHash bands over word pairs; SimHash (128 bits) prunes the pairs that meet in one.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import Scratch, bitmap_of, cut, in_bitmap, maybe_in, split_batch
from .graph import components, runs_of
from .packed import deal, parts_for, released, rounds_for, runs
from .tokens import LETTER, MIX, Words, lowered, mixed, occurrences, powers
from .shingles import plan_bands

WORDS64 = 2  # length of a SimHash in 64-bit words
BITS = 64 * WORDS64
#: Of each byte, its bits as eight lanes of a byte, so that words are counted eight bits at a time.
_LANES = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)).copy().view(np.uint64).ravel()
#: What is dealt out for a line and a band: the key, the line's hash, its SimHash and its number of words.
ENTRY = np.dtype([("k", "<u8"), ("id", "<i8"), ("sim", "<u8", (WORDS64,)), ("n", "<u2")])
LONGEST = (1 << 14) - 1  # numbers of words beyond are one
#: Set in n: the lines under this key are part of those of another one; the line leads such a part of this key's.
SPLIT, LED = np.uint16(1 << 15), np.uint16(1 << 14)
#: How keys with many lines are handled: lines of a key whose pairs are all looked at, near pairs per line from which a key is dense, lines of a key
#: that one batch passes on under it. Of keys beyond, lines meet their leaders, and then all lines that those didn't link.
LARGE, DENSE, PASSED = LIMITS = 16_384, 16, 2_048
#: Lines that are tried as a leader, and leaders of a key.
TRIED, LEADERS = 32, 32
#: What a pair is: a candidate; or a key (with itself) whose lines have to be compared as far as they aren't linked.
PAIR, AGAIN = 0, 2


class Lines:
    """The lines of some texts: text, number, words (n, and where they begin in words.hash) and hash of each."""

    def __init__(self, texts: list[str]):
        raw = [lowered(t) for t in texts]
        self.words = Words(raw, LETTER)
        ends = np.flatnonzero(self.words.buf == 10)
        self.starts = np.searchsorted(self.words.first, np.concatenate([[0], ends + 1]))
        self.n = np.diff(self.starts)
        up, down = powers(len(self.words.hash) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.words.hash * up[:-1])])
        self.starts, last = self.starts[:-1], self.starts[1:]
        self.hash = mixed((total[last] - total[self.starts]) * down[self.starts] + self.n.astype(np.uint64))
        per_text = np.diff(np.searchsorted(ends, self.words.text_at))
        self.text = np.repeat(np.arange(len(texts)), per_text)
        self.number = np.arange(len(ends)) - np.repeat(np.cumsum(per_text) - per_text, per_text)

    def words_of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word hashes of these lines, one after the other, and how many each has."""
        n = self.n[some]
        return self.words.hash[np.repeat(self.starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


class LineBands:
    """MinHash band keys of lines, planned for a recall at the edit similarity itself, whatever the number of lines.

    If d edits part two lines, the longer of n words, their multisets of word pairs (with a mark before the first and after the last word)
    share n + 1 - 2d at least, of n + 1 + 2d at most: at similarity s a Jaccard similarity of (2s - 1) / (3 - 2s) or more, wherever the
    edits fall. At s of a half or less single words do, with s / (2 - s). Lines so short that one edit takes them below s have no keys.
    """

    def __init__(self, up: int, down: int, recall: float, least_words: int, seed: int = 4):
        s = up / down
        self.pairs = 2 * up > down
        self.bands, self.rows = plan_bands((2 * s - 1) / (3 - 2 * s) if self.pairs else s / (2 - s), recall)
        self.least = max(1, least_words, -(-up // (down - up)) if down > up else 1 << 62)
        rng = np.random.default_rng(seed)
        self.mul, self.add = (rng.integers(0, 1 << 32, self.bands * self.rows, dtype=np.uint32) for _ in range(2))
        self.mul |= np.uint32(1)

    def keys(self, words: np.ndarray, n: np.ndarray) -> np.ndarray:
        """bands x lines keys (unsigned, 64 bits) of lines of n words each, which lie one after the other."""
        if self.pairs:
            owner = np.repeat(np.arange(len(n)), n)
            slot = np.arange(len(words)) + owner  # one more slot a line
            left, right = np.full(len(words) + len(n), 1, np.uint64), np.full(len(words) + len(n), 2, np.uint64)
            right[slot], left[slot + 1] = words, words
            left[np.cumsum(n + 1) - n - 1] = 1
            left *= MIX
            left += right
            words, n = mixed(left), n + 1
        items, starts = occurrences(words, np.repeat(np.arange(len(n)), n)), np.cumsum(n) - n
        x = (mixed(items) >> np.uint64(32)).astype(np.uint32)
        out, now, low = np.empty((self.bands, len(n)), np.uint64), np.empty_like(x), np.empty(len(n), np.uint32)
        for band in range(self.bands):
            key = np.full(len(n), band + 1, np.uint64)
            for j in range(band * self.rows, (band + 1) * self.rows):
                np.multiply(x, self.mul[j], out=now)
                now += self.add[j]
                np.minimum.reduceat(now, starts, out=low)
                key *= MIX
                key += low
            out[band] = mixed(key)
        return out


def simhashes(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A SimHash (WORDS64 words) of each of the runs of n word hashes, which lie one after the other."""
    starts = np.cumsum(n) - n
    pieces = -(-n // 255)  # a lane holds 255 at most
    parts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    whole = np.cumsum(pieces) - pieces
    out = np.empty((len(n), WORDS64), np.uint64)
    for j in range(WORDS64):
        raw = mixed(hashes * MIX + np.uint64(j + 1)).view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(_LANES[raw], parts, axis=0).view(np.uint8).reshape(len(parts), 64)
        if len(parts) > len(n):
            sums = np.add.reduceat(sums.astype(np.int32), whole, axis=0)
        out[:, j] = np.packbits(2 * sums.astype(np.int32) > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences, by bit vectors in whole numbers."""
    while a and b and a[0] == b[0] and a[-1] == b[-1]:
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        a, b = a[k:], b[k:]
        k = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
        a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b:
        return len(a) + len(b)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = full, 0, len(a)
    for y in b:
        eq = at.get(y, 0)
        v = eq | minus
        h = ((eq & plus) + plus ^ plus) | eq
        up, down = minus | ~(h | plus) & full, plus & h
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | ~(v | up) & full, up & v
    return score


def edit_distances(x: list[bytes], y: list[bytes], chunk: int = 1024) -> np.ndarray:
    """edit_distance() of each pair of lines (words by their 64-bit hashes), by bit vectors for many pairs at once.

    The shorter line of a pair stands in the bits, 64 words to a number; from one number to the next goes the step at its last row.
    """
    out = np.zeros(len(x), np.int64)
    sides = trimmed([(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(x, y)])
    p, q = (np.fromiter((len(s[i]) // 8 for s in sides), np.int64, len(sides)) for i in (0, 1))
    blocks_ = -(-p // 64)
    out[p == 0] = q[p == 0]
    few = np.bincount(np.minimum(blocks_, 9), minlength=10) < 24
    few[9] = True
    for i in np.flatnonzero(few[np.minimum(blocks_, 9)] & (p > 0)):
        out[i] = edit_distance(*(np.frombuffer(s, np.int64).tolist() for s in sides[i]))
    for w in np.flatnonzero(~few[1:]) + 1:
        some = np.flatnonzero(blocks_ == w)
        some = some[np.argsort(-q[some], kind="stable")]
        at = 0
        while at < len(some):
            own = some[at : at + max(1, min(chunk, (1 << 20) // int(q[some[at]])))]  # 8 MB of words at most, or a pair
            out[own] = _distances([sides[i] for i in own], p[own], q[own], w)
            at += len(own)
    return out


def trimmed(sides: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """Without the words that a shorter and a longer line have in common at the beginning and at the end."""
    n = np.fromiter((len(a) // 8 for a, _ in sides), np.int64, len(sides))
    some = np.flatnonzero(n)
    if not len(some):
        return sides
    starts, total = np.cumsum(n[some]) - n[some], int(n.sum())
    place = np.arange(total)

    def words(at: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(at), np.uint64)

    a = words([s[0] for s in sides])
    differ = a != words([s[1][: len(s[0])] for s in sides])
    head = np.minimum(np.minimum.reduceat(np.where(differ, place, total), starts) - starts, n[some])
    differ = a != words([s[1][len(s[1]) - len(s[0]) :] for s in sides])
    tail = np.minimum(starts + n[some] - 1 - np.maximum.reduceat(np.where(differ, place, -1), starts), n[some] - head)
    out = list(sides)
    for i, h, t in zip(some.tolist(), (8 * head).tolist(), (8 * tail).tolist()):
        x, y = sides[i]
        out[i] = (x[h : len(x) - t], y[h : len(y) - t])
    return out


def _distances(sides: list[tuple[bytes, bytes]], p: np.ndarray, q: np.ndarray, w: int) -> np.ndarray:
    """Of pairs in descending order of q, the longer lines' lengths; p: the shorter ones', in w numbers of 64 bits."""
    n, one, top = len(p), np.uint64(1), np.uint64(63)
    a, b = np.zeros((n, 64 * w), np.uint64), np.zeros((int(q[0]), n), np.uint64)
    a[np.repeat(np.arange(n), p), np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)] = np.frombuffer(b"".join([s[0] for s in sides]), np.uint64)
    b[np.arange(q.sum()) - np.repeat(np.cumsum(q) - q, q), np.repeat(np.arange(n), q)] = np.frombuffer(b"".join([s[1] for s in sides]), np.uint64)
    plus, minus = [np.full(n, ~np.uint64(0)) for _ in range(w)], [np.zeros(n, np.uint64) for _ in range(w)]
    score, last, bit = p.copy(), (p - 1) // 64, ((p - 1) % 64).astype(np.uint64)
    for j in range(int(q[0])):
        k = int(np.searchsorted(-q, -j, side="left"))  # pairs whose longer line has a word j
        eqs = np.packbits(a[:k] == b[j, :k, None], axis=1, bitorder="little").view(np.uint64)
        up_in, down_in = np.ones(k, np.uint64), np.zeros(k, np.uint64)
        for i in range(w):
            pv, mv, eq = plus[i][:k], minus[i][:k], eqs[:, i]
            v = eq | mv
            eq = eq | down_in
            h = (((eq & pv) + pv) ^ pv) | eq
            up, down = mv | ~(h | pv), pv & h
            here = last[:k] == i
            score[:k] += np.where(here, (up >> bit[:k] & one).astype(np.int64) - (down >> bit[:k] & one).astype(np.int64), 0)
            up_out, down_out = up >> top, down >> top
            up, down = up << one | up_in, down << one | down_in
            plus[i][:k], minus[i][:k] = down | ~(v | up), up & v
            up_in, down_in = up_out, down_out
    return score


def similar(x: list[bytes], y: list[bytes], up: int, down: int) -> np.ndarray:
    """Of each pair of lines, whether 1 - distance / longer length is at least up / down, over words by their 64-bit hashes."""
    p, q = (np.fromiter((len(v) // 8 for v in s), np.int64, len(s)) for s in (x, y))
    out = np.minimum(p, q) * down >= np.maximum(p, q) * up
    some = np.flatnonzero(out)
    out[some] = down * edit_distances([x[i] for i in some], [y[i] for i in some]) <= (down - up) * np.maximum(p, q)[some]
    return out


def hamming_bound(similarity: float) -> int:
    """Bits in which SimHashes of lines at the similarity hardly ever differ more: the mean plus three deviations (one pair in a thousand does)."""
    p = math.acos(similarity) / math.pi
    return math.ceil(BITS * p + 3 * math.sqrt(BITS * p * (1 - p)))


class Prune:
    """Which entries may be of similar lines, by their numbers of words and SimHashes."""

    def __init__(self, up: int, down: int, large: int = LARGE, dense: int = DENSE):
        self.up, self.down, self.near, self.large, self.dense = up, down, hamming_bound(up / down), large, dense

    def pairs(self, e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the pairs of entries x and y (indices), those that may be."""
        p, q = e["n"][x].astype(np.int64), e["n"][y].astype(np.int64)
        ok = np.flatnonzero(np.minimum(p, q) * self.down >= np.maximum(p, q) * self.up)
        return ok[np.bitwise_count(e["sim"][x[ok]] ^ e["sim"][y[ok]]).sum(axis=1, dtype=np.int64) <= self.near]

    def near_of(self, e: np.ndarray, some: np.ndarray, *differ: np.ndarray):
        """Of the entries `some` (indices) the pairs that may be similar, as pairs() finds them, a million looked at at a time. differ: for each of the
        entries; of a pair they aren't equal. Lines are looked at by their numbers of words, each with those that aren't too long for it."""
        order = np.argsort(e["n"][some], kind="stable")
        some, differ = some[order], [c[order] for c in differ]
        n, sim = e["n"][some].astype(np.int64), np.ascontiguousarray(e["sim"][some].T)
        ends, low = np.searchsorted(n, n * self.down // self.up, side="right"), 0
        while low < len(some):
            high = min(len(some), low + max(1, (1 << 20) // int(ends[low] - low)))
            end = int(ends[high - 1])
            bits = np.bitwise_count(sim[0, low:high, None] ^ sim[0, None, low:end])
            for w in sim[1:]:
                bits += np.bitwise_count(w[low:high, None] ^ w[None, low:end])
            x, y = np.nonzero(bits <= self.near)
            x, y = x + low, y + low
            ok = (x < y) & (y < ends[x])
            for c in differ:
                ok &= c[x] != c[y]
            yield some[x[ok]], some[y[ok]]
            low = high

    def meet(self, data: bytes):
        """a, b and kind of the pairs that meet under a key and may be similar; see many()."""
        e = np.frombuffer(data, ENTRY)
        e = e[often(e["k"], 2, max(16, len(e).bit_length() + 1)) | (e["n"] & LED > 0)]
        e = e.take(np.lexsort((e["id"], e["k"])))
        same = e["k"][1:] == e["k"][:-1]
        e = e[np.concatenate([same, [False]]) | np.concatenate([[False], same]) | (e["n"] & LED > 0)] if len(e) else e
        e = e[np.concatenate([np.ones(min(1, len(e)), bool), (e["k"][1:] != e["k"][:-1]) | (e["id"][1:] != e["id"][:-1])])]
        starts, size = runs(e["k"])
        split, led = e["n"][starts] >= SPLIT, np.add.reduceat(e["n"] & LED > 0, starts, dtype=np.int64) > 0 if len(e) else np.zeros(0, bool)
        e["n"] &= np.uint16(LONGEST)
        found, held = [], 0
        for x, y, kind in self.groups(e, starts, size, split, led):
            found.append((x, y, kind))
            held += len(x)
            if held >= 1 << 20:
                yield self.batch(e, found)
                found, held = [], 0
        yield self.batch(e, found)

    def groups(self, e: np.ndarray, starts: np.ndarray, size: np.ndarray, split: np.ndarray, led: np.ndarray):
        """Of each key, the pairs of entries (indices) and what they are."""
        few = (size > 1) & (size <= min(48, self.large))
        for z in np.unique(size[few]):
            at = starts[few & (size == z)]
            u, v = np.triu_indices(z, 1)
            step = max(1, (1 << 18) // len(u))
            for s in range(0, len(at), step):
                x, y = (np.repeat(at[s : s + step], len(t)) + np.tile(t, len(at[s : s + step])) for t in (u, v))
                ok = self.pairs(e, x, y)
                yield x[ok], y[ok], PAIR
        dense = led & ~split
        for i in np.flatnonzero((size > 1) & ~few):
            x, y, whole = self.many(e, starts[i], size[i])
            dense[i] |= not whole and not split[i]  # what a split key leaves is seen to under the one that it is part of
            yield x, y, PAIR
        yield starts[dense], starts[dense], AGAIN

    def batch(self, e: np.ndarray, found: list) -> pa.RecordBatch:
        x, y = (np.concatenate([f[n] for f in found]) if found else np.zeros(0, np.int64) for n in (0, 1))
        kind = np.repeat(np.array([f[2] for f in found], np.int32), [len(f[0]) for f in found]) if found else np.zeros(0, np.int32)
        a, b = (np.where(kind == AGAIN, e["k"][at].view(np.int64), e["id"][at]) for at in (x, y))  # a < b of pairs, as ids ascend within a key
        _, once = np.unique(mixed(a.view(np.uint64) * MIX + b.view(np.uint64)) ^ kind.astype(np.uint64), return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once]), pa.array(kind[once])], names=["a", "b", "kind"])

    def many(self, e: np.ndarray, at: int, z: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """meet() of one key with z lines, from `at` on: pairs, and whether they are all near ones.

        They are if there are `dense` a line at most. Else a leader (the first of some lines with nearly the most near ones) is paired with those near
        it, then a leader of the others with those near that one, and so on: no more than a pair a line. What that doesn't link is compared once
        it is known what is linked (find_repeats()).
        """
        if z <= self.large:
            found, count = [], 0
            for pair in self.near_of(e, np.arange(at, at + z)):
                found.append(pair)
                count += len(pair[0])
                if count > self.dense * z:
                    break
            else:
                x, y = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                return np.minimum(x, y), np.maximum(x, y), True
        rest, out = np.arange(at, at + z), []
        for _ in range(LEADERS):
            if len(rest) < 2:
                break
            tried = rest[np.unique(np.linspace(0, len(rest) - 1, min(TRIED, len(rest))).astype(np.int64))]
            near = [rest[self.pairs(e, np.full(len(rest), t), rest)] for t in tried]  # a line is near itself
            most = max(map(len, near))
            t, own = next((t, y) for t, y in zip(tried, near) if len(y) >= 0.9 * most)
            out.append((np.minimum(t, own[own != t]), np.maximum(t, own[own != t])))
            rest = np.setdiff1d(rest, own)
        return *(np.concatenate([o[n] for o in out]) for n in (0, 1)), False


def apart(e: np.ndarray, passed: int = PASSED) -> np.ndarray:
    """Of a key with more than `passed` entries, all get a key of their own; the first, which leads them, keeps the old one as well, and says so there."""
    few = ~often(e["k"], passed + 1)
    if few.all():
        return e
    rest, e = e[few], e[~few]
    e = e.take(np.lexsort((e["id"], e["k"])))
    starts, size = runs(e["k"])
    hot = np.flatnonzero(size > passed)
    if not len(hot):
        return np.concatenate([rest, e])
    at = np.repeat(starts[hot] - (np.cumsum(size[hot]) - size[hot]), size[hot]) + np.arange(size[hot].sum())
    own = e[at].copy()
    first = np.repeat(own["id"][np.cumsum(size[hot]) - size[hot]], size[hot])
    own["k"] = mixed(own["k"] ^ mixed(first.view(np.uint64) + MIX))
    own["n"] |= SPLIT
    keep = np.ones(len(e), bool)
    keep[at] = np.arange(len(at)) - np.repeat(np.cumsum(size[hot]) - size[hot], size[hot]) == 0
    e["n"][starts[hot]] |= LED
    return np.concatenate([rest, e[keep], own])


def often(k: np.ndarray, least: int, bits: int = 16) -> np.ndarray:
    """Whether each key may come `least` times or more: surely not, where so few keys share its `bits` bits of a hash."""
    slot = (k * MIX >> np.uint64(64 - bits)).astype(np.int64)
    return np.bincount(slot, minlength=1 << bits)[slot] >= least


def find_repeats(docs: DataFrame, similarity: tuple[int, int] = (4, 5), least_words: int = 3, least_equal: int | None = None, recall: float = 0.99, rounds: int = 4, limits: tuple[int, int, int] = LIMITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_key (see row_key()) and lines (array<int>, the numbers of its lines that go) of each row of docs that loses lines.

    Lines (between line feeds) are compared without case, ASCII punctuation and spacing. Two are linked if their edit similarity over words, 1 -
    distance / longer length, is at least similarity (a fraction); of each connected group only the first occurrence, by doc_id (nulls last),
    text (by a hash) and line number, stays. Equal lines of least_equal words or more (least_words if none is given) always meet; lines of
    fewer stay, as do lines without a word. Of lines of least_words words or more those meet that aren't equal, with a probability of recall
    at least if they are just at the similarity: if one of their MinHash bands agrees (LineBands). Rows of one doc_id with different texts
    are different rows; rows that are equal in both count as one, and all keep the same lines. Null texts have no lines.

    Bands are dealt out in `rounds` parts at most, one after the other, each of which takes its share of disk.
    """
    up, down = similarity
    bands, prune = LineBands(up, down, recall, least_words), Prune(up, down, *limits[:2])
    least_equal = least_words if least_equal is None else least_equal
    texts = docs.select(row_key(id_col, text_col).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.col(text_col).alias("text")).where("text is not null")

    def sketch(batches):
        for batch in batches:
            for part in split_batch(batch, 2, 1 << 19):
                found = Lines(part.column(2).to_pylist())
                use = np.flatnonzero(found.n >= max(1, least_equal))
                h = found.hash[use]
                some = use[found.n[use] >= bands.least]
                first = np.sort(some[np.unique(found.hash[some], return_index=True)[1]])
                words, n = found.words_of(first)
                sims = simhashes(occurrences(words, np.repeat(np.arange(len(n)), n)), n) if len(n) else np.zeros((0, WORDS64), np.uint64)
                keys = bands.keys(words, n) if len(n) else np.zeros((bands.bands, 0), np.uint64)
                doc, row = (c.to_numpy(zero_copy_only=False) for c in (part.column(1), part.column(0)))
                cols = [h, row[found.text[use]], doc[found.text[use]], found.number[use].astype(np.int32), found.hash[first], sims, np.minimum(n, LONGEST).astype(np.uint16), *(keys[low:high].view(np.uint8).reshape(high - low, len(n), 8)[:, :, 2:] for low, high in parts_of)]
                yield pa.RecordBatch.from_arrays([pa.array([len(h)], pa.int64()), pa.array([len(first)], pa.int64()), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cols)], names=["n_lines", "n_first", *packed])
        released()

    columns = min(bands.bands, math.lcm(*range(1, rounds + 1)))  # so that rounds, however many there are, take equal shares
    cuts = [bands.bands * i // columns for i in range(columns + 1)]
    parts_of = [(low, high) for low, high in zip(cuts, cuts[1:]) if low < high]
    packed = ("h", "row", "doc", "line", "first", "sim", "size", *(f"keys{low}" for low, _ in parts_of))
    scratch = Scratch(docs.sparkSession)
    lines = scratch.table(texts.mapInArrow(sketch, "n_lines long, n_first long," + ",".join(f"{c} binary" for c in packed)))
    n_lines, n_first = lines.agg(F.coalesce(F.sum("n_lines"), F.lit(0)), F.coalesce(F.sum("n_first"), F.lit(0))).first()

    def sketches(batches, low: int = 0):
        """Of some lines their hashes, SimHashes, numbers of words, and keys by band, from `low` on, of the columns given."""
        for batch in batches:
            for first, sim, size, *keys in zip(*(c.to_pylist() for c in batch.columns)):
                ids, raw = np.frombuffer(first, np.int64), np.frombuffer(b"".join(keys), np.uint8)
                k = np.zeros((raw.size // max(1, 6 * len(ids)), len(ids), 8), np.uint8)
                k[:, :, 2:] = raw.reshape(len(k), len(ids), 6)
                yield ids, np.frombuffer(sim, np.uint64).reshape(len(ids), WORDS64), np.frombuffer(size, np.uint16), k.view(np.uint64)[:, :, 0] | np.arange(low + 1, low + 1 + len(k), dtype=np.uint64)[:, None]

    def entries(batches, low: int):
        for ids, sim, n, k in sketches(batches, low):
            out = np.empty(k.shape, ENTRY)
            out["k"], out["id"], out["sim"], out["n"] = k, ids, sim, n
            yield out.ravel()

    met, rounds = [], rounds_for(n_first * bands.bands * ENTRY.itemsize, rounds)
    for i in range(rounds):  # a round takes the columns of some parts of the bands
        own = parts_of[len(parts_of) * i // rounds : len(parts_of) * (i + 1) // rounds]
        if own:
            low, high = own[0][0], own[-1][1]
            met.append(cut(deal(lines.select("first", "sim", "size", *(f"keys{x}" for x, _ in own)), lambda b, low=low: entries(b, low), prune.meet, "a long, b long, kind int", parts_for(docs, n_first * (high - low) * ENTRY.itemsize), lambda e: apart(e, limits[2]))))
    found = met[0]
    for m in met[1:]:
        found = found.unionByName(m)
    side = lambda d, c: d.select(F.col("id").alias(c), *(F.col(n).alias(f"{c}_{n}") for n in d.columns if n != "id"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b) of lines those that are similar, as far as it takes to join up what they link.

        First each line meets the one of its candidates that has most candidates itself; then only pairs are left that no link found joins.
        """
        pairs = cut(pairs)
        content = cut(_contents(texts, _places(lines, cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id")))
        compared = lambda some: cut(some.join(side(content, "a"), "a").join(side(content, "b"), "b").select("a", "b", "a_words", "b_words").mapInArrow(verify, "a long, b long"))
        ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        known = ends.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        hub = ends.join(known.select(F.col("a").alias("b"), "n"), "b").groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b"))
        first = cut(hub.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        links = compared(first)
        joined = cut(components(links))
        own = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
        rest = pairs.join(first, ["a", "b"], "left_anti").join(own("a"), "a", "left").join(own("b"), "b", "left")
        return links.unionByName(compared(rest.where("coalesce(a_in, a) <> coalesce(b_in, b)").select("a", "b")))

    def verify(batches):
        for b in batches:
            for part in split_batch(b, 2, 1 << 20):
                ok = pa.array(np.flatnonzero(similar(part.column(2).to_pylist(), part.column(3).to_pylist(), up, down)))
                yield pa.RecordBatch.from_arrays([part.column(c).take(ok) for c in (0, 1)], names=["a", "b"])
        released()

    edges = verified(found.where(f"kind = {PAIR}").select("a", "b").distinct())
    comp = cut(components(edges))
    again = cut(found.where(f"kind = {AGAIN}").select(F.col("a").alias("k")).distinct())
    if not again.isEmpty():
        members = cut(_members(lines.select("first", "sim", "size", *(f"keys{x}" for x, _ in parts_of)), again, sketches).join(comp.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id")))
        tally = members.mapInArrow(tallied, TALLY).groupBy("k").agg(F.sum("n").alias("n"), F.bit_xor("who").alias("who"), F.bit_xor("whose").alias("whose"), F.min("low").alias("low"), F.max("high").alias("high"))
        open_ = tally.where("low <> high").join(again, "k", "left_semi").groupBy("n", "who", "whose").agg(F.min("k").alias("k"))  # of keys with the same lines one
        open_ = cut(open_.select("k", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
        dealt = open_.agg(F.coalesce(F.sum(F.col("n") * F.col("blocks")), F.lit(0))).first()[0] * MEMBER.itemsize
        near = deal(members, _to_blocks(open_), lambda d: in_play(prune, d), "id long, ks binary", parts_for(docs, dealt), key=block_key)
        near = cut(near.groupBy("id").agg(F.collect_list("ks").alias("ks")))  # lines near one that they aren't linked with, a row each
        content = _contents(texts, _places(lines, cut(near.select("id")), "id"))
        members = cut(members.drop("ks").join(near, "id").join(content, "id").select("id", "sim", "component", "ks", "words"))
        meet = members.mapInArrow(_to_meetings(members), MEETING).repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
        more = meet.mapInArrow(lambda batches: compared_blocks(prune, batches), "a long, b long")  # of components
        higher = cut(components(more)).select(F.col("node").alias("component"), F.col("component").alias("higher"))
        every = comp.unionByName(higher.select(F.col("component").alias("node"), "component")).dropDuplicates(["node"])
        comp = cut(every.join(higher, "component", "left").select("node", F.coalesce("higher", "component").alias("component")))

    def hashes(batches):
        for h in (np.frombuffer(x, np.uint64) for b in batches for x in b.column(0).to_pylist()):
            yield np.ascontiguousarray(h).view(HASH)

    def twice(data: bytes):
        h = np.sort(np.frombuffer(data, np.uint64))
        again = np.unique(h[1:][h[1:] == h[:-1]])
        yield pa.RecordBatch.from_arrays([pa.array(again.view(np.int64))], names=["h"])

    equal = cut(deal(lines.select("h"), hashes, twice, "h long", parts_for(docs, n_lines * 8), only_twice))
    groups = cut(comp.select(F.col("node").alias("h"), F.col("component").alias("g")).unionByName(equal.join(comp.select(F.col("node").alias("h")), "h", "left_anti").select("h", F.col("h").alias("g"))))
    placed = cut(_places(lines, groups, "h").join(groups, "h").select("g", "doc", "row", "line"))
    keep = cut(placed.groupBy("g").agg(F.min(F.struct("doc", "row", "line")).alias("keep")))
    gone = placed.join(keep, "g").where(F.struct("doc", "row", "line") != F.col("keep"))
    out = cut(gone.groupBy(F.col("row").alias("row_key")).agg(F.array_sort(F.collect_set("line")).alias("lines")))
    scratch.drop()
    return out


def words_shared(words: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, common: int = 64) -> np.ndarray:
    """How many words (with their repeats) each of the lines `left` shares with each of `right`, which are the same ones or others. words: the lines'
    words, one after the other, n of each. Words of more than `common` lines are counted by products of matrices, the others pair by pair."""
    owner = np.repeat(np.arange(len(n)), n)
    _, code = np.unique(words, return_inverse=True)
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    starts, size = runs(owner * (len(words) + 1) + code)
    code = code * (int(size.max(initial=0)) + 1) + np.arange(len(code)) - np.repeat(starts, size)  # the second, third ... of equal words are others
    order = np.argsort(code, kind="stable")
    owner = owner[order]
    starts, size = runs(code[order])
    row, col, out = np.full(len(n), -1), np.full(len(n), -1), np.zeros((len(left), len(right)), np.float32)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    often = np.flatnonzero(size > common)
    for at in range(0, len(often), 512):
        own = often[at : at + 512]
        line = owner[np.repeat(starts[own] - (np.cumsum(size[own]) - size[own]), size[own]) + np.arange(size[own].sum())]
        word, sides = np.repeat(np.arange(len(own)), size[own]), []
        for spot, count in ((row, len(left)), (col, len(right))):
            sides.append(np.zeros((count, len(own)), np.float32))
            sides[-1][spot[line[spot[line] >= 0]], word[spot[line] >= 0]] = 1
        out += sides[0] @ sides[1].T
    for z in np.unique(size[(size > 1) & (size <= common)]):
        at, (u, v) = starts[size == z], np.triu_indices(z, 1)
        step = max(1, (1 << 18) // len(u))
        for s in range(0, len(at), step):
            x, y = (owner[at[s : s + step, None] + t].ravel() for t in (u, v))
            for x, y in ((x, y), (y, x)):
                use = (row[x] >= 0) & (col[y] >= 0)
                np.add.at(out, (row[x[use]], col[y[use]]), 1)
    return out


def apart_pairs(prune: Prune, e: np.ndarray, own: np.ndarray, root: np.ndarray, words: np.ndarray, n: np.ndarray, two: bool, most: int = 1024):
    """Pairs of entries (of the two sides, or of all) that may be similar and whose roots differ, `most` at most at a time. root may change meanwhile.

    Lines at a distance d share all but d words of the longer one at least, so that others needn't be looked at word by word."""
    left, right = (np.flatnonzero(own == 0), np.flatnonzero(own == 1)) if two else (np.arange(len(e)),) * 2
    shared = words_shared(words, n, left, right)
    for low in range(0, len(left), 256):
        x, y = np.nonzero(shared[low : low + 256] * prune.down >= prune.up * np.maximum(n[left[low : low + 256], None], n[None, right]))
        x, y = left[x + low], right[y]
        some = np.flatnonzero((root[x] != root[y]) & (two | (x < y)))
        some = some[prune.pairs(e, x[some], y[some])]
        for at in range(0, len(some), most):
            x_, y_ = x[some[at : at + most]], y[some[at : at + most]]
            still = root[x_] != root[y_]
            if still.any():
                yield x_[still], y_[still]


#: A line under a key, in a pair of blocks (i <= j; own: on the side of j) that all its lines are dealt to, and the line's component.
MEMBER = np.dtype([("k", "<i8"), ("i", "<i4"), ("j", "<i4"), ("own", "<i1"), ("id", "<i8"), ("sim", "<u8", (WORDS64,)), ("n", "<u2"), ("within", "<i8")])
#: Lines of a block; keys of more are named one by one.
BLOCK = 8_192
#: What is summed up of each key: its lines, two hashes of them all, and the smallest and the largest component.
TALLY = "k long, n long, who long, whose long, low long, high long"


def _members(sketched: DataFrame, asked: DataFrame, sketches) -> DataFrame:
    """id, sim, n and ks (its keys, packed) of each line that has a key among those asked for (and few others): a row a line, however many of its
    keys are."""
    bits = sketched.sparkSession.sparkContext.broadcast(bitmap_of(asked, "k"))

    def run(batches):
        for ids, sim, n, k in sketches(batches):
            use = in_bitmap(bits.value, k.view(np.int64))
            some = np.flatnonzero(use.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array([x.tobytes() for x in sim[some]], pa.binary()), pa.array(n[some].astype(np.int32)), pa.array([k[use[:, i], i].tobytes() for i in some], pa.binary())], names=["id", "sim", "n", "ks"])

    return sketched.mapInArrow(run, "id long, sim binary, n int, ks binary").dropDuplicates(["id"])


def tallied(batches):
    """TALLY of the keys of each batch of _members() with their component."""
    for batch in batches:
        ids, _, _, ks, within = batch.columns
        n = np.fromiter(map(len, ks := ks.to_pylist()), np.int64, len(ks)) // 8
        k = np.frombuffer(b"".join(ks), np.int64)
        order = np.argsort(k, kind="stable")
        at, (starts, size) = np.repeat(np.arange(len(n)), n)[order], runs(k[order])
        who, within = mixed(ids.to_numpy().view(np.uint64) + MIX)[at], within.to_numpy()[at]
        if len(starts):
            cols = [k[order][starts], size, np.bitwise_xor.reduceat(who, starts).view(np.int64), np.bitwise_xor.reduceat(mixed(who), starts).view(np.int64), np.minimum.reduceat(within, starts), np.maximum.reduceat(within, starts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in TALLY.split(", ")])


def _to_blocks(open_: DataFrame):
    """A function that makes MEMBERs of batches of _members() with their component, for the keys that are open (and few others)."""
    spark = open_.sparkSession.sparkContext
    many = open_.where("blocks > 1").select("k", "blocks").orderBy("k").toArrow()  # keys of more than a block of lines
    bits, large = spark.broadcast(bitmap_of(open_, "k")), spark.broadcast([many.column(c).to_numpy() for c in ("k", "blocks")])

    def make(batches):
        names, counts = large.value
        for part in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            ids, sim, n, ks, within = part.columns
            own = np.fromiter(map(len, ks := ks.to_pylist()), np.int64, len(ks)) // 8
            k = np.frombuffer(b"".join(ks), np.int64)
            use = in_bitmap(bits.value, k)
            k, at = k[use], np.repeat(np.arange(len(own)), own)[use]
            k, at, *pair = in_blocks(k, at, ids.to_numpy(), names, counts)
            e = np.empty(len(k), MEMBER)
            e["k"], e["id"], (e["i"], e["j"], e["own"]) = k, ids.to_numpy()[at], pair
            e["sim"], e["n"], e["within"] = np.frombuffer(b"".join(sim.to_pylist()), np.uint64).reshape(-1, WORDS64)[at], n.to_numpy()[at], within.to_numpy()[at]
            yield e

    return make


def in_blocks(k: np.ndarray, at: np.ndarray, ids: np.ndarray, names: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The lines at[...] of keys k dealt to the pairs of blocks (i, j, and own: whether on the side of j) of the keys that have many (names: ascending,
    counts: their blocks): k, at, i, j, own."""
    blocks_ = np.ones(len(k), np.int64)
    if len(names):
        spot = np.minimum(np.searchsorted(names, k), len(names) - 1)
        blocks_[names[spot] == k] = counts[spot[names[spot] == k]]
    other = np.arange(blocks_.sum()) - np.repeat(np.cumsum(blocks_) - blocks_, blocks_)
    k, at, blocks_ = (np.repeat(x, blocks_) for x in (k, at, blocks_))
    block = (mixed(ids[at].view(np.uint64)) % blocks_.astype(np.uint64)).astype(np.int64)
    return k, at, np.minimum(block, other), np.maximum(block, other), block > other


def block_key(e: np.ndarray) -> np.ndarray:
    """Of MEMBERs, a hash of their key and pair of blocks."""
    return mixed(e["k"].astype(np.uint64)) ^ mixed((e["i"].astype(np.uint64) << np.uint64(32)) + e["j"].astype(np.uint64) + MIX)


def in_play(prune: Prune, data: bytes):
    """Of the MEMBERs that may be similar to one of another component that they meet, id and ks (the keys that they meet it under, packed)."""
    m = np.frombuffer(data, MEMBER)
    m = m.take(np.lexsort((m["id"], m["j"], m["i"], m["k"])))
    e = np.empty(len(m), ENTRY)
    e["id"], e["sim"], e["n"] = m["id"], m["sim"], m["n"]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(m)), bool), (m["k"][1:] != m["k"][:-1]) | (m["i"][1:] != m["i"][:-1]) | (m["j"][1:] != m["j"][:-1])]))
    use = np.zeros(len(m), bool)
    for low, high in zip(new.tolist(), np.append(new[1:], len(m)).tolist()):
        _, root = np.unique(m["within"][low:high], return_inverse=True)
        if root.any():
            for x, y in prune.near_of(e, np.arange(low, high), root, *([m["own"][low:high]] if m["i"][low] < m["j"][low] else [])):
                use[x] = use[y] = True
    m = m[use]
    m = m[np.lexsort((m["k"], m["id"]))]
    starts, size = runs(m["id"])
    k = np.ascontiguousarray(m["k"])
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(m["id"][starts])), pa.array([k[a : a + z].tobytes() for a, z in zip(starts.tolist(), size.tolist())], pa.binary())], names=["id", "ks"])


#: Of lines of a key that meet in a pair of blocks: what MEMBER has, with their number of words, and the words, one line after the other.
MEETING = "k long, i int, j int, head binary, words binary"
HEAD = np.dtype([("own", "<i1"), ("id", "<i8"), ("sim", "<u8", (WORDS64,)), ("within", "<i8"), ("n", "<i4")])
#: Lines of a block whose words are compared, and bytes of them.
MET, MET_BYTES = 2_048, 1 << 24


def _to_meetings(members: DataFrame):
    """A function that packs batches of lines (id, sim, component, ks, words) by the keys and pairs of blocks that they meet in: a row for each of those,
    not for each line."""

    def keys_of(part):
        ks = [b"".join(x) for x in part.column("ks").to_pylist()]
        size = np.fromiter(map(len, ks), np.int64, len(ks)) // 8
        k, at = np.frombuffer(b"".join(ks), np.int64), np.repeat(np.arange(len(ks)), size)
        order = np.lexsort((at, k))
        k, at = k[order], at[order]
        new = np.concatenate([np.ones(min(1, len(k)), bool), (k[1:] != k[:-1]) | (at[1:] != at[:-1])])  # a key of many blocks may have named a line in some
        return k[new], at[new]

    def weighed(batches):
        for batch in batches:
            k, at = keys_of(batch)
            starts, size = runs(k)
            if len(starts):
                weight = np.fromiter(map(len, batch.column("words").to_pylist()), np.int64, batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(k[starts]), pa.array(size), pa.array(np.add.reduceat(weight[at], starts))], names=["k", "n", "bytes"])

    each = members.mapInArrow(weighed, "k long, n long, bytes long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    each = each.select("k", F.greatest(F.ceil(F.col("n") / MET), F.ceil(F.col("bytes") / MET_BYTES)).alias("blocks"))
    many = each.where("blocks > 1").orderBy("k").toArrow()
    large = members.sparkSession.sparkContext.broadcast([many.column(c).to_numpy() for c in ("k", "blocks")])

    def make(batches):
        for part in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            k, at, i, j, own = in_blocks(*keys_of(part), part.column("id").to_numpy(), *large.value)
            words = part.column("words").to_pylist()
            order = np.lexsort((j, i, k))
            k, at, i, j, own = (c[order] for c in (k, at, i, j, own))
            starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            head = np.empty(len(k), HEAD)
            head["own"], head["id"], head["within"] = own, part.column("id").to_numpy()[at], part.column("component").to_numpy()[at]
            head["sim"] = np.frombuffer(b"".join(part.column("sim").to_pylist()), np.uint64).reshape(-1, WORDS64)[at]
            head["n"] = np.fromiter(map(len, words), np.int64, len(words))[at] // 8
            rows, held = [], 0
            for a, b in zip(starts.tolist(), np.append(starts[1:], len(k)).tolist()):
                rows.append((int(k[a]), int(i[a]), int(j[a]), head[a:b].tobytes(), b"".join([words[x] for x in at[a:b].tolist()])))
                held += len(rows[-1][4]) + len(rows[-1][3])
                if held >= 1 << 22:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["k", "i", "j", "head", "words"])

    return make


def compared_blocks(prune: Prune, batches):
    """a and b: components that a link joins of lines that meet (MEETING, sorted)."""
    for (_, i, j), (*_, heads, words) in runs_of(batches, 3):
        head, raw = np.frombuffer(b"".join(heads.to_pylist()), HEAD), b"".join(words.to_pylist())
        e = np.zeros(len(head), ENTRY)
        e["id"], e["sim"], e["n"] = head["id"], head["sim"], np.minimum(head["n"], LONGEST)
        names, root = np.unique(head["within"], return_inverse=True)
        n, first, links = head["n"].astype(np.int64), root.copy(), []
        ends = (8 * np.cumsum(n)).tolist()
        line = lambda r: raw[ends[r - 1] if r else 0 : ends[r]]  # noqa: E731, B023
        for x, y in apart_pairs(prune, e, head["own"], root, np.frombuffer(raw, np.uint64), n, i < j):
            for r, t in np.stack([x, y])[:, similar([line(r) for r in x.tolist()], [line(t) for t in y.tolist()], prune.up, prune.down)].T:
                if root[r] != root[t]:  # a link that joins nothing anew says no more
                    root[root == root[r]] = root[t]
                    links.append((names[first[r]], names[first[t]]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])
    released()


HASH = np.dtype([("k", "<u8")])


def only_twice(h: np.ndarray) -> np.ndarray:
    """Each hash once or twice: more of them say no more."""
    s = np.sort(h["k"])
    keep = np.ones(len(s), bool)
    keep[2:] = s[2:] != s[:-2]
    return s[keep].view(HASH)


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row of documents: a hash of its id and its text."""
    return F.xxhash64(F.col(id_col).cast("long"), text_col)


def _places(lines: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """h, row, doc and line of all places of the lines asked for (a distinct column of hashes)."""
    bits = lines.sparkSession.sparkContext.broadcast(bitmap_of(asked, key))

    def emit(batches):
        for chunk in (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)))):
            cols = [np.frombuffer(x, t) for x, t in zip(chunk, (np.int64, np.int64, np.int64, np.int32))]
            use = in_bitmap(bits.value, cols[0])
            yield pa.RecordBatch.from_arrays([pa.array(c[use]) for c in cols], names=["h", "row", "doc", "line"])
        released()

    found = lines.select("h", "row", "doc", "line").mapInArrow(emit, "h long, row long, doc long, line int")
    return found.join(asked.select(F.col(key).alias("h")), "h", "left_semi")


def _contents(texts: DataFrame, places: DataFrame) -> DataFrame:
    """id and words (their hashes) of the lines at these places (h, row, doc, line), from one place of each."""
    one = places.groupBy("h").agg(F.min("row").alias("row"))
    one = places.join(one, ["h", "row"]).groupBy("h", "row").agg(F.min("line").alias("line"))
    by_row = cut(one.groupBy("row").agg(F.collect_list(F.struct("line", F.col("h").alias("id"))).alias("asked")))  # a row asks for its own lines only
    some = texts.where(maybe_in(bitmap_of(by_row, "row"), "row")).select("row", "text").join(by_row.hint("merge"), "row")  # no broadcast: two Python workers a task

    def emit(batches):
        for batch in batches:
            for part in split_batch(batch, 0, 1 << 19):
                ids, out = [], []
                for text, want in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    split = text.split("\n")
                    for x in want:
                        if x["line"] < len(split):
                            ids.append(x["id"])
                            out.append(split[x["line"]])
                w = Words([lowered(t) for t in out], LETTER)
                raw = w.hash.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([raw[8 * a : 8 * b] for a, b in zip(w.starts.tolist(), w.starts[1:].tolist())], pa.binary())], names=["id", "words"])
        released()

    return some.select("text", "asked").mapInArrow(emit, "id long, words binary").dropDuplicates(["id"])


def without_lines(text: Column, lines: Column) -> Column:
    """The text without the lines with these numbers; unchanged where lines is null."""

    def run(texts, gone):
        import pandas as pd

        return pd.Series([t if t is None or g is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gs) for t, g in zip(texts, gone) for gs in [() if g is None else set(g.tolist())]], dtype=object)

    return pandas_udf(run, "string")(text, lines)


def drop_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs without the lines that find_repeats() names, and with n_dropped, their number (replacing a column of that name).

    Every row of docs stays, with its other columns; null texts stay null; an empty table stays empty.
    """
    tag = uuid.uuid4().hex  # no column of docs has such a name
    own, numbers, key = (f"{n}_{tag}" for n in ("own", "lines", "key"))
    gone = find_repeats(docs, **options).select(F.col("row_key").alias(own), F.col("lines").alias(numbers))
    text = options.get("text_col", "text")
    keyed = docs.drop("n_dropped").withColumn(key, row_key(options.get("id_col", "doc_id"), text))
    touched = maybe_in(bitmap_of(gone, own), key)  # the rest needs no shuffle
    joined = keyed.where(touched).join(gone.hint("merge"), F.col(key) == F.col(own), "left").withColumn(text, without_lines(F.col(text), F.col(numbers)))
    joined = joined.withColumn("n_dropped", F.greatest(F.coalesce(F.size(numbers), F.lit(0)), F.lit(0))).drop(own, numbers, key)
    return joined.unionByName(keyed.where(~touched).drop(key).withColumn("n_dropped", F.lit(0)))
