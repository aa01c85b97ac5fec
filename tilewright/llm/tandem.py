"""Periodic runs of words: stretches that repeat a block of words again and again, found in suffix trees and collapsed to their first period.

A run is a stretch of words with smallest period q (words q apart are equal), of `least_words` words and `least_periods` periods at least, that no
neighbouring word extends. A tandem repeat whose next word breaks its period is a branching one: it belongs to the tree's node at the end of its
first half, whose depth is the period. Of each node, all children but the largest are gone through (the smaller half: n log n leaves in all), and each leaf
looks for its partner one period away in the node's leaf list, which is an interval of the suffix array. A branching repeat is then rotated to
the left as long as words agree; its rotations and the multiples of its period merge into one maximal run.

Both suffixes of a run's first two periods share `least_words` - `least_words` // `least_periods` words at least. So words that lie in no window of
that length which comes twice in their document belong to no run, and stay out of the tree: exact, and most texts need no tree at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_batch
from .tokens import MIX, Words, mixed, owners, powers

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Leaves that are looked up at a time.
LEAVES = 1 << 20


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of s in order, and the rank of each. s ends with a number that comes once, so suffixes that share h items go on after them."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    head = _heads(s[sa])
    rank = np.empty(n, np.int64)
    rank[sa] = head
    open_, h = _shared(head), 1
    while len(open_):  # only suffixes whose first h items another one has
        at = sa[open_]
        key = rank[at] * n + rank[at + h]
        order = np.argsort(key, kind="stable")
        at, head = at[order], _heads(key[order])
        sa[open_], rank[at] = at, open_[head]
        open_, h = open_[_shared(head)], 2 * h
    return sa, rank


def _heads(ordered: np.ndarray) -> np.ndarray:
    """For each item, where its run of equal ones begins."""
    first = np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]])
    return np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))


def _shared(head: np.ndarray) -> np.ndarray:
    """Places whose run has another item."""
    return np.flatnonzero(np.bincount(head, minlength=len(head))[head] > 1) if len(head) else head


def common_prefixes(s: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> list[int]:
    """How many items each suffix shares with the one before it in order."""
    words, order, at, out = s.tolist(), sa.tolist(), rank.tolist(), [0] * len(s)
    h = 0
    for i, r in enumerate(at):
        if r:
            j = order[r - 1]
            while words[i + h] == words[j + h]:  # ends at the last item, which comes once
                h += 1
            out[r] = h
            h -= h > 0
        else:
            h = 0
    return out


def tree_nodes(lcp: list[int], deepest: int) -> tuple[np.ndarray, ...]:
    """The tree's inner nodes of depth 1 to `deepest`, as (depth, first leaf, end) for each, and (node, first leaf, end) of each child but the largest."""
    depth, lo, hi, edges, counts = [], [], [], [], []
    stack: list[tuple[int, int, list[int]]] = []
    for k in range(1, len(lcp) + 1):
        here, first = lcp[k] if k < len(lcp) else 0, k - 1
        while stack and stack[-1][0] > here:
            d, first, cuts = stack.pop()
            if d <= deepest:
                depth.append(d)
                lo.append(first)
                hi.append(k)
                edges += [first, *cuts]
                counts.append(len(cuts) + 1)
        if stack and stack[-1][0] == here:
            stack[-1][2].append(k)
        elif here:
            stack.append((here, first, [k]))
    node = np.repeat(np.arange(len(depth)), counts)
    begin, ends = np.array(edges, np.int64), np.array(hi, np.int64)
    end = np.append(begin[1:], 0)
    first_child = np.cumsum([0, *counts[:-1]]) if counts else np.zeros(0, np.int64)
    end[np.append(first_child[1:], len(begin)) - 1] = ends  # the last child ends with its node
    size = end - begin
    order = np.lexsort((-size, node))  # by node, the largest first
    small = np.ones(len(node), bool)
    small[order[first_child]] = False
    return np.array(depth, np.int64), np.array(lo, np.int64), ends, node[small], begin[small], end[small]


def branching_repeats(s: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the tandem repeats of s with a period of at most `longest` whose next item isn't the one that the period asks for."""
    sa, rank = suffix_array(s)
    depth, lo, hi, node, begin, end = tree_nodes(common_prefixes(s, sa, rank), longest)
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = end - begin
    total = np.concatenate([[0], np.cumsum(size)])
    for a in range(0, int(total[-1]), LEAVES):  # leaves a to b of all small children
        leaf = np.arange(a, min(a + LEAVES, total[-1]))
        child = np.searchsorted(total, leaf, side="right") - 1
        i = sa[begin[child] + leaf - total[child]]
        v = node[child]
        q = depth[v]
        for first in (i, i - q):  # the leaf is the first of the two, or the second
            other = first + q if first is i else first
            there = (other >= 0) & (other < len(s))
            r = rank[np.where(there, other, 0)]
            there &= (r >= lo[v]) & (r < hi[v])
            f, p = first[there], q[there]
            broken = s[f + p] != s[f + 2 * p]
            starts.append(f[broken])
            periods.append(p[broken])
    both = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)]), axis=1)
    return both[0], both[1]


def maximal_runs(s: np.ndarray, least_words: int = 24, least_periods: int = 3, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of s, whose last item comes once."""
    if len(s) <= least_words:
        return []
    i, q = branching_repeats(s, len(s) // least_periods if longest is None else longest)
    more = np.maximum(least_words, least_periods * q) - 2 * q  # words to the left that a run needs besides
    far = i - more
    ok = far >= 0
    for back in (np.minimum(i - 1, i), far):  # its neighbour and the last one needed must agree
        at = np.where(ok & (more > 0), back, 0)
        ok &= (more <= 0) | (s[at] == s[at + q])
    i, q = i[ok], q[ok]
    order = np.lexsort((q, i + 2 * q))
    out, last, reach = [], -1, 0
    for start, period in zip(i[order].tolist(), q[order].tolist()):
        end = start + 2 * period
        if end == last and start >= reach:  # a multiple of the period of a run that is known
            continue
        begin, step = start, 64
        while begin > 0:  # rotate to the left
            a = max(0, begin - step)
            differ = np.flatnonzero(s[a:begin] != s[a + period : begin + period])
            begin = a if not len(differ) else a + int(differ[-1]) + 1
            if len(differ):
                break
            step *= 2
        reach = begin if end != last else min(reach, begin)
        last = end
        if end - begin >= max(least_words, least_periods * period):
            out.append((begin, end - begin, period))
    return out


def repeated_stretches(texts: list[bytes], width: int, least: int) -> list[tuple[int, int, int]]:
    """(text, first word, end) of the stretches of at least `least` words that windows of `width` words which come twice in their text cover.
    Equal windows have equal hashes, so none is missed."""
    words = Words(texts)
    n = len(words.hash) - width + 1
    if n < 1:
        return []
    up, down = powers(len(words.hash) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(words.hash * up[:-1])])
    owner = owners(words.starts)
    key = mixed((total[width:] - total[:-width]) * down[:n] + owner[:n].astype(np.uint64) * MIX)
    whole = np.flatnonzero(owner[:n] == owner[width - 1 :])
    key = key[whole]
    slots = 1 << max(12, (4 * n).bit_length())
    slot = (key >> np.uint64(20)).astype(np.int64) & (slots - 1)
    met = np.flatnonzero(np.bincount(slot, minlength=slots)[slot] > 1)  # few others
    order = met[np.argsort(key[met])]
    at = whole[order[_shared(_heads(key[order]))]]
    edge = np.zeros(len(words.hash) + 1, np.int32)
    edge[at] += 1
    edge[at + width] -= 1
    inside = np.where(np.cumsum(edge[:-1]) > 0, owner + 1, 0)
    change = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]])))
    out = []
    for a, b in zip(change[:-1].tolist(), change[1:].tolist()):
        if b - a >= least and inside[a]:
            t = int(owner[a])
            out.append((t, a - int(words.starts[t]), b - int(words.starts[t])))
    return out


def runs_of_texts(texts: list[bytes], least_words: int = 24, least_periods: int = 3) -> dict[int, list[tuple[int, int, int]]]:
    """By text, its runs by start and period; texts without any are left out."""
    stretches = repeated_stretches(texts, least_words - least_words // least_periods, least_words)
    if not stretches:
        return {}
    numbers: dict[bytes, int] = {}
    items, sizes, held, of = [], [], None, -1
    for t, a, b in stretches:
        if t != of:
            held, of = texts[t].split(), t
        items += [numbers.setdefault(w, len(numbers)) for w in held[a:b]]
        items.append(-1)
        sizes.append(b - a + 1)
    s = np.array(items, np.int64)
    ends = np.flatnonzero(s < 0)
    s[ends] = len(numbers) + np.arange(len(ends))  # each stretch ends with a number of its own
    begins = ends + 1 - np.array(sizes)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for start, length, period in maximal_runs(s, least_words, least_periods, max(sizes) // least_periods):
        k = int(np.searchsorted(begins, start, side="right")) - 1
        t, a, _ = stretches[k]
        out.setdefault(t, []).append((start - int(begins[k]) + a, length, period))
    for found in out.values():
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without those that come in a run after its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep).tolist())


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 24, least_periods: int = 3) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and collapsed, the text without what its runs repeat, its words
    joined by one space. Words are what ASCII white space separates.

    Each row is a row of its own, whatever its id (null or repeated ids stay). A null, empty or blank text has no words, no runs and collapses to the empty
    string. Texts of any length are taken whole; a text lies in one task, which holds its words and, of stretches that repeat themselves, a suffix array.
    An empty table gives none. Other columns, whatever their names, aren't read.
    """
    if least_periods < 2 or least_words < least_periods:
        raise ValueError("a run has two periods and a word a period at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, 1, 1 << 22):
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                found, n, out = runs_of_texts(texts, least_words, least_periods), [], []
                for i, t in enumerate(texts):
                    words = t.split()
                    n.append(len(words))
                    out.append(collapsed(words, found.get(i, [])))
                spans = [[{"start": a, "length": b, "period": q} for a, b, q in found.get(i, ())] for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(spans, _RUN), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def with_looped_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and text, where every tenth text by the CRC of its id loops from some word on (the words are then joined by one space). Expressions only.
    Rows without an id or a word stay as they are."""
    code = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.expr("_code div 10")

    def looped(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(at, " "))

    words = F.filter(F.split(F.col("_text"), "[ \\t-\\r]+"), lambda x: x != "")
    tail = F.get(F.transform(F.array(words), looped), 0)  # the words are a variable there, made once a row
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), code.alias("_code"))
    return rows.select(F.col("_id").alias(id_col), F.when(F.col("_code") % 10 == 0, F.coalesce(tail, "_text")).otherwise(F.col("_text")).alias(text_col))


def digest_runs(found: DataFrame) -> DataFrame:
    """Of find_runs(): doc_id, n_runs, the run with most periods (ties: the first, then the shortest period), and digests of all runs and of the
    collapsed text."""
    best = F.get(F.array_sort("runs", lambda a, b: F.when(a["length"] * b["period"] > b["length"] * a["period"], -1).when(a["length"] * b["period"] < b["length"] * a["period"], 1).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))), 0)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
