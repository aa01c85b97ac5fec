"""Periodic runs against all periods of all words."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import tandem


def plain_runs(w: list, least_words: int, least_periods: int) -> list[tuple[int, int, int]]:
    out = []
    for q in range(1, len(w) // least_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least_words, least_periods * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@st.composite
def texts(draw):
    alphabet = draw(st.integers(1, 4))
    out: list[int] = []
    for _ in range(draw(st.integers(0, 5))):
        block = draw(st.lists(st.integers(0, alphabet), min_size=1, max_size=7))
        out += (block * 12)[: draw(st.integers(0, 70))] if draw(st.booleans()) else block
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(texts(), max_size=4), st.sampled_from([(24, 3), (4, 2), (6, 3), (2, 2), (9, 4)]))
def test_runs_are_all_of_them(batch, limits):
    words = [[b"w%d" % x for x in t] for t in batch]
    got = tandem.runs_of_texts([b" ".join(t) for t in words], *limits)
    for i, t in enumerate(words):
        assert got.get(i, []) == plain_runs(t, *limits)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_suffixes_in_order(x):
    s = np.array([*x, 9], np.int64)
    sa, rank = tandem.suffix_array(s)
    want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
    assert sa.tolist() == want and rank[sa].tolist() == list(range(len(s)))
    lcp = tandem.common_prefixes(s, sa, rank)
    for k in range(1, len(s)):
        a, b = s[sa[k - 1] :].tolist(), s[sa[k] :].tolist()
        assert lcp[k] == next(i for i, (p, q) in enumerate(zip(a, b)) if p != q)


def test_long_texts():
    rng = np.random.default_rng(1)
    block = [b"b%d" % x for x in rng.integers(0, 50, 700)]
    assert tandem.runs_of_texts([b" ".join([b"x"] * 60_000)]) == {0: [(0, 60_000, 1)]}
    assert tandem.runs_of_texts([b"y " + b" ".join(block * 40 + block[:5])]) == {0: [(1, 28_005, 700)]}
    fib, more = "a", "ab"
    while len(more) < 5000:
        fib, more = more, more + fib
    got = tandem.runs_of_texts([" ".join(more).encode()])[0]
    assert got == plain_runs(list(more), 24, 3) and len(got) > 100


def brute(doc_id, text):
    w = [] if text is None else text.encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = plain_runs(w, 24, 3)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 9, rng.integers(0, 160))), "clash") for i in range(300)]
    rows += [(1000 + i, t, "clash") for i, t in enumerate([None, "", " \n\t", "one", "a " * 50, "é ü x " * 30, "x\x1cy z " * 20, "a b\nc " * 40 + "tail"])]
    rows += [(None, "p q " * 30, "x"), (7, "r s t " * 20, "x"), (7, "r s t " * 20, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = tandem.digest_runs(tandem.find_runs(tandem.with_looped_tails(docs))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[6], r[7])
    want = sorted((brute(i, t) for i, t, _ in rows), key=key)
    assert sorted(map(tuple, got), key=key) == want
    assert sum(r[1] > 0 for r in want) > 15 and any(r[1] for r in want if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0)


def test_spans_and_text(spark):
    docs = spark.createDataFrame([("a", "start " + "one two three " * 9 + "end")], "key string, body string")
    got = tandem.find_runs(docs, "key", "body").collect()[0]
    assert got["n_words"] == 29 and [tuple(r) for r in got["runs"]] == [(1, 27, 3)]
    assert got["collapsed"] == "start one two three end"
    assert tandem.find_runs(docs.limit(0), "key", "body").count() == 0
    with pytest.raises(ValueError):
        tandem.find_runs(docs, "key", "body", least_periods=1)
