"""The audit of sources against plain counts, and what a round moves."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tilewright.llm import divergence

SHOUT = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least_docs=30, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        found = [t.translate(SHOUT) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = []
    for lang in groups:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        share = lambda have: {t: 1 + 1_000_000_000 * (have[t] + 5) // (sum(have[x] for x in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in groups[lang]}
        q = share(sum((counts[lang, s] for s in groups[lang]), Counter()))
        for s in groups[lang]:
            pair = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in groups[lang] - {s}))
            term = sorted((-(p[s][t] - q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item.decode(), -v, i + 1) for part, found in (("pair", pair), ("term", term)) for i, (v, item) in enumerate(found)]
    return sorted(out)


def corpus(seed, n, sources):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "é", "日本", "naïve", "Word", "WORD"]
    rows = []
    for _ in range(n):
        lang, s = str(rng.choice(["en", "de", "fr"], p=[0.7, 0.2, 0.1])), f"s{min(int(rng.geometric(0.2)), sources)}"
        rows.append((lang, s, " 1-".join(rng.choice(words, rng.integers(0, 40)))))
    rows += [(None, None, None), (None, "s1", ""), ("xx", "only", "a b c"), ("en", None, "12 34 _"), ("en", "SÉ", "waa " * 500), ("de", "s1", "x")]
    return rows


@pytest.mark.parametrize(("least", "top", "slice_terms", "block_groups"), [(30, 50, 1 << 14, 8), (3, 4, 16, 1), (1, 2, 7, 3)])
def test_against_plain_counts(spark, least, top, slice_terms, block_groups):
    rows = corpus(least, 500, 12)
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "lang string, source string, text string, n string, term string").repartition(5)
    got = divergence.audit_sources(docs, least_docs=least, top_terms=top, slice_terms=slice_terms, block_groups=block_groups)
    assert sorted(map(tuple, got.collect())) == plain(rows, least, top)


def test_empty_table(spark):
    assert divergence.audit_sources(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_every_block_meets_every_other_once():
    for blocks in (2, 4, 6, 10):
        met = []
        for turn in range(blocks - 1):
            at = {}
            for b in range(blocks):
                other = (2 * turn - b) % (blocks - 1)
                at[b] = turn % (blocks - 1) if b == blocks - 1 else blocks - 1 if other == b else other
            assert all(at[at[b]] == b != at[b] for b in at)
            met += [frozenset((b, at[b])) for b in at]
        assert Counter(met) == {frozenset((a, b)): 2 for a in range(blocks) for b in range(a)}


def test_rounds_in_spark(spark):
    from pyspark.sql import functions as F

    for blocks in (2, 6):
        met = Counter()
        for turn in range(blocks - 1):
            other = divergence.opponent(F.col("id").cast("int"), turn, blocks)
            for b, o, host in spark.range(blocks).select("id", other, divergence.hosts(F.col("id"), other)).collect():
                met[frozenset((b, o)), host] += 1
        assert met == {(frozenset((a, b)), h): 1 for a in range(blocks) for b in range(a) for h in (True, False)}


def test_shares_are_exact():
    rng = np.random.default_rng(0)
    count = rng.integers(0, 9 * 10**14, 200)
    size = int(9 * 10**15)
    assert divergence.share(count, np.int64(size)).tolist() == [1 + 10**9 * c // size for c in count.tolist()]


def test_only_visitors_are_shuffled(spark):
    from pyspark.sql import functions as F

    cells = divergence.resident(spark.range(40).select((F.col("id") % 4).alias("lang"), (F.col("id") % 3).alias("slice"), (F.col("id") % 8).cast("int").alias("block")), "lang", "slice", "block")
    visitors = cells.select("lang", "slice", divergence.opponent(F.col("block"), 1, 8).alias("block"))
    plan = cells.join(visitors.hint("shuffle_hash"), ["lang", "slice", "block"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
