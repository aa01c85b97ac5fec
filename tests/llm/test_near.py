"""Near-duplicate and learned operators, against brute force, planted cases and held-out rows."""

import itertools
import os
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilewright.llm import embeddings, graph, lines, packed, passages, shingles, tokens, toxicity
from tilewright.llm.common import hashed_sample


def groups(n: int, pairs) -> list[int]:
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def words(rng: random.Random, n: int) -> list[str]:
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


@pytest.mark.parametrize("n, edges", [(1, []), (40, [(i, i + 1) for i in range(39)]), (60, [(0, i) for i in range(1, 60)]), (50, [(random.Random(i).randint(0, 49), random.Random(-i - 1).randint(0, 49)) for i in range(45)])])
def test_components(spark, n, edges):
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame([*edges, (0, 0), *edges[:3]], "a long, b long")).collect()}
    want = groups(n, edges)
    assert got == {i: want[i] for i in {0} | {x for e in edges for x in e}}


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 30), st.lists(st.tuples(st.integers(0, 29), st.integers(0, 29)), max_size=40))
def test_forest(n, pairs):
    pairs = [(a % n, b % n) for a, b in pairs]
    got = graph.forest(n, [(np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int))])
    assert got.tolist() == groups(n, pairs)


def test_sample_is_the_smallest_hashes_and_bounded(spark):
    rows = spark.range(5000)
    got = hashed_sample(rows, "id", 100).collect()
    assert len(got) == 100 and hashed_sample(rows.limit(30), "id", 100).count() == 30
    assert {r["id"] for r in got} == {r["id"] for r in hashed_sample(rows.repartition(7), "id", 100).collect()}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([np.repeat(base, 6, axis=0) + 0.045 * rng.standard_normal((240, 16)), np.repeat(base[:1], 60, axis=0) + 0.03 * rng.standard_normal((60, 16)), base[:3], base[:3]]).astype(np.float32)
    label = [int(i % 3 == 0) for i in range(len(x))]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (1004, [float(v) for v in x[0]], None), (1005, [1.0, 2.0], 0), (1006, [1.0, 2.0], 0), (1007, [], 0)]
    rows = spark.createDataFrame([*((i, [float(v) for v in r], label[i], 3) for i, r in enumerate(x)), *((*o, 4) for o in odd)], "vec_id long, embedding array<float>, label int, keys int")
    got = {r["vec_id"]: r for r in embeddings.near_vectors(rows).collect()}
    d = x.astype(np.float64)
    near = (d @ d.T >= 0.98 * np.linalg.norm(d, axis=1)[:, None] * np.linalg.norm(d, axis=1)[None, :]) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(near, False)
    root = groups(len(x), zip(*np.nonzero(near)))
    found, there = sum(got[i]["n_links"] for i in range(len(x))), int(near.sum())
    assert there > 1000 and found >= 0.99 * there and all(got[i]["n_links"] <= near[i].sum() for i in range(len(x)))
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(x))]) > 0.99
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (1000, 1001, 1002, 1003, 1004, 1007))
    assert got[1005]["n_links"] == 1 and got[1006]["component_id"] == 1005 and not got[1006]["kept"]
    assert embeddings.near_vectors(rows.limit(0)).count() == 0


def edited(rng: random.Random, text: list[str], edits: int) -> list[str]:
    out = list(text)
    for _ in range(edits):
        i = rng.randrange(len(out))
        out[i : i + rng.randint(0, 1)] = [f"e{rng.randint(0, 999)}"]
    return out


def test_jaccard_against_brute_force(spark):
    rng = random.Random(2)
    base = [words(rng, 120) for _ in range(25)]
    texts = [" ".join(t) for b in base for t in (b, edited(rng, b, 1), edited(rng, b, 3), edited(rng, b, 9))]
    hot = words(rng, 150)
    texts += [" ".join(edited(rng, hot, 1)) for _ in range(40)] + [" ".join(hot)] * 25 + [None, "", " \n", "one two", "one two", "two one", "same " * 400]
    rows = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, id int, keys string")
    got = {r["doc_id"]: r for r in shingles.jaccard_join(rows).collect()}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = groups(len(sets), pairs)
    for i in range(len(texts)):
        assert got[i]["n_links"] == sum(i in p for p in pairs)
        assert got[i]["component_id"] == root[i] and got[i]["kept"] == (root[i] == i)
        assert got[i]["class_id"] == min(j for j in range(len(sets)) if sets[j] == sets[i] and (sets[i] or i == j))
    assert shingles.jaccard_join(rows.limit(0)).count() == 0


def plain_distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_edit_distance(a, b):
    assert lines.edit_distance(a, b) == plain_distance(a, b)


def test_edit_distances_of_many_pairs():
    rng, x, y = random.Random(6), [], []
    for _ in range(1200):
        n, kinds = rng.choice([0, 1, 5, 63, 64, 65, 128, 130, 200]), rng.choice([2, 40, 10**6])
        a = [rng.randint(1, kinds) for _ in range(n)]
        b = edited_numbers(rng, a, rng.randint(0, max(1, n // 3)), kinds)
        x.append(np.array(a, np.int64).tobytes())
        y.append(np.array(b, np.int64).tobytes())
    want = [lines.edit_distance(np.frombuffer(a, np.int64).tolist(), np.frombuffer(b, np.int64).tolist()) for a, b in zip(x, y)]
    assert lines.edit_distances(x, y).tolist() == want
    assert lines.similar(x, y, 4, 5).tolist() == [5 * d <= max(len(a), len(b)) // 8 for d, a, b in zip(want, x, y)]


def edited_numbers(rng: random.Random, a: list[int], edits: int, kinds: int) -> list[int]:
    out = list(a)
    for _ in range(edits):
        i = rng.randint(0, len(out))
        out[i : i + rng.randint(0, 2)] = [rng.randint(1, kinds) for _ in range(rng.randint(0, 2))]
    return out


def test_simhash_counts_bits():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    whole, parts = lines.simhashes(h, np.array([700])), lines.simhashes(h, np.array([300, 400]))
    assert (whole[0] == lines.simhashes(h[::-1].copy(), np.array([700]))[0]).all() and (parts[0] == lines.simhashes(h[:300], np.array([300]))[0]).all()


def test_line_dedup(spark):
    rng = random.Random(3)
    common, near = words(rng, 12), [f"longer{rng.randint(0, 9999)}" for _ in range(60)]
    docs = []
    for d in range(40):
        body = [" ".join(words(rng, 20)) for _ in range(3)]
        docs.append((d, "\n".join([" ".join(common).upper() + "!!", *body, " ".join([*near[: d % 60], f"changed{d}", *near[d % 60 + 1 :]]), "a b", ""])))
    docs += [(40, None), (41, ""), (42, docs[5][1]), (43, "x " * 5000), (None, docs[5][1]), (44, docs[44 - 4 - 1][1]), (44, docs[44 - 4 - 1][1])]
    rows = spark.createDataFrame([(d, t, "y", 7) for d, t in docs], "doc_id long, text string, _lines string, n_dropped int")
    got = lines.drop_repeats(rows)
    assert got.columns == ["doc_id", "text", "_lines", "n_dropped"]
    out: dict = {}
    for r in got.collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, out.values())) == len(docs)
    key = lambda s: tuple(re.findall(r"[^\W_]+", s.lower()))
    kept = [k for d in sorted(x for x in out if x is not None) for s in (out[d][0]["text"] or "").split("\n") if len(k := key(s)) >= 3]
    assert len(kept) == len(set(kept))
    everything = {k for d, t in docs if d is not None for s in (t or "").split("\n") if len(k := key(s)) >= 3}
    fuzzy = [k for k in kept if any(w.startswith("changed") for w in k)]
    assert len(fuzzy) <= 4 and len(everything) - len(kept) == 40 - len(fuzzy)
    assert out[40][0]["text"] is None and out[41][0]["text"] == "" and out[None][0]["text"] == "a b\n"
    assert out[42][0]["text"] == "a b\n" and out[0][0]["n_dropped"] == 0
    assert lines.drop_repeats(rows.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=14, unique=True))
def test_best_chain(anchors):
    """Against all chains; at k = 1 no two anchors overlap, and on one diagonal there is no gap."""
    a, b = [x for x, _ in anchors], [y for _, y in anchors]
    step = lambda i, j: 0.0 if a[i] - b[i] == a[j] - b[j] else 0.01 * (a[j] - a[i] + b[j] - b[i])
    best = [1.0] * len(a)
    order = sorted(range(len(a)), key=lambda i: (a[i], b[i]))
    for n, i in enumerate(order):
        best[i] = max([1.0, *(best[j] + 1 - step(j, i) for j in order[:n] if a[j] < a[i] and b[j] < b[i])])
    got = passages.chain(a, b, 1, 0.01, 1000)[0]
    assert len(got) - sum(map(step, got, got[1:])) == pytest.approx(max(best)) and all(a[i] < a[j] and b[i] < b[j] for i, j in zip(got, got[1:]))


def test_passages(spark):
    rng = random.Random(4)
    exact, fuzzy, own = words(rng, 70), words(rng, 80), words(rng, 60)
    docs, planted = [], set()
    for d in range(60):
        t = words(rng, 150)
        if d % 3 == 1:
            t[50:50] = exact
            planted.add(d)
        if d % 7 == 2:
            f = list(fuzzy)
            for i in rng.sample(range(80), 3):
                f[i] = f"e{rng.randint(0, 999)}"
            t[20:20] = f
            planted.add(d)
        docs.append((d, " ".join(t)))
    docs += [(60, None), (61, ""), (62, "few words"), (63, " ".join([*own, *words(rng, 30), *own])), (64, "again and " * 3000), (None, docs[1][1]), (65, docs[0][1]), (66, "again and " * 2000)]
    rows = spark.createDataFrame([(d, t, 3) for d, t in docs], "doc_id long, text string, h int")
    got = passages.find_passages(rows).collect()
    text = {d: (t or "").split() for d, t in docs if d is not None}
    assert {r["doc_id"] for r in got} | {r["other_id"] for r in got} == planted | {0, 65, 64, 66, None}
    assert any(r["doc_id"] is None and r["other_id"] == 1 and r["matched"] >= 150 for r in got) and all(r["other_id"] is not None for r in got)
    for r in got:
        assert (r["doc_id"] is None or r["other_id"] < r["doc_id"]) and r["end"] - r["start"] >= 45
        if r["doc_id"] in planted and r["doc_id"] % 7 != 2:
            assert text[r["doc_id"]][r["start"] : r["end"]] == exact == text[r["other_id"]][r["other_start"] :][:70]
    assert next(r for r in got if r["doc_id"] == 65)["matched"] == 150
    assert passages.find_passages(rows.limit(0)).count() == 0


def test_ordinal_thresholds_ascend_and_share_weights():
    rng = np.random.default_rng(5)
    n, x = 600, rng.random(600)
    grade = np.digitize(4 * x - 2 + 0.5 * rng.standard_normal(n), [-1, 0, 1])
    w, theta = toxicity.fit_ordinal(np.arange(n), np.zeros(n, int), x, grade, 1, steps=600)
    assert w[0] > 2 and (np.diff(theta) > 0).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels.where("doc_id % 4 <> 0"))
    got = toxicity.rate_documents(docs, model).withColumnRenamed("toxic", "says").join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    clean = [r for r in got if not r["toxic"]]
    assert sum(r["says"] for r in clean) <= 0.03 * len(clean)
    assert sum(r["says"] for r in got if r["toxic"]) >= 0.7 * (len(got) - len(clean))


def test_toxicity_edges(spark):
    rows = [(i, f"plain words number{i} here are fine" if i % 2 else f"you idiot number{i} are a moron", "z") for i in range(80)] + [(80, None, "z"), (81, "", "z"), (81, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(60)], "doc_id long, toxic int")
    got = toxicity.rate_documents(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert len(got) == 83 and all(r["toxic"] == (r["doc_id"] < 80 and r["doc_id"] % 2 == 0) for r in got)
    assert toxicity.fit_toxicity(docs, labels.limit(0)) is None and not any(r["toxic"] for r in toxicity.rate_documents(docs, None).collect())
    assert toxicity.rate_documents(docs.limit(0), None).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["Abc", "abc", " ", "\n", ", ", "É", "x9", "-", "longword", "longwords"]), max_size=14).map("".join), min_size=1, max_size=5), st.integers(1, 3))
def test_sketches_of_lines(texts, least):
    found = lines.Lines(texts)
    use = np.flatnonzero(found.n >= least)
    want = [(i, k, tuple(w)) for i, t in enumerate(texts) for k, line in enumerate(t.split("\n")) if len(w := normalised(line)) >= least]
    assert list(zip(found.text[use].tolist(), found.number[use].tolist())) == [(i, k) for i, k, _ in want]
    assert len(set(found.hash[use].tolist())) == len({w for _, _, w in want}) == len({(x, w) for x, (_, _, w) in zip(found.hash[use].tolist(), want)})
    words, n = found.words_of(use)
    assert n.tolist() == [len(w) for _, _, w in want] and len({(h, w) for h, w in zip(words.tolist(), (x for _, _, w in want for x in w))}) == len({x for _, _, w in want for x in w})


def normalised(line: str) -> list[bytes]:
    return re.findall(rb"[a-z0-9\x80-\xff]+", tokens.lowered(line))


def test_repeated_ids_with_other_texts_keep_their_own_lines(spark):
    """A line goes from the row that repeats it, not from another row of the same id; null ids come last."""
    docs = [(7, "one two three four\nalpha beta gamma delta"), (7, "own words stand here\nepsilon zeta eta theta"), (9, "iota kappa lambda my\nepsilon zeta eta theta"), (None, "alpha beta gamma delta\nonly here is this"), (8, "one two three four"), (8, "one two three four")]
    got = {(r["doc_id"], r["text"]) for r in lines.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(7, docs[0][1]), (7, docs[1][1]), (9, "iota kappa lambda my"), (None, "only here is this"), (8, "")}


def test_dense_and_hot_buckets_give_the_same_groups(spark):
    rng = random.Random(8)
    base = words(rng, 24)
    docs = [(d, " ".join([*base[: d % 24], f"c{d}", *base[d % 24 + 1 :]])) for d in range(150)]
    chain = [" ".join([*(f"x{k}" for k in range(d)), *(f"y{k}" for k in range(d, 24))]) for d in range(0, 25, 2)]  # each similar to the next, not to all
    docs += [(500 + i, t) for i, t in enumerate(chain)] + [(1000 + d, " ".join(words(rng, 24))) for d in range(40)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    want = {d: int(0 < d < 1000 and d != 500) for d, _ in docs}
    for limits in ((4096, 16, 256), (20, 0, 256), (4096, 16, 3)):
        assert {r["doc_id"]: r["n_dropped"] for r in lines.drop_repeats(rows, limits=limits).collect()} == want


def test_lines_at_the_threshold_are_linked(spark):
    """Pairs at an edit similarity of 0.8 exactly, their edits spread evenly, which leaves the fewest pairs of words."""
    rng = random.Random(12)
    docs = []
    for d in range(300):
        line = [f"w{rng.randint(0, 10**7)}" for _ in range((5, 10, 20, 40)[d % 4])]
        docs += [(2 * d, " ".join(line)), (2 * d + 1, " ".join(f"e{rng.randint(0, 10**7)}" if i % 5 == 2 else w for i, w in enumerate(line)))]
    got = {r["doc_id"]: r["n_dropped"] for r in lines.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[2 * d + 1] for d in range(300)) >= 290 and not any(got[2 * d] for d in range(300))


def test_short_and_unspaced_lines_repeat_too(spark, tmp_path):
    from tilewright.llm.queries import op4_line_dedup

    line = "\u672c\u30b5\u30a4\u30c8\u306e\u6587\u7ae0\u306e\u7121\u65ad\u8ee2\u8f09\u3092\u7981\u3058\u307e\u3059\u3002"
    docs = [(0, f"Read more\n{line}\nMenu\n\n---"), (1, f"menu!\nother words\n{line}\n\n---"), (2, f"READ more\n{line.replace(line[4], line[0])}\nwords other")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: (0, docs[0][1]), 1: (2, "other words\n\n---"), 2: (2, "words other")}
    assert normalised("Abc \u4e2d\u6587x") == [b"abc", "\u4e2d".encode(), "\u6587".encode(), b"x"]


def test_passage_whose_parts_come_earlier_elsewhere(spark):
    rng = random.Random(21)
    docs, want = [], set()
    for n in range(25):
        whole, d = words(rng, 60), 5 * n
        parts = [whole[:30], whole[30:], whole, [*whole[:30], *words(rng, 9), *whole[30:]][:36], whole]
        docs += [(d + i, " ".join([*words(rng, 40), *p, *words(rng, 40)])) for i, p in enumerate(parts)]
        want.add((d + 4, d + 2))
    got = passages.find_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert want <= {(r["doc_id"], r["other_id"]) for r in got if r["matched"] >= 60}


def test_edited_passages_down_to_the_identity(spark):
    """Passages of 60 words with 6, 9 and 12 edits, at random and evenly spread."""
    rng = random.Random(22)
    docs, kinds = [], [(n, even) for n in (6, 9, 12) for even in (False, True)]
    for d in range(240):
        n, even = kinds[d % 6]
        whole = words(rng, 60)
        edits = {i * 60 // n + 2 for i in range(n)} if even else set(rng.sample(range(60), n))
        docs += [(2 * d, " ".join([*words(rng, 60), *whole])), (2 * d + 1, " ".join([*words(rng, 30), *(f"e{rng.randint(0, 10**7)}" if i in edits else w for i, w in enumerate(whole))]))]
    got = {r["doc_id"] // 2 for r in passages.find_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = {kind: sum(d in got for d in range(i, 240, 6)) for i, kind in enumerate(kinds)}
    assert all(n >= 36 for n in found.values()), found


@pytest.mark.parametrize("kind", ["offset", "low rank", "clustered", "plain"])
def test_links_are_found_whatever_the_shape_of_the_cloud(spark, kind):
    rng = np.random.default_rng(3)
    n, d = 900, 32
    base = rng.standard_normal((n // 3, 4 if kind == "low rank" else d))
    near = np.concatenate([base + s * rng.standard_normal(base.shape) * np.linalg.norm(base, axis=1, keepdims=True) / base.shape[1] ** 0.5 for s in (0, 0.18, 0.2)])
    if kind == "low rank":
        near = near @ rng.standard_normal((4, d))
    if kind == "offset":
        near += 3 * np.linalg.norm(near, axis=1).mean() * np.ones(d) / d**0.5
    if kind == "clustered":
        near += 6 * rng.standard_normal((5, d))[rng.integers(0, 5, n // 3)][np.tile(np.arange(n // 3), 3)]
    x = near.astype(np.float32)
    rows = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(rows).collect()}
    u = x.astype(np.float64)
    close = u @ u.T >= 0.98 * np.linalg.norm(u, axis=1)[:, None] * np.linalg.norm(u, axis=1)[None, :]
    there = int(close.sum()) - n
    assert there > 300 and sum(got.values()) >= 0.999 * there


def common_run(a: list[str], b: list[str]) -> int:
    """Words of the longest stretch that both hold."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0, *(row[j] + 1 if x == y else 0 for j, y in enumerate(b))]
        best = max(best, *row)
    return best


def test_exact_passages_against_all_pairs_of_documents(spark):
    """Pieces of a pool, cut anywhere, in documents that share parts of them with many others."""
    rng = random.Random(31)
    pool, docs = [words(rng, 120) for _ in range(6)], []
    for d in range(70):
        piece, n = rng.choice(pool), rng.choice((20, 30, 40, 50, 55, 70))
        at = rng.randint(0, 120 - n)
        docs.append((d, [*words(rng, 25), *piece[at : at + n], *words(rng, 25)]))
    got = {r["doc_id"] for r in passages.find_passages(spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string"), many=3).collect()}
    runs = {d: max([0, *(common_run(t, o) for _, o in docs[:d])]) for d, t in docs}
    assert {d for d, n in runs.items() if n >= 50} <= got and not any(runs[d] < 30 for d in got)
    assert sum(n >= 50 for n in runs.values()) >= 10


def test_line_groups_against_all_pairs(spark):
    """Dense groups whose lines lie around the threshold from one another: as many lines stay as there are groups by brute force."""
    rng = random.Random(41)
    docs = []
    for _ in range(3):
        base = words(rng, 30)
        for _ in range(110):
            line = list(base)
            for i in rng.sample(range(30), rng.choice((1, 2, 3, 4, 5, 6))):
                line[i] = f"v{rng.randint(0, 10**6)}"
            docs.append((len(docs), " ".join(line)))
    text = [t.split() for _, t in docs]
    near = [(i, j) for i in range(len(text)) for j in range(i) if 5 * sum(x != y for x, y in zip(text[i], text[j])) <= 30]
    root = groups(len(text), near)
    got = {r["doc_id"]: r["n_dropped"] for r in lines.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert 3 <= len(set(root)) and len(near) > 2000
    assert sum(got[d] == int(root[d] != d) for d in got) >= 0.99 * len(got)


def test_vectors_of_doubles(spark):
    """Compared as doubles, of any size, and rows without an id."""
    a = np.array([1.0, 0.0])
    at = lambda c, scale=1.0: (scale * np.array([c, np.sqrt(1 - c * c)])).tolist()
    just, under = 0.98 + 1e-12, 0.98 - 1e-9  # equal as floats
    rows = [(1, a.tolist(), 1), (2, at(just), 1), (3, a.tolist(), 2), (4, at(under), 2), (5, (1e300 * a).tolist(), 3), (6, at(0.99, 1e300), 3), (7, (1e-300 * a).tolist(), 4), (8, at(0.99, 1e-300), 4), (None, [1.0, 5.0], 5), (None, [3.0, 3.0], 6), (9, [3.0, 3.0], 6)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    links = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None}
    assert links == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (1, 5, True), 6: (1, 5, False), 7: (1, 7, True), 8: (1, 7, False), 9: (1, 9, True)}
    assert sorted((r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None) == [(0, None, True), (1, 9, False)]


def test_lines_of_a_template_are_compared_with_all_others(spark):
    """Lines of one template, most of them near by SimHash and unlike: those that go are those of brute force, with keys that batches split as well."""
    rng = random.Random(600)
    base, docs, spots = [f"w{i}" for i in range(20)], [], []
    for d in range(400):
        spots = rng.sample(range(20), 4) if d % 2 == 0 else spots
        docs.append([f"v{rng.randint(0, 30)}" if i in spots else w for i, w in enumerate(base)])
    root = groups(400, [(i, j) for i in range(400) for j in range(i) if sum(x != y for x, y in zip(docs[i], docs[j])) <= 4])
    gone = {d for d in range(400) if root[d] != d}
    rows = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string")
    for limits in (lines.LIMITS, (1024, 16, 60)):
        got = {r["doc_id"] for r in lines.drop_repeats(rows, limits=limits).collect() if r["n_dropped"]}
        assert len(gone - got) <= 0.01 * len(gone), (len(gone), len(gone - got))


def test_components_need_no_round_for_few_edges(spark):
    """A long chain: joined up by one task, or by rounds while more than `few` edges are left; two jobs suffice where there are few."""
    edges = [(i, i + 1) for i in range(0, 3000) if i % 500] + [(7, 7), (9001, 9000)]
    want = groups(9002, edges)
    rows, tracker = spark.createDataFrame(edges, "a long, b long"), spark.sparkContext.statusTracker()
    for few in (1 << 19, 700, 0):
        spark.sparkContext.setJobGroup(f"few {few}", "")
        got = {r["node"]: r["component"] for r in graph.components(rows, few=few).collect()}
        assert got == {i: want[i] for i in {x for e in edges for x in e}}
    assert len(tracker.getJobIdsForGroup(f"few {1 << 19}")) <= 6 < len(tracker.getJobIdsForGroup("few 0"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_unlike_lines_of_a_common_key_are_no_dense_key():
    """Of 3,000 lines under one key, few of which are near others, all near pairs are found at once; nothing is left to compare again."""
    rng = np.random.default_rng(9)
    e = np.zeros(3000, lines.ENTRY)
    e["id"], e["n"], e["sim"] = np.arange(3000), rng.integers(4, 200, 3000), rng.integers(0, 1 << 63, (3000, 2), dtype=np.uint64)
    e["sim"][1500:1600], e["n"][1500:1600] = e["sim"][:100] ^ np.uint64(5), e["n"][:100]
    prune = lines.Prune(4, 5)
    x, y = np.triu_indices(3000, 1)
    ok = prune.pairs(e, x, y)
    got = [b for b in prune.meet(e.tobytes()) if b.num_rows]
    assert {k for b in got for k in b.column(2).to_pylist()} == {lines.PAIR} and len(ok) >= 100
    assert sorted((p, q) for b in got for p, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist())) == sorted(zip(x[ok].tolist(), y[ok].tolist()))


def test_edited_passages_of_common_phrases(spark):
    """Passages of 60 words with 6 edits; documents before and between hold 20-word parts only."""
    rng = random.Random(23)
    docs, want = [], set()
    for n in range(40):
        whole, d = words(rng, 60), 20 * n
        parts = [whole[a : a + 20] for a in (0, 20, 40, 10, 30)]
        copy = [f"e{rng.randint(0, 10**7)}" if i % 10 == 4 else w for i, w in enumerate(whole)]
        docs += [(d + i, " ".join([*words(rng, 40), *p, *words(rng, 40)])) for i, p in enumerate([*parts, whole, *parts, copy])]
        want.add((d + 11, d + 5))
    got = {(r["doc_id"], r["other_id"]) for r in passages.find_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r["matched"] >= 45}
    assert len(want & got) >= 36, len(want & got)


def test_lines_of_dense_keys_are_a_row_each(spark, monkeypatch):
    """500 lines under 23 dense keys each: 500 rows (before: 11,500), and what is summed up of each key is right; groups are the same if keys have many blocks."""
    rng = np.random.default_rng(4)
    ids, k = rng.integers(-(1 << 62), 1 << 62, 500), np.repeat(rng.integers(0, 1 << 63, 23, dtype=np.uint64), 500).reshape(23, 500)
    asked = spark.createDataFrame([(int(x),) for x in k[1:, 0].astype(np.int64)], "k long")
    sketched = lambda batches: ((ids, np.zeros((500, 2), np.uint64), np.full(500, 9, np.uint16), k) for b in batches if b.num_rows)
    rows = lines._members(spark.createDataFrame([(0,), (1,)], "n int").repartition(2), asked, sketched).withColumn("component", F.col("id"))
    assert rows.count() == 500
    tally = rows.mapInArrow(lines.tallied, lines.TALLY).groupBy("k").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).join(asked, "k").collect()
    assert {(r["n"], r["low"], r["high"]) for r in tally} == {(500, int(ids.min()), int(ids.max()))} and len(tally) == 22
    monkeypatch.setattr(lines, "BLOCK", 50)
    test_lines_of_a_template_are_compared_with_all_others(spark)


def test_pairs_of_small_keys_are_looked_at_in_small_pieces(spark):
    """2,000 keys of 40 lines take 40 MB at most (before: 89); texts that lose lines are merged, as a broadcast puts two Python workers in a task."""
    rng = np.random.default_rng(2)
    e = np.zeros(80_000, lines.ENTRY)
    e["k"], e["id"], e["n"], e["sim"] = np.arange(80_000) // 40 * 65537 + 1, np.arange(80_000), 9, rng.integers(0, 1 << 63, (80_000, 2), dtype=np.uint64)
    tracemalloc.start()
    found = sum(b.num_rows for b in lines.Prune(4, 5).meet(e.tobytes()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 46 and peak < 40e6, (found, peak)
    rows = lines.drop_repeats(spark.createDataFrame([(1, "one two three four"), (2, "one two three four")], "doc_id long, text string"))
    assert "strategy=merge" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_a_document_sends_its_own_blocks_once(spark):
    """A document that shares a passage with 20 earlier ones, of three blocks each: 3 + 60 blocks are sent (before: 120), all passages are found."""
    rng = random.Random(5)
    shared = words(rng, 60)
    texts = spark.createDataFrame([(d, " ".join([*words(rng, 60), *shared, *words(rng, 60)])) for d in range(21)], "doc_id long, text string")
    anchors = list(range(60, 116, 8))
    chains = spark.createDataFrame([(20, d, 0, anchors, anchors) for d in range(20)], "doc_id long, other_id long, n int, a array<int>, b array<int>")
    found = passages._align(texts, chains, 4, 45, 0.8)
    assert {tuple(r) for r in found.collect()} == {(20, 60, 120, d, 60, 60) for d in range(20)}

    def joins(plan):
        name, kids = plan.nodeName(), plan.children()
        if name.startswith("AdaptiveSparkPlan"):
            return joins(plan.executedPlan())
        if "QueryStage" in name:
            return joins(plan.plan())
        own = [plan.metrics().apply("numOutputRows").value()] if "Join" in name else []
        return own + [n for i in range(kids.size()) for n in joins(kids.apply(i))]

    assert max(joins(found._jdf.queryExecution().executedPlan())) == 63


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=12), min_size=2, max_size=20), st.integers(1, 8), st.booleans())
def test_words_shared_are_counted(texts, common, two):
    n, w = np.array([len(t) for t in texts]), np.array([x for t in texts for x in t], np.uint64)
    left, right = (np.arange(len(texts))[s::2] for s in (0, 1)) if two else (np.arange(len(texts)),) * 2
    got = lines.words_shared(w, n, left, right, common)
    assert all(got[i, j] == sum((Counter(texts[a]) & Counter(texts[b])).values()) for i, a in enumerate(left) for j, b in enumerate(right) if a != b)


def test_lines_that_meet_are_packed_by_blocks(spark, monkeypatch):
    """300 lines of a template under 23 keys of six blocks each: joined by line, they are 300 rows, and packed a row for each key and pair of blocks (before:
    41,400 rows joined); all pairs meet once a key; words are compared of pairs that share enough of them only (before: of all near by SimHash)."""
    rng = np.random.default_rng(8)
    base, prune, met, compared = rng.integers(0, 1 << 63, 20, dtype=np.uint64), lines.Prune(4, 5), {}, []
    ids, keys = rng.integers(-(1 << 62), 1 << 62, 300).tolist(), rng.integers(-(1 << 62), 1 << 62, 23)
    texts = [np.where(rng.permutation(20) < 4, rng.integers(0, 1 << 63, 20, dtype=np.uint64), base) for _ in ids]
    sims = lines.simhashes(np.concatenate(texts), np.full(300, 20))
    rows = [(i, s.tobytes(), i, [keys[:9].tobytes(), keys[5:].tobytes()], t.tobytes()) for i, s, t in zip(ids, sims, texts)]
    members = spark.createDataFrame(rows, "id long, sim binary, component long, ks array<binary>, words binary").coalesce(1)
    monkeypatch.setattr(lines, "MET", 50)
    monkeypatch.setattr(lines, "similar", lambda x, y, *s, f=lines.similar: compared.append(len(x)) or f(x, y, *s))
    meet = members.mapInArrow(lines._to_meetings(members), lines.MEETING).orderBy("k", "i", "j")
    packed = meet.toArrow().combine_chunks().to_batches()
    assert sum(b.num_rows for b in packed) == 23 * 21
    for k, i, j, head, words in ([*r.values()] for b in packed for r in b.to_pylist()):
        h = np.frombuffer(head, lines.HEAD)
        assert len(words) == 8 * h["n"].sum()
        a, b = (h["id"][h["own"] == s].tolist() for s in (0, 1))
        for pair in [frozenset(p) for p in (((x, y) for x in a for y in b) if i < j else itertools.combinations(a, 2))]:
            met[k, pair] = met.get((k, pair), 0) + 1
    assert len(met) == 23 * 300 * 299 // 2 and set(met.values()) == {1}
    near = [(a, b) for a, b in itertools.combinations(range(300), 2) if (texts[a] != texts[b]).sum() <= 4]
    links = {frozenset(map(ids.index, p)) for b in lines.compared_blocks(prune, iter(packed)) for p in zip(*b.to_pydict().values())}
    assert groups(300, links) == groups(300, near) and 0 < sum(compared) <= 23 * len(near)


def test_a_task_gives_free_memory_back():
    """60 MB of small pieces, freed below one that stays: the system gets them back when a task ends (before: the worker kept them)."""
    held = [bytes(2000) for _ in range(30_000)]
    last = bytes(2000)
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    del held
    before = resident()
    packed.released()
    assert resident() < before - 30e6 and last


def test_entries_of_lone_keys_are_not_sorted(monkeypatch):
    """Of 245,000 entries, all but some under keys of their own, few are sorted where they are passed on and where they meet (before: all of them)."""
    rng = np.random.default_rng(3)
    e = np.zeros(245_000, lines.ENTRY)
    e["k"], e["id"], e["n"] = rng.integers(0, 1 << 63, len(e), dtype=np.uint64), np.arange(len(e)), 9
    e["k"][1000:1040] = e["k"][:40]
    ordered = []
    for name in ("argsort", "lexsort"):
        monkeypatch.setattr(np, name, lambda x, *s, f=getattr(np, name), **o: ordered.append(len(x[-1]) if isinstance(x, tuple) else len(x)) or f(x, *s, **o))
    assert len(lines.apart(e)) == len(e) and max(ordered, default=0) == 0
    found = [r for b in lines.Prune(4, 5).meet(e.tobytes()) for r in zip(*b.to_pydict().values())]
    assert set(found) == {(i, 1000 + i, lines.PAIR) for i in range(40)} and max(ordered) < len(e) // 2
    e["k"][5000:8000] = 77
    split = lines.apart(e)
    assert (split["n"] >= lines.SPLIT).sum() == 3000 and (split["n"] & lines.LED > 0).sum() == 1 and len(split) == len(e) + 1 and max(ordered) < len(e) // 2
