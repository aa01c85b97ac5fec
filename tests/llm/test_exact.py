"""Operators with exact contracts, against plain versions."""

import hashlib
import itertools
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import bpe, chat, packing, pii, quality, toxicity
from tilewright.llm.queries import tokenizer

pytestmark = pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="needs the public vocabularies")
ODD = ["", " ", "  a", "a  b   c\n\n d \t e", "<|endoftext|>x <|endoftext|>", "it's we'll 'tis", "aaaaaaaaaaaaaaa", "99999 XXXXX 0000000", "日本 é ﬁ ²", "a\x0bb\x1cc\xa0d", "ΣΑΣ İx", "!!'s ?'re", "x" * 3000, "\\<|im_end|>\\"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load(open(tokenizer("byte_bpe_50k.json"), encoding="utf-8").read()))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


TEXTS = st.text(st.sampled_from("ab'sStTdDéé12²!. \n\t<|>ΣİA-_日🙂"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_bpe_is_the_librarys(codec, library, text):
    want = library["byte_bpe_50k.json"].encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == want
    assert codec.decode(want) == library["byte_bpe_50k.json"].decode(want, skip_special_tokens=False) == text


def test_bpe_odd_texts(codec, library):
    for t in ODD:
        assert codec.encode(t) == library["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids


def greedy(word: list[int], rank: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    while True:
        best = min(((rank[p][0], i) for i, p in enumerate(zip(word, word[1:])) if p in rank), default=None)
        if best is None:
            return word
        word = [*word[: best[1]], rank[word[best[1]], word[best[1] + 1]][1], *word[best[1] + 2 :]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=12), st.lists(st.integers(0, 2), max_size=14))
def test_automaton_of_any_merges(pairs, word):
    spelled, merges, rank = [b"a", b"b", b"c"], [], {}
    for u, v in pairs:
        u, v = u % len(spelled), v % len(spelled)
        s = spelled[u] + spelled[v]
        if (u, v) in rank or s in spelled or len(s) > 12:
            continue
        rank[u, v] = (len(merges), len(spelled))
        merges.append((u, v, len(spelled)))
        spelled.append(s)
    a = bpe.MergeAutomaton(merges, spelled)
    assert a.encode_word(b"".join(spelled[w] for w in word)) == greedy(list(word), rank)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_chunks_are_the_librarys(library, text):
    e = packing.encoder(open(tokenizer("word_bpe_49k.json"), encoding="utf-8").read())
    assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == library["word_bpe_49k.json"].encode(text, add_special_tokens=False).ids


def test_digests_of_a_table(spark, library):
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate([*ODD, None, "same", "same"])], "doc_id long, text string, id string, ids int")
    got = {r["doc_id"]: r for r in bpe.digest_documents(rows, tokenizer("byte_bpe_50k.json")).collect()}
    assert len(got) == len(ODD) + 3
    for i, t in enumerate([*ODD, ""]):
        ids = library["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    back = bpe.encode_documents(rows, tokenizer("byte_bpe_50k.json")).where("doc_id = 5").first()
    assert back["decoded"] == ODD[5] and bpe.encode_documents(rows.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([1, 2, 10, 31]), st.lists(st.tuples(st.integers(1, 31), st.integers(0, 6)), max_size=12))
def test_packing_plan(capacity, lengths):
    hist = Counter()
    for n, c in lengths:
        hist[min(n, capacity)] += c
    bins: dict[int, list] = {}
    placed = Counter()
    for length, first, n, each, seq, offset in packing.plan_runs(hist, capacity):
        assert first == placed[length]
        placed[length] += n
        for i in range(n):
            bins.setdefault(seq + i // each, []).append((offset + i % each * length, length))
    assert placed == +hist
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in items) <= 2


def test_packing_a_table(spark, library):
    texts = [None, "", "a b c", "a b c", "long words here " * 4000, *(f"word {i} " * (i * 7 % 90) for i in range(80))]
    rows = spark.createDataFrame([(i, t, 5, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int, salt int")
    got = packing.pack_documents(rows, tokenizer("word_bpe_49k.json"), capacity=256).collect()
    seqs: dict[int, list] = {}
    for r in got:
        ids = [*library["word_bpe_49k.json"].encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        piece = ids[r["start"] : r["start"] + r["length"]]
        assert r["start"] == 256 * r["piece"] and len(piece) == r["length"] and zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(n for s in seqs.values() for _, n in s) == sum(len(library["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    for s in seqs.values():
        assert [o for o, _ in sorted(s)] == list(np.cumsum([0, *(n for _, n in sorted(s))])[:-1]) and sum(n for _, n in s) <= 256
    assert packing.pack_documents(rows.limit(0), tokenizer("word_bpe_49k.json")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb\\", "<|im_end|>"]), st.lists(st.sampled_from(["a", "n", "\\", "|", "<", "\n", "<|im_end|>"]), max_size=12).map("".join)), max_size=6))
def test_chat_round_trip(turns):
    turns = [{"role": r, "content": c} for r, c in turns]
    r = chat.render_spans(turns, chat.chatml)
    assert chat.parse_chatml(r.text) == turns and not r.rewrites
    assert [chat.unescape(r.text[a:b]) for a, b in r.contents] == [t["content"] for t in turns]
    assert "".join(r.text[a:b] for a, b in r.spans) == r.text


def test_rewriting_template_is_found():
    drop = lambda turns: "".join(t["content"] if i == len(turns) - 1 else t["content"].replace("think", "") for i, t in enumerate(turns))
    assert chat.render_spans([{"role": "a", "content": "think x"}, {"role": "b", "content": "y"}], drop).rewrites == [1]
    assert not chat.render_spans([{"role": "a", "content": "x"}, {"role": "b", "content": "y"}], drop).rewrites


def test_chat_table(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "hi"), (1, 0, "user", None), (2, 0, None, ""), (2, None, "user", "x"), (None, 0, "user", "n"), (3, 0, "user", "same"), (3, 0, "user", "same")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_conversations(chat.added_conversation(rows)).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["loss_chars"] == 2 and got[1]["loss_sha256"] == hashlib.sha256(b"hi").hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nhi\n").hexdigest()
    assert got[-1]["loss_chars"] == len(chat.ADDED) and got[3]["n_turns"] == 2 and got[None]["n_turns"] == 1 and got[2]["n_turns"] == 2
    r = got[-1]
    assert chat.unescape(r["formatted"][r["loss_starts"][0] : r["loss_ends"][0]]) == chat.ADDED and r["formatted_chars"] == len(r["formatted"])
    assert chat.format_conversations(rows.limit(0)).count() == 0


EMAIL, IP, CARD, PHONE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t: str) -> list:
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(t)] + [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits(m)))) % 10 == 0]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "1", "4", "111", "@", ".", " ", "-", "+", "(", ")", "%", "25", "b.c", "x@y.z", "4111 1111 1111 1111", "+1 (555) 123-4567", "é"]), max_size=18).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_skip_edges_carry_labels():
    """A token in a telling context makes the same token elsewhere one too."""
    field = pii.Field(np.zeros((pii.N_FEATURES, len(pii.LABELS))), np.zeros((len(pii.LABELS),) * 2), 3.0)
    unary = np.zeros((3, len(pii.LABELS)))
    unary[0, 5], unary[1, 0], unary[2, 0] = 6.0, 3.0, 0.5
    p = pii.marginals(field, unary, pii.edges_of(["0123456789abcdef", "zzzz1", "0123456789abcdef"]))
    assert p[2].argmax() == 5 and p[1].argmax() == 0
    exact = np.exp(unary[0][:, None] + unary[2][None, :] + np.eye(len(pii.LABELS)) * 3.0)
    q = pii.marginals(field, unary[[0, 2]], [(0, 1, True)], rounds=40)
    assert np.allclose(q[1], exact.sum(0) / exact.sum(), atol=1e-6)  # on a tree the messages are exact


def test_personal_data_table(spark):
    secret = "0f9a8b7c6d5e4f3a2b1c0d9e8f7a6b5c4d3e2f1a"
    texts = [None, "", "no data here", f'token = "{secret}" and mail me@x.example.com', "call +1 (555) 123-4567", "4111 1111 1111 1111 ok", *(f'x token = "{secret[i:]}{secret[:i]}" y' for i in range(30)), *("plain words only %d" % i for i in range(30))]
    rows = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, id string, spans string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(rows, pii.fit_field(rows)).collect()}
    assert got[0]["spans"] == "" == got[2]["spans"] and got[3]["n_email"] == 1 and got[4]["n_phone"] == 1 and got[5]["n_card"] == 1
    assert secret not in got[3]["masked"] and "me@x" not in got[3]["masked"]
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in plain_spans(t or "")).encode()).hexdigest()
    assert pii.find_personal_data(rows.limit(0), pii.fit_field(rows.limit(0))).count() == 0


def plain_counts(text: str) -> list[int]:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    marked = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bé", "#", " ", " ", "\n", "\x0b", "\x1c", "\x85", "c d e", "c d e\n"]), max_size=40).map("".join))
def test_quality_counts(text):
    assert quality.statistics(text)[0] == plain_counts(text)


def test_forest_is_monotone_and_learns():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = (x[:, 0] + 0.3 * rng.standard_normal(800) - x[:, 1] > 0).astype(float)
    f = quality.fit_forest(x[:600], y[:600], [1, -1, 0], trees=30)
    assert ((f.score(x[600:]) > 0.5) == y[600:]).mean() > 0.75
    grid = np.tile(rng.random((20, 3)), (30, 1))
    for j, sign in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, j] = np.repeat(np.linspace(0, 1, 30), 20)
        assert (sign * np.diff(f.score(g).reshape(30, 20), axis=0) >= -1e-12).all()


def test_quality_table(spark):
    good = [" ".join(f"word{(i * 31 + j * 7) % 997}" for j in range(80)) for i in range(60)]
    bad = [" ".join(f"w{(i * 13 + j) % 991}###" for j in range(80)) for i in range(60)]
    texts = [*good, *bad, None, "", "too few words", "again and again " * 40]
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in enumerate(texts)], "doc_id long, text string, y string, kept boolean")
    labels = spark.createDataFrame([*((i, int(i < 60)) for i in range(0, 120, 2)), (None, 1), (500, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judge(docs, quality.fit_quality(docs, labels)).collect()}
    assert all(got[i]["kept"] == (i < 60) for i in range(120))
    assert not any(got[i]["kept"] for i in range(120, 124)) and all(got[i]["base_failed"] for i in range(120, 124))
    assert quality.fit_quality(docs, labels.limit(0)) is None
    assert quality.judge(docs, None).where("kept").count() == 120 and quality.judge(docs.limit(0), None).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9))
def test_sure_candidates_stay_without_a_label(seed, n):
    """What find_spans() leaves out: no label reaches 0.6 where all lie SURE below none, whatever chain, skip edges and unaries."""
    rng = np.random.default_rng(seed)
    k = len(pii.LABELS)
    field = pii.Field(np.zeros((1, k)), rng.choice([-0.5, 0.5, 0.1], (k, k)), float(rng.uniform(0.5, 4)))
    unary = np.concatenate([rng.uniform(0, 3, (n, 1)), -pii.SURE - rng.exponential(0.5, (n, k - 1))], axis=1)
    edges = pii.edges_of([rng.choice(["token-of-12-a", "token-of-12-b", "9999"]) for _ in range(n)])
    assert pii.marginals(field, unary, edges)[:, 1:].max() < 0.6


def test_loopy_marginals_come_close_to_enumeration():
    """On small loops (chain and skip edges) with weak potentials."""
    rng = np.random.default_rng(7)
    k = len(pii.LABELS)
    for _ in range(5):
        field = pii.Field(np.zeros((1, k)), rng.uniform(-0.3, 0.3, (k, k)), 0.5)
        unary = rng.normal(size=(4, k))
        edges = pii.edges_of(["9999", "8888", "9999", "8888"])
        total = np.zeros((4, k))
        for labels in itertools.product(range(k), repeat=4):
            score = sum(unary[i, y] for i, y in enumerate(labels)) + sum((field.skip * (labels[a] == labels[b])) if skip else field.chain[labels[a], labels[b]] for a, b, skip in edges)
            for i, y in enumerate(labels):
                total[i, y] += np.exp(score)
        assert np.abs(pii.marginals(field, unary, edges) - total / total.sum(axis=1, keepdims=True)).max() < 0.03


def test_very_long_digit_runs_are_no_addresses():
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)]
    assert pii.base_spans("9" + "1" * 5000 + ".1.1.1") == [] == pii.base_spans("256.1.1.1")
    assert pii.base_spans("at 255.0.0.1") == [("ip", 3, 12)]


def fewest_bins(sizes: list[int], capacity: int) -> int:
    """By trying all ways."""
    best = len(sizes)

    def put(at: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if at == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[at] <= capacity:
                put(at + 1, [*bins[:i], bins[i] + sizes[at], *bins[i + 1 :]])
        put(at + 1, [*bins, sizes[at]])

    put(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_packing_takes_hardly_more_sequences_than_the_fewest(sizes):
    runs = packing.plan_runs(Counter(sizes), 20)
    used = max(first + -(-n // each) for _, _, n, each, first, _ in runs)
    assert used <= fewest_bins(sorted(sizes, reverse=True), 20) + 1


def test_forest_against_a_walk_row_by_row():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(300, 3)), (rng.random(300) < 0.5).astype(float)
    forest = quality.fit_forest(x, y, [1, 0, -1], trees=7, depth=3)
    for row, raw in zip(x[:60], forest.raw(x[:60])):
        total = forest.start
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        assert raw == pytest.approx(total)


def test_ordinal_fit_is_a_minimum_of_the_plain_likelihood():
    rng = np.random.default_rng(2)
    x = rng.random((120, 3))
    grade = np.digitize(x @ [2.0, -1.0, 0.5] + 0.3 * rng.standard_normal(120), [0.2, 0.7, 1.1])
    w, theta = toxicity.fit_ordinal(np.repeat(np.arange(120), 3), np.tile(np.arange(3), 120), x.ravel(), grade, 3, l2=0.01, steps=4000)

    def loss(w, theta):
        total = 0.0
        for row, g in zip(x, grade):
            above = [1.0, *(1 / (1 + np.exp(-(row @ w - t))) for t in theta), 0.0]
            total -= np.log(above[g] - above[g + 1])
        return total / len(x) + 0.005 * (w @ w)

    here = loss(w, theta)
    for i in range(3):
        for step in (-0.05, 0.05):
            moved = np.eye(3)[i] * step
            assert loss(w + moved, theta) > here - 1e-5 and loss(w, np.sort(theta + moved)) > here - 1e-5
