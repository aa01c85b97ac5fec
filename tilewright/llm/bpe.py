"""Byte-level BPE as a deterministic automaton over tokens, built from the merges by gadgets.

The automaton starts as one state with a loop for each byte. Each merge (u, v) -> w, in order of rank, applies a gadget: the state q that u
leads to is replaced, for arcs labelled u alone, by a copy that lacks the arc v, and every state with an arc u into q gets an arc w to where
v led from q. Afterwards a path spells a text if and only if its labels are the text's BPE tokens, so each prefix of a word has exactly one
path. Where an arc leads depends on its label only, so a state is named by the token that enters it. A state's row of the transition table
(which labels it has arcs for, one bit each) is compiled when the state is first entered; the rows depend on the merges alone.

Encoding runs a pre-split word through trie and table; decoding emits the labels' bytes.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts

#: The pre-split pattern that the vocabulary was made with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.iinfo(np.int32).max
#: Compiled rows that are held at a time: a bit a label each, 50 MB with 50,000 labels.
MOST_ROWS = 8_192
Piece = tuple[tuple[int, ...], str]  # ids, and the same in decimal, joined by commas


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """merges: (left id, right id, merged id) by rank; spelled: bytes by id (None: no arc label); special: strings that become one id."""

    def __init__(self, merges: list[tuple[int, int, int]], spelled: list[bytes | None], special: dict[str, int] | None = None):
        n = len(spelled)
        self.spelled, self.special = spelled, special or {}
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.step = np.full(n, -1, np.int32)  # of a byte: -1, before all merges
        self.lacks: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # by entering label: (label lost, at which merge)
        self.rank: dict[int, int] = {}
        labels = [i for i, s in enumerate(spelled) if s is not None and len(s) == 1]
        for k, (u, v, w) in enumerate(merges):
            if self.has_arc(u, v):  # else no path takes u then v, and there is nothing to rewire
                self.lacks[u].append((v, k))
                self.rank[u * n + v] = k
                self.left[w], self.right[w], self.step[w] = u, v, k
                labels.append(w)
        depth = np.zeros(n, np.int32)
        for w in sorted(labels, key=lambda i: self.step[i]):
            if self.left[w] >= 0:
                depth[w] = depth[self.left[w]] + 1
        order = np.argsort(depth[labels], kind="stable") if labels else []
        self.label = np.array(labels, np.int32)[order]  # by place: parts stand before what they form, so that a row is compiled level by level
        self.place = np.full(n, -1, np.int32)
        self.place[self.label] = np.arange(len(labels), dtype=np.int32)
        edges = np.searchsorted(depth[self.label], np.arange(1, depth.max(initial=0) + 2)).tolist()
        self.levels = [(a, b, self.place[self.left[self.label[a:b]]], self.step[self.label[a:b]]) for a, b in zip(edges, edges[1:])]
        self.start = np.packbits(np.ones(len(labels), bool), bitorder="little").tobytes()
        self.labels_at: list[int] = self.label.tolist()
        self.rows: dict[int, bytes] = {}
        self.trie: list[dict[int, int]] = [{}]
        self.ends = [-1]
        for i in labels:
            at = 0
            for b in spelled[i]:
                if b not in self.trie[at]:
                    self.trie[at][b] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(-1)
                at = self.trie[at][b]
            self.ends[at] = int(self.place[i])

    def has_arc(self, u: int, v: int) -> bool:
        """Whether the state that u leads to has an arc v, after the merges so far."""
        n, before = len(self.spelled), NEVER
        while u >= 0:
            x, until = v, NEVER
            while x >= 0:
                k = self.rank.get(u * n + x, NEVER)
                if k < before and k <= until:
                    return False
                x, until = int(self.left[x]), int(self.step[x])
            u, before = int(self.right[u]), int(self.step[u])
        return True

    def row(self, token: int) -> bytes:
        """The compiled row of the state that token leads to: the bit at a label's place is set if there is an arc with that label."""
        gone = np.full(len(self.label), NEVER, np.int32)
        at, before = token, NEVER
        while at >= 0:  # what its spine had lost when the merges copied it
            places, steps = self.lost(at)
            some = places[: np.searchsorted(steps, before)]
            gone[some] = np.minimum(gone[some], steps[: len(some)])
            at, before = int(self.right[at]), int(self.step[at])
        for a, b, lefts, steps in self.levels:  # a merged label has an arc where its left part still had one at that merge
            np.copyto(gone[a:b], -1, where=gone[lefts] <= steps)
        if len(self.rows) >= MOST_ROWS:
            self.rows.clear()
        self.rows[token] = bits = np.packbits(gone == NEVER, bitorder="little").tobytes()
        return bits

    def lost(self, token: int) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(got := self.lacks[token], list):
            got = self.lacks[token] = (self.place[[x for x, _ in got]] if got else np.zeros(0, np.int32), np.array([k for _, k in got], np.int32))
        return got

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the one path that spells word.

        Every prefix has one path at most, so each place in the word is entered once: the longest arc first, back from dead ends.
        """
        trie, ends, rows, label, n = self.trie, self.ends, self.rows, self.labels_at, len(word)
        if not n:
            return []
        root, met, stack, path, i, bits = trie[0], set(), [], [], 0, self.start
        while True:
            node, j, open_arcs = root, i, []
            while j < n:
                at = node.get(word[j])
                if at is None:
                    break
                j += 1
                t = ends[at]
                if t >= 0 and bits[t >> 3] >> (t & 7) & 1 and j not in met:
                    open_arcs.append((j, t))
                node = trie[at]
            stack.append(open_arcs)
            while not stack[-1]:
                stack.pop()
                path.pop()
            i, t = stack[-1].pop()
            while i in met:  # entered meanwhile, and dead
                while not stack[-1]:
                    stack.pop()
                    path.pop()
                i, t = stack[-1].pop()
            met.add(i)
            path.append(t := label[t])
            if i == n:
                return path
            bits = rows.get(t) or self.row(t)


def load(content: str) -> MergeAutomaton:
    """From the text of a byte-level vocabulary file with vocab, merges and added tokens."""
    data = json.loads(content)
    vocab, letters = data["model"]["vocab"], byte_letters()
    spelled: list[bytes | None] = [None] * (max([*vocab.values(), *(t["id"] for t in data["added_tokens"])]) + 1)
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    for s, i in vocab.items():
        if s not in special:
            spelled[i] = bytes(letters[c] for c in s)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    return MergeAutomaton([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], spelled, special)


class Codec:
    """Encodes whole texts through the automaton, with a bounded memory of words met before."""

    def __init__(self, automaton: MergeAutomaton, most_words: int = 400_000):
        self.automaton, self.most = automaton, most_words
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, Piece] = {}
        self.find = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(automaton.special, key=len, reverse=True))) + ")").split if automaton.special else lambda t: [t]
        self.labels = [s if s is not None else b"" for s in automaton.spelled]
        for s, i in automaton.special.items():
            self.labels[i] = s.encode()

    def piece(self, text: str, spaced: bool) -> Piece:
        """Of a piece that starts at a pre-split boundary and ends at one; spaced: a space stands before it."""
        ids: list[int] = []
        for word in self.find(" " + text if spaced else text):
            ids += self.word(word)
        got = (tuple(ids), ",".join(map(str, ids)))
        if spaced and len(text) <= 64:
            if len(self.pieces) >= self.most:
                self.pieces.clear()
            self.pieces[text] = got
        return got

    def word(self, word: str) -> tuple[int, ...]:
        got = self.words.get(word)
        if got is None:
            got = tuple(self.automaton.encode_word(word.encode("utf-8", "surrogatepass")))
            if len(word) <= 64:
                if len(self.words) >= self.most:
                    self.words.clear()
                self.words[word] = got
        return got

    def coded(self, text: str) -> list[Piece]:
        """A single space between two that aren't spaces always starts a pre-split word, so the text is looked up piece by piece."""
        out: list[Piece] = []
        for part in self.cut(text):
            if part in self.automaton.special:
                out.append(((i := self.automaton.special[part],), str(i)))
            elif "  " in part or part[-1:] == " ":
                out.append(self.piece(part, False))
            elif part:
                first, *rest = part.split(" ")
                if first:
                    out.append(self.piece(first, False))
                known = self.pieces.get
                out += [known(x) or self.piece(x, True) for x in rest]
        return out

    def encode(self, text: str) -> list[int]:
        return [*chain.from_iterable(ids for ids, _ in self.coded(text))]

    def decode(self, ids) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(content: str) -> Codec:
    """One per worker and vocabulary."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(load(content))
    return _codecs[key]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and the text decoded from them, for each row of docs.

    vocabulary: path of the file, read on the driver and sent to the executors (its size doesn't grow with the data).
    Null texts count as empty and give no ids; repeated rows give repeated rows; an empty table gives an empty one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(ids: list, texts: list) -> dict:
        c = codec(shared.value)
        found = [c.encode(t) for t in texts]
        return {"doc_id": ids, "ids": found, "decoded": [c.decode(x) for x in found]}

    return map_texts(docs, id_col, text_col, run, "doc_id long,ids array<int>,decoded string")


def digest_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, in the same pass reduced to counts and digests."""
    shared = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(ids: list, texts: list) -> dict:
        c, sha = codec(shared.value), lambda b: hashlib.sha256(b).hexdigest()
        counts, coded, back = [], [], []
        for t in texts:
            pieces = c.coded(t)
            path = [*chain.from_iterable(x for x, _ in pieces)]
            counts.append(len(path))
            coded.append(sha(",".join([s for _, s in pieces if s]).encode()))
            back.append(sha(c.decode(path).encode()))
        return {"doc_id": pa.array(ids, pa.int64()), "n_tokens": counts, "ids_sha256": coded, "decoded_sha256": back}

    return map_texts(docs, id_col, text_col, run, "doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string")
