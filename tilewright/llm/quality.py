"""Quality rules: gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents, with monotone constraints on chosen statistics, and flattened into NumPy
node arrays; all documents of a batch then walk all levels of a tree at once. A few plain rules (the base) reject before the trees do.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, map_texts

#: Fixed values of the base rules: the symbols that are counted, the fewest words, and the largest share of repeated words in percent.
SYMBOLS = b"#*$%&|<>"
FEWEST_WORDS, MOST_REPEATED = 50, 50
BLANKS = b" \t\n\x0b\x0c\r"
#: The statistics that the trees see, and whether quality may only rise (1) or fall (-1) with one; 0: free.
FEATURES = {"log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "upper_share": -1, "punct_share": -1, "digit_share": 0, "words_per_line": 0, "top_word_share": -1, "symbol_word_share": -1}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_KEEP_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_KEEP_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)
_PUNCT = b"!\"'(),-./:;?@[\\]^_`{}~"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of `width` words that the text holds twice or more, the first included; each place counts once."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    key = ids[: n - width + 1].copy()
    kinds = len(seen)
    for i in range(1, width):
        if kinds > 3_000_000_000:
            kinds, key = _dense(key)
        key = key * len(seen) + ids[i : n - width + 1 + i]
        kinds *= len(seen)
        if kinds > 4_000_000_000:
            kinds, key = _dense(key)
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.concatenate([[False], s[1:] == s[:-1]])
    twice = order[same | np.concatenate([same[1:], [False]])]
    if not len(twice):
        return 0
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, twice, 1)
    np.add.at(mark, twice + width, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def _dense(key: np.ndarray) -> tuple[int, np.ndarray]:
    found, at = np.unique(key, return_inverse=True)
    return len(found), at.astype(np.int64)


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts and the features of a text; a word is a run of characters other than ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, BLANKS)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines, again, seen = 0, 0, set()
    for line in raw.split(b"\n"):
        if line.strip(BLANKS):
            lines += 1
            if line in seen:
                again += 1
            else:
                seen.add(line)
    repeat = repeated_words(words)
    size = max(1, len(raw))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    odd = sum(c for w, c in counts.items() if len(w.translate(None, SYMBOLS)) < len(w))
    d = max(1, n)
    features = [np.log1p(n), chars / d, symbols / d, again / max(1, lines), repeat / d, len(counts) / d, (len(raw) - len(raw.translate(None, bytes(range(65, 91))))) / size, (len(raw) - len(raw.translate(None, _PUNCT))) / size, (len(raw) - len(raw.translate(None, b"0123456789"))) / size, n / max(1, lines), max(counts.values(), default=0) / d, odd / d]
    return [n, chars, symbols, again, repeat], features


@dataclass
class Forest:
    """Flattened trees: at each node the feature, the threshold (left: at most), the children (a leaf is its own child) and the value."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of good quality."""
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_forest(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss over histograms.

    Under a constraint a split whose sides would be in the wrong order is not made, and both sides keep to their side of the mean of the
    two values in all that is split further, so the whole model is monotone in that feature.
    """
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], axis=1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    raw = np.full(n, start)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        me = len(nodes)
        value = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        nodes.append([0, np.inf, me, me, rate * value])
        best = (1e-6, None)
        if level < depth and len(rows) > 1:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j in range(d):
                if not len(cuts[j]):
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g[rows], len(cuts[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(cuts[j]) + 1))[:-1]
                gr, hr = total_g - gl, total_h - hl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - total_g**2 / (total_h + ridge)
                ok = (hl >= least) & (hr >= least)
                if monotone[j]:
                    ok &= (vr - vl) * monotone[j] >= 0
                gain = np.where(ok, gain, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, float(vl[k]), float(vr[k])))
        if best[1]:
            j, k, vl, vr = best[1]
            to_left = binned[rows, j] <= k
            mid = (vl + vr) / 2
            a, b = ((low, mid), (mid, high)) if monotone[j] > 0 else ((mid, high), (low, mid)) if monotone[j] < 0 else ((low, high), (low, high))
            left = grow(rows[to_left], g, h, *a, level + 1)
            right = grow(rows[~to_left], g, h, *b, level + 1)
            nodes[me] = [j, cuts[j][k], left, right, 0.0]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        first = len(nodes)
        roots.append(grow(np.arange(n), p - y, p * (1 - p), -4.0, 4.0, 0))
        part = _flat(nodes, [roots[-1]], depth, 0.0)
        raw += part.raw(x)
        assert len(nodes) > first
    return _flat(nodes, roots, depth, start)


def _flat(nodes: list, roots: list, depth: int, start: float) -> Forest:
    f, t, le, r, v = zip(*nodes)
    return Forest(np.array(roots), np.array(f, np.int64), np.array(t), np.array(le, np.int64), np.array(r, np.int64), np.array(v), depth, start)


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """The labelled documents with the smallest hashes of doc_id, `most` at most: doc_id, text, y. Null labels and ids are left out."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = hashed_sample(known, "doc_id", most)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def fit_quality(docs: DataFrame, labels: DataFrame, max_train_rows: int = 10_000) -> Forest | None:
    """From labels (doc_id, quality 0 or 1) of max_train_rows documents at most; None if one of the two grades is missing."""
    rows = sample_labelled(docs, labels, "quality", max_train_rows)

    def run(batches):
        for b in batches:
            stats = [statistics(t or "")[1] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(stats, pa.list_(pa.float64())), b.column(2)], names=["x", "y"])

    got = rows.mapInArrow(run, "x array<double>, y int").toPandas()
    y = got.y.to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    order = np.lexsort(np.stack(got.x).T)
    return fit_forest(np.stack(got.x)[order], y[order], list(FEATURES.values()))


def judge(docs: DataFrame, forest: Forest | None, threshold: float = 0.5) -> DataFrame:
    """One row per document: the base counts, base_failed, score (null without a forest) and kept.

    Null and empty texts have no words and fail; repeated rows are judged alike; an empty table gives an empty one; other columns are
    ignored. A text that passes the base is kept if its score is at least threshold, or if there is no forest.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(ids: list, texts: list) -> dict:
        stats = [statistics(t) for t in texts]
        counts = np.array([s[0] for s in stats], np.int64).reshape(-1, len(BASE))
        x = np.array([s[1] for s in stats]).reshape(-1, len(FEATURES))
        failed = (counts[:, 0] < FEWEST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
        score = shared.value.score(x) if shared.value is not None else np.full(len(x), np.nan)
        kept = ~failed & ~(score < threshold)
        return {"doc_id": pa.array(ids, pa.int64()), **{n: counts[:, i] for i, n in enumerate(BASE)}, "base_failed": failed, "kept": kept, "score": pa.array(score, from_pandas=True)}

    return map_texts(docs, "doc_id", "text", run, "doc_id long," + ",".join(f"{n} long" for n in BASE) + ",base_failed boolean,kept boolean,score double")
