"""Toxicity grades by cumulative-link ordinal regression on sparse features: words and beginnings of words (stems, so to say).

P(grade > j) = sigmoid(w . x - theta_j) with one weight vector w for all thresholds theta_1 < theta_2 < ... The labels say toxic or not; the
grades above 0 come from what share of a toxic text's features are marked ones (that the labelled toxic texts use far more): 1 below the lower third of toxic texts, 2 below the upper third, 3 above. A text's score is its expected grade.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .packed import released
from .quality import sample_labelled

_WORDS = re.compile(r"[^\W\d_]+").findall
GRADES = 4
PREFIXES = (4, 5, 6, 7)


DENSE, TOP = 50.0, 2.0


def density(count, n_words):
    """A feature's value: its occurrences per DENSE words, TOP at most; toxic texts hold marked words all along, others one by chance."""
    return np.minimum(TOP, DENSE * count / np.maximum(n_words, 1))


def features_of(word: str) -> list[str]:
    """The word, and its beginnings, each with a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _WORDS(text.lower())


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    thresholds: np.ndarray  # ascending, GRADES - 1
    cut_at: float  # rejected from this probability of a grade above 0 on

    def linear(self, text: str, known: dict[str, tuple[str, ...]], most: int = 100_000) -> float:
        """w . x, where x has the density of each feature the model knows; known: the features of words met before."""
        counts: dict[str, int] = {}
        words = words_of(text)
        for w in words:
            got = known.get(w)
            if got is None:
                if len(known) >= most:
                    known.clear()
                got = known[w] = tuple(f for f in features_of(w) if f in self.weights)
            for f in got:
                counts[f] = counts.get(f, 0) + 1
        return sum(self.weights[f] * min(TOP, DENSE * counts[f] / len(words)) for f in sorted(counts))

    def above(self, linear: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold, by row."""
        return 1 / (1 + np.exp(-np.clip(linear[:, None] - self.thresholds[None, :], -60, 60)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grade: np.ndarray, n_features: int, grades: int = GRADES, l2: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient steps (Adam) on the mean log loss of the cumulative links with a ridge; x by (row, column, value)."""
    n = len(grade)
    w, share = np.zeros(n_features), np.array([(grade > j).mean() for j in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    first, gaps = -np.log(share[0] / (1 - share[0])), np.log(np.maximum(np.diff(-np.log(share / (1 - share))), 1e-2))
    theta = np.concatenate([[first], gaps])  # the first threshold, and logarithms of the gaps: the order is kept
    m, v = np.zeros(n_features + grades - 1), np.zeros(n_features + grades - 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for t in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
        z = np.bincount(rows, values * w[cols], n)
        up = np.concatenate([np.ones((n, 1)), sig(z[:, None] - cuts), np.zeros((n, 1))], axis=1)  # P(grade >= j)
        p = np.maximum(up[np.arange(n), grade] - up[np.arange(n), grade + 1], 1e-12)
        slope = up * (1 - up)
        d_low, d_high = slope[np.arange(n), grade] / p, slope[np.arange(n), grade + 1] / p
        gz = -(d_low - d_high) / n
        gc = np.array([(d_low[grade == j + 1].sum() - d_high[grade == j].sum()) / n for j in range(grades - 1)])
        gt = np.concatenate([[gc.sum()], np.exp(theta[1:]) * np.array([gc[j:].sum() for j in range(1, grades - 1)])])
        g = np.concatenate([np.bincount(cols, values * gz[rows], n_features) + l2 * w, gt])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, theta = w - step[:n_features], theta - step[n_features:]
    return w, np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_train_rows: int = 10_000, max_features: int = 2048, least_texts: int = 6) -> OrdinalModel | None:
    """From labels (doc_id, toxic 0 or 1) of max_train_rows documents at most; None if one of the two is missing.

    The model knows the max_features features (in least_texts labelled texts at least) that toxic texts hold most clearly more often.
    """
    got = sample_labelled(docs, labels, "toxic", max_train_rows).select("doc_id", "text", "y")

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                counts: dict[str, int] = {}
                for w in words_of(t or ""):
                    counts[w] = counts.get(w, 0) + 1
                out.append(counts)
            yield pa.RecordBatch.from_arrays([pa.array([[*c] for c in out], pa.list_(pa.string())), pa.array([[*c.values()] for c in out], pa.list_(pa.int32())), b.column(1), b.column(2)], names=["words", "counts", "y", "doc_id"])

    t = got.select("text", "y", "doc_id").mapInArrow(run, "words array<string>, counts array<int>, y int, doc_id long").toArrow().sort_by("doc_id")
    y = t.column("y").to_numpy().astype(np.int64)
    if not len(y) or y.min() == y.max():
        return None
    words, counts = t.column("words").combine_chunks(), t.column("counts").combine_chunks().flatten().to_numpy()
    del t
    rows = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    del words
    n_words = np.bincount(rows, counts, len(y))
    word_at, vocabulary = coded.indices.to_numpy(), coded.dictionary
    pa.default_memory_pool().release_unused()
    starts = np.searchsorted(rows, np.arange(0, len(y) + 500, 500))  # of 500 texts each, so that little is held at a time
    length = pc.utf8_length(vocabulary).to_numpy()
    kept, parts, base, total = [], [], 0, np.zeros(len(y))
    for k in (None, *PREFIXES):
        kinds = vocabulary.dictionary_encode() if k is None else pc.utf8_slice_codeunits(vocabulary, 0, k).dictionary_encode()
        use = length[word_at] > (k or 0)
        size = len(kinds.dictionary)
        code, found = kinds.indices.to_numpy(), []
        for a, b in zip(starts[:-1], starts[1:]):
            own = np.flatnonzero(use[a:b]) + a
            pair, at = np.unique(rows[own].astype(np.int64) * size + code[word_at[own]], return_inverse=True)
            found.append(((pair // size).astype(np.int32), (pair % size).astype(np.int32), np.bincount(at, counts[own], len(pair)).astype(np.float32)))
        in_text, kind, n_at = (np.concatenate(x) for x in zip(*found))
        del found
        total += np.bincount(in_text, n_at, len(y))
        often = np.bincount(kind, minlength=size)[kind] >= least_texts  # the rest is no feature
        parts.append((in_text[often], kind[often] + np.int32(base), n_at[often]))
        kept.append((base, k, kinds.dictionary))
        base += len(kinds.dictionary)
    rows, cols, counts = (np.concatenate(x) for x in zip(*parts))
    del parts, coded, word_at, code, use, in_text, kind, n_at, often
    bad, all_ = np.bincount(cols, y[rows], base), np.bincount(cols, minlength=base)
    n_bad, n_ok = y.sum(), len(y) - y.sum()
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((all_ - bad + 0.5) / (n_ok + 1))
    spread = odds / np.sqrt(1 / (bad + 0.5) + 1 / (all_ - bad + 0.5))
    spread[(all_ < least_texts) | (odds < 0.7)] = -1
    pick = np.argsort(-spread, kind="stable")[:max_features]
    pick = pick[spread[pick] > 2]
    marked = (odds > 2) & (spread > 2.5)
    rate = np.bincount(rows, counts * marked[cols], len(y)) / np.maximum(total, 1)
    edges = np.quantile(rate[y == 1], [1 / 3, 2 / 3])
    grade = np.where(y == 1, 1 + (rate > edges[0]).astype(int) + (rate > edges[1]), 0)
    names = [f"{kind[i - low].as_py()}*" if k else kind[i - low].as_py() for i in pick.tolist() for low, k, kind in [next(x for x in reversed(kept) if x[0] <= i)]]
    place = np.full(base, -1)
    place[pick] = np.arange(len(pick))
    use = place[cols] >= 0
    rows, cols, x = rows[use], place[cols[use]], density(counts[use], n_words[rows[use]])
    held = np.arange(len(y)) % 5 == 0  # a fifth sets the cut
    mine = ~held[rows]
    w, theta = fit_ordinal((np.cumsum(~held) - 1)[rows[mine]], cols[mine], x[mine], grade[~held], len(pick))
    cut_at = best_cut(1 / (1 + np.exp(theta[0] - np.bincount(rows, x * w[cols], len(y))[held])), y[held] == 1)
    w, theta = fit_ordinal(rows, cols, x, grade, len(pick))
    return OrdinalModel({n: float(v) for n, v in zip(names, w)}, theta, cut_at)


def best_cut(p: np.ndarray, bad: np.ndarray) -> float:
    """Between 0.1 and 0.5, the cut on the probability with the fewest mistakes; a clean text that goes counts as three toxic ones that stay."""
    cuts = np.linspace(0.5, 0.1, 41)
    cost = [3 * (p[~bad] >= c).sum() + (p[bad] < c).sum() for c in cuts]
    return float(cuts[int(np.argmin(cost))])


def severity(text: Column, model: OrdinalModel | None) -> Column:
    """A struct of severity (expected grade), grade (the likeliest) and p_toxic for each text; null texts count as empty.

    Without a model (nothing to learn from) all three are 0.
    """
    known: dict[str, tuple[str, ...]] = {}

    def run(texts):
        import pandas as pd

        if model is None:
            return pd.DataFrame({"severity": np.zeros(len(texts)), "grade": np.zeros(len(texts), np.int32), "p_toxic": np.zeros(len(texts))})
        up = model.above(np.array([model.linear(t or "", known) for t in texts], float))
        each = -np.diff(np.concatenate([np.ones((len(up), 1)), up, np.zeros((len(up), 1))], axis=1), axis=1)
        released()
        return pd.DataFrame({"severity": up.sum(axis=1), "grade": each.argmax(axis=1).astype(np.int32), "p_toxic": up[:, 0]})

    return pandas_udf(run, "severity double, grade int, p_toxic double")(F.coalesce(text, F.lit("")))


def rate_documents(docs: DataFrame, model: OrdinalModel | None, text_col: str = "text") -> DataFrame:
    """docs with three more columns, severity, grade and p_toxic, and toxic (p_toxic at least the model's cut).

    Rows are rated each for itself: nulls and empty texts are not toxic, repeated rows are rated alike, an empty table stays empty. Columns
    of docs with one of these four names are replaced.
    """
    own = f"severity_{uuid.uuid4().hex}"  # no column of docs has such a name
    rated = docs.drop("severity", "grade", "p_toxic", "toxic").withColumn(own, severity(F.col(text_col), model))
    cut_at = model.cut_at if model else 2.0
    return rated.select("*", f"{own}.*").drop(own).withColumn("toxic", F.col("p_toxic") >= cut_at)
