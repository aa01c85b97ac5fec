"""Personal data by fixed patterns and a skip-chain conditional random field.

Base spans come from plain patterns. The field then labels candidate tokens (words with a digit, an at sign or a plus sign, or long mixed
strings): unary potentials from a logistic model of each token's shape and left context, chain potentials between neighbouring candidates,
and skip potentials between equal or similar candidates anywhere in the document, so that a token seen once in a telling context is labelled
alike where it comes again without one. Loopy belief propagation (sum-product, damped) gives each candidate's marginals.

The field learns from the base spans of a bounded sample of documents, and from values that a text itself assigns to a secret's name.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, map_texts
from .packed import released

#: The kinds in the order of the result (the first four have base patterns), and the patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|key)\s*[=:]\s*[\"']?([A-Za-z0-9_+/=-]{12,})", re.I)
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Kind, start and end (code points, end exclusive), by kind, then start."""
    out: list[Span] = []
    low = 0
    at = text.find("@")
    while at >= 0:  # from each @ to the left: a leftmost match starts where its run of local characters does
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    if not re.search("[0-9]", text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(q := p.lstrip("0")) < 3 or len(q) == 3 and q <= "255" for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


_TOKEN = re.compile(r"[^\s\"'<>|,;]*[0-9@+][^\s\"'<>|,;]*")
_STRIP = ".:!?()[]{}*$%&#="
N_FEATURES = 512
LABELS = ("O", *KINDS)


def candidates(text: str) -> list[tuple[int, int]]:
    """Tokens that may be personal data, without the punctuation around them."""
    out = []
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while a < b and text[a] in _STRIP:
            a += 1
        while b > a and text[b - 1] in _STRIP:
            b -= 1
        if b - a >= 4:
            out.append((a, b))
    return out


def shape(token: str) -> str:
    """Letters to a or A, hex letters among digits to h, digits to 9, runs shortened to two."""
    hexed = len(token) >= 16 and re.fullmatch(r"[0-9a-f]+", token) and re.search("[a-f]", token)
    s = "h" * len(token) if hexed else re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", token))
    return re.sub(r"(.)\1+", r"\1\1", s)


def features(text: str, a: int, b: int) -> list[int]:
    """Hashed names of a candidate's shape, length and left context."""
    token, left = text[a:b], text[max(0, a - 24) : a]
    before = re.findall(r"[^\W\d_]+|[=:\"(+]", left)[-3:]
    names = ["bias", "shape=" + shape(token)[:12], f"digits={min(20, sum(c.isdigit() for c in token))}", f"long={min(10, (b - a) // 4)}", "at" if "@" in token else "", f"dots={min(4, token.count('.'))}", "plus" if token[0] == "+" else "", *("left=" + w.lower() for w in before if len(w) == 1 or w.lower() in _TELLING)]
    return [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=4).digest(), "little") % N_FEATURES for n in names if n]


_TELLING = {"token", "secret", "password", "passwd", "key", "apikey", "card", "phone", "mail", "email", "ip", "tel"}


def training_labels(text: str, spans: list[Span], found: list[tuple[int, int]]) -> list[int]:
    """What a candidate is inside of: a base span or a value assigned to a secret's name."""
    marks = [*spans, *(("secret", *m.span(1)) for m in SECRET.finditer(text))]
    return [next((LABELS.index(k) for k, s, e in marks if s < b and a < e), 0) for a, b in found]


@dataclass
class Field:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, log potentials
    skip: float  # log potential of equal labels on a skip edge


def fit_field(docs: DataFrame, max_train_rows: int = 2_000) -> Field:
    """From the base labels of the documents with candidates that have the smallest hashes of doc_id, max_train_rows at most.

    Unary weights by regularised maximum entropy; the chain by counts of neighbouring labels against independence; the skip potential by how
    often equal candidates of a document have equal labels.
    """
    picked = hashed_sample(docs.where(F.col("text").rlike("[0-9@+]") & F.col("doc_id").isNotNull()).select("doc_id"), "doc_id", max_train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked.distinct()), "doc_id")

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                found = candidates(t)
                labels = training_labels(t, base_spans(t), found)
                out.append(([f for a, b in found for f in [*features(t, a, b), -1]], labels, [hash_token(t[a:b]) for a, b in found]))
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int64()), *(pa.array([o[i] for o in out], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64())))], names=["doc_id", "f", "y", "token"])

    k = len(LABELS)
    xs, ys, trans, same = [], [], np.full((k, k), 1.0), [1.0, 1.0]
    for r in rows.select("text", "doc_id").mapInArrow(run, "doc_id long, f array<int>, y array<int>, token array<long>").toArrow().sort_by("doc_id").to_pylist():
        groups: list[list[int]] = [[]]
        for f in r["f"]:
            if f < 0:
                groups.append([])
            else:
                groups[-1].append(f)
        xs += groups[: len(r["y"])]
        ys += r["y"]
        for a, b in zip(r["y"], r["y"][1:]):
            trans[a, b] += 1
        seen: dict[int, int] = {}
        for token, y in zip(r["token"], r["y"]):
            if token in seen:
                same[seen[token] == y] += 1
            seen[token] = y
    w = np.zeros((N_FEATURES, k))
    if ys:
        sets = [sorted(set(x)) for x in xs]  # every candidate has a feature
        n = np.array([len(x) for x in sets])
        cols, starts = np.array([f for x in sets for f in x]), np.cumsum(n) - n
        y = np.eye(k)[ys]
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, 151):
            z = np.add.reduceat(w[cols], starts, axis=0)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            off = np.repeat(p / p.sum(axis=1, keepdims=True) - y, n, axis=0)
            g = np.stack([np.bincount(cols, off[:, c], N_FEATURES) for c in range(k)], axis=1) / len(y) + 1e-4 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    joint = trans / trans.sum()
    chain = np.clip(np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True))), -1, 1) * 0.5
    return Field(w, chain, float(np.clip(np.log(same[1] / same[0]), 0.5, 4)))


def hash_token(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def edges_of(tokens: list[str], similar_from: int = 12) -> list[tuple[int, int, bool]]:
    """Chain edges, and skip edges from each candidate to the last one with the same text, or else (when long) the same first similar_from
    characters; so a document of n candidates has fewer than 2 n edges."""
    out, last, like = [(i, i + 1, False) for i in range(len(tokens) - 1)], {}, {}
    for i, t in enumerate(tokens):
        j = last.get(t, like.get(t[:similar_from]) if len(t) >= similar_from else None)
        if j is not None:
            out.append((j, i, True))
        last[t] = i
        if len(t) >= similar_from:
            like[t[:similar_from]] = i
    return out


def marginals(field: Field, unary: np.ndarray, edges: list[tuple[int, int, bool]], rounds: int = 12, damping: float = 0.5) -> np.ndarray:
    """Loopy sum-product over the edges: label probabilities of each node."""
    n, k = unary.shape
    u = np.exp(unary - unary.max(axis=1, keepdims=True))
    if edges:
        a, b = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
        skip = np.exp(np.eye(k) * field.skip)
        pot = np.stack([np.exp(field.chain), skip])[np.array([int(e[2]) for e in edges])]
        right, left = np.full((len(a), k), 1 / k), np.full((len(a), k), 1 / k)  # messages a to b, b to a
        for _ in range(rounds):
            logs = np.log(u + 1e-30)
            np.add.at(logs, b, np.log(right))
            np.add.at(logs, a, np.log(left))
            to_a, to_b = np.exp(logs[a] - logs[a].max(1, keepdims=True)), np.exp(logs[b] - logs[b].max(1, keepdims=True))
            new_right = np.einsum("ek,ekl->el", to_a / left, pot)
            new_left = np.einsum("el,ekl->ek", to_b / right, pot)
            right = damping * right + (1 - damping) * new_right / new_right.sum(1, keepdims=True)
            left = damping * left + (1 - damping) * new_left / new_left.sum(1, keepdims=True)
        logs = np.log(u + 1e-30)
        np.add.at(logs, b, np.log(right))
        np.add.at(logs, a, np.log(left))
        u = np.exp(logs - logs.max(axis=1, keepdims=True))
    return u / u.sum(axis=1, keepdims=True)


#: Where every candidate's every label lies so far below "none" (logarithms), no message can lift one to a probability of 0.6: a chain edge adds
#: 1 at most, as potentials lie between -0.5 and 0.5, a candidate has two, and a skip edge passes on its neighbour's own leaning to "none".
SURE = 4


def find_spans(text: str, field: Field, least: float = 0.6) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: those, and candidates that the field labels with at least this probability outside of them."""
    base = base_spans(text)
    found = candidates(text)
    if not found:
        return base, base
    cols = [features(text, a, b) for a, b in found]
    unary = np.stack([field.unary[c].sum(axis=0) for c in cols])
    if base or unary[:, 1:].max() > unary[:, 0].min() - SURE:
        for i, y in enumerate(training_labels(text, base, found)):
            if 0 < y <= len(BASE):
                unary[i, y] += 12  # what the patterns found is given
        p = marginals(field, unary, edges_of([text[a:b] for a, b in found]))
        best = p.argmax(axis=1)
        taken = sorted((s, e) for _, s, e in base)
        ends = [s for s, _ in taken]
        more = []
        for (a, b), y, q in zip(found, best, p.max(axis=1)):
            i = bisect_left(ends, b)
            if y and q >= least and not (i and any(e > a for _, e in taken[max(0, i - 4) : i])):
                more.append((LABELS[y], a, b))
        return base, sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return base, base


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """One row per document: base counts by kind, digest of the base spans, all spans, and the text with all spans masked.

    Null texts count as empty and hold nothing; repeated rows are treated alike; an empty table gives an empty one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(ids: list, texts: list) -> dict:
        base, every, masked = [], [], []
        for t in texts:
            b, s = find_spans(t, shared.value)
            base.append(b)
            every.append(s)
            masked.append(mask(t, s))
        return {"doc_id": pa.array(ids, pa.int64()), **{f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in BASE}, "base_sha256": [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], "spans": [_joined(s) for s in every], "masked": masked}

    return map_texts(docs, "doc_id", "text", run, "doc_id long," + ",".join(f"n_{k} long" for k in BASE) + ",base_sha256 string,spans string,masked string")


def mask(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in angle brackets; of overlapping spans, which form one, by the first's kind."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def masked_text(field: Field):
    """A column function: the text with all personal data masked; null stays null."""
    from pyspark.sql.functions import pandas_udf

    def run(texts):
        masked = texts.map(lambda t: t if t is None else mask(t, find_spans(t, field)[1]))
        released()
        return masked

    return pandas_udf(run, "string")
