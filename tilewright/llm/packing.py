"""Best-fit packing of documents into sequences by large-item matching.

Pieces longer than a third of the capacity can share a sequence with one other such piece at most (three don't fit), so they are matched
greedily: the longest open one with the longest partner that still fits. Shorter pieces then go, longest first, to the tightest gap.

Lengths are all that packing looks at, and there are at most `capacity` of them, so the plan is made on the driver from the number of pieces
of each length: sequences that are filled alike form a class, and a class is filled as a whole. The plan is a list of runs: so many pieces of
one length, so many to each sequence, in sequences numbered from here, at this offset. Each length splits two classes at most, so there are
at most 3 * capacity classes; the lengths in one sequence differ from run to run and sum to the capacity at most, so a class has at most
sqrt(2 * capacity) runs. The plan is therefore bounded by the capacity alone (about 1.1 million runs at 4096, some ten thousand in
practice), whatever the corpus. Pieces find their runs by their rank among pieces of the same length.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, split_batch
from .tokens import mixed, powers

RUN = ("length", "first_rank", "n", "each", "first_sequence", "offset")


def plan_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Runs (see RUN) that place all pieces; histogram: pieces by length (1 to capacity)."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, ...]] = []
    gaps: dict[int, deque] = {}  # gap: (first sequence, sequences)
    sequences = 0

    def place(length: int, each: int, n_seq: int, first: int, gap: int) -> None:
        runs.append((length, used[length], each * n_seq, each, first, capacity - gap))
        used[length] += each * n_seq
        left[length] -= each * n_seq
        if gap > each * length:
            gaps.setdefault(gap - each * length, deque()).append((first, n_seq))

    large = [n for n in sorted(left, reverse=True) if 3 * n > capacity]
    partners = sorted(large)
    for n in large:
        while left[n]:
            fit = next((m for m in reversed(partners) if m + n <= capacity and left[m] and (m != n or left[n] > 1)), None)
            if fit is None:
                k = left[n]
                place(n, 1, k, sequences, capacity)
                sequences += k
            elif fit == n:
                k = left[n] // 2
                place(n, 2, k, sequences, capacity)
                sequences += k
            else:
                k = min(left[n], left[fit])
                first = sequences
                sequences += k
                runs.append((n, used[n], k, 1, first, 0))
                used[n] += k
                left[n] -= k
                place(fit, 1, k, first, capacity - n)
    for n in (m for m in sorted(left, reverse=True) if 3 * m <= capacity):
        open_gaps = [g for g in gaps if g >= n and gaps[g]]
        heapq.heapify(open_gaps)
        while left[n] and open_gaps:
            gap = heapq.heappop(open_gaps)
            queue = gaps.get(gap)
            while queue and left[n]:
                first, k = queue.popleft()
                each = min(gap // n, left[n])
                full = min(k, left[n] // each)
                if full < k:
                    queue.appendleft((first + full, k - full))
                before = gap - each * n
                place(n, each, full, first, gap)
                if before >= n and before not in open_gaps:
                    heapq.heappush(open_gaps, before)
        if left[n]:
            each = capacity // n
            full, rest = divmod(left[n], each)
            if full:
                place(n, each, full, sequences, capacity)
                sequences += full
            if rest:
                place(n, rest, 1, sequences, capacity)
                sequences += 1
    return runs


#: The pre-split pattern of the vocabulary and its mark of a word's end.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Of each byte: 0 white space, 1 part of a letter, 2 digit, 3 other; and whether a chunk that holds it is looked up as a whole: with an apostrophe
#: or the beginning of a special token, control characters, or anything but ASCII and the letters from U+00C0 to U+00FF.
KIND = np.array([0 if c in b" \t\n\x0b\x0c\r" else 1 if 65 <= c <= 90 or 97 <= c <= 122 or c > 127 else 2 if 48 <= c <= 57 else 3 for c in range(256)], np.uint8)
ODD = np.array([c in b"'<" or c < 32 and c not in b"\t\n\x0b\x0c\r" or c == 127 or c > 191 and c != 0xC3 for c in range(256)])


class ChunkEncoder:
    """Ids of texts from the tokenizers library, each word only once.

    The vocabulary's normalizer turns white space into single spaces and its pre-splitter drops them, so a text's ids are those of its
    chunks between white space, one after the other, and a chunk's ids those of its pre-split words. All texts of a call are one array of
    bytes: lower-casing and pre-splitting compare neighbouring bytes, and words are looked up by 64-bit hashes in a table of 2 ** slots places
    (one word a place, the last one stays), so its memory is bounded. The new words of a call go to the library at once, whose ids are parted
    where words end. Chunks with bytes of ODD are words of their own.
    """

    def __init__(self, content: str, slots: int = 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self.find, self.mask = regex.compile(SPLIT).findall, np.uint64((1 << slots) - 1)
        self.keys, self.at, self.n = np.zeros(1 << slots, np.uint64), np.zeros(1 << slots, np.int32), np.zeros(1 << slots, np.int32)
        self.ids, self.used = np.zeros(1 << 23, np.uint16 if len(self.ends) <= 1 << 16 else np.uint32), 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not texts:
            return []
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        first, last, h, odd = self.words(buf)
        at, n, ids = self.lookup(buf, first, last, h, odd)
        flat = ids[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]  # at and n: 32 bits in the table, 64 in sums
        edges = np.cumsum([0, *(len(r) + 1 for r in raw)])
        bounds = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(first, edges)] * 4
        out = flat.astype("<u4").tobytes()
        return [out[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]

    @staticmethod
    def words(buf: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where each word begins and ends (bytes), its hash, and whether it is a chunk with odd bytes."""
        kind = KIND[buf]
        after = np.append(buf[1:], 0)
        odd = ODD[buf] | (buf == 0xC3) & ((after == 0x97) | (after == 0xB7))
        solid = np.concatenate([[0], (kind > 0).view(np.int8), [0]])
        step = np.diff(solid)
        begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        whole = np.zeros(len(buf) + 1, np.int8)
        if odd.any():
            some = np.unique(np.searchsorted(begins, np.flatnonzero(odd & (kind > 0)), side="right") - 1)
            whole[begins[some]] = 1
            whole[ends[some]] -= 1
        whole = np.cumsum(whole[:-1], dtype=np.int8).view(bool)
        edge = np.empty(len(buf) + 1, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        inside = np.concatenate([[False], whole[1:] & whole[:-1], [False]])
        edge[inside] = False
        edges = np.flatnonzero(edge)
        use = kind[edges[:-1]] > 0
        first, last = edges[:-1][use], edges[1:][use]
        upper = (buf >= 65) & (buf <= 90)
        upper[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
        upper &= ~whole
        value = buf.astype(np.uint64)
        value += np.uint64(32) * upper
        value += np.uint64(1)
        up, down = powers(len(buf) + 1)
        value *= up[:-1]
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        return first, last, mixed((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)), whole[first]

    def lookup(self, buf: np.ndarray, first: np.ndarray, last: np.ndarray, h: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where each word's ids are, how many, and in what array."""
        slot = (h & self.mask).astype(np.int64)
        miss = np.flatnonzero(self.keys[slot] != h)
        if not len(miss):
            return self.at[slot], self.n[slot], self.ids
        new, one, which = np.unique(h[miss], return_index=True, return_inverse=True)
        raw, start, end, as_is = buf.tobytes(), first[miss[one]].tolist(), last[miss[one]].tolist(), odd[miss[one]].tolist()
        ids = self.fresh([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start, end)], as_is)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate(ids)
        if self.used + len(flat) > len(self.ids):
            self.keys[:], self.used = 0, 0
            if len(flat) > len(self.ids):
                self.ids = np.zeros(2 * len(flat), self.ids.dtype)
            return self.lookup(buf, first, last, h, odd)
        base = self.used + np.cumsum(size) - size
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        at, n = self.at[slot], self.n[slot]
        at[miss], n[miss] = base[which], size[which]
        to = (new & self.mask).astype(np.int64)
        self.keys[to], self.at[to], self.n[to] = new, base, size
        return at, n, self.ids

    def fresh(self, words: list[str], odd: list[bool]) -> list[np.ndarray]:
        """Ids of words; odd ones are chunks."""
        plain: dict[str, int] = {}
        parts: list[list[int] | None] = []
        for w, o in zip(words, odd):
            if o and not (w.isascii() and w.isprintable() and "<" not in w):
                parts.append(None)
            else:
                parts.append([plain.setdefault(x, len(plain)) for x in (self.find(w.lower()) if o else (w.lower(),))])
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids if plain else [], np.uint32)
        cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
        out = []
        for w, p in zip(words, parts):
            if p is None:
                out.append(np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32))
            elif len(p) == 1:
                out.append(ids[cuts[p[0]] : cuts[p[0] + 1]])
            else:
                out.append(np.concatenate([ids[cuts[i] : cuts[i + 1]] for i in p] or [ids[:0]]))
        return out


_encoders: dict[int, ChunkEncoder] = {}


def encoder(content: str) -> ChunkEncoder:
    key = zlib.crc32(content.encode())
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(content)
    return _encoders[key]


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece: a document's ids and end_id, cut only where longer than capacity."""
    shared = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}

    def run(batches):
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in split_batch(batch, 1, 1 << 19):
                out = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encoder(shared.value).encode(texts)):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        out.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types.values())], names=list(types))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long,piece int,start long,length long,ids_crc32 long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, salts: int = 1024) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty (end_id alone); repeated rows are packed each for itself; an empty table gives an empty one; other columns are
    ignored. A length that many pieces share is ranked in `salts` parts, whose sizes are then summed, so no task orders all of its pieces.
    """
    spark = docs.sparkSession
    pieces = cut(cut_pieces(docs, vocabulary, capacity, end_id).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # `capacity` rows at most
    runs = np.array(plan_runs(counts, capacity), np.int64).reshape(-1, len(RUN))
    runs = spark.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])

    parts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select("length", "salt", before.alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("own", own).join(bases, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("base")).alias("rank"))

    def locate(batches):
        r = runs.value
        span = int(r[:, 1].max(initial=0) + r[:, 2].max(initial=0) + 1)
        keys = r[:, 0].astype(object) * span + r[:, 1] if span > 1 << 50 else r[:, 0] * span + r[:, 1]
        for b in batches:
            length, rank = b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            within, each = rank - r[at, 1], r[at, 3]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(r[at, 4] + within // np.maximum(each, 1)), pa.array(r[at, 5] + within % np.maximum(each, 1) * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(locate, "doc_id long,piece int,start long,length long,ids_crc32 long,sequence_id long,offset long")
