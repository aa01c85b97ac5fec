"""The corpus pipeline stage by stage on a small corpus with planted cases."""

import random
import re

import pytest

import corpus_pipeline
from tilewright.llm import toxicity

BAD = ["idiot", "moron", "scum", "trash"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    words = lambda n: " ".join(f"word{rng.randint(0, 4000)}" for _ in range(n))
    docs = [[d, "\n".join(words(30) for _ in range(4))] for d in range(120)]
    for d in range(0, 120, 6):  # toxic
        docs[d][1] += " " + " ".join(rng.choice(BAD) + " " + words(4) for _ in range(8))
    for d in range(1, 120, 10):  # a line that all share
        docs[d][1] += "\nThis exact closing line stands in many documents"
    docs[115][1] = docs[31][1]  # a copy
    near = docs[43][1].split()
    docs[116][1] = " ".join([*near[:60], "changed", *near[61:]])  # one line, a word changed
    docs[117][1] += " write to someone@mail.example.com or 10.1.2.3"
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(d, t, "en", "src", len(t)) for d, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d % 6 == 0)) for d in range(0, 120) if d % 5], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {d: t for d, t in docs}


def test_stages(spark, corpus):
    folder, texts = corpus
    docs, got = spark.read.parquet(f"{folder}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        path = f"{folder}/stage-{n}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        got.append(docs.collect())
        if n < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    clean, lined, single, masked, packed = ({r["doc_id"]: r for r in g} for g in got)
    assert set(clean) == {d for d in texts if d % 6} and all(clean[d]["text"] == texts[d] for d in clean)
    key = lambda s: tuple(re.findall(r"[^\W_]+", s.lower()))
    seen, want = set(), {}
    for d in sorted(clean):
        kept = []
        for line in texts[d].split("\n"):
            if len(key(line)) < 3 or key(line) not in seen:
                kept.append(line)
            seen.add(key(line))
        want[d] = "\n".join(kept)
    assert {d: r["text"] for d, r in lined.items()} == {d: t for d, t in want.items() if t.strip()} and 115 not in lined
    assert set(lined) - set(single) == {116} and all(single[d]["text"] == lined[d]["text"] for d in single)
    assert set(masked) == set(single) and "<email>" in masked[117]["text"] and "<ip>" in masked[117]["text"]
    assert all(masked[d]["text"] == single[d]["text"] for d in masked if d != 117) and all(r["n_chars"] == len(r["text"]) for r in masked.values())
    assert {r["doc_id"] for r in got[4]} == set(masked) and sum(r["length"] for r in got[4]) > 0


def test_run_gives_the_last_stage(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 60
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_stages_on_an_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus[0]).count() == 0


def test_words_are_letters():
    assert toxicity.words_of("It's 3x BÄR_x") == ["it", "s", "x", "bär", "x"]


def test_repeated_and_missing_ids_leave_one_row_of_a_group(spark):
    rng = random.Random(10)
    a, b, c, d = (" ".join(f"word{rng.randint(0, 4000)}" for _ in range(60)) for _ in range(4))
    near = a.split(" ", 1)[1]
    rows = [(5, a), (5, a), (5, near), (9, a), (3, b), (3, c), (None, b), (None, d), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    left = [(r["doc_id"], r["text"]) for r in got]
    assert len(left) == 4 and {(3, b), (3, c), (None, d)} < set(left) and {i for i, t in left if t in (a, near)} == {5}
