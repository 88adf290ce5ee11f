import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tidelog.llm import nearcopies


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_stage_drops_planted_copies(spark):
    rng = random.Random(4)
    text = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    docs, copies = {}, 0
    for i in range(60):
        words = text(rng.randint(60, 300))
        changed = words[:]
        for at in rng.sample(range(5, len(words) - 5), max(1, len(words) // 80)):
            changed[at] = text(1)[0]
        docs[i], docs[1000 + i] = " ".join(words), " ".join(changed)
        assert 0.8 <= jaccard(docs[i], docs[1000 + i]) < 1
    base = text(120)
    for i in range(40):  # more than are paired
        docs[2000 + i] = " ".join([*base[:118], *text(2)])
    rows = [(i, t, "en", "src", len(t)) for i, t in docs.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in pipeline.drop_near_duplicates(spark, frame, "").collect()}
    assert kept == {*range(60), 2000}


def test_short_and_equal_texts(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (2, "A, b c d e f."), (3, "a b"), (4, "a b"), (5, None), (6, "a b c d e x")], "key long, text string")
    assert [tuple(r) for r in nearcopies.similar_links(frame).collect()] == [(1, 2)]


def test_a_large_bucket_loses_no_link(spark, monkeypatch):
    """All texts share every band, and only pairs of them are near copies."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for i in range(60):
        words = [word() for _ in range(100)]
        rows += [(i, " ".join(words)), (i + 1000, " ".join([*words[:-1], word()]))]
    frame = spark.createDataFrame(rows, "key long, text string")
    same = lambda rows, found=nearcopies.signatures: found(rows).withColumn("bands", F.array_repeat(F.lit(5).cast("long"), 12))
    monkeypatch.setattr(nearcopies, "signatures", same)
    assert {tuple(r) for r in nearcopies.similar_links(frame).select("a", "b").collect()} == {(i, i + 1000) for i in range(60)}


def test_a_small_bucket_loses_no_link(spark, monkeypatch):
    """The least text of the only bucket is similar to none, so all links are between components."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = [(0, " ".join(word() for _ in range(100)))]
    for i in range(1, 7):
        words = [word() for _ in range(100)]
        rows += [(i, " ".join(words)), (i + 1000, " ".join([*words[:-1], word()]))]
    frame = spark.createDataFrame(rows, "key long, text string")
    same = lambda rows, found=nearcopies.signatures: found(rows).withColumn("bands", F.array_repeat(F.lit(5).cast("long"), 12))
    monkeypatch.setattr(nearcopies, "signatures", same)
    links = lambda known=None: {tuple(r) for r in nearcopies.similar_links(frame, known).select("a", "b").collect()}
    assert links() == {(i, i + 1000) for i in range(1, 7)}
    assert links(spark.createDataFrame([(1, 1001), (2, 1002)], "a long, b long")) == {(i, i + 1000) for i in range(3, 7)}


def test_buckets_of_near_copies_are_not_paired(spark):
    """Twelve sets alike: each meets the least one, and no pair is left once these links are known."""
    rows = [(key, 100, [-1] * 8, [7] * 12) for key in range(12)]
    shared = nearcopies.buckets(spark.createDataFrame(rows, "key long, size long, bits array<long>, bands array<long>"))
    pairs = nearcopies.candidates(shared)
    assert {tuple(r) for r in pairs.collect()} == {(0, key) for key in range(1, 12)}
    assert nearcopies.crossing(shared, pairs).count() == 0
    rest = {tuple(r) for r in nearcopies.crossing(shared, pairs.where("b < 11")).collect()}
    assert rest == {(key, 11) for key in range(11)}


def test_sketches_rule_out_no_similar_sets():
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(3)
    ruled_out = 0
    for size in (1, 20, 64, 65, 500, 3000):
        for share in np.arange(0, 1.01, 0.05):
            both, more = draw(size), int(size * share)
            a, b = (np.unique(np.concatenate((both, draw(int(k))))) for k in (more // 2, more - more // 2))
            similar = size >= 0.8 * (len(a) + len(b) - size)
            alike = nearcopies.sketches_alike(nearcopies.sketch(a), len(a), nearcopies.sketch(b), len(b))
            assert alike or not similar
            ruled_out += not alike
            assert not alike or size >= 0.7 * (len(a) + len(b) - size) or size < 100
    assert ruled_out > 60
