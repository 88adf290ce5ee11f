import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidelog.llm import lm


def signed_hash(word):
    return int(np.uint64(xxhash.xxh64_intdigest(word.encode(), 42)).astype(np.int64))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    cycle = ["red", "green", "blue", "grey"]
    rows = [(i, " ".join(cycle[(i + k) % 4] for k in range(rng.randint(20, 80))), 0) for i in range(150)]
    rows += [(200 + i, " ".join(rng.choices(cycle, k=60)), 0) for i in range(10)]
    rows += [(300, None, 0), (301, "", 0), (302, "...", 0), (303, "red green blue grey " * 40_000, 0), (None, "red green", 0), rows[0], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")


def test_orderly_texts_score_higher(spark, docs):
    rows = lm.pseudo_likelihoods(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r for r in rows}
    orderly = np.mean([got[i].mean_log_likelihood for i in range(150)])
    mixed = np.mean([got[200 + i].mean_log_likelihood for i in range(10)])
    assert orderly > mixed + 0.5
    assert got[303].n_tokens == 160_000 and got[303].mean_log_likelihood > mixed
    assert all((got[i].n_tokens, got[i].log_likelihood, got[i].mean_log_likelihood) == (0, 0.0, None) for i in (300, 301))


def test_scores_are_the_sum_over_all_places():
    net = lm.Network().prepared()
    ids = np.array([1, 2, 3, 250, 7], dtype=np.uint8)
    looked = net.embed[lm.contexts(ids)].reshape(len(ids), -1)
    hidden, want = np.tanh(looked @ net.inner + net.inner_bias), []
    log_softmax = lambda x: x - np.log(np.exp(x).sum())
    for h, i in zip(hidden, ids):
        g, k = divmod(int(i), lm.IN_GROUP)
        want.append(log_softmax(h @ net.group + net.group_bias)[g] + log_softmax(h @ net.outer[g] + net.outer_bias[g])[k])
    assert np.allclose(net.log_probabilities(lm.contexts(ids), ids.astype(np.int64)), want, atol=1e-5)
    around = lm.contexts(ids)
    assert around[0].tolist() == [lm.EDGE, lm.EDGE, 2, 3] and around[2].tolist() == [1, 2, 250, 7]


def test_probabilities_of_all_classes_sum_to_one():
    net = lm.Network(seed=5).prepared()
    for scale in (1, 400):  # the second makes logits whose exponentials are not finite
        net.outer *= scale
        around = np.repeat(lm.contexts(np.array([1, 2, 3], dtype=np.uint8))[1:2], lm.CLASSES, axis=0)
        p = np.exp(net.log_probabilities(around, np.arange(lm.CLASSES)).astype(np.float64))
        assert np.isfinite(p).all() and abs(p.sum() - 1) < 1e-3


def test_a_step_follows_the_gradient():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 9, 400)
    context, target = lm.contexts(ids), ids.astype(np.int64)
    net = lm.Network()
    before = net.prepared().log_probabilities(context, target).sum()
    squares = np.full(lm.Network.SIZE, 1e-2)
    for _ in range(40):
        lm.train_steps(net, context, target, squares)
    assert net.prepared().log_probabilities(context, target).sum() > before + 20


def test_a_step_has_the_exact_gradient():
    """A tiny step moves every part of the weights as finite differences say."""
    net, rng = lm.Network(), np.random.default_rng(2)
    ids = rng.integers(0, lm.CLASSES, 300)
    context, target = lm.contexts(ids), ids.astype(np.int64)
    loss = lambda flat: -lm.Network(flat).prepared().log_probabilities(context, target).mean(dtype=np.float64)
    start = net.flat.astype(np.float64)
    squares = np.full(lm.Network.SIZE, 1e12, dtype=np.float32)  # then a step is the gradient times rate / 1e6
    lm.train_steps(net, context, target, squares, rate=1e6)
    gradient, first = start - net.flat, 0
    for shape in lm.Network.SHAPES:
        part = np.arange(first, first + int(np.prod(shape)))
        first = part[-1] + 1
        for k in part[np.argsort(-np.abs(gradient[part]))[:3]]:
            up, down = start.copy(), start.copy()
            up[k] += 1e-2
            down[k] -= 1e-2
            assert abs((loss(up) - loss(down)) / 2e-2 - gradient[k]) < 0.05 * abs(gradient[k]) + 1e-4


def test_every_place_is_used_once():
    places = [sorted(k for turn in range(lm.ROUNDS) for k in range((key + turn) % lm.EVERY, 50, lm.EVERY)) for key in range(5)]
    assert places == [list(range(50))] * 5


def test_vocabulary_counts_all_texts(spark, docs):
    assert set(lm.vocabulary(lm.word_counts(lm.split(docs)))[:4]) == {signed_hash(w) for w in ("red", "green", "blue", "grey")}
    assert lm.pseudo_likelihoods(docs.limit(0)).collect() == []


def test_scores_are_those_of_words(spark):
    """The sums of class probability and share of the class, word by word in plain Python."""
    rng = random.Random(6)
    bank = [f"w{i}" for i in range(900)]
    texts = [" ".join(rng.choices(bank, weights=[1 / (1 + i) for i in range(900)], k=rng.randint(1, 200))) + " é! _x" for _ in range(60)]
    frame = spark.createDataFrame([(i % 7, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string")
    cut = lm.split(frame).cache()
    counts = lm.word_counts(cut)
    words = lm.vocabulary(counts)
    rest, sizes = lm.shared_classes(counts, words)
    corpus = lm.tokens(cut, words)
    weights = lm.Network(seed=3).flat
    got = sorted((r.doc_id, r.n_tokens, round(r.log_likelihood, 2)) for r in lm.with_words(lm.score(corpus, weights, sizes), cut, rest, words).collect())
    split = [lm.WORDS.findall((t or "").lower()) for t in [*texts, None, ""]]
    n = Counter(w for ws in split for w in ws)
    want_words = sorted(n, key=lambda w: (-n[w], signed_hash(w)))[: lm.KNOWN]
    assert words == [signed_hash(w) for w in want_words]
    words = want_words
    number = {w: i for i, w in enumerate(words)}
    cls = lambda w: number.get(w, lm.KNOWN + xxhash.xxh64_intdigest(w.encode(), 42) % lm.HASHED)
    of = Counter()
    for w, k in n.items():
        of[cls(w)] += k
    net, want = lm.Network(weights).prepared(), []
    for i, ws in enumerate(split):
        ids = np.array([cls(w) for w in ws], dtype=np.int64)
        total = net.log_probabilities(lm.contexts(ids), ids).sum(dtype=np.float64) if ws else 0.0
        want.append((i % 7, len(ws), round(float(total) + sum(np.log(n[w] / of[cls(w)]) for w in ws if w not in number), 2)))
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 0.05 for a, b in zip(got, sorted(want)))


def test_registered_query(spark, docs, tmp_path):
    from tidelog.llm.registry import QUERIES

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op8_likelihood"](spark, str(tmp_path)).collect()
    assert len(rows) == docs.count() and all(r.log_likelihood <= 0 for r in rows)


def test_splitting_loses_no_token(spark):
    """Places and hashes give back the tokens of the plain pattern, also in long texts and beside low lines."""
    many = " ".join(f"x{i}" for i in range(70_000))
    texts = ["", None, "a_b __c, d\u0301 \u00e9t\u00e9 \u4e2d\u6587 \u0661\u0662 a a!", "one two one", "z" * 5, many, "w\u00f6rd " * 300_000, "__ _ " * 10]
    rows = lm.split(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = lm.WORDS.findall((texts[r.doc_id] or "").lower())
        places = np.frombuffer(bytes(r.places), dtype=lm._width(len(r.hashes)))
        assert [r.hashes[p] for p in places] == [signed_hash(w) for w in want]
        assert sum(r.counts) == len(want) and len(set(r.hashes)) == len(set(want))
