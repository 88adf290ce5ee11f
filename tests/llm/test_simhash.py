import random

import pytest
import xxhash

from tidelog.llm import simhash
from tidelog.llm.components import connected_components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {i: i for i in range(len(fps))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), fps[i][0]), fps[i][0])
    return {fps[i][0]: least[find(i)] for i in range(len(fps))}


def corpus():
    rng = random.Random(3)
    vocab = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    docs = [" ".join(rng.choices(vocab, k=rng.randint(1, 120))) for _ in range(60)]
    for _ in range(90):
        words = rng.choice(docs[:20]).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        docs.append("\t".join(words))
    return [*docs, None, "", " \n", "one", "ONE", "two words", "a\x1cb c", "long " * 3000]


def test_fingerprint_by_the_definition():
    for text in corpus():
        assert simhash.fingerprint(text) == plain_fingerprint(text)
        assert simhash.fingerprint(text, piece=40) == plain_fingerprint(text)


def test_components_against_all_pairs(spark):
    texts = list(enumerate(corpus(), start=100))
    texts += [(7, texts[0][1]), (7, texts[0][1])]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in texts], "doc_id long, text string, fp int, rep string")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts)
    want = brute_components([(i, plain_fingerprint(t)) for i, t in texts])
    assert {r.doc_id: r.component_id for r in rows} == want


@pytest.mark.parametrize("bucket", [64, 3, 0])
def test_random_fingerprints_within_two_bits(spark, bucket):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(25)}
    fps |= {centres[0] ^ (1 << i) ^ (1 << j) for i in range(32, 64) for j in range(32, i)} | {0, 1 << 63, (1 << 64) - 1, (1 << 64) - 2}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.component for r in connected_components(simhash.near_links(table, bucket)).collect()}
    assert {f: roots.get(f, f) for f in signed} == brute_components([(f, f & (1 << 64) - 1) for f in signed])


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "other text here")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == [("5", "5"), ("None", "5"), ("None", "None")]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_links_lead_through_documents_without_an_id(spark, monkeypatch):
    fps = spark.createDataFrame([(1, 0b0), (None, 0b11), (2, 0b1111), (None, 0b110000001111), (9, 7 << 40)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: fps)
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(None).collect()}
    assert got == {(1, 0): 1, (None, 0b11): 1, (2, 0b1111): 1, (None, 0b110000001111): 1, (9, 7 << 40): 9}


def test_registered_query_against_all_pairs(spark, tmp_path):
    from tidelog.llm.registry import QUERIES

    texts = list(enumerate(corpus()[40:120]))
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op5_simhash"](spark, str(tmp_path)).collect()
    want = brute_components([(i, plain_fingerprint(t)) for i, t in texts])
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{plain_fingerprint(t):016x}", want[i]) for i, t in texts}


def test_long_chain_of_links(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(None, 3), (4, 4), (900, 901)], "a long, b long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900}
