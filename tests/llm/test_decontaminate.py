import random
import re

import pytest

from tests.oracle import compare
from tidelog.llm import decontaminate


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute(docs, items, window=10):
    parts = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(len(ws) - window, 0) + 1 if ws else 0):
            parts.setdefault(tuple(ws[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        ws, hit, found = words(text), set(), set()
        for size in {len(p) for p in parts}:
            for i in range(len(ws) - size + 1):
                if (p := tuple(ws[i : i + size])) in parts:
                    hit.update(range(i, i + size))
                    found |= parts[p]
        out.append((doc, len(ws), len(hit), sorted(str(f) for f in found if f is not None)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    vocab = [*"the of and in a to is".split(), *(f"w{i}" for i in range(60)), "É1", "日本", "Straße"]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(rng.randint(8, 40))) for i in range(25)]
    items += [(90, "one"), (91, "two words"), (92, items[0][1]), (93, None), (94, "!!! ..."), (None, text(12)), (95, "a a a a a a a a a a a a")]
    docs = []
    for i in range(60):
        ws = text(rng.randint(0, 80)).split()
        for _ in range(rng.randint(0, 3)):
            source = words(rng.choice(items)[1])
            cut = rng.randint(0, max(len(source) - 8, 0))
            at = rng.randint(0, len(ws))
            ws[at:at] = source[cut : cut + rng.randint(5, 30)]
        docs.append((i, rng.choice([" ", "--", "\n", " ; "]).join(w.upper() if rng.random() < 0.2 else w for w in ws)))
    docs += [(100, None), (101, ""), (102, "?!"), (103, "a " * 30), (104, "ONE"), (3, docs[3][1]), (3, docs[4][1]), (None, items[2][1]), (105, "two\x00WORDS x " * 5000)]
    return docs, items


def test_against_brute_force(spark, tables):
    docs, items = tables
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, row int, pos int")
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in decontaminate.contamination(d, b).collect()]
    assert sorted(got, key=str) == brute(docs, items)


def test_without_broadcast(spark, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate.small, "__defaults__", (0,))
    got = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark, tables):
    docs, items = tables
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(d.limit(0), b).collect() == []
    assert {r.n_hit for r in decontaminate.contamination(d, b.limit(0)).collect()} == {0}


def test_proximity_finds_a_phrase_with_a_word_left_out(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    filler = " ".join(["alpha beta gamma delta epsilon zeta eta iota kappa filler"] * 3)
    docs = spark.createDataFrame([(1, "so " + item.replace("delta ", "") + " end"), (2, "theta far " + "x " * 50 + " delta"), (3, filler)], "doc_id long, text string")
    items = decontaminate.benchmark_items(spark.createDataFrame([("q", item)], "item_id string, text string"))
    index = decontaminate.positional_index(docs, items.terms)
    near = decontaminate.proximity_matches(index, items).collect()
    assert {r.doc_id for r in near} >= {1} and all(r.item_id == "q" and abs(r.moved) <= 3 for r in near)
    assert 2 not in {r.doc_id for r in near}


def test_registered_query_gives_the_rows_of_its_sql(spark):
    from tidelog.llm.registry import ORACLE_SQL, QUERIES

    assert compare(spark, QUERIES["op10_decontaminate"], ORACLE_SQL["op10_decontaminate"])
