import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm.test_decontaminate import brute, words
from tests.llm.test_simhash import brute_components, plain_fingerprint

PARTS = {"en": "tha ing er on ti".split(), "de": "sch ung ßen ie ver".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    text = lambda lang, n: " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text((lang := rng.choice(["en", "de"])), rng.randint(30, 90)), lang) for i in range(150)]
    items = [(i, text("en", 25)) for i in range(5)]
    rows += [(200 + i, rows[i][1].upper(), "en") for i in range(20)] + [(300, rows[3][1], "en"), (3, rows[3][1], "en"), (None, rows[4][1], None)]
    rows += [(400 + i, text("en", 20) + " " + items[i % 5][1] + ".", "en") for i in range(9)]
    rows += [(500, "call +1 (279) 555-0216 " + text("en", 40), "en"), (600, None, "en"), (601, "", None), (602, "12 34", "en"), (603, text("de", 20_000), "de")]
    where = tmp_path_factory.mktemp("tables")
    frame = spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), rows, items


def test_stages_one_by_one(spark, folder):
    where, rows, items = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    one = pipeline.identify_language(spark, docs, where)
    kept = texts(one)
    gone = {r[0] for r in rows} - {k[0] for k in kept}
    assert one.columns == pipeline.COLUMNS and {600, 601, 602} <= gone and len(gone) <= 5

    two = pipeline.drop_near_duplicates(spark, one, where)
    found = texts(two)
    numbered = [(n, plain_fingerprint(t)) for n, (_, t) in enumerate(kept)]
    classes = brute_components(numbered)
    groups = {}
    for n, c in classes.items():
        groups.setdefault(c, []).append(kept[n])
    assert len(found) == len(groups)
    for group in groups.values():
        least = min((g[0] is None, g[0] or 0) for g in group)
        assert sum((f[0] is None, f[0] or 0) == least and f in group for f in found) == 1

    three = pipeline.drop_contaminated(spark, two, where)
    clean = {i for i, _, n_hit, _ in brute(found, items) if not n_hit}
    assert texts(three) == sorted((f for f in found if f[0] in clean), key=str) and len(clean) < len(found)

    four = pipeline.pseudonymize(spark, three, where)
    changed = {r.doc_id: r for r in four.collect()}
    assert four.columns == pipeline.COLUMNS and "555-0216" not in changed[500].text and changed[500].n_chars == len(changed[500].text)
    assert all(changed[i].text == t for i, t in texts(three) if i != 500)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    five = pipeline.encode_and_decode(spark, four, where).collect()
    assert {r.doc_id for r in five} == set(changed)
    for r in five[:40]:
        ids = library.encode(changed[r.doc_id].text, add_special_tokens=False).ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False) and r.n_tokens == len(ids)


def test_run_and_empty_table(spark, folder, tmp_path):
    where, rows, items = folder
    out = pipeline.run(spark, where)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and 100 < out.count() < len(rows)
    spark.read.parquet(f"{where}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{where}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
    assert words("A-b é") == ["a", "b", "é"]
