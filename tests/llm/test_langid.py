import random
import zlib

import numpy as np
import pytest

from tidelog.llm import langid

PARTS = {"aa": "ka ro mi tu sel".split(), "bb": "ßen ü chk zwo ern".split(), "cc": "ção lhe nha éu sim".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, (lang := rng.choice(list(PARTS))), rng.randint(2, 120)), lang, None) for i in range(700)]
    rows += [(1000, None, "aa", 1.0), (1001, "", "aa", 1.0), (1002, "123 !!", "bb", 1.0), (1003, text(rng, "bb", 60_000), None, 1.0), (None, text(rng, "cc", 50), "aa", 1.0)]
    rows += [rows[0], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_held_out_accuracy_and_special_texts(spark, docs):
    found = langid.identify(docs, langid.fit(docs)).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    unseen = [r for r in found if r.doc_id is not None and r.doc_id < 700 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in unseen]) > 0.97
    got = {r.doc_id: r for r in found}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "bb" and got[None].lang_pred == "cc"


def test_held_out_rows_teach_nothing(spark, docs):
    poisoned = docs.withColumn("lang", langid.F.when(langid.held_out(), "zz").otherwise(langid.F.col("lang")))
    assert langid.fit(poisoned).langs == ["aa", "bb", "cc"]


def test_nothing_to_learn_from(spark, docs):
    none = docs.withColumn("lang", langid.F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(none, langid.fit(none)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0))).collect() == []


def test_pair_tables_give_the_convolution():
    rng = np.random.default_rng(0)
    model = langid.train([(lang, rng.bytes(40)) for lang in ("x", "y") for _ in range(8)], epochs=1)
    rows = langid.windows(b"some text in a window")
    table, wide = model.tables(), np.zeros(langid.WINDOW + 3, dtype=np.uint8)
    wide[: langid.WINDOW] = rows[0]
    want = np.max([sum(table[k][wide[i + k]] for k in range(4)) for i in range(langid.WINDOW)], axis=0)
    assert np.allclose(langid.pooled(rows, *model.pairs())[0], want, atol=1e-5)


def test_columns_come_through(spark, docs):
    out = langid.identify(docs, langid.fit(docs), keep=["doc_id", "text", "lang"])
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and out.count() == docs.count()
