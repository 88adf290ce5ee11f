import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidelog.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    (1, "It's a WELL-known fact, isn't it?  1234 tokens"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "<|startoftext|>mixed<|endoftext|> with <|ENDOFTEXT|>"),
    (6, "aaaaaaaaaaaaaaaaaaaa !!!!!!!!!!!! 'sss"),
    (7, "ΑΣ ΑΣΑ İstanbul ß ẞ é 각 日本語 😀👍🏽 \x1c\x1f x"),
    (8, "word another thing " * 80_000),
    (9, "x" * 30_000),
    (1, "It's a WELL-known fact, isn't it?  1234 tokens"),
    (10, "Ɤ Ᲊ \U00010d50 \U00016ea0a ꟝b"),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_encode_and_decode_as_the_library(spark, library):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in TEXTS], "doc_id long, text string, ids string, n_tokens int")
    rows = bpe.encode(docs, PATH, decoded=True).collect()
    assert len(rows) == len(TEXTS)
    by_id = dict(TEXTS)
    for row in rows:
        ids, text = expected(library, by_id[row.doc_id])
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        assert (row.n_tokens, row.decoded) == (len(ids), text)


def test_decode_from_stored_ids(spark, library):
    docs = spark.createDataFrame(TEXTS[:7], "doc_id long, text string")
    tokens = bpe.encode(docs, PATH).withColumn("decoded", bpe.F.lit("clash"))
    got = {r.doc_id: r.decoded for r in bpe.decode(tokens, PATH).collect()}
    assert got == {i: expected(library, t)[1] for i, t in TEXTS[:7]}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, PATH, decoded=True).collect() == []


def test_cut_texts_give_the_ids_of_the_whole(library):
    import json

    codec = bpe.Codec(json.load(open(PATH, encoding="utf-8")))
    text = "Some words é and   others, " * 2000
    pieces = list(codec.pieces(text, 1000))
    assert len(pieces) > 20 and "".join(pieces) == text
    assert np.concatenate(codec.encode(pieces)).tolist() == expected(library, text)[0]


def test_registered_query(spark, library, tmp_path):
    from tidelog.llm.registry import QUERIES

    spark.createDataFrame(TEXTS[:7], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for row in QUERIES["op1_bpe"](spark, str(tmp_path)).collect():
        ids, text = expected(library, dict(TEXTS)[row.doc_id])
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
