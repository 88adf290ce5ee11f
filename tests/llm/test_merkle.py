import hashlib
import re

from pyspark.sql import functions as F

from tests.oracle import compare
from tidelog.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def nodes(text):
    return [sha("p:" + p) for p in re.findall(r"[^\n]{1,32}\n?|\n", text)]


def fingerprint(text):
    leaves = nodes(text)
    return sha("r:" + "".join(sha("s:" + "".join(leaves[i : i + 8])) for i in range(0, len(leaves), 8)))


def near(a, b):
    a, b = set(nodes(a)), set(nodes(b))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


DOCS = [(5, "one line"), (2, None), (9, ""), (7, "\n\n\n"), (11, "é日😀\n" * 40), (3, "x" * 100_000), (1, "same text of two\nlines"), (4, "same text of two\nlines"), (-8, "z")]


def expected(docs):
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append((i, len(text), edited, fingerprint(text), fingerprint(edited), near(text, edited), near(text, after)))
    return sorted(out, key=str)


def check(spark, docs):
    frame = spark.createDataFrame([(i, t, 3, "x") for i, t in docs], "doc_id long, text string, bucket int, key string")
    got = [tuple(r) for r in merkle.edited_fingerprints(frame).collect()]
    assert sorted(got, key=str) == expected(docs)


def test_against_plain_python(spark):
    check(spark, DOCS)


def test_ties_null_ids_and_repeated_rows(spark):
    check(spark, [(1, "a b c"), (1, "a b d"), (None, "null id"), (None, "another"), (2, "r"), (2, "r"), (2, "r")])


def test_one_row_and_none(spark):
    check(spark, [(1, "only one text")])
    assert merkle.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_more_buckets_than_rows_and_gaps_in_ids(spark):
    check(spark, [(i * i * 1_000_003 - 5, f"text {i}\n" * (i % 7)) for i in range(200)])


def test_edits_are_located(spark):
    text = "\n".join(f"line {i}" for i in range(100))
    changed = text.replace("line 57", "line fifty-seven")
    rows = merkle.fingerprints(spark.createDataFrame([(1, text), (2, changed), (3, text)], "doc_id long, text string"))
    a, b, c = rows.orderBy("doc_id").collect()
    assert a.fingerprint == c.fingerprint != b.fingerprint
    both = rows.where("doc_id = 1").alias("a").crossJoin(rows.where("doc_id = 2").alias("b"))
    found = both.select(merkle.differing(F.col("a.sections"), F.col("b.sections")).alias("s"), merkle.differing(F.col("a.paragraphs"), F.col("b.paragraphs")).alias("p")).first()
    assert (found.s, found.p) == ([57 // 8], [57])


def test_registered_query_gives_the_rows_of_its_sql(spark):
    from tidelog.llm.registry import ORACLE_SQL, QUERIES

    assert compare(spark, QUERIES["op9_merkle"], ORACLE_SQL["op9_merkle"])
