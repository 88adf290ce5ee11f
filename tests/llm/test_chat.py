from tests.oracle import compare
from tidelog.llm import chat

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|im_end|> x"), (1, 3, "ann", None), (1, 3, "cat", "tie"), (1, 1, "ann", "hi"),
    (2, 0, "system", "alone"), (3, None, None, "who"), (None, 0, "ann smith", "x"), (None, 1, "bob", "y"), (4, 0, "solo", ""),
]


def plain(rows):
    out = []
    clean = lambda t: (t or "").replace("<|im_start|>", "< |im_start|>").replace("<|im_end|>", "< |im_end|>")
    turns = {(c, -1 if n is None else n, "_".join((r or "unknown").split()), clean(t)) for c, n, r, t in rows}
    for conv, speaker in {(c, r) for c, _, r, _ in turns if r != "system"}:
        text, mask, n = "", [], 0
        for _, _, r, t in sorted((t for t in turns if t[0] == conv), key=lambda t: t[1:]):
            text += "<|im_start|>" + ("assistant" if r == speaker else r if r == "system" else f"user name={r}") + "\n"
            if r == speaker:
                mask.append((len(text), len(text) + len(t) + len("<|im_end|>")))
            text += t + "<|im_end|>\n"
            n += 1
        out.append((conv, speaker, n, text, mask))
    return sorted(out, key=str)


def got(spark, rows):
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, gone int")
    return sorted(((r.conv_id, r.speaker, r.n_turns, r.text, [(m.start, m.end) for m in r.mask]) for r in chat.rotations(frame).collect()), key=str)


def test_every_perspective(spark):
    assert got(spark, ROWS) == plain(ROWS)


def test_long_conversations_and_texts_are_whole(spark):
    rows = [(7, i, f"p{i % 3}", f"turn {i}é😀") for i in range(5000)] + [(7, None, "p1", "x"), (7, -3, "system", "s"), (8, 1, "a", "long " * 200_000), (8, 2, "b", "y")]
    assert got(spark, rows) == plain(rows)


def test_mask_covers_the_speakers_own_texts(spark):
    for _, _, _, text, mask in got(spark, ROWS):
        assert all(text[:start].endswith("<|im_start|>assistant\n") and text[start:end].endswith("<|im_end|>") for start, end in mask)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_registered_query_gives_the_rows_of_its_sql(spark):
    from tidelog.llm.registry import ORACLE_SQL, QUERIES

    assert compare(spark, QUERIES["op4_chat"], ORACLE_SQL["op4_chat"])
