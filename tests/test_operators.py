import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions.rules import every_n
from tidelog.operators import append, fold, restore
from tidelog.operators.upcast import Step, Upcaster
from tidelog.plans import replay


def test_every_n_fires_once_for_crossed_runs(spark):
    cases = [(None, 9, False), (None, 10, True), (9, 10, True), (10, 19, False), (19, 31, True)]
    frame = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, old long, new long")
    got = frame.orderBy("i").select(every_n(F.col("old"), F.col("new"), 10)).collect()
    assert [r[0] for r in got] == [c[2] for c in cases]


def test_running_sum_over_blocks(spark):
    rows = [(s, v, (v * 7) % 11 - 5) for s in range(3) for v in range(1, 200)]
    frame = spark.createDataFrame(rows, "stream_id long, version long, d long")
    got = {(r.stream_id, r.version): r.running for r in fold.running_sum(frame, F.col("d"), block=16).collect()}
    for s in range(3):
        total = 0
        for v in range(1, 200):
            total += (v * 7) % 11 - 5
            assert got[s, v] == total


def test_overflow_is_not_a_conflict(spark):
    most = (1 << 63) - 1
    batch = spark.createDataFrame([(1, most, most, 1), (2, 4, 5, 1), (3, 4, 6, 1), (4, 3, 5, 1)], "stream_id long, expected long, version long, ordinal long")
    heads = spark.createDataFrame([(1, most), (2, 4), (3, 4), (4, 4)], "stream_id long, head long")
    got = {r.stream_id: r.outcome for r in append.validate_appends(batch, heads).collect()}
    assert got == {1: "VersionOverflow", 2: "Accepted", 3: "Conflict", 4: "Conflict"}


def test_long_streams_are_not_gathered(spark):
    frame = spark.createDataFrame([(1, v, v) for v in range(1, 6)] + [(2, v, v) for v in range(1, 4)], "stream_id long, version long, d long")
    got = {r.stream_id: (r.head, r.state, r.error) for r in fold.ordered_fold(frame, ["d"], F.lit(0).cast("long"), lambda s, e: s * 2 + e["d"], limit=4).collect()}
    assert got == {1: (5, None, "RehydrationLimitExceeded"), 2: (3, 11, None)}


def test_steps_must_form_chains():
    same = lambda p: p
    for bad in ([Step("a", 0, same)], [Step("a", 1, same), Step("a", 1, same)], [Step("a", 2, same)], [Step("a", 1, same), Step("a", 3, same)], [Step("a", 1, same, "b"), Step("b", 3, same)]):
        with pytest.raises(ValueError):
            Upcaster(bad)
    up = Upcaster([Step("a", 1, same), Step("a", 2, same, "b"), Step("b", 3, same)])
    assert [up.current_version(n) for n in ("a", "b", "c")] == [2, 4, None]


def test_resume_equals_whole_replay(spark):
    log = spark.createDataFrame([(s, v, v * s) for s in range(6) for v in range(1, 30)], "stream_id long, version long, d long")
    snaps = spark.createDataFrame([(s, 12, 2 if s % 2 else 1, sum(v * s for v in range(1, 13))) for s in range(4)] + [(9, 5, 2, 7)], "stream_id long, version long, schema_version int, state long")
    got = {r.stream_id: (r.head, r.total, r.replayed) for r in replay.resumed_sum(log, snaps, 2, F.col("d")).collect()}
    assert got == {**{s: (29, sum(v * s for v in range(1, 30)), 17 if s in (1, 3) else 29) for s in range(6)}, 9: (5, 7, 0)}


def test_numbered_over_blocks(spark):
    rows = [(0 if i % 2 else i % 7, i * 3) for i in range(900)]  # one key holds half of the rows
    frame = spark.createDataFrame(rows, "stream_id long, at long").repartition(5)
    got = {(r.stream_id, r["at"]): r.version for r in fold.numbered(frame, "stream_id", ["at"], F.floor(F.col("at") / 64)).collect()}
    for key in {k for k, _ in rows}:
        assert [got[key, at] for at in sorted(a for k, a in rows if k == key)] == list(range(1, sum(k == key for k, _ in rows) + 1))


def test_runs_are_validated_in_order(spark):
    most = (1 << 63) - 1
    schema = "run long, expected long, version long, ordinal long"
    first = lambda rows: tuple(append.validate_runs(spark.createDataFrame(rows, schema)).first())
    good = [(0, None, 1, 1), (0, None, 2, 2), (1, 4, 5, 1)]
    assert first(good) == (True, None, None, None, None) and first([]) == (True, None, None, None, None)
    assert first([*good, (3, None, 2, 1), (2, 4, 5, 1), (2, 4, 7, 2), (2, 4, 9, 3)]) == (False, 2, "NonSequential", 6, 7)
    assert first([(5, most, most, 1)]) == (False, 5, "VersionOverflow", None, most)


def test_hot_streams_in_blocks(spark, monkeypatch):
    """One stream holds half of all events, over many blocks; triggers, guards, projections and plans as in plain Python."""
    for module in (fold, append, restore):
        monkeypatch.setattr(module, "BLOCK", 16)
    monkeypatch.setattr(fold.highest_before, "__defaults__", (16,))
    monkeypatch.setattr(fold.running_sum, "__defaults__", ("running", 16))
    rng, events = random.Random(4), []
    for stream, size in ((0, 400), *((s, 57) for s in range(1, 8))):
        version = 0
        for _ in range(size):
            version += rng.choice((1, 1, 1, 40))  # gaps leave whole blocks empty
            events.append((stream, version, rng.randint(-30, 33), rng.randint(0, 500)))
    log = spark.createDataFrame(events, "stream_id long, version long, d long, position long").repartition(4)
    of = {s: [e for e in events if e[0] == s] for s in range(8)}

    due = {(s, b[1]) for s, own in of.items() for a, b in zip([(s, 0)] + own, own) if b[1] // 10 > a[1] // 10}
    assert {(r.stream_id, r.version) for r in replay.trigger_points(log, 10).collect()} == due

    told = replay.guard_positions(log.select(F.col("stream_id").alias("consumer"), F.col("version").alias("delivery"), "position"))
    want = {(s, e[1]): "NonIncreasingPosition" if i and e[3] <= max(x[3] for x in own[:i]) else "Applied" for s, own in of.items() for i, e in enumerate(own)}
    assert {(r.consumer, r.delivery): r.status for r in told.collect()} == want

    states = {}
    for s, own in of.items():
        total, applied, failed = 0, 0, None
        for e in own:
            if not -120 <= total + e[2] <= 150:
                failed = e[1]
                break
            total, applied = total + e[2], applied + 1
        states[s] = (applied, failed, total)
    assert {r.stream_id: (r.applied, r.failed_at, r.state) for r in replay.projected(log, F.col("d"), -120, 150).collect()} == states

    blocks = [(s, b, b + s + (b >= 300)) for s, n in ((0, 400), (1, 90), (2, 1)) for b in range(1, n + 1)]
    plan = restore.section_plan(spark.createDataFrame(blocks, "section long, block long, version long").withColumn("corrupt", F.expr("section = 1 and block = 50")))
    assert {r.section: (r.events, r.halt, r.got) for r in plan.collect()} == {0: (299, "Gap", 301), 1: (49, "Corrupt", None), 2: (1, "Complete", None)}

    runs = spark.createDataFrame([(s, v, v) for s, n in ((0, 400), (1, 60)) for v in range(1, n + 1) if (s, v) != (0, 222)], "stream_id long, version long, ordinal long")
    assert {r.stream_id: (r.events, r.first_bad, r.error) for r in append.validate_sequence(runs).collect()} == {0: (399, 223, "Conflict"), 1: (60, None, None)}
