"""The laws that every log keeps."""

import threading

import pytest
from pyspark.sql import functions as F

from tidelog.functions import errors
from tidelog.operators import restore
from tidelog.operators.backup import decode_chunks, export_chunks
from tidelog.sources.log import EventLog
from tidelog.sources.state import CheckpointStore, InvalidRebuild, NonIncreasingPosition, SchemaMismatch

RUN = "stream_id binary, expected long, version long, event_type string, schema_version long, payload binary, metadata binary"


@pytest.fixture
def log(spark, tmp_path):
    return EventLog(spark, f"file://{tmp_path}/log")


def run(log, stream, expected, versions, payload=b"p", metadata=None, kind="E"):
    rows = [(stream, expected, v, kind, 1, payload + bytes([v % 251]), metadata) for v in versions]
    return log.spark.createDataFrame(rows, RUN)


def stream(view, key, start=1):
    return [r.version for r in view.read_stream(key, start).collect()]


def test_append_and_read(log):
    assert stream(log.view(), b"a") == []
    history, last = log.append(run(log, b"a", None, range(1, 6)))
    assert (history, last) == (log.history, 5)
    assert stream(log.view(), b"a", 3) == [3, 4, 5] and stream(log.view(), b"ab") == []
    log.append(run(log, b"a", 5, [6, 7]))
    log.append(run(log, b"\x00\xff\x42", None, [1], metadata=b"m"))
    rows = log.view().read_all().collect()
    assert [r.position for r in rows] == list(range(1, 9)) and bytes(rows[-1].metadata) == b"m" and rows[0].metadata is None
    assert [r.position for r in log.view().read_all((log.history, 6)).collect()] == [7, 8]
    with pytest.raises(errors.HistoryMismatch):
        log.view().read_all(("other", 1))
    assert {bytes(r.stream_id): r.head for r in log.view().heads().collect()} == {b"a": 7, b"\x00\xff\x42": 1}


def test_refused_appends_leave_nothing(log):
    log.append(run(log, b"a", None, [1, 2]))
    for bad in (run(log, b"a", 1, [2, 3]), run(log, b"a", None, [1]), run(log, b"a", 2, [4]), run(log, b"a", 2, [3, 5]), run(log, b"b", 1, [2])):
        with pytest.raises(errors.Conflict):
            log.append(bad)
    with pytest.raises(errors.InvalidEnvelope):
        log.append(run(log, b"a", 2, [3], metadata=b""))
    with pytest.raises(errors.InvalidEnvelope):
        log.append(run(log, b"a", 2, [3], kind="x" * 65_536))
    with pytest.raises(errors.DuplicateTarget):
        log.append(run(log, b"a", 2, [3]).union(run(log, b"a", None, [1])))
    assert log.append(run(log, b"a", 2, [])) is None
    assert log.view().frame.count() == 2


def test_all_runs_land_or_none(log):
    log.append(run(log, b"a", None, [1]))
    with pytest.raises(errors.Conflict):
        log.append(run(log, b"b", None, [1]).union(run(log, b"a", None, [1])))
    assert log.view().frame.count() == 1
    assert log.append(run(log, b"b", None, [1, 2]).union(run(log, b"a", 1, [2])))[1] == 4


def test_one_of_several_writers_wins(log):
    results = []

    def write(i):
        try:
            results.append(log.append(run(log, b"s", None, [1], payload=bytes([i]))))
        except errors.Conflict:
            results.append(None)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(results) == 5 and sum(r is not None for r in results) == 1 and log.view().frame.count() == 1


def test_writers_of_different_streams_all_land(log):
    threads = [threading.Thread(target=lambda i=i: log.append(run(log, bytes([i]), None, [1, 2]))) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [r.position for r in log.view().read_all().collect()] == list(range(1, 9))


def test_a_view_stays_as_it_was(log):
    log.append(run(log, b"a", None, [1]))
    view, short = log.view(), log.view(lifetime=0)
    log.append(run(log, b"a", 1, [2]))
    assert stream(view, b"a") == [1] and stream(log.view(), b"a") == [1, 2]
    with pytest.raises(errors.Expired):
        _ = short.frame


def test_export_and_import_give_the_same_log(log, spark, tmp_path):
    log.append(run(log, b"a", None, range(1, 26), metadata=b"m").union(run(log, b"b", None, [1, 2])))
    chunks = export_chunks(log.view().frame, b"dev", part=10)
    assert chunks.count() == 4
    blocks = decode_chunks(chunks).withColumn("block", F.col("part") * 10 + F.col("block"))
    plans = restore.section_plan(blocks)
    assert {(bytes(r.section), r.first, r.reached, r.halt) for r in plans.collect()} == {(b"a", 1, 25, "Complete"), (b"b", 1, 2, "Complete")}
    other = EventLog(spark, f"file://{tmp_path}/other")
    runs = blocks.select(F.col("section").alias("stream_id"), F.lit(None).cast("long").alias("expected"), "version", "event_type", "schema_version", "payload", "metadata")
    other.append(runs)
    same = ["stream_id", "version", "event_type", "schema_version", "payload", "metadata"]
    assert other.view().frame.select(same).exceptAll(log.view().frame.select(same)).count() == 0
    again = restore.import_report(plans, other.view().heads()).collect()
    assert {r.outcome for r in again} == {"Mismatch"} and {r.reached for r in again} == {None}


def test_checkpoints(log):
    store = CheckpointStore(log)
    assert store.load("p") is None
    with pytest.raises(InvalidRebuild):
        store.commit("p", None, 1, 5, "{}", rebuild=True)
    assert store.commit("p", None, 1, 5, "a").revision == 1
    with pytest.raises(errors.Conflict):
        store.commit("p", None, 1, 6, "b")
    with pytest.raises(SchemaMismatch):
        store.commit("p", 1, 2, 6, "b")
    with pytest.raises(NonIncreasingPosition):
        store.commit("p", 1, 1, 5, "b")
    with pytest.raises(InvalidRebuild):
        store.commit("p", 1, 1, 6, "b", rebuild=True)
    assert store.commit("p", 1, 2, 1, "rebuilt", rebuild=True).revision == 2
    assert (store.load("p").position, store.load("p").state) == (1, "rebuilt")


def test_execute_and_catch_up(log, spark):
    from tidelog.functions.errors import Conflict
    from tidelog.operators.decide import decide
    from tidelog.plans.project import catch_up, execute

    def decided(amounts, head):
        commands = spark.createDataFrame([(k, a) for k, a in amounts.items()], "stream_id binary, amount long")
        states = spark.createDataFrame([(k, head) for k in amounts], "stream_id binary, head long")
        event = F.struct(F.lit("Paid").alias("event_type"), F.col("amount").cast("string").alias("payload"))
        return decide(commands, states, F.when(F.col("amount") > 0, F.array(event)), F.when(F.col("amount") > 100, "TooMuch"))

    assert execute(log, decided({b"a": 10, b"b": 0, b"c": 500}, None), F.col("head"))[1] == 1
    assert execute(log, decided({b"b": 0}, None), F.col("head")) is None
    with pytest.raises(Conflict):
        execute(log, decided({b"a": 10}, None), F.col("head"))
    execute(log, decided({b"a": 7}, 1), F.col("head"))
    store = CheckpointStore(log)

    def total(state, events):
        return str(int(state or 0) + events.agg(F.sum(F.col("payload").cast("string").cast("long"))).first()[0])

    assert (first := catch_up(log, store, "total", 1, total)) and (first.state, first.position, first.revision) == ("17", 2, 1)
    assert catch_up(log, store, "total", 1, total) == first
    execute(log, decided({b"z": 3}, None), F.col("head"))
    assert catch_up(log, store, "total", 1, total).state == "20"
    with pytest.raises(SchemaMismatch):
        catch_up(log, store, "total", 2, total)
    assert (again := catch_up(log, store, "total", 2, total, rebuild=True)) and (again.state, again.revision) == ("20", 3)


def test_an_unknown_outcome_is_settled_by_the_mark(log, monkeypatch):
    import os

    real = os.link

    def lost(a, b):
        real(a, b)
        raise OSError("the answer got lost")

    monkeypatch.setattr(os, "link", lost)
    assert log.append(run(log, b"a", None, [1]))[1] == 1
    monkeypatch.setattr(os, "link", real)
    assert log.view().frame.count() == 1


def test_positions_of_a_wide_append_are_gapless(log):
    rows = log.spark.range(400_000).select(
        F.concat(F.lit("s"), (F.col("id") % 5000).cast("string")).cast("binary").alias("stream_id"), F.lit(None).cast("long").alias("expected"),
        (F.expr("id div 5000") + 1).alias("version"), F.lit("E").alias("event_type"), F.lit(1).cast("long").alias("schema_version"),
        F.repeat(F.col("id").cast("string"), 20).cast("binary").alias("payload"), F.lit(None).cast("binary").alias("metadata"),
    )
    log.append(rows)
    got = log.view().frame.agg(F.count("*"), F.count_distinct("position"), F.min("position"), F.max("position")).first()
    assert tuple(got) == (400_000, 400_000, 1, 400_000)
