from tidelog.streaming.subscribe import Steps, live_balances, subscribe, subscribe_stream

SCHEMA = "position long, stream_id long, version long, delta long"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_backlog_then_one_mark_then_live(spark, tmp_path):
    path, seen = f"{tmp_path}/log", []
    write(spark, path, [(1, 1, 1, 5), (2, 2, 1, 5)])
    write(spark, path, [(3, 1, 2, 5)])
    steps = Steps(lambda batch, _: seen.extend(r.position for r in batch.collect()), lambda: seen.append("caught up"))
    steps.drain(subscribe(spark, path, SCHEMA, after=1), f"{tmp_path}/ck")
    assert sorted(seen[:-1]) == [2, 3] and seen[-1] == "caught up"
    write(spark, path, [(4, 1, 3, 5)])
    steps.drain(subscribe(spark, path, SCHEMA, after=1), f"{tmp_path}/ck")
    assert seen[-2:] == ["caught up", 4] and seen.count("caught up") == 1


def test_one_stream(spark, tmp_path):
    path, seen = f"{tmp_path}/log", []
    write(spark, path, [(1, 1, 1, 5), (2, 2, 1, 5), (3, 1, 2, 5)])
    Steps(lambda batch, _: seen.extend(r.version for r in batch.collect()), lambda: None).drain(subscribe_stream(spark, path, SCHEMA, 1, 1), f"{tmp_path}/ck")
    assert seen == [2]


def test_balances_wait_for_missing_versions(spark, tmp_path):
    path = f"{tmp_path}/log"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    parts = [[(2, 1, 2, -8), (3, 2, 1, 4)], [(1, 1, 1, 5)], [(4, 1, 3, 100), (2, 1, 2, -8)]]
    last = {}

    def keep(batch, _):
        last.update({r.stream_id: (r.head, r.balance, r.poisoned_at) for r in batch.collect()})

    write(spark, path, parts[0])
    for extra in parts[1:] + [[]]:
        query = live_balances(subscribe(spark, path, SCHEMA)).writeStream.outputMode("update").foreachBatch(keep)
        query.option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        if extra:
            write(spark, path, extra)
    assert last == {1: (3, 97, 2), 2: (1, 4, None)}
