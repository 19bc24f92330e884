import datetime as dt

from gridload.session import scratch_path
from gridload.streaming import lockout as LO
from gridload.streaming import streams as ST

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def attempts(spark, rows):
    return spark.createDataFrame([(1, i, T0 + dt.timedelta(minutes=m), ok) for i, (m, ok) in enumerate(rows)],
                                 "user_id bigint, event_id bigint, ts timestamp_ntz, success boolean")


def test_lockout_model(spark):
    rows = [(0, False), (1, False), (2, False), (5, False), (16, False), (17, True), (18, False)]
    out = [r.outcome for r in LO.lockout_batch(attempts(spark, rows)).orderBy("event_id").collect()]
    assert out == ["failed", "failed", "locked", "ignored_locked", "ignored_locked", "success", "failed"]


def test_lockout_expiry_resets(spark):
    rows = [(0, False), (1, False), (2, False), (17, False), (18, False), (19, False)]
    out = [r.outcome for r in LO.lockout_batch(attempts(spark, rows)).orderBy("event_id").collect()]
    assert out == ["failed", "failed", "locked", "failed", "failed", "locked"]


def test_late_attempts_across_batches_equal_the_batch_result(spark):
    import random

    rnd = random.Random(5)
    schema = "user_id bigint, event_id bigint, ts timestamp_ntz, success boolean"
    rows, eid = [], 0
    for user in range(8):
        t = 0
        for _ in range(40):
            t += rnd.choice([0, 1, 2, 7, 14, 15, 16, 40])
            eid += 1
            rows.append((user, eid, T0 + dt.timedelta(minutes=t, microseconds=rnd.randrange(3)), rnd.random() < 0.4))
    late = sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rnd.uniform(0, 30)))  # up to 30 minutes late
    end = (None, None, max(r[2] for r in rows) + dt.timedelta(hours=1), None)
    src, sink, ckpt = (scratch_path(spark, x) for x in ("lock-src", "lock-sink", "lock-ckpt"))
    for i in range(0, len(late), 80):  # a run per file: state and timers come back from the checkpoint
        part = late[i:i + 80] + ([end] if i + 80 >= len(late) else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = ST.file_stream(spark, src, spark.createDataFrame([], schema).schema, 1)
        with ST.rocksdb_state(spark):
            q = (LO.lockout_stream(stream, "31 minutes").writeStream.format("parquet").option("path", sink)
                 .option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    fields = ("user_id", "event_id", "ts", "success", "outcome", "failures", "locked_until")
    got = sorted(tuple(r[f] for f in fields) for r in spark.read.parquet(sink).collect())
    want = sorted(tuple(r[f] for f in fields) for r in LO.lockout_batch(spark.createDataFrame(rows, schema)).collect())
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert [r[6] for r in got] == [r[6] for r in want]


def test_stretches_equal_the_sequential_replay(spark):
    import random

    rnd = random.Random(3)
    rows, want = [], {}
    for user, n in ((1, 3000), (2, 40), (3, 1)):
        t, failures, locked = 0, 0, None
        for i in range(n):
            t += rnd.choice([0, 1, 2, 7, 14, 15, 16, 40])
            ts, ok = T0 + dt.timedelta(minutes=t), rnd.random() < 0.4
            rows.append((user, i, ts, ok))
            outcome, failures, locked = LO.step(failures, locked, ts, ok)
            want[(user, i)] = (outcome, failures, locked)
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "user_id bigint, event_id bigint, ts timestamp_ntz, success boolean")
    got = {(r.user_id, r.event_id): (r.outcome, r.failures, r.locked_until) for r in LO.lockout_batch(df).collect()}
    assert got == want


def test_accepted_keys_join_the_target(spark):
    schema = "k int, ts timestamp_ntz"
    src, sink, ckpt = (scratch_path(spark, x) for x in ("src", "sink", "ckpt"))
    target = spark.createDataFrame([(1, T0)], schema)
    for i, ks in enumerate([[1, 2], [2, 3], [2, 3, 4]]):  # a run per file
        spark.createDataFrame([(k, T0 + dt.timedelta(days=i)) for k in ks], schema).coalesce(1).write.mode("append").parquet(src)
        ST.new_records_stream(ST.file_stream(spark, src, target.schema), target, ["k"], sink, ckpt).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(sink).collect()) == [2, 3, 4]


def test_registered_stream_lockout_equals_batch(spark, small_dir):
    import __spark_entry__ as E

    got = {(r.event_id, r.outcome, r.failures) for r in E.queries()["t3_lockout_stream"](spark, small_dir).collect()}
    ev = spark.read.parquet(f"{small_dir}/events.parquet")
    want = {(r.event_id, r.outcome, r.failures) for r in LO.lockout_batch(LO.login_attempts(ev)).collect()}
    assert got == want
