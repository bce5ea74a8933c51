"""The streaming drivers give what the batch drivers give."""

from pathlib import Path

from pyspark.sql import functions as F

from waymark.operators import estimators as E
from waymark.streaming import stateful as S

SCHEMA = "session_id long, seq long, available boolean, accuracy double"


def rows(spark):
    return spark.range(200).select((F.col("id") % 3).alias("session_id"), F.col("id").alias("seq"), (F.col("id") % 50 < 30).alias("available"), (F.col("id") % 17).cast("double").alias("accuracy"))


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in range(2):
        rows(spark).where(f"seq div 100 = {part}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    inputs = ["available", "accuracy"]
    out = S.stream_fold(stream, E.QualityMachine, inputs, E.QualityMachine.OUTPUTS)
    query = out.writeStream.format("memory").queryName("modes").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["session_id"], r["seq"]): r["mode"] for r in spark.table("modes").collect()}
    want = {(r["session_id"], r["seq"]): r["mode"] for r in E.fold(rows(spark), E.QualityMachine, inputs, E.QualityMachine.OUTPUTS).collect()}
    assert got == want


def test_append_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):  # the same rows twice
        rows(spark).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = S.append_once(stream, target, ["session_id", "seq"], str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(target).count() == 200


def test_outage_timer():
    timer = S.OutageTimer()
    said = [timer.step(t, t == 0)[0] for t in range(0, 9000, 500)]
    assert [i * 500 for i, x in enumerate(said) if x] == [6500, 7500, 8500]


def test_late_gate():
    gate = S.LateGate()
    assert [gate.step(t)[0] for t in (5, 5, 3, 6)] == [True, True, False, True]


def test_last_state_of_each_session_can_be_asked_for(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "c")
    Path(source).mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    out = S.keep_latest(stream, ["accuracy", "available"])
    for part, last in ((0, 99), (1, 199)):  # the stream is begun anew for the second part
        rows(spark).where(f"seq div 100 = {part}").coalesce(1).write.mode("append").parquet(source)
        query = out.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: batch.count()).start()
        query.processAllAvailable()
        query.stop()
        got = {(r["session_id"], r["seq"], r["accuracy"], r["available"]) for r in S.latest_states(spark, checkpoint).collect()}
        assert got == {(n % 3, n, float(n % 17), n % 50 < 30) for n in range(last - 2, last + 1)}
    before = {r["seq"] for r in S.latest_states(spark, checkpoint, batch=0).collect()}
    assert before == {97, 98, 99}


def test_append_once_by_day_across_restarts(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    dated = rows(spark).select("session_id", "seq", F.timestamp_seconds(86400 + F.col("seq") * 3600).alias("ts"))
    for checkpoint, delay in (("c1", "20 days"), ("c1", "20 days"), ("c2", None)):  # again after a restart, and once more with its progress lost
        dated.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("session_id long, seq long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        query = S.append_once(stream, target, ["session_id", "seq", "ts"], str(tmp_path / checkpoint), time="ts", delay=delay).start()
        query.processAllAvailable()
        query.stop()
    found = spark.read.parquet(target)
    assert found.count() == 200 and found.select("day").distinct().count() == 9
