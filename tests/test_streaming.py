"""Streams give the rows of their batch forms."""

from quillon.streaming import events as S


def made(spark, folder):
    rows = spark.range(400).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 97 % 50000) as ts", "id % 7 as user_id",
        "concat('t', id % 3) as event_type", "cast(id as double) as value", "'{}' as props",
    )
    rows.repartition(3).write.parquet(folder)
    return rows.withColumn("ts", rows.ts.cast("timestamp"))


def streamed(spark, folder, build, mode, name, checkpoint):
    q = build(S.read(spark, folder)).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_windows_and_frequencies(spark, tmp_path):
    batch = made(spark, str(tmp_path / "in"))
    for name, build in (("windows", S.windows), ("frequencies", S.frequencies)):
        got = streamed(spark, str(tmp_path / "in"), lambda e, b=build: b(e, late="30 days"), "complete", name, str(tmp_path / name))
        assert sorted(got.collect()) == sorted(build(batch).collect())


def test_sessions(spark, tmp_path):
    batch = made(spark, str(tmp_path / "in"))
    got = streamed(spark, str(tmp_path / "in"), lambda e: S.sessions(e, late="30 days"), "complete", "sessions", str(tmp_path / "c"))
    assert sorted(got.collect()) == sorted(S.sessions(batch).collect())


def test_gaps(spark, tmp_path):
    batch = made(spark, str(tmp_path / "in"))
    spark.read.parquet(str(tmp_path / "in")).coalesce(1).orderBy("ts").write.parquet(str(tmp_path / "one"))
    got = streamed(spark, str(tmp_path / "one"), S.gaps, "update", "gaps", str(tmp_path / "c")).collect()
    assert {r.event_type: r.n for r in got} == {r.event_type: r["count"] - 1 for r in batch.groupBy("event_type").count().collect()}
