import datetime as dt

from tidemark.streaming.mentions import exact_mentions, monthly_counts, upsert_batches


def rows(spark, path, values, schema):
    spark.createDataFrame(values, schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def drain(stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_counts_and_mentions(spark, tmp_path):
    s = rows(spark, str(tmp_path / "e"), [(dt.datetime(2026, 1, 1, 5), "a"), (dt.datetime(2026, 1, 1, 9), "a"), (dt.datetime(2026, 1, 2), "b")], "ts timestamp, event_type string")
    got = {(str(r.day), r.event_type, r.n) for r in drain(monthly_counts(s), "update", "counts").collect()}
    assert got == {("2026-01-01", "a", 2), ("2026-01-02", "b", 1)}
    m = rows(spark, str(tmp_path / "m"), [("A1", "Same span.", dt.datetime(2026, 1, 1)), ("A1", "same  span", dt.datetime(2026, 1, 2)), ("A2", "Same span.", dt.datetime(2026, 1, 2))], "article_id string, evidence string, published_at timestamp")
    assert drain(exact_mentions(m), "append", "mentions").count() == 2


def test_upserts(spark, tmp_path):
    s = rows(spark, str(tmp_path / "in"), [(1, "x", 1), (1, "y", 2), (2, "z", 1)], "k int, v string, seq int")
    q = upsert_batches(s, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "seq").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out/version=0")).collect()} == {(1, "y"), (2, "z")}
