from quillmill.operators.changes import replay
from quillmill.streaming.follow import Replica, on_change, windowed_counts


def test_stream_is_batch(spark, tmp_path):
    schema = "id string, n int, op string, v int"
    ops = [("a", 1, "put", 9), ("a", 2, "delete", None), ("c", 1, "put", 3), ("b", 1, "put", 7)]
    for k, op in enumerate(ops):
        spark.createDataFrame([op], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    index = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    replica = Replica(index, "id", ["n"])
    replica.follow(stream(), str(tmp_path / "checkpoint")).awaitTermination()
    wanted = replay(index, spark.createDataFrame(ops, schema), "id", ["n"])
    assert sorted(map(tuple, replica.table.collect())) == sorted(map(tuple, wanted.collect()))
    seen = []
    on_change(stream(), lambda df: seen.extend(r["id"] for r in df.collect()), "id", ["n"], str(tmp_path / "other")).awaitTermination()
    assert sorted(seen) == ["a", "a", "b", "c"]
    assert windowed_counts(spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path)), "ts", "kind").isStreaming
