"""Streams over files: append, restart, compaction, windows, stopping."""

import json

from pyspark.sql import functions as F

from tesseral.streaming import streams

SCHEMA = "id string, step int, score double, run string, ts timestamp"


def put(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def rows(*ids, score=1.0, day=1):
    return [{"id": i, "step": n, "score": score, "run": "r", "ts": f"2024-01-{day:02d}T00:00:00Z"} for n, i in enumerate(ids)]


def test_append_goes_on_where_it_stopped(spark, tmp_path):
    put(tmp_path / "in", "a.json", rows("a", "b"))
    for extra in ([], rows("c")):
        if extra:
            put(tmp_path / "in", "b.json", extra)
        streams.append(streams.read_stream(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.id for r in out.collect()) == ["a", "b", "c"]
    prompts = spark.createDataFrame([("a",), ("z",)], "id string")
    assert [r.id for r in streams.resume(prompts, out, "id").collect()] == ["z"]


def test_compaction(spark, tmp_path):
    put(tmp_path / "in", "a.json", rows("a", "b"))
    run = lambda: streams.compacting(streams.read_stream(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "t"), str(tmp_path / "cp"), "id", "step").awaitTermination()
    run()
    put(tmp_path / "in", "b.json", [{"id": "a", "step": 9, "score": 5.0}])
    run()
    shown = lambda: {r.id: r.score for r in streams.current(spark, str(tmp_path / "t")).collect()}
    assert shown() == {"a": 5.0, "b": 1.0}
    many = [f"k{i}" for i in range(300)]
    for n in range(2, 6):
        put(tmp_path / "in", f"c{n}.json", [{"id": k, "step": n, "score": float(n)} for k in many[:: n - 1]])
        run()
    want = {"a": 5.0, "b": 1.0} | {k: float(max(n for n in range(2, 6) if i % (n - 1) == 0)) for i, k in enumerate(many)}
    assert shown() == want
    versions = streams._versions(spark, str(tmp_path / "t"))
    assert max(len(v) for v in versions.values()) <= 2 and len(versions) > 20
    batch = spark.createDataFrame([("a", 10, 7.0)], "id string, step int, score double")
    for _ in range(2):  # a batch that is tried again
        streams.merged(batch.select("id", "step", "score"), 9, str(tmp_path / "u"), ["id"], "step")
    assert streams.current(spark, str(tmp_path / "u")).collect() == batch.collect()
    assert streams.current(spark, str(tmp_path / "none"), "id string").count() == 0


def test_running_and_windows(spark, tmp_path):
    put(tmp_path / "in", "a.json", rows("a", "b") + rows("c", day=3))
    stream = streams.read_stream(spark, str(tmp_path / "in"), SCHEMA)
    run = lambda: streams.running(stream, ["run"], [F.count("*").alias("n")], str(tmp_path / "counts"), str(tmp_path / "cp")).awaitTermination()
    run()
    assert [(r.run, r.n) for r in streams.current(spark, str(tmp_path / "counts")).collect()] == [("r", 3)]
    put(tmp_path / "in", "b.json", rows("d") + [{"id": "e", "run": "s"}])
    run()
    assert {(r.run, r.n) for r in streams.current(spark, str(tmp_path / "counts")).collect()} == {("r", 4), ("s", 1)}
    (tmp_path / "in/b.json").unlink()
    batch = spark.read.schema(SCHEMA).json(str(tmp_path / "in"))
    assert sorted(r.n for r in streams.tumbling(batch, "ts", "1 day", [], [F.count("*").alias("n")]).collect()) == [1, 2]
    assert streams.sliding(batch, "ts", "2 days", "1 day", [], [F.count("*").alias("n")]).count() == 4
    assert sorted(r.n for r in streams.sessions(batch, "ts", "1 hour", ["run"], [F.count("*").alias("n")]).collect()) == [1, 2]
    assert streams.every(batch, "step", 2).count() == 2


def test_early_stop(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    scores = [0.5, 0.9, 0.7, 0.6, 0.5]
    put(tmp_path / "in", "a.json", [{"run": "x", "step": i, "score": s} for i, s in enumerate(scores)])
    stream = streams.read_stream(spark, str(tmp_path / "in"), SCHEMA).select("run", "step", "score")
    q = streams.early_stop(stream, 10, 3).writeStream.format("memory").queryName("stops").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.best, r.strikes, r.stopped) for r in spark.table("stops").collect()] == [(0.9, 3, True)]


def test_progress():
    p = streams.Progress(100)
    assert p.seconds_left() is None
    p.rows, p.rate = 40, 6.0
    assert p.seconds_left() == 10
