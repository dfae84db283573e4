"""Streams give the rows of the batch forms."""

import json

from pyspark.sql import functions as F

from tessera.operators import telemetry as TM
from tessera.streaming import streams

SF = "/root/testdata/sf0.001"


def run(df, tmp_path, spark, mode="append"):
    name = "out_" + tmp_path.name.replace("-", "_")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def events(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)


def test_counters_equal_batch(spark, tmp_path):
    got = run(streams.stream_counters(events(spark), ["event_type"]), tmp_path, spark, "complete")
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.window("ts", "1 hour").start.alias("window_start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_health_equals_batch(spark, tmp_path):
    kind = F.col("event_type")
    args = (kind == "view", kind == "click", kind == "purchase", F.col("value"))
    got = run(streams.stream_search_health(events(spark), *args, window="1 hour", slide="1 hour"), tmp_path, spark, "complete")
    batch = TM.search_health(spark.read.parquet(f"{SF}/events.parquet"), "1 hour", *args)
    assert sorted((r.window_start, r.n, r.hit_ratio) for r in got.collect()) == sorted((r.window_start, r.n, r.hit_ratio) for r in batch.collect())


def test_last_run(spark, tmp_path):
    runs = events(spark).select(F.col("event_type").alias("profile"), "ts", (F.col("user_id") % 2 == 0).alias("success"))
    got = {r.profile: r.last_run for r in run(streams.stream_last_run(runs), tmp_path, spark, "complete").collect()}
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy("event_type").agg(F.max("ts").alias("t")).collect()
    assert got == {r.event_type: r.t for r in batch}


def test_feedback_replay_counts_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    line = {"request_id": "r1", "timestamp": "2024-08-01T00:00:00Z", "rank": 1, "query": "q", "feedback_vote": 4.0}
    (log / "a.jsonl").write_text("\n".join(json.dumps(line | {"rank": i}) for i in (1, 2, 1)) + "\nbroken")
    got = run(streams.stream_feedback(spark, str(log)), tmp_path, spark)
    assert sorted(r["rank"] for r in got.collect()) == ["1", "2"]


def test_ingest_batches(spark, tmp_path):
    store = str(tmp_path / "store")
    step = streams.ingest_batch(store)
    schema = "path string, content string, modified long"
    step(spark.createDataFrame([("a", "x" * 1500, 1), ("b", "short", 1)], schema), 0)
    assert sorted(r.chunk_id for r in streams.stored_chunks(spark, store).collect()) == ["a::0", "a::1", "b::0"]
    second = spark.createDataFrame([("a", "x" * 100, 2), ("b", "short", 1), ("c", " ", 1)], schema)
    for _ in range(2):  # a batch that runs again changes nothing
        step(second, 1)
        got = streams.stored_chunks(spark, store).collect()
        assert sorted((r.chunk_id, r.epoch, len(r.vector)) for r in got) == [("a::0", 1, 8), ("b::0", 0, 8)]
        assert sorted((r.path, r.chunk_count, r.epoch) for r in streams.stored_ledger(spark, store).collect()) == [("a", 1, 1), ("b", 1, 0), ("c", 0, 1)]


def test_stream_ingest_follows_a_tree(spark, tmp_path):
    root, store = tmp_path / "tree", str(tmp_path / "store")
    (root / "docs").mkdir(parents=True)
    (root / "docs/a.md").write_text("one\r\ntwo")
    (root / "docs/b.bin").write_bytes(b"x\x00y")
    (root / "other.md").write_text("not asked for")
    watch = lambda: streams.stream_ingest(spark, str(root), store, str(tmp_path / "cp")).awaitTermination(120)
    watch()
    assert [(r.path, r.text) for r in streams.stored_chunks(spark, store).collect()] == [("docs/a.md", "one\ntwo")]
    (root / "docs/c.md").write_text("three")
    watch()
    got = streams.stored_chunks(spark, store).collect()
    assert sorted((r.path, r.epoch) for r in got) == [("docs/a.md", 0), ("docs/c.md", 1)]
    assert len({r.point_id for r in got}) == 2


def test_sketches_of_panes(spark):
    """A window's P95 is off by no more than the stated share of its rows, and exact for few."""
    n, k = 40_000, 200
    df = spark.range(n).select(F.timestamp_seconds(F.col("id") % 3600).alias("ts"), (F.hash("id") % 100_000).cast("double").alias("v"), (F.col("id") % 3 == 0).alias("hit"))
    panes = streams.health_panes(df, F.col("hit"), ~F.col("hit"), F.lit(False), F.col("v"), "1 minute", k)
    assert panes.count() == 60
    windows = streams.windows_of_panes(panes, "30 minutes", "10 minutes", k).collect()
    values = [(r.ts.timestamp(), r.v) for r in df.collect()]
    assert len(windows) == 8
    for w in windows:
        inside = [v for t, v in values if w.window_start.timestamp() <= t < w.window_end.timestamp()]
        share = sum(v <= w.p95_latency for v in inside) / len(inside)
        assert len(inside) == w.n and abs(share - 0.95) <= 2.3 / k**0.9
    few = streams.windows_of_panes(streams.health_panes(df.where("id % 400 = 0"), F.col("hit"), ~F.col("hit"), F.lit(False), F.col("v")), "30 minutes", "30 minutes").collect()
    for w in few:
        inside = sorted(r.v for r in df.where("id % 400 = 0").collect() if w.window_start <= r.ts < w.window_end)
        assert w.p95_latency == inside[-(-95 * len(inside) // 100) - 1]
    none = streams.windows_of_panes(streams.health_panes(df.where("id < 10"), F.col("hit"), ~F.col("hit"), F.lit(False), F.lit(None).cast("double")), "30 minutes", "30 minutes").collect()
    assert [(w.n, w.p95_latency) for w in none] == [(10, None)]


def test_removals_leave_the_store(spark, tmp_path):
    """A path that a listing lacks goes; a listing read again changes nothing; the path may come back."""
    store, listed, cp = str(tmp_path / "store"), str(tmp_path / "listed"), str(tmp_path / "cp")
    streams.ingest_batch(store)(spark.createDataFrame([("src/a.py", "AMessage x", 1), ("src/b.py", "two", 1), ("docs/c.md", " ", 1)], "path string, content string, modified long"), 0)
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    catalog = spark.createDataFrame([], "ord int, name string, key_lower string, dependencies array<string>")
    try:
        for hour, paths in ((1, "src/a.py src/b.py docs/c.md"), (2, "src/b.py docs/c.md"), (2, "src/b.py docs/c.md"), (3, "src/b.py docs/c.md")):
            rows = spark.createDataFrame([(p, "d") for p in paths.split()], "path string, digest string").withColumn("listed_at", F.timestamp_seconds(F.lit(3600 * hour)))
            rows.write.mode("append").parquet(listed)
            changes = streams.listing_changes(spark.readStream.schema(rows.schema).parquet(listed))
            streams.stream_removals(changes, store, cp).awaitTermination(120)
            left = sorted(r.path for r in streams.stored_ledger(spark, store).collect())
            assert left == (["docs/c.md", "src/a.py", "src/b.py"] if hour == 1 else ["docs/c.md", "src/b.py"])
    finally:
        spark.conf.unset(name)
    assert {r.path for r in streams.stored_chunks(spark, store).collect()} == {"src/b.py"}
    nodes, edges = streams.stored_graph(spark, store, catalog)
    assert not nodes.where("id like '%a.py%' or label = 'IntegrationMessage'").count() and not edges.where("src like '%a.py%'").count()
    streams.ingest_batch(store)(spark.createDataFrame([("src/a.py", "back", 2)], "path string, content string, modified long"), 1)
    assert sorted((r.path, r.text) for r in streams.stored_chunks(spark, store).collect()) == [("src/a.py", "back"), ("src/b.py", "two")]
