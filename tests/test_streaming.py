import pytest
from pyspark.sql import functions as F

from quarry.operators import metrics as M
from quarry.sources.adapters import change_rows, health, requests
from quarry.streaming import changes as S
from quarry.streaming import state as T

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@pytest.fixture
def events(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def ran(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_counts(spark, events):
    stream = S.read_events(spark, events, EVENTS)
    ran(S.count_by_type(S.classify(change_rows(stream))), "counts", "complete")
    batch = S.count_by_type(S.classify(change_rows(spark.read.parquet(events))))
    assert sorted(spark.table("counts").collect()) == sorted(batch.collect())


def test_running_health(spark, events, sf_dir):
    checks = lambda e: e.select(F.col("user_id").alias("monitor"), (F.col("event_type") != "error").alias("healthy"), F.col("value").alias("ms"))
    ran(S.running_health(checks(S.read_events(spark, events, EVENTS))), "health", "complete")
    got = {r.monitor: (r.total, r.failed, pytest.approx(r.avg_ms)) for r in spark.table("health").collect()}
    assert {r.monitor: (r.total, r.failed, r.avg_ms) for r in M.health_metrics(health(spark, sf_dir)).collect()} == got


def test_leading_debounce(spark, events):
    ran(S.leading(change_rows(S.read_events(spark, events, EVENTS)), 3600), "leading")
    want = M.debounced(change_rows(spark.read.parquet(events)), 3600)
    assert sorted(spark.table("leading").collect()) == sorted(want.collect())


def test_trailing_debounce(spark, events):
    late = spark.read.parquet(events).limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 400 DAYS")).withColumn("event_id", F.lit(-1).cast("long"))
    late.write.mode("append").parquet(events)
    ran(S.trailing(change_rows(S.read_events(spark, events, EVENTS))), "trailing")
    want = M.settled(change_rows(spark.read.parquet(events).where("event_id >= 0")))
    key = lambda rows: sorted((r.path, r.events, r.last_event) for r in rows)
    assert key(spark.table("trailing").where("last_event >= 0").collect()) == key(want.collect())


def in_parts(spark, sf_dir, folder, parts):
    """Events in order of time, dealt into files that arrive one after the other."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("ts", "event_id").toPandas()
    size = -(-len(rows) // parts)
    frames = [spark.createDataFrame(rows[k : k + size], EVENTS) for k in range(0, len(rows), size)]
    return [lambda k=k, f=f: f.coalesce(1).write.mode("append").parquet(f"{folder}/p{k}") for k, f in enumerate(frames)]


def step(spark, make, folder, name, tmp_path, part=""):
    stream = make(spark.readStream.schema(EVENTS).option("recursiveFileLookup", True).parquet(folder))
    write = lambda df, n: df.write.mode("append").parquet(str(tmp_path / f"{name}{part}"))
    stream.writeStream.outputMode("update" if name == "rings" else "append").foreachBatch(write).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start().awaitTermination()


def test_rate_limit_goes_on_after_a_restart(spark, sf_dir, tmp_path):
    """Each part is a run of its own from the checkpoint: together they decide as the batch twin does."""
    folder = str(tmp_path / "in")
    clients = lambda e: e.select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client"), "ts", "event_id")
    for arrive in in_parts(spark, sf_dir, folder, 4):
        arrive()
        step(spark, lambda e: T.limited(clients(e), 3, 86_400, 100 * 86_400), folder, "limits", tmp_path)
    got = spark.read.parquet(str(tmp_path / "limits"))
    want = M.rate_decisions(requests(spark, sf_dir), 3, 86_400)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.where("not accepted").count() > 0 and got.where("not accepted and retry_after < 1").count() == 0
    held = spark.read.format("statestore").option("stateVarName", "taken").load(str(tmp_path / "limits-c"))
    assert held.groupBy("key").count().agg({"count": "max"}).first()[0] <= 3


def test_idle_clients_leave_no_state(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "in")
    schema = "client string, ts timestamp_ntz, event_id long"
    make = lambda e: T.limited(e.select(F.col("props").alias("client"), "ts", "event_id"), 2, 60, 120)
    for k, rows in enumerate(([("a", 0), ("a", 1), ("a", 2), ("b", 3)], [("b", 600)], [("b", 601), ("c", 602)], [("c", 1200)])):
        data = [(client, f"2024-01-01T00:{s // 60:02}:{s % 60:02}", 10 * k + n) for n, (client, s) in enumerate(rows)]
        events = spark.createDataFrame(data, "client string, ts string, event_id long").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "0L user_id", "'view' event_type", "1d value", "client props")
        events.coalesce(1).write.parquet(f"{folder}/p{k}")
        step(spark, make, folder, "idle", tmp_path)
    got = {r.event_id: (r.accepted, r.retry_after) for r in spark.read.schema("client string, event_id long, accepted boolean, retry_after long").parquet(str(tmp_path / "idle")).collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (False, 59), 3: (True, 0), 10: (True, 0), 20: (True, 0), 21: (True, 0), 30: (True, 0)}
    held = spark.read.format("statestore").option("stateVarName", "taken").load(str(tmp_path / "idle-c"))
    assert {r.key[0] for r in held.collect()} <= {"b", "c"} and schema


def test_history_keeps_the_last_checks(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "in")
    checks = lambda e: e.select(F.col("user_id").alias("monitor"), "ts", "event_id", (F.col("event_type") != "error").alias("healthy"), F.col("value").alias("ms"))
    rounded = lambda df: {(r.monitor, r.checks, r.failed, r.avg_ms and round(r.avg_ms, 9), r.consecutive, r.last_event) for r in df.collect()}
    for k, arrive in enumerate(in_parts(spark, sf_dir, folder, 3)):
        arrive()
        step(spark, lambda e: T.health_history(checks(e), 7), folder, "rings", tmp_path, k)
        seen = checks(spark.read.schema(EVENTS).option("recursiveFileLookup", True).parquet(folder))
        told = rounded(spark.read.parquet(str(tmp_path / f"rings{k}")))
        assert told and told <= rounded(M.health_history(seen, 7))
    held = spark.read.format("statestore").option("stateVarName", "ring").load(str(tmp_path / "rings-c"))
    rings = {r["key"][0]: r["n"] for r in held.groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert rings == {r.monitor: r.checks for r in M.health_history(seen, 7).collect()} and max(rings.values()) == 7


def test_apply_changes(spark, tmp_path):
    stored = spark.createDataFrame([("p", "a", "old"), ("p", "b", "old"), ("p", "c", "old")], "project_id string, file_path string, content_hash string")
    changes = spark.createDataFrame([("p", "a", "deleted", 1, 1), ("p", "b", "deleted", 1, 2), ("p", "b", "created", 2, 3), ("p", "d", "created", 2, 4), ("p", "d", "modified", 2, 5)], "project_id string, file_path string, change_type string, ts long, event_id long")
    index = lambda files: files.select("project_id", "file_path", F.lit("new").alias("content_hash"))
    got = S.apply_changes(stored, changes, index).collect()
    assert sorted((r.file_path, r.content_hash) for r in got) == [("b", "new"), ("c", "old"), ("d", "new")]
