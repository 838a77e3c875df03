"""The streaming forms and the limiter against plain versions."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators import limits
from docloom.plans import registry
from docloom.streaming import feeds

SCHEMA = "key long, event long, ts timestamp, removed boolean"
START = dt.datetime(2024, 1, 1)


def rows():
    at = [0, 10, 20, 30, 61, 62, 200, 201, 202, 203, 203, 300]
    out = [(k, 100 * k + i, START + dt.timedelta(seconds=s), i % 5 == 4) for k in (1, 2) for i, s in enumerate(at)]
    return out + [(None, 7, START, False), (3, 8, None, False)]


def plain(events, limit, seconds):
    found, kept = {}, {}
    for key, event, ts, _ in sorted(events, key=lambda r: (r[2] or START, r[1])):
        times = kept.setdefault(key, [])
        found[event] = ts is not None and sum((ts - t).total_seconds() < seconds for t in times) < limit
        if found[event]:
            times.append(ts)
    return found


def files(spark, path):
    data = rows()
    for n, part in enumerate((data[:8], data[8:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/{n}")
    return data


def test_limiter_over_tables(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).withColumn("_k", F.lit("clash"))
    got = {r.event: r.accepted for r in limits.rate_limited(df, "key", "ts", "event", 3, 60).collect()}
    assert got == plain(data, 3, 60)
    assert limits.rate_limited(df.limit(0), "key", "ts", "event", 3, 60).count() == 0


def test_limited_events_is_as_brute_force(spark, sf_dir):
    events = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", F.lit(False)).collect()]
    got = {r.event_id: r.accepted for r in registry.QUERIES["limited_events"](spark, sf_dir).collect()}
    assert got == plain(events, 2, 12 * 3600)


def test_limiter_over_a_stream(spark, tmp_path):
    data = files(spark, tmp_path / "in")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = feeds.rate_limited(stream, "key", "ts", "event", 3, 60).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.event: r.accepted for r in spark.table("limited").collect()} == plain(data, 3, 60)


def test_changes_are_applied_batch_by_batch(spark, tmp_path):
    data = files(spark, tmp_path / "in")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feeds.apply_changes(stream, "key", ["ts", "event"], str(tmp_path / "state"), str(tmp_path / "c")).awaitTermination()
    got = {(r.key, r.event) for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / "state" / "v=1")).collect()}
    newest = {}
    for key, event, ts, _ in data:
        newest[key] = max(newest.get(key, (dt.datetime.min, -1)), (ts or dt.datetime.min, event))
    assert got == {(k, e) for k, (_, e) in newest.items()}


def test_each_key_once(spark, tmp_path):
    files(spark, tmp_path / "in")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).where("ts IS NOT NULL")
    query = feeds.once_each(stream, ["key"], "ts", "1 hour").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(str(r.key) for r in spark.table("once").collect()) == ["1", "2", "None"]


def plain_within(events, limits_):
    found, kept = {}, {}
    for key, event, ts, _ in sorted(events, key=lambda r: (r[2] or START, r[1])):
        times = kept.setdefault(key, [])
        found[event] = ts is not None and all(sum((ts - t).total_seconds() < seconds for t in times) < limit for limit, seconds in limits_)
        if found[event]:
            times.append(ts)
    return found


def test_two_limits_over_tables_and_streams(spark, sf_dir, tmp_path):
    both = [(3, 60), (5, 250)]
    data = files(spark, tmp_path / "in")
    df = spark.createDataFrame(data, SCHEMA)
    assert {r.event: r.accepted for r in limits.limited_within(df, "key", "ts", "event", both).collect()} == plain_within(data, both) != plain(data, 3, 60)
    events = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", F.lit(False)).collect()]
    got = {r.event_id: r.accepted for r in registry.QUERIES["doubly_limited_events"](spark, sf_dir).collect()}
    assert got == plain_within(events, [(2, 12 * 3600), (3, 72 * 3600)])
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = feeds.limited_within(stream, "key", "ts", "event", both, "1 hour").writeStream.format("memory").queryName("within").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got, want = {r.event: r.accepted for r in spark.table("within").collect()}, plain_within(data, both)
    assert {e: a for e, a in got.items() if e != 8} == {e: a for e, a in want.items() if e != 8} and not got.get(8)


def test_silence_is_told_by_a_timer(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    parts = [[(1, 1, at(0), False), (2, 2, at(5), False)], [(2, 3, at(100), False)], [(3, 4, at(500), False)], [(2, 5, at(2000), False), (1, 6, at(2001), False)], [(3, 7, at(9000), False)]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = feeds.silences(stream, "key", "ts", 300, "10 seconds").writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.key, int((r.since - START).total_seconds())) for r in spark.table("silent").collect()}
    assert got == {(1, 0), (2, 100), (3, 500), (1, 2001), (2, 2000)}  # the last two by timers, and 3 may still speak


def test_state_in_buckets_writes_what_it_touches_and_relists(spark, tmp_path):
    schema = T.StructType.fromDDL("key long, value string, ts timestamp, removed boolean")
    at = lambda s: START + dt.timedelta(seconds=s)
    parts = [[(k, "a", at(0), False) for k in range(300)], [(5, "b", at(10), False), (6, None, at(10), True)], [(6, "old", at(5), False), (7, None, at(20), True)]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "state")
    feeds.apply_in_buckets(stream, "key", ["ts"], path, str(tmp_path / "c"), forget="removed AND ts < '2024-01-01 00:00:15'").awaitTermination()
    want = {k: "a" for k in range(300)} | {5: "b"}
    del want[6], want[7]
    after = {r.key: r.value for r in feeds.state(spark, path, schema, 2).collect()}
    assert {k: v for k, v in after.items() if k != 6} == want and after.get(6) in (None, "old")  # its removal was old enough to be forgotten
    assert len([d for d in (tmp_path / "state" / "rows" / "v=1").iterdir() if d.name.startswith("bucket=")]) <= 2 and len(feeds._manifest(spark, path, 2)) > 40
    known = feeds.state(spark, path, schema, 2)
    listing = spark.createDataFrame([(k, "new", at(50), False) for k in range(100, 320)], schema)
    changes = feeds.relist(listing, known, "key", "ts", F.lit(at(40)).cast("timestamp"))
    feeds._merged(changes, 3, "key", ["ts"], path, None)
    assert {r.key: r.value for r in feeds.state(spark, path, schema, 3).collect()} == {k: "new" for k in range(100, 320)}
