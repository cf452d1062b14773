"""Streams against their tables: the expiring cache, sinks run into twice, confirmations, after restarts too."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from labelwright.streaming import cache, compact, confirmed, done_keys, latest, once_each, ttl_cache, upsert_latest

BEGIN = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(cache.PROVIDER[0])
    spark.conf.set(*cache.PROVIDER)
    yield spark
    spark.conf.set(cache.PROVIDER[0], before)


def asked():
    """Requests of 40 keys over 150 days; every third fetch fails."""
    rows = []
    for k in range(600):
        key = (k * k + k // 7) % 40
        at = BEGIN + timedelta(hours=6 * k, milliseconds=k % 5)
        rows.append((key, at, None if (k * 7 + key) % 3 == 0 else f"v{k}"))
    return rows


def served(rows, ttl=7, keep=20):
    """The cache in plain Python."""
    entry, out = {}, []
    for key, at, fetched in sorted(rows, key=lambda r: (r[1], r[2] is None, r[2])):
        old = entry.get(key)
        age = (at.date() - old[0].date()).days if old else None
        if old and age > keep:
            old = None
        if old and age <= ttl:
            out.append((key, at, "fresh", old[1]))
        elif fetched is not None:
            entry[key] = (at, fetched)
            out.append((key, at, "fetched", fetched))
        else:
            out.append((key, at, "stale_cache_served" if old else "missing", old[1] if old else None))
    return sorted(out, key=repr)


def lay(spark, rows, schema, path, parts):
    """The rows in order as so many files, named in order, a second apart."""
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.parquet(f"{path}/part-{i:03d}")


def run(stream, path, mode="append"):
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


SCHEMA = "key long, ts timestamp, fetched string"


def test_cache_in_micro_batches_and_after_a_restart_is_the_plain_one(rocks, tmp_path):
    spark, rows = rocks, asked()
    lay(spark, rows[:400], SCHEMA, f"{tmp_path}/in", 4)

    def stream():
        given = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        return ttl_cache(given, 7, 20)

    run(stream(), tmp_path)
    first = spark.read.parquet(f"{tmp_path}/out").count()
    # the rest comes after the query has ended; a new one goes on from the checkpoint with the state it finds there
    lay(spark, rows[400:], SCHEMA, f"{tmp_path}/in/more", 2)
    run(stream(), tmp_path)
    got = sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()), key=repr)
    assert first == 400 and got == served(rows)
    assert {s for _, _, s, _ in got} == {"fresh", "fetched", "stale_cache_served", "missing"}


def test_a_batch_run_twice_leaves_one_table(spark, tmp_path):
    rows = [(k % 9, BEGIN + timedelta(minutes=k), f"v{k}") for k in range(90)]
    lay(spark, rows, SCHEMA, f"{tmp_path}/in", 6)
    given = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    keep, calls = upsert_latest(f"{tmp_path}/table", "key", "ts"), []

    def killed(batch, epoch):
        keep(batch, epoch)
        calls.append(epoch)
        if len(calls) == 3:
            raise RuntimeError("killed after writing, before the checkpoint knows")

    def start(sink):
        return given.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()

    with pytest.raises(Exception, match="killed"):
        start(killed).awaitTermination()
    start(keep).awaitTermination()
    want = sorted((k, BEGIN + timedelta(minutes=81 + k), f"v{81 + k}") for k in range(9))
    table = lambda: sorted(map(tuple, latest(spark, f"{tmp_path}/table", "key", "ts", SCHEMA).collect()))
    assert table() == want
    compact(spark, f"{tmp_path}/table", "key", "ts", SCHEMA)
    compact(spark, f"{tmp_path}/table", "key", "ts", SCHEMA)
    assert table() == want
    keep(spark.createDataFrame([(3, BEGIN + timedelta(days=9), "newest")], SCHEMA), 77)
    assert dict((k, v) for k, _, v in table())[3] == "newest" and len(table()) == 9
    assert latest(spark, f"{tmp_path}/none", "key", "ts", SCHEMA).count() == 0


def test_each_key_is_worked_on_once(spark, tmp_path):
    rows = [(k % 25, BEGIN, "x") for k in range(100)]
    lay(spark, rows, SCHEMA, f"{tmp_path}/in", 5)
    given = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    sink, calls = once_each(f"{tmp_path}/table", "key", lambda new: new.groupBy("key").agg(F.count(F.lit(1)).alias("n"))), []

    def killed(batch, epoch):
        sink(batch, epoch)
        calls.append(epoch)
        if len(calls) == 2:
            raise RuntimeError("killed")

    def start(f):
        return given.writeStream.foreachBatch(f).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()

    with pytest.raises(Exception, match="killed"):
        start(killed).awaitTermination()
    start(sink).awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/table")
    assert sorted(r.key for r in got.collect()) == list(range(25))
    assert done_keys(spark, f"{tmp_path}/table", "key", "long").count() == 25


PAUSED, CONFIRMED = "key long, paused_at timestamp", "key long, confirmed_at timestamp, choice string"


def test_confirmations_of_streams_are_those_of_tables(spark, tmp_path):
    at = lambda h: BEGIN + timedelta(hours=h)
    paused = [(k, at(3 * k)) for k in range(40)]
    # in time, twice, before the pause, too late, for no one
    said = [(k, at(3 * k + (1, 47, -1, 49, 30)[k % 5]), f"c{k}") for k in range(40) if k % 7] + [(5, at(20), "again"), (99, at(9), "no one")]
    said.sort(key=lambda r: r[1])
    left, right = spark.createDataFrame(paused, PAUSED), spark.createDataFrame(said, CONFIRMED)
    want = sorted(map(repr, confirmed(left, right).select("key", "paused_at", "confirmed_at", "choice", "state").collect()))
    assert sum("unconfirmed" in r for r in want) > 10 and len(want) > 40
    # a last row on both sides lets the watermark pass all waits; it is not looked at
    end = at(2000)
    lay(spark, [*paused, (-1, end)], PAUSED, f"{tmp_path}/paused", 3)
    lay(spark, [*said, (-2, end, "end")], CONFIRMED, f"{tmp_path}/said", 3)

    def stream():
        read = spark.readStream.option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        return confirmed(read.schema(PAUSED).parquet(f"{tmp_path}/paused"), read.schema(CONFIRMED).parquet(f"{tmp_path}/said"), late="500 hours")

    run(stream(), tmp_path)
    run(stream(), tmp_path)  # nothing new: a restart adds nothing
    got = spark.read.parquet(f"{tmp_path}/out").where("key >= 0").select("key", "paused_at", "confirmed_at", "choice", "state")
    assert sorted(map(repr, got.collect())) == want
