"""Streams over several micro-batches give what one gives; state that expires goes."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from tessera.session import table
from tessera.streaming import telemetry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dealt(spark, tmp_path_factory):
    """Tables of four files each, in order of time, of which a micro-batch takes one."""
    root = tmp_path_factory.mktemp("dealt")
    for name, order in (("events", "ts"), ("orders", "o_orderdate")):
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        bounds = rows.select(F.col(order).cast("string").alias("t")).agg(F.percentile_approx(F.unix_timestamp(F.col("t").cast("timestamp")), [0.3, 0.55, 0.8])).first()[0]
        at = F.unix_timestamp(F.col(order).cast("string").cast("timestamp"))
        part = sum((at > b).cast("int") for b in bounds)
        os.makedirs(f"{root}/{name}.parquet", exist_ok=True)
        for i in range(4):
            rows.filter(part == i).toPandas().to_parquet(f"{root}/{name}.parquet/{i}.parquet", coerce_timestamps="us")
            os.utime(f"{root}/{name}.parquet/{i}.parquet", (time.time() - 1000 + 10 * i,) * 2)
    spark.range(1).write.parquet(f"{root}/events.parquet.bak")  # a neighbour that is no part of the table
    return str(root)


@pytest.fixture
def file_by_file(monkeypatch):
    monkeypatch.setattr(telemetry, "BATCH_BYTES", 1)


def rows(df):
    order = sorted(df.columns)
    return sorted((tuple(None if r[c] is None else round(r[c], 4) if isinstance(r[c], float) else r[c] for c in order) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", ["st_ema_rate", "st_lookahead_ema", "st_drop_rate", "st_ttl_state", "st_library_cdc", "st_delivery_slo", "st_surprise", "st_clock_correct"])
def test_four_batches_equal_one(spark, dealt, file_by_file, name):
    got = rows(telemetry.QUERIES[name](spark, dealt))
    assert got == rows(telemetry.QUERIES[name](spark, SF)) and got


def test_a_batch_is_a_file(spark, dealt, file_by_file):
    seen = []
    stream = telemetry._event_stream(spark, dealt)
    stream.writeStream.foreachBatch(lambda b, n: seen.append(b.count())).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and sum(seen) == table(spark, SF, "events").count()


def test_a_micro_batch_rewrites_touched_buckets_only(spark, dealt, file_by_file):
    touched = []

    def step(before, batch):
        touched.append((None if before is None else before.count(), batch.count()))
        now = batch.select("session", F.lit(1).cast("long").alias("n"))
        both = now if before is None else now.unionByName(before.select("session", "n"))
        return both.groupBy("session").agg(F.sum("n").alias("n"))

    events = telemetry._event_stream(spark, dealt).select(F.col("user_id").alias("session"))
    found = telemetry.run_with_buckets(events, "session", step, buckets=4)
    want = table(spark, SF, "events").groupBy(F.col("user_id").alias("session")).count()
    assert sorted(map(tuple, found.select("session", "n").collect())) == sorted(map(tuple, want.collect()))
    assert touched[0][0] is None and all(b is not None for b, _ in touched[1:])


def put(spark, path, i, events):
    os.makedirs(path, exist_ok=True)
    day = dt.datetime(2024, 1, 1)
    data = [(s, n, kind, day + dt.timedelta(days=d), v) for s, n, kind, d, v in events]
    frame = spark.createDataFrame(data, "session long, event_id long, event_type string, ts timestamp, value double")
    frame.toPandas().to_parquet(f"{path}/{i}.parquet", coerce_timestamps="us")
    os.utime(f"{path}/{i}.parquet", (time.time() - 1000 + 10 * i,) * 2)


def test_values_expire_are_overwritten_and_removed(spark, tmp_path):
    path = f"{tmp_path}/e"
    many = [(100 + k, 1000 + k, "purchase", 0, 1.0) for k in range(50)]
    put(spark, path, 0, [(1, 1, "purchase", 0, 5.0), (1, 2, "view", 1, 0.0), (2, 3, "purchase", 0, 7.0), *many])
    put(spark, path, 1, [(1, 4, "signup", 2, 6.0), (1, 5, "view", 4.9, 0.0), (2, 6, "view", 3.1, 0.0), (3, 7, "purchase", 4, 8.0), (3, 8, "error", 5, 0.0), (3, 9, "view", 5.5, 0.0)])
    put(spark, path, 2, [(1, 10, "view", 5.1, 0.0), (9, 11, "purchase", 30, 1.0)])
    put(spark, path, 3, [(9, 12, "view", 31, 0.0)])
    schema = "session long, event_id long, event_type string, ts timestamp, value double"
    found, sizes = [], []
    before = spark.conf.get(telemetry.PROVIDER_KEY)
    spark.conf.set(telemetry.PROVIDER_KEY, telemetry.ROCKSDB)
    try:
        stream = telemetry.expiring(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), ttl=3 * 86_400, late="10 days")
        query = stream.writeStream.foreachBatch(lambda b, n: found.extend(map(tuple, b.collect()))).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    finally:
        spark.conf.set(telemetry.PROVIDER_KEY, before)
    assert sorted((e, hit, v) for _, e, hit, v in found) == [(2, True, 5.0), (5, True, 6.0), (6, False, None), (9, False, None), (10, False, None), (12, True, 1.0)]
    assert max(sizes) >= 50 and sizes[-1] < 10, sizes  # the timers of values that nobody reads have cleared them


def test_calibration_comes_before_the_moving_average(spark):
    day = dt.datetime(2024, 1, 1)
    data = [(1, i, day + dt.timedelta(seconds=i), x) for i, x in enumerate([10.0, 20.0, 30.0, 50.0, 0.0, 100.0])] + [(2, 99, day, 5.0)]
    events = spark.createDataFrame(data, "session long, event_id long, ts timestamp, value double")
    half = events.filter("event_id < 2 OR session = 2")
    first = telemetry.ema_rate(None, half, 3)
    assert {r.session: (r.n, r.fps) for r in first.collect()} == {1: (2, 45.0), 2: (1, 45.0)}
    after = telemetry.ema_rate(telemetry.materialize(first, "first"), events.filter("event_id BETWEEN 2 AND 98"), 3)
    want = 0.85 * (0.85 * 50.0 + 0.15 * 20.0) + 0.15 * 10.0  # three frames of 20 ms; the frame of no time counts for nothing
    got = {r.session: (r.n, round(r.fps, 9)) for r in after.collect()}
    assert got == {1: (6, round(want, 9)), 2: (1, 45.0)}


def test_a_day_of_no_time_has_no_interval(spark):
    """Closed or open, such a day counts with the time to render alone."""
    day = dt.datetime(2024, 1, 1)
    data = [(1, day, 0.0), (1, day + dt.timedelta(days=1), 20.0), (2, day, 20.0), (2, day + dt.timedelta(days=1), 0.0), (3, day, 0.0)]
    events = spark.createDataFrame(data, "session long, ts timestamp, value double")
    got = dict(map(tuple, telemetry.looked_ahead(telemetry.lookahead(None, events)).collect()))
    assert got == {1: round(0.8 * 15 + 0.2 * 55, 6), 2: round(0.8 * 55 + 0.2 * 15, 6), 3: 15.0}
