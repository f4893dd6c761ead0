"""Delivery telemetry and keyed state: streams with ``availableNow`` and their batch twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tessera.operators.series import _envelope_sql, _fold_sql, follow_step, hours
from tessera.operators.signals import _WIDE, stem_frames
from tessera.session import delete_at_exit, materialize, scratch_path, table

TOLERANCE_MS = 50
DECAY = 0.85
#: The second that clocks count from: the beginning of 2024.
EPOCH = 1_704_067_200


def deliveries(events: DataFrame) -> DataFrame:
    """Frames of each session (the user): produced at the event's time, due 40 ms later, sent up to 120 ms after they were produced."""
    ms = F.unix_millis("ts")
    return events.select("event_id", F.col("user_id").alias("session"), "ts", "event_type", "value", (ms + 40).alias("due_ms"), (ms + (F.col("event_id") * 7919) % 121).alias("sent_ms"))


def late_drop(df: DataFrame, tolerance: int = TOLERANCE_MS) -> DataFrame:
    """Frames sent no more than ``tolerance`` milliseconds after they were due."""
    return df.filter(F.col("sent_ms") - F.col("due_ms") <= tolerance)


def _newest(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id"))


def _at_share(values, share: float):
    """The value at a share of a sorted array, without interpolation."""
    n = F.size(values)
    return F.element_at(values, (F.least(n - 1, F.floor(share * n)) + 1).cast("int"))


def delivery_slo(df: DataFrame, last: int = 100) -> DataFrame:
    """Median and 95th percentile of delay over the last frames of each session, without interpolation, and the jitter of the times between them.

    Jitter is the distance of an interval from the mean one; its mean and 95th percentile need two intervals.
    """
    kept = df.withColumn("rn", F.row_number().over(_newest("session"))).filter(F.col("rn") <= last)
    gap = F.col("sent_ms") - F.lag("sent_ms").over(Window.partitionBy("session").orderBy("ts", "event_id"))
    timed = kept.withColumn("gap", gap.cast("double"))
    listed = timed.groupBy("session").agg(F.sort_array(F.collect_list(F.col("sent_ms") - F.col("due_ms"))).alias("d"), F.collect_list("gap").alias("gaps"), F.avg("gap").alias("mean_gap"))  # ``last`` values
    jitters = listed.withColumn("j", F.sort_array(F.transform("gaps", lambda g: F.abs(g - F.col("mean_gap")))))
    enough = F.size("j") >= 2
    mean = F.aggregate("j", F.lit(0.0), lambda a, x: a + x) / F.size("j")
    return jitters.select(
        "session", F.element_at("d", (F.floor(F.size("d") / 2) + 1).cast("int")).alias("p50"), _at_share(F.col("d"), 0.95).alias("p95"), F.size("d").cast("long").alias("n"),
        F.when(enough, F.round(mean, 3)).alias("jitter_mean"), F.when(enough, F.round(_at_share(F.col("j"), 0.95), 3)).alias("jitter_p95"),
    )


def queued(before: DataFrame | None, df: DataFrame, most: int = 2) -> DataFrame:
    """(session, day, event_id, ts, late, n): the ``most`` newest frames of each session and day, and how many it has had, after those of ``df``."""
    fresh = df.select("session", F.to_date("ts").alias("day"), "event_id", "ts", (F.col("sent_ms") - F.col("due_ms") > TOLERANCE_MS).alias("late"))
    counts = fresh.groupBy("session", "day").agg(F.count("*").alias("n"))
    rows = fresh
    if before is not None:
        rows = fresh.unionByName(before.drop("n"))
        counts = counts.unionByName(before.select("session", "day", "n").distinct()).groupBy("session", "day").agg(F.sum("n").alias("n"))
    kept = rows.withColumn("rn", F.row_number().over(_newest("session", "day"))).filter(F.col("rn") <= most).drop("rn")
    return kept.hint("merge").join(counts, ["session", "day"])


def drop_rate(state: DataFrame) -> DataFrame:
    """Share of frames of each day that were late or that a session's backlog of a day (``queued``) shed; 0 where there is none."""
    own = state.groupBy("session", "day").agg(F.count_if("late").alias("n_late"), (F.max("n") - F.count("*")).alias("n_shed"), F.max("n").alias("n"))
    sums = own.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("n_late", "n_shed", "n")])
    return sums.select(F.unix_seconds(F.col("day").cast("timestamp")).alias("start_s"), "n_late", "n_shed", "n", ((F.col("n_late") + F.col("n_shed")) / F.col("n")).alias("rate"))


def throttle(df: DataFrame) -> DataFrame:
    """The first frame of each session in each hour."""
    hour = F.window("ts", "1 hour")
    return df.groupBy("session", hour.alias("w")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")).select("session", F.unix_seconds("w.start").alias("start_s"), "event_id")


def backlog_shed(df: DataFrame, floor: int = 2, most: int = 4) -> DataFrame:
    """Frames of each session and day; where there are more than ``most``, the newest ``floor`` of them."""
    day = F.to_date("ts")
    n = F.count("*").over(Window.partitionBy("session", "day"))
    x = df.withColumn("day", day).withColumn("n", n).withColumn("rn", F.row_number().over(_newest("session", "day")))
    return x.filter((F.col("n") <= most) | (F.col("rn") <= floor)).select("session", "event_id", "rn")


#: Older values than these many weigh less in a moving average than a double can hold.
EMA_ROWS = 600


def ema_step(df: DataFrame, key: str, value: str, order: list[str], decay: float = DECAY) -> DataFrame:
    """(key, shift, factor, first, n): what the ordered values of each key do to a moving average m before them: shift + factor * m.

    Without an average before, m is the first value.  Each key's newest EMA_ROWS rows are all that counts, so
    that a key with very many is cut before it moves.
    """
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    top = df.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= EMA_ROWS)
    shift = top.groupBy(key).agg(F.sum((1 - decay) * F.pow(F.lit(decay), F.col("rn") - 1) * F.col(value)).alias("shift"))
    sums = df.groupBy(key).agg(F.count("*").alias("n"), F.min_by(value, F.struct(*order)).alias("first"))
    return sums.hint("merge").join(shift, key).withColumn("factor", F.pow(F.lit(decay), F.col("n")))


#: Frames a second until a session is calibrated, and the frames that calibrate it.
BOOTSTRAP_FPS, CALIBRATION = 45.0, 30


def ema_rate(before: DataFrame | None, df: DataFrame, frames: int = CALIBRATION) -> DataFrame:
    """(session, n, total, fps) after the frames of ``df`` (value: milliseconds), from that state ``before`` them.

    Until a session has had ``frames`` of them its rate is BOOTSTRAP_FPS; then it is that of their mean time; each
    later frame that took time moves it on by 0.85 old + 0.15 new.  total is the time of the frames that calibrate.
    """
    had = df.select("session").distinct().select("session", F.lit(0).cast("long").alias("had"), F.lit(0.0).alias("was"), F.lit(BOOTSTRAP_FPS).alias("rate"))
    if before is not None:
        had = before.select("session", F.col("n").alias("had"), F.col("total").alias("was"), F.col("fps").alias("rate")).unionByName(had)
        had = had.groupBy("session").agg(F.max_by("was", "had").alias("was"), F.max_by("rate", "had").alias("rate"), F.max("had").alias("had"))
    order = Window.partitionBy("session").orderBy("ts", "event_id")
    rows = df.withColumn("rn", F.row_number().over(order)).hint("merge").join(had.select("session", "had"), "session").withColumn("i", F.col("had") + F.col("rn"))
    rows = materialize(rows.select("session", "ts", "event_id", "value", "i"), "frames")
    sums = rows.groupBy("session").agg(F.count("*").alias("more"), F.coalesce(F.sum(F.when(F.col("i") <= frames, F.col("value"))), F.lit(0.0)).alias("time"))
    later = rows.filter((F.col("i") > frames) & (F.col("value") > 0)).withColumn("instant", 1000.0 / F.col("value"))
    moved = ema_step(later, "session", "instant", ["ts", "event_id"]).select("session", "shift", "factor")
    joined = had.hint("merge").join(sums, "session", "left").hint("merge").join(moved, "session", "left")
    n, total = F.col("had") + F.coalesce("more", F.lit(0).cast("long")), F.col("was") + F.coalesce("time", F.lit(0.0))
    mean = F.when((n >= frames) & (total > 0), 1000.0 * frames / total).otherwise(BOOTSTRAP_FPS)
    start = F.when(F.col("had") >= frames, F.col("rate")).otherwise(mean)
    return joined.select("session", n.alias("n"), total.alias("total"), F.when(F.col("factor").isNull(), start).otherwise(F.col("shift") + F.col("factor") * start).alias("fps"))


def interval(mean: Column) -> Column:
    """Milliseconds between frames at the rate of a mean frame time, one a second at least; none for frames of no time."""
    return F.when(mean == 0, 0.0).otherwise(1000.0 / F.greatest(F.lit(1.0), 1000.0 / mean))


def lookahead(before: DataFrame | None, df: DataFrame, decay: float = 0.8, render_ms: float = 15.0) -> DataFrame:
    """(session, day, time, n, closed, ema) after the frames of ``df``, from that state ``before`` them.

    Each day (the interval of a refresh here) of a session gives an estimate: its mean frame time, the interval at its rate
    and the time to render.  A day is closed by a later one; closed ones (their number) have moved ema on, the open
    one is held as sums, which later micro-batches add to.
    """
    days = df.groupBy("session", F.to_date("ts").alias("day")).agg(F.sum("value").alias("time"), F.count("*").alias("n"))
    if before is not None:
        days = days.unionByName(before.select("session", "day", "time", "n")).groupBy("session", "day").agg(F.sum("time").alias("time"), F.sum("n").alias("n"))
    last = F.max("day").over(Window.partitionBy("session"))
    days = materialize(days.withColumn("last", last), "days")
    mean = F.col("time") / F.col("n")
    estimate = mean + interval(mean) + render_ms
    moved = ema_step(days.filter("day < last").withColumn("estimate", estimate), "session", "estimate", ["day"], decay).withColumnRenamed("n", "more")
    open_ = days.filter("day = last").drop("last").hint("merge").join(moved, "session", "left")
    old = open_.withColumns({"had": F.lit(0).cast("long"), "old": F.lit(None).cast("double")}) if before is None else open_.hint("merge").join(before.select("session", F.col("closed").alias("had"), F.col("ema").alias("old")), "session", "left")
    ema = F.when(F.col("more").isNull(), F.col("old")).otherwise(F.col("shift") + F.col("factor") * F.coalesce("old", "first"))
    return old.select("session", "day", "time", "n", (F.coalesce("had", F.lit(0).cast("long")) + F.coalesce("more", F.lit(0).cast("long"))).alias("closed"), ema.alias("ema"))


def looked_ahead(state: DataFrame, decay: float = 0.8, render_ms: float = 15.0) -> DataFrame:
    """The lookahead of each session, its open day counted in."""
    mean = F.col("time") / F.col("n")
    now = mean + interval(mean) + render_ms
    return state.select("session", F.round(F.when(F.col("closed") == 0, now).otherwise(decay * F.col("ema") + (1 - decay) * now), 6).alias("lookahead_ms"))


#: Bytes of files that a micro-batch takes.
BATCH_BYTES = 1 << 30


def _table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, oldest first; zone-less timestamps become session timestamps.

    A micro-batch takes files of about BATCH_BYTES, one at least.
    """
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    exact = f"{sf_dir}/{name}[.]parquet"  # a stream of one file needs a pattern; this one matches nothing else
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(exact)
    for field in schema.fields:
        if field.dataType.simpleString() == "timestamp_ntz":
            stream = stream.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return stream


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_stream(spark, sf_dir, "events")


def run_to_table(stream: DataFrame, mode: str, key: list[str], each: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    """Run a stream over all that is there, ``each`` of each micro-batch appended with its number; the last row of each key counts."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")

    def sink(batch: DataFrame, number: int) -> None:
        each(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    delete_at_exit(spark, out)
    delete_at_exit(spark, state)
    rows = spark.read.parquet(out).drop("part")
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


def run_with_table(stream: DataFrame, step: Callable[[DataFrame | None, DataFrame], DataFrame]) -> DataFrame:
    """Run a stream over all that is there; after each micro-batch the state table is ``step``(state before, batch).

    Each state is written under the number of its batch and the one before is read from the
    number before, so that a batch that runs again after a loss gives the same state.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, "state"), scratch_path(spark, "stream-state")
    seen: list[int] = []

    def sink(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{out}/{number - 1}") if number else None
        step(before, batch).write.mode("overwrite").parquet(f"{out}/{number}")
        seen.append(number)

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    delete_at_exit(spark, out)
    delete_at_exit(spark, state)
    if not seen:  # no batch ran: the state of an empty one
        return step(None, spark.createDataFrame([], stream.schema))
    return spark.read.parquet(f"{out}/{max(seen)}")


#: Buckets of a state table.
BUCKETS = 32


def run_with_buckets(stream: DataFrame, key: str, step: Callable[[DataFrame | None, DataFrame], DataFrame], buckets: int = BUCKETS) -> DataFrame:
    """``run_with_table`` for a state of which a micro-batch touches little: the table lies in buckets by ``key``.

    ``step`` gets and gives rows of the touched buckets only; these are written anew under the number of the batch, the others
    stay as they are.  A batch that runs again reads what there was before it.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, "buckets"), scratch_path(spark, "stream-state")
    written: dict[int, list[int]] = {}
    number_of = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def latest(which: list[int], before: int | None = None) -> list[str]:
        held = {b: [n for n in written.get(b, []) if before is None or n < before] for b in which}
        return [f"{out}/{max(n)}/bucket={b}" for b, n in held.items() if n]

    def sink(batch: DataFrame, number: int) -> None:
        batch = materialize(batch, "batch")
        touched = sorted(r["b"] for r in batch.select(number_of.alias("b")).distinct().collect())  # at most ``buckets``
        paths = latest(touched, number)
        rows = step(spark.read.parquet(*paths) if paths else None, batch)
        rows.withColumn("bucket", number_of).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/{number}")
        for b in touched:
            written[b] = [*[n for n in written.get(b, []) if n != number], number]

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    delete_at_exit(spark, out)
    delete_at_exit(spark, state)
    paths = latest(list(written))
    return spark.read.parquet(*paths) if paths else step(None, spark.createDataFrame([], stream.schema))


def keyed_fold(stream: DataFrame, step: Callable[..., tuple], start: tuple, inputs: tuple[str, ...], state: str, emit: Callable[[tuple], tuple | None] | None, out: str, each: bool = False) -> DataFrame:
    """A fold over the events of each session in order of time, its state kept between micro-batches.

    ``step`` takes the state and the ``inputs`` of an event.  ``emit`` gives the columns after
    session of a row of ``out`` from a state, after each event or once a batch, or None for no row.
    """
    columns = [c.strip().split(" ")[0] for c in out.split(",")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        found = []
        for values in zip(*(rows[c].tolist() for c in inputs)):
            now = step(now, *values)
            if each and (row := emit(now)) is not None:
                found.append((key[0], *row))
        held.update(now)
        if not each and (row := emit(now)) is not None:
            found.append((key[0], *row))
        yield pd.DataFrame(found, columns=columns)

    timed = stream.withColumn("at", F.unix_micros("ts")).drop("ts")
    return timed.groupBy("session").applyInPandasWithState(run, out, state, "append" if each else "update", "NoTimeout")


def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ema_rate with each session's state in a table that every micro-batch moves on; ten sessions, of enough frames to be calibrated."""
    frames = deliveries(_event_stream(spark, sf_dir)).withColumn("session", F.col("session") % 10)
    return run_with_buckets(frames, "session", ema_rate).select("session", F.round("fps", 6).alias("fps"), "n")


def stream_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looked_ahead(run_with_buckets(deliveries(_event_stream(spark, sf_dir)), "session", lookahead))


def stream_drop_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_rate(run_with_buckets(deliveries(_event_stream(spark, sf_dir)), "session", queued))


#: Share of drift that a report corrects; kinds of events that play, pause and seek, the others report a time.
ALPHA, PLAY, PAUSE, SEEK = 0.5, "purchase", "error", "signup"


def clock_step(state: tuple, kind: str, client: float, now: float) -> tuple:
    """(client time, its server time, playing, events) after one report: a clock that is put right by ALPHA of the drift each report shows."""
    at, since, playing, n = state
    if kind == PAUSE:
        return at, since, False, n + 1
    if kind == SEEK:
        return client, now, playing, n + 1
    if kind == PLAY or since < 0:
        return client, now, True, n + 1
    return at, since - ALPHA * (client - (at + now - since)), playing, n + 1


def _reports(df: DataFrame) -> DataFrame:
    """Client time (seconds since 2024, off by the delay of the frame) and server time of each delivery."""
    now = F.unix_millis("ts") / 1000.0 - EPOCH
    return deliveries(df).withColumn("now", now).withColumn("client", now + (F.col("sent_ms") - F.col("due_ms")) / 1000.0).select("session", "event_id", "ts", "event_type", "client", "now")


def stream_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clock of each session after its last report: client time, its server time, whether it plays."""
    emit = lambda s: (round(s[0], 4), round(s[1], 4), s[2], s[3])
    out = keyed_fold(_reports(_event_stream(spark, sf_dir)), clock_step, (0.0, -1.0, False, 0), ("event_type", "client", "now"), "a double, b double, c boolean, n long", emit, "session long, client double, server double, playing boolean, n long")
    return run_to_table(out, "update", ["session"])


#: Kinds of events that put a value in the cache and that take it out; the others read it.  Seconds that a value is good for.
PUT, REMOVE, GOOD_FOR = ("purchase", "signup"), "error", 86_400 * 3
PROVIDER_KEY, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ExpiringValue(StatefulProcessor):
    """One value for each key, good for ``ttl`` seconds from when it was last put.

    A read after that finds nothing and clears the state; a timer clears the state of keys that nobody reads once
    the watermark has passed.  A new value starts its time again, a removal ends it.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value double, at_us long")

    def _forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.held.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at_us", "event_id"])
        value, since = self.held.get() if self.held.exists() else (None, 0)
        was, found = since, []
        for event, kind, x, at in zip(batch["event_id"].tolist(), batch["event_type"].tolist(), batch["value"].tolist(), batch["at_us"].tolist()):
            if kind in PUT:
                value, since = x, at
            elif value is not None and (kind == REMOVE or at > since + self.ttl * 1_000_000):
                value = None
            if kind not in PUT and kind != REMOVE:
                found.append((key[0], event, value is not None, value))
        if value is None:
            self._forget()
        elif since != was or not self.held.exists():
            self._forget()
            self.held.update((value, since))
            self.handle.registerTimer(max(since // 1000 + self.ttl * 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(found, columns=["session", "event_id", "hit", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        yield pd.DataFrame({"session": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "hit": pd.Series(dtype="bool"), "value": pd.Series(dtype="float64")})

    def close(self) -> None:
        pass


def expiring(events: DataFrame, ttl: int = GOOD_FOR, late: str = "1 day") -> DataFrame:
    """(session, event_id, hit, value) of each read of a stream of events(session, event_id, event_type, ts, value)."""
    timed = events.withWatermark("ts", late).select("session", "event_id", "event_type", "ts", "value", F.unix_micros("ts").alias("at_us"))
    return timed.groupBy("session").transformWithStateInPandas(ExpiringValue(ttl), "session long, event_id long, hit boolean, value double", "Append", "EventTime")


def stream_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each read of a session's value finds: the value as keyed state that expires."""
    events = _event_stream(spark, sf_dir).select(F.col("user_id").alias("session"), "event_id", "event_type", "ts", "value")
    before = spark.conf.get(PROVIDER_KEY)
    spark.conf.set(PROVIDER_KEY, ROCKSDB)  # timers and value state need it
    try:
        return run_to_table(expiring(events), "append", ["event_id"])
    finally:
        spark.conf.set(PROVIDER_KEY, before)


def stream_envelope(spark: SparkSession, sf_dir: str, attack: float = 1.0, release: float = 8.0) -> DataFrame:
    """The envelope of each session's values after its last event."""
    follow = follow_step(attack, release)
    events = deliveries(_event_stream(spark, sf_dir)).select("session", "event_id", "ts", (F.col("value") / 500.0).alias("x"))
    out = keyed_fold(events, lambda s, x: (*follow((s[0],), x), s[1] + 1), (0.0, 0), ("x",), "y double, n long", lambda s: (round(s[0], 6), s[1]), "session long, envelope double, n long")
    return run_to_table(out, "update", ["session"])


#: Surprise lost an hour; values over this share of full scale surprise.
FADE, STARTLE = 0.33, 0.2


def surprise_step(state: tuple, x: float, hour: float) -> tuple:
    """Jumps to a larger boost, else fades by FADE an hour down to zero."""
    faded = max(0.0, state[0] - FADE * max(0.0, hour - state[1]))
    boost = x if x > STARTLE else 0.0
    return (boost if boost > state[0] else faded), hour


def stream_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surprise of each session after each of its events."""
    events = deliveries(_event_stream(spark, sf_dir)).select("session", "event_id", "ts", (F.col("value") / 500.0).alias("x"), (F.unix_seconds("ts") / 3600.0).alias("hour"))
    step = lambda s, x, hour, event: (*surprise_step(s[:2], x, hour), event)
    out = keyed_fold(events, step, (0.0, 0.0, 0), ("x", "hour", "event_id"), "boost double, hour double, event long", lambda s: (s[2], round(s[0], 6)), "session long, event_id long, surprise double", each=True)
    return run_to_table(out, "append", ["session", "event_id"])


#: Fixed values of triggers, in hours here: least gap, nearness of a section, interval without change.
GAP, NEAR, STABLE = 12, 8, 15


def trigger_step(state: tuple, hour: int, eligible: bool) -> tuple:
    """(hour, section, reason) of the last time that fired, reason empty if this hour does not: too soon, a new section (a day), one that is near, a stable interval."""
    at, section, _ = state
    here, ahead = hour // 24, 24 - hour % 24
    if not eligible or hour - at < GAP:
        return at, section, ""
    if section >= 0 and here != section:
        return hour, here, "section_change"
    if section < 0 and ahead <= NEAR:
        return hour, here, "section_near"
    if hour - at >= STABLE:
        return hour, here, "stable_interval"
    return at, section, ""


def stream_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours at which each session fires, and why; error events are not eligible."""
    events = deliveries(_event_stream(spark, sf_dir)).select("session", "event_id", "ts", (F.floor(F.unix_seconds("ts") / 3600) - EPOCH // 3600).alias("hour"), (F.col("event_type") != "error").alias("eligible"))
    out = keyed_fold(events, trigger_step, (-1000, -1, ""), ("hour", "eligible"), "at long, section long, reason string", lambda s: (s[0], s[2]) if s[2] else None, "session long, hour long, reason string", each=True)
    return run_to_table(out, "append", ["session", "hour"])


def stream_drift(spark: SparkSession, sf_dir: str, bar: float = 0.5) -> DataFrame:
    """Views and clicks of one session within an hour of each other whose clocks are over ``bar`` seconds apart: a join of two streams."""
    side = lambda kind, p: _event_stream(spark, sf_dir).filter(F.col("event_type") == kind).select(F.col("user_id").alias(f"{p}_session"), F.col("event_id").alias(f"{p}_id"), F.col("ts").alias(f"{p}_ts"), (((F.col("event_id") * 7919) % 121) / 100.0).alias(f"{p}_off")).withWatermark(f"{p}_ts", "1 day")
    near = "c_session = s_session AND c_ts >= s_ts - INTERVAL 1 HOUR AND c_ts <= s_ts + INTERVAL 1 HOUR"
    both = side("view", "c").join(side("click", "s"), F.expr(near))
    drift = F.round(F.abs(F.col("c_off") - F.col("s_off")), 4)
    found = both.select(F.col("c_session").alias("session"), F.col("c_id").alias("client_event"), F.col("s_id").alias("server_event"), drift.alias("drift")).filter(F.col("drift") > bar)
    return run_to_table(found, "append", ["client_event", "server_event"])


def stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type in each hour, with a watermark of a day."""
    counts = _event_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return run_to_table(counts.select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n"), "update", ["start_s", "event_type"])


def stream_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = late_drop(deliveries(_event_stream(spark, sf_dir))).select("event_id", "session")
    return run_to_table(kept, "append", ["event_id"])


ACTIVITY = ("envelope", "energy_smooth", "transient", "flux", "brightness", "flash", "sustain")


def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each event (a tick of its track) the channels of all stems, on the line between its frame and the next: a stream against a table."""
    h0 = hours(table(spark, sf_dir, "events")).select("h0")
    place = F.unix_micros("ts") / 3.6e9 - F.col("h0")
    ticks = _event_stream(spark, sf_dir).crossJoin(F.broadcast(h0)).select("event_id", (F.col("user_id") % 10).alias("track"), F.floor(place).cast("int").alias("frame_idx"), (place - F.floor(place)).alias("past"))
    w = Window.partitionBy("track", "stem").orderBy("frame_idx")
    pairs = [F.struct(F.coalesce(c, F.lit(0.0)).alias("x"), F.coalesce(F.lead(c).over(w), F.col(c), F.lit(0.0)).alias("y")).alias(c) for c in ACTIVITY]
    still = materialize(stem_frames(spark, sf_dir).select("track", "stem", "frame_idx", *pairs), "activity")
    met = ticks.hint("merge").join(still, ["track", "frame_idx"])
    line = lambda c: F.round(F.col(f"{c}.x") + F.col("past") * (F.col(f"{c}.y") - F.col(f"{c}.x")), 6).alias(c)
    return run_to_table(met.select("event_id", "track", "stem", *map(line, ACTIVITY)), "append", ["event_id", "stem"])


def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """throttle over the stream, with a watermark of a day."""
    return run_to_table(throttle(deliveries(_event_stream(spark, sf_dir).withWatermark("ts", "1 day"))), "update", ["session", "start_s"])


def stream_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary records of each day: number, mean and largest value, as the windows of a stream give them."""
    day = F.window("ts", "1 day")
    sums = _event_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(day.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_ms"), F.max("value").alias("max_ms"))
    return run_to_table(sums.select(F.unix_seconds("w.start").alias("start_s"), "n", "mean_ms", "max_ms"), "update", ["start_s"])


def stream_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """backlog_shed of each micro-batch, which is the queue that there is; what is kept is appended."""
    return run_to_table(deliveries(_event_stream(spark, sf_dir)), "append", ["event_id"], backlog_shed)


def stream_slo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """delivery_slo of the newest frames of each session, which a state table keeps between micro-batches."""
    def step(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch if before is None else before.unionByName(batch)
        return rows.withColumn("rn", F.row_number().over(_newest("session"))).filter("rn <= 100").drop("rn")

    return delivery_slo(run_with_table(deliveries(_event_stream(spark, sf_dir)), step))


def feed_of(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_custkey").alias("song_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("duration"), F.unix_seconds("o_orderdate").alias("at"))


def library_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of library rows: one for each order, keyed by customer."""
    return feed_of(table(spark, sf_dir, "orders"))


def stream_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library after all changes of a feed, each micro-batch merged into the table as it was before."""
    step = lambda before, batch: upsert(batch) if before is None else merge_library(before.drop("bucket"), upsert(batch))
    return run_with_buckets(feed_of(_table_stream(spark, sf_dir, "orders")), "song_id", step)


def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest status of each id of a feed, the newest 256 that have not expired; the table holds no others between micro-batches."""
    def step(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        now = upsert(feed_of(batch))
        rows = now if before is None else merge_library(before, now)
        fresh = rows.filter(F.col("updated_at") + TTL > NOW)
        return fresh.orderBy(F.desc("updated_at"), "song_id").limit(256)

    return run_with_table(_table_stream(spark, sf_dir, "orders"), step).select("song_id", "status", (F.col("updated_at") + TTL).alias("expires_at"))


def upsert(feed: DataFrame) -> DataFrame:
    """The newest version of each song; created_at is that of its first."""
    order = F.struct("at", "version")
    return feed.groupBy("song_id").agg(F.max_by("status", order).alias("status"), F.max_by("duration", order).alias("duration"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))


def merge_library(base: DataFrame, changes: DataFrame) -> DataFrame:
    """A full outer join of a library and changes to it: new fields win, created_at stays."""
    b, c = base.alias("b"), changes.alias("c")
    return b.hint("merge").join(c, F.col("b.song_id") == F.col("c.song_id"), "full").select(
        F.coalesce("c.song_id", "b.song_id").alias("song_id"), F.coalesce("c.status", "b.status").alias("status"), F.coalesce("c.duration", "b.duration").alias("duration"),
        F.coalesce("b.created_at", "c.created_at").alias("created_at"), F.greatest("c.updated_at", "b.updated_at").alias("updated_at"),
    )


#: Phases of a frame, in order, and least frames of a summary.
PHASES, LEAST_FRAMES = ("steer", "infer", "d2h", "encode"), 5


def timed_phases(df: DataFrame) -> DataFrame:
    """Milliseconds of each phase of a frame: shares of its time that its event id gives."""
    share = {"steer": F.col("event_id") % 7, "infer": 20 + F.col("event_id") % 11, "d2h": F.col("event_id") % 3, "encode": F.col("event_id") % 5}
    return df.withColumns({f"{p}_ms": F.col("value") * share[p] / 50.0 for p in PHASES}).withColumnRenamed("value", "total_ms")


def timing_summary(df: DataFrame, last: int = 100) -> DataFrame:
    """Mean time of a frame and of each phase, and the rate, over the last frames of each session; none for fewer than LEAST_FRAMES."""
    names = [f"{p}_ms" for p in ("total", *PHASES)]
    kept = df.withColumn("rn", F.row_number().over(_newest("session"))).filter(F.col("rn") <= last)
    means = kept.groupBy("session").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"avg_{c}") for c in names]).filter(F.col("n") >= LEAST_FRAMES)
    return means.withColumn("fps", F.when(F.col("avg_total_ms") > 0, 1000 / F.col("avg_total_ms")).otherwise(0.0))


def _frames(s, d):
    return deliveries(table(s, d, "events"))


def _split(s, d):
    feed = library_feed(s, d)
    return merge_library(upsert(feed.filter("version % 3 <> 0")), upsert(feed.filter("version % 3 = 0")))


NOW, TTL = 883_612_800, 90 * 86_400

QUERIES = {
    "st_late_drop": stream_late_drop,
    "st_rate_per_second": stream_rate,
    "st_ema_rate": stream_ema,
    "st_delivery_slo": stream_slo,
    "st_drop_rate": stream_drop_rate,
    "st_throttle": stream_throttle,
    "st_backlog_shed": stream_backlog,
    "st_checkpoint_trigger": stream_triggers,
    "st_lookahead_ema": stream_lookahead,
    "st_clock_correct": stream_clock,
    "st_ttl_state": stream_ttl,
    "st_envelope": stream_envelope,
    "st_surprise": stream_surprise,
    "st_drift_alert": stream_drift,
    "snk_telemetry": stream_telemetry,
    "st_extended_activity": stream_activity,
    "agg_timing_summary": lambda s, d: timing_summary(timed_phases(_frames(s, d))),
    "st_library_cdc": stream_library,
    "snk_library_upsert": _split,
    "sort_library": lambda s, d: upsert(library_feed(s, d)).orderBy(F.desc("updated_at"), F.desc("created_at"), "song_id"),
    "st_status_bounded": stream_status,
    "flt_fresh": lambda s, d: upsert(library_feed(s, d)).filter(F.col("updated_at") + TTL > NOW).select("song_id", "updated_at"),
    "top_newest_bounded": lambda s, d: upsert(library_feed(s, d)).orderBy(F.desc("updated_at"), "song_id").limit(256).select("song_id", "updated_at"),
}

_D = """f AS (SELECT event_id, user_id AS session, ts, event_type, value, (epoch_us(ts) // 1000) + 40 AS due_ms, (epoch_us(ts) // 1000) + (event_id * 7919) % 121 AS sent_ms FROM events)"""
_LIB = """feed AS (SELECT o_custkey AS song_id, o_orderkey AS version, o_orderstatus AS status, o_totalprice AS duration, epoch(o_orderdate)::BIGINT AS ats FROM orders),
lib AS (SELECT song_id, arg_max(status, struct_pack(a := ats, v := version)) AS status, arg_max(duration, struct_pack(a := ats, v := version)) AS duration, min(ats) AS created_at, max(ats) AS updated_at FROM feed GROUP BY song_id)"""

_FIRES = f"x.eligible AND x.hour - s.at >= {GAP} AND ((s.section >= 0 AND x.here <> s.section) OR (s.section < 0 AND x.ahead <= {NEAR}) OR x.hour - s.at >= {STABLE})"

ORACLE_SQL = {
    "st_late_drop": f"WITH {_D} SELECT event_id, session FROM f WHERE sent_ms - due_ms <= 50",
    "st_rate_per_second": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL",
    "st_ema_rate": f"""WITH RECURSIVE {_D}, o AS MATERIALIZED (SELECT session % 10 AS session, value, row_number() OVER (PARTITION BY session % 10 ORDER BY ts, event_id) AS i FROM f),
c AS (SELECT session, count(*) AS n, sum(value) FILTER (i <= {CALIBRATION}) AS total FROM o GROUP BY session),
r AS (SELECT session, {CALIBRATION}::BIGINT AS i, CASE WHEN total > 0 THEN 1000.0::DOUBLE * {CALIBRATION} / total ELSE {BOOTSTRAP_FPS} END AS fps FROM c WHERE n >= {CALIBRATION}
  UNION ALL SELECT o.session, o.i, CASE WHEN o.value > 0 THEN 0.85 * r.fps + 0.15 * (1000.0 / o.value) ELSE r.fps END FROM r JOIN o ON o.session = r.session AND o.i = r.i + 1)
SELECT c.session, round(coalesce(fps, {BOOTSTRAP_FPS}), 6) AS fps, n FROM c LEFT JOIN (SELECT session, arg_max(fps, i) AS fps FROM r GROUP BY session) USING (session)""",
    "st_delivery_slo": f"""WITH {_D}, k AS (SELECT session, sent_ms - due_ms AS d, (sent_ms - lag(sent_ms) OVER (PARTITION BY session ORDER BY ts, event_id))::DOUBLE AS gap FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS rn FROM f) WHERE rn <= 100),
l AS (SELECT session, list_sort(list(d)) AS d, list(gap) FILTER (gap IS NOT NULL) AS gaps, avg(gap) AS m FROM k GROUP BY session),
j AS (SELECT session, d, list_sort(list_transform(gaps, lambda g: abs(g - m))) AS j FROM l)
SELECT session, d[floor(len(d) / 2)::INT + 1] AS p50, d[least(len(d) - 1, floor(0.95 * len(d)))::INT + 1] AS p95, len(d) AS n, CASE WHEN len(j) >= 2 THEN round(list_sum(j) / len(j), 3) END AS jitter_mean,
  CASE WHEN len(j) >= 2 THEN round(j[least(len(j) - 1, floor(0.95 * len(j)))::INT + 1], 3) END AS jitter_p95 FROM j""",
    "st_drop_rate": f"""WITH {_D}, x AS (SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY session, ts::DATE ORDER BY ts DESC, event_id DESC) > 2 AS shed FROM f)
SELECT epoch(day)::BIGINT AS start_s, count(*) FILTER (NOT shed AND sent_ms - due_ms > 50) AS n_late, count(*) FILTER (shed) AS n_shed, count(*) AS n, count(*) FILTER (shed OR sent_ms - due_ms > 50) / count(*) AS rate FROM x GROUP BY day""",
    "st_throttle": f"WITH {_D} SELECT session, epoch(date_trunc('hour', ts))::BIGINT AS start_s, arg_min(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM f GROUP BY ALL",
    "st_backlog_shed": f"""WITH {_D}, x AS (SELECT *, count(*) OVER (PARTITION BY session, ts::DATE) AS n, row_number() OVER (PARTITION BY session, ts::DATE ORDER BY ts DESC, event_id DESC)::INTEGER AS rn FROM f)
SELECT session, event_id, rn FROM x WHERE n <= 4 OR rn <= 2""",
    "st_lookahead_ema": f"""WITH RECURSIVE {_D}, days AS (SELECT session, ts::DATE AS day, avg(value) AS m FROM f GROUP BY ALL),
o AS MATERIALIZED (SELECT session, m + 1000.0 / greatest(1.0, 1000.0 / m) + 15 AS x, row_number() OVER (PARTITION BY session ORDER BY day) AS i FROM days),
r AS (SELECT session, i, x AS y FROM o WHERE i = 1 UNION ALL SELECT o.session, o.i, 0.8::DOUBLE * r.y + 0.2::DOUBLE * o.x FROM r JOIN o ON o.session = r.session AND o.i = r.i + 1)
SELECT session, round(arg_max(y, i), 6) AS lookahead_ms FROM r GROUP BY session""",
    "st_clock_correct": f"""WITH RECURSIVE {_D}, x AS (SELECT session, (row_number() OVER (PARTITION BY session ORDER BY ts, event_id))::INTEGER AS frame_idx, event_type AS kind, (epoch_us(ts) // 1000) / 1000.0::DOUBLE - {EPOCH} AS tick, (epoch_us(ts) // 1000) / 1000.0::DOUBLE - {EPOCH} + (sent_ms - due_ms) / 1000.0::DOUBLE AS client FROM f),
{_fold_sql('x', {
    'a': ('0.0::DOUBLE', f"CASE WHEN x.kind = '{PAUSE}' THEN s.a WHEN x.kind IN ('{SEEK}', '{PLAY}') OR s.b < 0 THEN x.client ELSE s.a END"),
    'b': ('-1.0::DOUBLE', f"CASE WHEN x.kind = '{PAUSE}' THEN s.b WHEN x.kind IN ('{SEEK}', '{PLAY}') OR s.b < 0 THEN x.tick ELSE s.b - {ALPHA} * (x.client - (s.a + x.tick - s.b)) END"),
    'c': ('false', f"CASE WHEN x.kind = '{PAUSE}' THEN false WHEN x.kind = '{SEEK}' THEN s.c WHEN x.kind = '{PLAY}' OR s.b < 0 THEN true ELSE s.c END"),
}, 'k', 'session')} SELECT session, round(arg_max(a, i), 4) AS client, round(arg_max(b, i), 4) AS server, arg_max(c, i) AS playing, max(i) AS n FROM k GROUP BY session""",
    "st_ttl_state": f"""WITH x AS (SELECT user_id AS session, event_id, event_type, ts, last(CASE WHEN event_type IN {PUT} OR event_type = '{REMOVE}' THEN {{'kind': event_type, 'at': ts, 'value': value}} END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS l FROM events),
y AS (SELECT session, event_id, coalesce(l.kind IN {PUT} AND ts <= l.at + INTERVAL {GOOD_FOR} SECOND, false) AS hit, l.value AS v FROM x WHERE event_type NOT IN {(*PUT, REMOVE)})
SELECT session, event_id, hit, CASE WHEN hit THEN v END AS value FROM y""",
    "st_envelope": f"""WITH RECURSIVE {_D}, x AS (SELECT session, (row_number() OVER (PARTITION BY session ORDER BY ts, event_id))::INTEGER AS frame_idx, value / 500.0 AS v FROM f),
{_envelope_sql('x', 1.0, 8.0, 'k', 'v', 'session')} SELECT session, round(arg_max(y, i), 6) AS envelope, max(i) AS n FROM k GROUP BY session""",
    "st_surprise": f"""WITH RECURSIVE {_D}, x AS (SELECT session, event_id, (row_number() OVER (PARTITION BY session ORDER BY ts, event_id))::INTEGER AS frame_idx, value / 500.0 AS v, floor(epoch(ts)) / 3600.0::DOUBLE AS hour FROM f),
{_fold_sql('x', {'y': ('0.0::DOUBLE', f"CASE WHEN x.v > {STARTLE} AND x.v > s.y THEN x.v ELSE greatest(0.0, s.y - {FADE} * greatest(0.0, x.hour - s.hour)) END"), 'hour': ('0.0::DOUBLE', 'x.hour'), 'event_id': ('0::BIGINT', 'x.event_id')}, 'k', 'session')}
SELECT session, event_id, round(y, 6) AS surprise FROM k WHERE i > 0""",
    "st_checkpoint_trigger": f"""WITH RECURSIVE {_D}, x AS (SELECT session, (row_number() OVER (PARTITION BY session ORDER BY ts, event_id))::INTEGER AS frame_idx, (floor(epoch(ts) / 3600) - {EPOCH // 3600})::BIGINT AS hour, event_type <> 'error' AS eligible FROM f),
r AS (SELECT *, hour // 24 AS here, 24 - hour % 24 AS ahead FROM x),
{_fold_sql('r', {
    'at': ('-1000::BIGINT', f"CASE WHEN {_FIRES} THEN x.hour ELSE s.at END"),
    'section': ('-1::BIGINT', f"CASE WHEN {_FIRES} THEN x.here ELSE s.section END"),
    'reason': ("''", f"CASE WHEN NOT ({_FIRES}) THEN '' WHEN s.section >= 0 AND x.here <> s.section THEN 'section_change' WHEN s.section < 0 AND x.ahead <= {NEAR} THEN 'section_near' ELSE 'stable_interval' END"),
}, 'k', 'session')} SELECT session, k."at" AS hour, reason FROM k WHERE reason <> ''""",
    "st_drift_alert": """WITH c AS (SELECT user_id AS session, event_id, ts, (event_id * 7919) % 121 / 100.0::DOUBLE AS off FROM events WHERE event_type = 'view'), s AS (SELECT user_id AS session, event_id, ts, (event_id * 7919) % 121 / 100.0::DOUBLE AS off FROM events WHERE event_type = 'click')
SELECT c.session, c.event_id AS client_event, s.event_id AS server_event, round(abs(c.off - s.off), 4) AS drift FROM c JOIN s ON c.session = s.session AND c.ts BETWEEN s.ts - INTERVAL 1 HOUR AND s.ts + INTERVAL 1 HOUR WHERE round(abs(c.off - s.off), 4) > 0.5""",
    "st_extended_activity": f"""WITH {_WIDE}, t AS (SELECT event_id, user_id % 10 AS track, epoch_us(ts) / 3.6e9 - h0 AS place FROM events, span),
p AS (SELECT track, stem, frame_idx, {', '.join(f"{c} AS {c}_x, coalesce(lead({c}) OVER (PARTITION BY track, stem ORDER BY frame_idx), {c}) AS {c}_y" for c in ACTIVITY)} FROM wide)
SELECT event_id, t.track, stem, {', '.join(f"round({c}_x + (place - floor(place)) * ({c}_y - {c}_x), 6) AS {c}" for c in ACTIVITY)} FROM t JOIN p ON t.track = p.track AND p.frame_idx = floor(place)""",
    "snk_telemetry": "SELECT epoch(date_trunc('day', ts))::BIGINT AS start_s, count(*) AS n, avg(value) AS mean_ms, max(value) AS max_ms FROM events GROUP BY 1",
    "agg_timing_summary": f"""WITH {_D} SELECT session, count(*) AS n, avg(value) AS avg_total_ms, avg(value * (event_id % 7) / 50.0) AS avg_steer_ms, avg(value * (20 + event_id % 11) / 50.0) AS avg_infer_ms, avg(value * (event_id % 3) / 50.0) AS avg_d2h_ms,
  avg(value * (event_id % 5) / 50.0) AS avg_encode_ms, CASE WHEN avg(value) > 0 THEN 1000 / avg(value) ELSE 0.0 END AS fps FROM (
  SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts DESC, event_id DESC) AS rn FROM f) WHERE rn <= 100 GROUP BY session HAVING count(*) >= {LEAST_FRAMES}""",
    "st_library_cdc": f"WITH {_LIB} SELECT * FROM lib",
    "snk_library_upsert": """WITH feed AS (SELECT o_custkey AS song_id, o_orderkey AS version, o_orderstatus AS status, o_totalprice AS duration, epoch(o_orderdate)::BIGINT AS ats FROM orders),
b AS (SELECT song_id, arg_max(status, struct_pack(a := ats, v := version)) AS status, arg_max(duration, struct_pack(a := ats, v := version)) AS duration, min(ats) AS created_at, max(ats) AS updated_at FROM feed WHERE version % 3 <> 0 GROUP BY song_id),
c AS (SELECT song_id, arg_max(status, struct_pack(a := ats, v := version)) AS status, arg_max(duration, struct_pack(a := ats, v := version)) AS duration, min(ats) AS created_at, max(ats) AS updated_at FROM feed WHERE version % 3 = 0 GROUP BY song_id)
SELECT song_id, coalesce(c.status, b.status) AS status, coalesce(c.duration, b.duration) AS duration, coalesce(b.created_at, c.created_at) AS created_at, greatest(c.updated_at, b.updated_at) AS updated_at FROM b FULL JOIN c USING (song_id)""",
    "sort_library": f"WITH {_LIB} SELECT * FROM lib",
    "st_status_bounded": f"WITH {_LIB} SELECT song_id, status, updated_at + {TTL} AS expires_at FROM lib WHERE updated_at + {TTL} > {NOW} ORDER BY 3 DESC, 1 LIMIT 256",
    "flt_fresh": f"WITH {_LIB} SELECT song_id, updated_at FROM lib WHERE updated_at + {TTL} > {NOW}",
    "top_newest_bounded": f"WITH {_LIB} SELECT song_id, updated_at FROM lib ORDER BY updated_at DESC, song_id LIMIT 256",
}
