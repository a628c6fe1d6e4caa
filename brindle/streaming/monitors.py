"""Streaming: snapshots, presence, one-pass aggregates and filters with state. Each function takes a streaming or a batch
table; batch twins are what the tests hold the streams against."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def snapshots(events: DataFrame, at: str = "ts", value: str = "value", every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, n, total, last_value) of tumbling windows; rows later than the watermark are dropped."""
    w = events.withWatermark(at, late).groupBy(F.window(at, every).alias("w"))
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max_by(value, at).alias("last_value")).select(F.col("w.start").alias("start"), "n", "total", "last_value")


def retained(df: DataFrame, at: str, now, days: int = 30) -> DataFrame:
    """Rows of the last days."""
    return df.filter(F.col(at) >= now - F.expr(f"interval {days} days"))


def presence(events: DataFrame, now, at: str = "ts", user: str = "user_id", seconds: int = 120) -> DataFrame:
    """(user, last_seen): users whose last heartbeat is recent enough."""
    return events.groupBy(user).agg(F.max(at).alias("last_seen")).filter(F.timestamp_diff("SECOND", F.col("last_seen"), now) <= seconds)


def presence_changes(events: DataFrame, keys: tuple[str, ...] = ("project_id", "user_id"), at: str = "ts", seconds: int = 120, late: str = "10 minutes", until=None) -> DataFrame:
    """(keys, at, change): "joined" at the first heartbeat of somebody who was away, "left" so many seconds after the last one before a
    longer gap; each once time has passed it, so in an order that does not hang on the order of arrival.

    A stream tells time by its watermark (the greatest time less late): a user's state is the last heartbeat and those
    that are ahead of the watermark, a timer tells of leaving, and who has left has no state any more. A batch is told up to the moment
    until (its greatest time if none is given). Rows without a time, and rows that come later than the watermark, are left out."""
    e = events.filter(F.col(at).isNotNull())
    gap = seconds * 1_000_000
    if not e.isStreaming:
        e = e.select(*keys, F.unix_micros(F.col(at).cast("timestamp")).alias("t"))
        end = F.lit(e.agg(F.max("t")).first()[0]) if until is None else F.unix_micros(F.lit(until).cast("timestamp"))
        e = e.withColumn("__end", end.cast("bigint")).filter("t < __end")
        w = Window.partitionBy(*keys).orderBy("t")
        e = e.select(*keys, "t", "__end", (F.col("t") - F.lag("t").over(w)).alias("before"), (F.lead("t").over(w) - F.col("t")).alias("after"))
        first = F.when(F.col("before").isNull() | (F.col("before") > gap), F.struct("t", F.lit("joined").alias("change")))
        last = F.when((F.col("after").isNull() | (F.col("after") > gap)) & (F.col("t") + gap < F.col("__end")), F.struct((F.col("t") + gap).alias("t"), F.lit("left").alias("change")))
        told = e.select(*keys, F.explode(F.array_compact(F.array(first, last))).alias("c"))
        return told.select(*keys, F.timestamp_micros("c.t").alias("at"), "c.change")

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ahead = state.get if state.exists else (None, [])
        ahead = sorted({*ahead, *(int(t) for f in frames for t in f["t"])}) if not state.hasTimedOut else sorted(ahead)
        now = max(0, state.getCurrentWatermarkMs()) * 1000
        out = []
        for t in (t for t in ahead if t < now):
            if last is None or t - last > gap:
                out += [(last + gap, "left")] if last is not None else []
                out.append((t, "joined"))
            last = t
        ahead = [t for t in ahead if t >= now]
        if last is not None and last + gap < now and not (ahead and ahead[0] - last <= gap):
            out.append((last + gap, "left"))
            last = None
        if last is None and not ahead:
            state.remove()
        else:
            state.update((last, ahead))
            state.setTimeoutTimestamp(min(([last + gap] if last is not None and last + gap >= now else []) + ahead[:1]) // 1000)
        if out:
            yield pd.DataFrame([(*k, *o) for o in out], columns=[*keys, "t", "change"])

    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in keys)
    rows = e.withWatermark(at, late).select(*keys, at, F.unix_micros(F.col(at).cast("timestamp")).alias("t"))
    told = rows.groupBy(*keys).applyInPandasWithState(step, f"{kinds}, t bigint, change string", "last bigint, ahead array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select(*keys, F.timestamp_micros("t").alias("at"), "change")


def visits(events: DataFrame, at: str = "ts", user: str = "user_id", gap: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """(user, start, end, beats): runs of heartbeats without a longer gap."""
    g = events.withWatermark(at, late).groupBy(user, F.session_window(at, gap).alias("s"))
    return g.agg(F.count("*").alias("beats")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "beats")


def one_pass(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, sum, least and most of each group: the aggregate of a file too large to hold, batch or streaming."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.round(F.sum(value), 2).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


# Chunks beyond which a text is for the slow queue, seconds that a job of a lower priority waits, tries of a failed job.
SLOW_CHUNKS, DEFERRED_SECONDS, MOST_TRIES = 300, 30, 3


def routed(files: DataFrame) -> DataFrame:
    """Files with the queue they go to."""
    from brindle.operators.relational import admission

    return files.withColumn("queue", admission(F.col("size"), F.col("name")))


def rerouted(jobs: DataFrame, slow_chunks: int = SLOW_CHUNKS) -> DataFrame:
    """Jobs (queue, kind, scanned, estimate) with next: what becomes of them once their file has been looked at. Scanned pages and
    texts of many chunks leave the fast queue for the slow one; others stay."""
    slow = (F.col("queue") != "slow") & (((F.col("kind") == "pdf") & F.coalesce("scanned", F.lit(False))) | (F.coalesce("estimate", F.lit(0)) > slow_chunks))
    return jobs.withColumn("next", F.when(slow, "slow").otherwise(F.col("queue")))


def due(jobs: DataFrame, projects: DataFrame, now, most: int = MOST_TRIES, wait: int = DEFERRED_SECONDS) -> DataFrame:
    """Jobs (project_id, status, message, tries, updated_at) with action and at: run now; retry, each failure for a passing fault
    after twice the wait of the one before; defer, while another project goes first; or give_up."""
    from brindle.operators.relational import deferred, retryable

    held = deferred(jobs.select("job_id", "project_id"), projects).select("job_id", F.lit(True).alias("held"))
    d = jobs.join(held, "job_id", "left")
    fault = retryable(F.col("status"), F.col("message"), F.col("tries"), most=most)
    backoff = F.lit(wait) * F.pow(F.lit(2), F.coalesce("tries", F.lit(0)))
    action = F.when(fault, "retry").when(F.col("status") == "failed", "give_up").when(F.coalesce("held", F.lit(False)), "defer").otherwise("run")
    at = F.when(fault, F.timestamp_add("SECOND", backoff.cast("int"), F.col("updated_at"))).when(F.coalesce("held", F.lit(False)) & (F.col("status") != "failed"), F.timestamp_add("SECOND", F.lit(wait), now)).otherwise(now)
    return d.withColumn("action", action).withColumn("at", at).drop("held")


# Jobs that run by the clock: every so many seconds, or once a day at an hour.
SCHEDULE = {"judge": ("daily", 3 * 3600), "recover_faults": ("every", 300), "snapshots": ("every", 600)}


def trigger_of(job: str) -> dict[str, object]:
    """The trigger of a stream that runs on a schedule: an interval, or all that is there for a daily job that the clock starts."""
    kind, seconds = SCHEDULE[job]
    return {"processingTime": f"{seconds} seconds"} if kind == "every" else {"availableNow": True}


def next_runs(spark, now, zone: str = "Asia/Shanghai") -> DataFrame:
    """(job, kind, seconds, at): when each job of the schedule runs next after a moment; daily ones by the clock of a zone."""
    rows = spark.createDataFrame([(k, *v) for k, v in SCHEDULE.items()], "job string, kind string, seconds int")
    utc = F.to_utc_timestamp(now, F.current_timezone())
    local = F.from_utc_timestamp(utc, zone)
    today = F.timestamp_add("SECOND", F.col("seconds"), F.date_trunc("day", local))
    daily = F.when(today > local, today).otherwise(F.timestamp_add("DAY", F.lit(1), today))
    daily = F.from_utc_timestamp(F.to_utc_timestamp(daily, zone), F.current_timezone())
    step = F.floor(F.unix_timestamp(now) / F.col("seconds")) + 1
    return rows.withColumn("at", F.when(F.col("kind") == "daily", daily).otherwise(F.timestamp_seconds(step * F.col("seconds"))))


OPEN, CLOSE = "<think>", "</think>"


def strip_thinking(state: tuple[bool, str], piece: str) -> tuple[tuple[bool, str], str]:
    """One step over a piece of a stream: (state, visible text). The state is whether a thought is open and the end of the
    text that may be the beginning of a tag."""
    inside, text = state[0], state[1] + piece
    out = []
    while True:
        tag = CLOSE if inside else OPEN
        at = text.find(tag)
        if at < 0:
            keep = next((n for n in range(min(len(tag) - 1, len(text)), 0, -1) if tag.startswith(text[-n:])), 0)
            if not inside:
                out.append(text[: len(text) - keep])
            return (inside, text[len(text) - keep :] if keep else ""), "".join(out)
        if not inside:
            out.append(text[:at])
        text, inside = text[at + len(tag) :], not inside


def visible(pieces: DataFrame, key: str = "stream_id", order: str = "seq", text: str = "piece") -> DataFrame:
    """(key, seq, visible) of a stream of pieces: thoughts removed even where a tag is cut by a border."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = tuple(state.get) if state.exists else (False, "")
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for r in rows.itertuples():
            at, seen = strip_thinking(at, getattr(r, text))
            out.append((k[0], getattr(r, order), seen))
        state.update(at)
        yield pd.DataFrame(out, columns=[key, order, "visible"])

    kind = pieces.schema[key].dataType.simpleString()
    return pieces.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} bigint, visible string", "inside boolean, rest string", "append", GroupStateTimeout.NoTimeout)


def tripped(results: DataFrame, key: str = "job_id", order: str = "seq", failed: str = "failed", most: int = 3) -> DataFrame:
    """(key, seq, streak, tripped): the circuit breaker opens at a run of failures and stays open."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, open_ = state.get if state.exists else (0, False)
        out = []
        for r in pd.concat(list(frames)).sort_values(order).itertuples():
            streak = streak + 1 if getattr(r, failed) else 0
            open_ = bool(open_ or streak >= most)
            out.append((k[0], getattr(r, order), streak, open_))
        state.update((streak, open_))
        yield pd.DataFrame(out, columns=[key, order, "streak", "tripped"])

    kind = results.schema[key].dataType.simpleString()
    return results.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} bigint, streak int, tripped boolean", "streak int, open boolean", "append", GroupStateTimeout.NoTimeout)


def unfinished(sections: DataFrame, done: DataFrame, key: str = "section_id") -> DataFrame:
    """What a resumed job still has to do."""
    return sections.join(done.select(key), key, "left_anti")


def latest_sink(path: str, key: str):
    """A foreachBatch function that keeps the last row of each key (column version) under path. Each batch is merged with the newest
    table into a table of its own epoch; read it with latest_table. A batch that is run again writes the same table."""
    from brindle.operators.relational import latest

    def write(batch: DataFrame, epoch: int) -> None:
        before = latest_table(batch.sparkSession, path, epoch)
        rows = batch if before is None else before.unionByName(batch)
        latest(rows, key, F.col("version")).write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")

    return write


def latest_table(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The table of the newest finished epoch of a latest_sink (below an epoch, if given); None if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return None
    done = [f.getPath() for f in system.listStatus(where) if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    epochs = {int(p.getName().split("=")[1]): p.toString() for p in done if p.getName().startswith("epoch=")}
    epochs = {k: v for k, v in epochs.items() if before is None or k < before}
    return spark.read.parquet(epochs[max(epochs)]) if epochs else None
