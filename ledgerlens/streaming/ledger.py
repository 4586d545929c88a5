"""Streaming operators of the ledger over Structured Streaming.

Each takes and gives a DataFrame that may be a stream or a table, so the batch result checks the stream's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def captured_once(events: DataFrame, key: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Capture by idempotency key: the first event of a key within the watermark."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)


def windowed(events: DataFrame, time: str, size: str, by: list[str], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts, sums and maxima in tumbling (or sliding) windows."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = e.groupBy(w.alias("w"), *by).agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.max("value").alias("most"))
    return out.select(F.col("w.start").alias("start"), *by, "events", "total", "most")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Session windows: events of a key that are less than a gap apart."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "events")


def numbered(events: DataFrame, key: str, order: str) -> DataFrame:
    """Per-key event indexes that go on from batch to batch; within a batch events are numbered by ``order``."""

    def assign(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        yield pd.DataFrame({key: [k[0]] * len(rows), order: rows[order], "event_index": range(n, n + len(rows))})
        state.update((n + len(rows),))

    shape = f"{key} long, {order} long, event_index long"
    return events.select(key, order).groupBy(key).applyInPandasWithState(assign, shape, "n long", "append", GroupStateTimeout.NoTimeout)


def leases(events: DataFrame, job: str, time: str, seconds: int, late: str = "1 minute") -> DataFrame:
    """job, status: a claim that no completion follows within the lease is requeued, on the event-time timer.

    events: job (long), kind (claim or done), time. A completion after its lease ended is fenced.
    """

    def follow(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, str]] = []
        until = state.get[0] if state.exists else None
        if state.hasTimedOut:
            out.append((k[0], "requeued"))
            state.remove()
        else:
            for r in pd.concat(list(batches)).sort_values([time, "kind"]).itertuples():
                at = int(getattr(r, time).timestamp() * 1000)
                if r.kind == "claim":
                    until = at + 1000 * seconds
                elif until is not None and at <= until:
                    out.append((k[0], "done"))
                    until = None
                else:
                    out.append((k[0], "fenced"))
            if until is None:
                if state.exists:
                    state.remove()
            else:
                state.update((until,))
                state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[job, "status"])

    marked = events.select(job, "kind", time).withWatermark(time, late)
    return marked.groupBy(job).applyInPandasWithState(follow, f"{job} long, status string", "until long", "append", GroupStateTimeout.EventTimeTimeout)


def deliver_once(stream: DataFrame, key: str, folder: str, checkpoint: str) -> DataFrame:
    """Delivers the rows of a stream to a sink, each key once, and reads the sink.

    A batch goes to a folder of its own number by overwriting, so that a batch that is tried again replaces itself; rows
    that another batch has delivered are left out, so that a stream that starts over from a lost checkpoint adds nothing.
    """
    spark, schema, out = stream.sparkSession, stream.schema, f"{folder}/outbox"
    written: list[str] = []

    def put(batch: DataFrame, number: int) -> None:
        own = f"{out}/run={checkpoint.rsplit('/', 1)[-1]}/batch={number}"
        others = sent(lambda p: p != own)
        rows = batch.dropDuplicates([key])
        (rows.join(others.select(key), key, "left_anti") if others is not None else rows).write.mode("overwrite").parquet(own)
        written.append(own)

    def sent(which) -> DataFrame | None:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(f"{out}/*/*")
        found = [str(f.getPath()) for f in (where.getFileSystem(conf).globStatus(where) or [])]
        here = [p for p in found if which(p) and which(p.replace("file:/", "file:///", 1))]
        return spark.read.schema(schema).parquet(*here) if here else None

    q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start()
    q.awaitTermination()
    done = sent(lambda p: True)
    return done if done is not None else spark.createDataFrame([], schema)


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into Parquet (append) with a checkpoint, and reads the result.

    For complete or update output the last batch's rows of each key are kept by foreachBatch with an overwrite.
    """
    spark: SparkSession = stream.sparkSession
    out = f"{folder}/out"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode)
    if mode == "append":
        q = writer.format("parquet").option("path", out).start()
    else:
        q = writer.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
