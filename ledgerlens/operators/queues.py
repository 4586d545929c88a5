"""Work queues as tables: claims, leases, fences, retries, resumable commits, run states and recovery after a crash.

Where a service would lock a row, a plan here decides for all rows at once and returns their next state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import backoff


def claimed(jobs: DataFrame, queue: str, order: list[Column], slots: int) -> DataFrame:
    """The jobs that a queue's ``slots`` workers take now: the first ones in order, each by one worker (number from 0)."""
    n = F.row_number().over(Window.partitionBy(queue).orderBy(*order))
    return jobs.withColumn("worker", n - 1).where(F.col("worker") < slots)


def after_lease(now: Column, until: Column, attempts: Column, most: int) -> Column:
    """The state of a running job: running in its lease; beyond it pending again, or dead after its last attempt."""
    return F.when(until >= now, "running").when(attempts >= most, "dead").otherwise("pending")


def fenced(results: DataFrame, leases: DataFrame, job: str) -> DataFrame:
    """results with ``accepted``: the job's lease has the result's generation and ends no earlier than the result came.

    results: job, generation, at. leases: job, generation (current), until.
    """
    own = leases.select(job, F.col("generation").alias("_generation"), F.col("until").alias("_until"))
    ok = (F.col("generation") == F.col("_generation")) & (F.col("at") <= F.col("_until"))
    return results.join(own, job, "left").withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("_generation", "_until")


def failure(kind: Column, message: Column) -> Column:
    """class and retryable of an error by its type and message."""
    m = F.lower(message)
    found = (
        F.when(kind.isin("TimeoutError", "ConnectionError") | F.contains(m, F.lit("timeout")), "retryable_network").when(F.contains(m, F.lit("429")), "retryable_provider_429").when(m.rlike("5[0-9][0-9]"), "retryable_provider_5xx")
        .when(m.rlike("privacy acknowledgement|secret|scheduled model profile|deterministic fallback"), "configuration_error").when(m.rlike("400|invalid request"), "invalid_request").otherwise("worker_error")
    )
    return F.struct(found.alias("class"), F.startswith(found, F.lit("retryable")).alias("retryable"))


def after_failure(retryable: Column, retries: Column, most: int) -> Column:
    """state and delay in seconds of a failed job: queued again with backoff while it may be retried, failed otherwise."""
    again = retryable & (retries + 1 < most)
    return F.struct(F.when(again, "queued").otherwise("failed").alias("state"), F.when(again, backoff(retries)).alias("delay"))


def commits(batches: DataFrame, done: DataFrame) -> DataFrame:
    """batch, action for batches (batch, mark) against what is committed: commit, skip (same mark) or conflict (another one)."""
    known = done.select("batch", F.col("mark").alias("was"))
    return batches.join(known, "batch", "left").select("batch", F.when(F.col("was").isNull(), "commit").when(F.col("was") == F.col("mark"), "skip").otherwise("conflict").alias("action"))


def run_state(items: DataFrame, requests: DataFrame) -> DataFrame:
    """run, state from items (run, status) and requests (run, request): cancelled and paused hold while work is open, a run
    whose items are all ended is completed, with failures if one failed."""
    ended = F.col("status").isin("committed", "skipped", "failed", "cancelled")
    n = items.groupBy("run").agg(F.count_if(~ended).alias("open"), F.count_if(F.col("status") == "failed").alias("failed"))
    r = F.col("request")
    state = F.when((F.col("open") == 0) & (F.col("failed") > 0), "completed_with_errors").when(F.col("open") == 0, "completed").when(r == "cancel", "cancelling").when(r == "pause", "paused").otherwise("running")
    return n.join(requests, "run", "left").select("run", state.alias("state"), "open", "failed")


def recovery(kinds: list[tuple[str, DataFrame, str, Column, Column]]) -> DataFrame:
    """kind, id, state: for each (kind, rows, id column, whether it was in flight, its new state) what a restart does."""
    out = None
    for kind, rows, key, in_flight, state in kinds:
        part = rows.where(in_flight).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), state.alias("state"))
        out = part if out is None else out.unionByName(part)
    return out
