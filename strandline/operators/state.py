"""Bounded retries and registries kept as snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.session import stage

PENDING, RETRY, SUCCESS, FAILED = "pending", "retry_pending", "success", "failed"


def run_with_retries(jobs: DataFrame, attempt: Callable[[DataFrame], DataFrame], key: str = "job_id", most: int = 3) -> DataFrame:
    """Rounds of ``attempt`` over the open jobs until none is left.

    ``jobs`` has ``key``; ``attempt`` takes (key, attempts) of the open jobs
    and returns (key, ok boolean, note string). The result has status,
    attempts and the ordered history of (attempt, status, note). Each round is
    a written snapshot, so a lost executor repeats one round at most.
    """
    history = "array<struct<attempt:int,status:string,note:string>>"
    state = jobs.select(key).distinct().select(key, F.lit(PENDING).alias("status"), F.lit(0).alias("attempts"), F.array().cast(history).alias("history"))
    state = stage(state, "retry-0")
    for no in range(1, most + 1):
        targets = state.where(F.col("status").isin(PENDING, RETRY))
        if targets.isEmpty():
            break
        tried = attempt(targets.select(key, "attempts")).select(key, F.col("ok").alias("_ok"), F.col("note").alias("_note"))
        after = F.when(F.col("_ok"), SUCCESS).when(F.lit(no >= most), FAILED).otherwise(RETRY)
        entry = F.struct(F.lit(no).alias("attempt"), after.alias("status"), F.col("_note").alias("note"))
        moved = state.join(tried, key, "left")
        hit = F.col("_ok").isNotNull()
        state = moved.select(
            key,
            F.when(hit, after).otherwise(F.col("status")).alias("status"),
            F.when(hit, F.lit(no)).otherwise(F.col("attempts")).alias("attempts"),
            F.when(hit, F.concat("history", F.array(entry))).otherwise(F.col("history")).cast(history).alias("history"),
        )
        state = stage(state, f"retry-{no}")
    return state


def upsert(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Registry after changes: changed columns replace, NULL changes keep, new keys are added."""
    fields = [c for c in old.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields if c in changes.columns])
    joined = old.join(new, keys, "full")
    return joined.select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in fields])


#: States in which a submitted job is asked for again, and those that end it.
OPEN_JOBS = ("pending", "running", "retrieve_error")
ENDED_JOBS = ("retrieved", "failed", "cancelled", "expired")


def advance_jobs(registry: DataFrame, polled: DataFrame, key: str = "job_name") -> DataFrame:
    """Registry after a poll: ``polled`` has ``key``, ``state`` (succeeded,
    failed, cancelled, expired, running; NULL if the poll failed) and ``note``.

    Only jobs that are open move: succeeded ones are retrieved, a failed poll
    leaves retrieve_error, which is polled again. Ended jobs, and jobs that
    were not polled, stay.
    """
    news = polled.groupBy(F.col(key)).agg(F.max("state").alias("_state"), F.max("note").alias("_note"), F.lit(True).alias("_polled"))
    ended = F.when(F.col("_state") == "succeeded", "retrieved").when(F.col("_state").isin(*ENDED_JOBS), F.col("_state"))
    moved = F.when(F.col("_state").isNull(), "retrieve_error").otherwise(F.coalesce(ended, F.lit("pending")))
    moves = F.col("_polled").isNotNull() & F.col("status").isin(*OPEN_JOBS)
    joined = registry.join(news, key, "left").withColumn("_moves", moves)
    kept = [c for c in registry.columns if c not in ("status", "note")]
    old_note = F.col("note") if "note" in registry.columns else F.lit(None).cast("string")
    return joined.select(*kept, F.when(F.col("_moves"), moved).otherwise(F.col("status")).alias("status"), F.when(F.col("_moves"), F.col("_note")).otherwise(old_note).alias("note"))


def status_of(counts: dict[str, str]) -> Column:
    """Group status by precedence: empty, success, failed, partly failed, retrying, pending."""
    total, ok, bad, again = (F.col(counts[k]) for k in ("total", "success", "failed", "retry"))
    return (
        F.when(total == 0, "empty")
        .when(ok == total, "success")
        .when(bad == total, "failed")
        .when(bad > 0, "partial_failed")
        .when(again > 0, "retry_pending")
        .otherwise("pending")
    )
