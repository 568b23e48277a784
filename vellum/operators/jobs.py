"""Ingest jobs as a log of state changes: latest state, recovery, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.config import DEFAULTS, Settings

#: The states of a job, in the order in which it passes through them.
STATES = ("QUEUED", "IN_PROGRESS", "COMPLETED", "FAILED")
TERMINAL = ("COMPLETED", "FAILED")


def progress(status: Column) -> Column:
    """Position of a state; both terminal states come last; -1 for others."""
    s = F.upper(F.trim(status))
    return F.when(s == "QUEUED", 0).when(s == "IN_PROGRESS", 1).when(s.isin(*TERMINAL), 2).otherwise(-1)


def latest_state(log: DataFrame) -> DataFrame:
    """One row per job: its latest logged state by updated_at (null first), then by progress, with
    retry_count, doc_id and error of that row. max_by aggregates before the shuffle."""
    order = F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp")), progress(F.col("status")), F.coalesce("retry_count", F.lit(0)), F.upper(F.trim("status")))
    row = F.struct(F.upper(F.trim("status")).alias("status"), F.coalesce("retry_count", F.lit(0)).alias("retry_count"), "doc_id", "error")
    last = log.where("job_id IS NOT NULL").groupBy("job_id").agg(F.max_by(row, order).alias("last"), F.count("*").alias("changes"))
    return last.select("job_id", "last.*", "changes")


def recover(jobs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """States after a restart: a job in progress is queued again with one more retry, or has failed if its
    retries are used up; queued and terminal jobs stay. requeued: whether it is to be offered again."""
    running = F.col("status") == "IN_PROGRESS"
    spent = F.col("retry_count") >= settings.max_retries
    return (
        jobs.withColumn("_retries", F.when(running & ~spent, F.col("retry_count") + 1).otherwise(F.col("retry_count")))
        .withColumn("error", F.when(running & spent, F.lit(f"gave up after a crash: retry cap ({settings.max_retries}) reached")).otherwise(F.col("error")))
        .withColumn("status", F.when(running & spent, "FAILED").when(running, "QUEUED").otherwise(F.col("status")))
        .withColumn("retry_count", F.col("_retries"))
        .withColumn("requeued", F.col("status") == "QUEUED")
        .drop("_retries")
    )


def queue_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "QUEUED").alias("pending"), F.count_if(F.col("status").isin(*TERMINAL)).alias("ended"))


def goes_to_queue(visual: Column, pdf: Column, pages: Column, settings: Settings = DEFAULTS) -> Column:
    """Only a visual ingest of a PDF with at least the threshold's pages is queued; a threshold of 0 or less
    turns the queue off."""
    if settings.queue_page_threshold <= 0:
        return F.lit(False)
    return visual & pdf & (pages >= settings.queue_page_threshold)


def mode_consistency(text_exists: Column, pages_exist: Column, wants_visual: Column) -> Column:
    """"ok", or why an ingest into an existing base is refused: a base stays with the mode of its first ingest."""
    return (
        F.when(~text_exists & ~pages_exist, "ok")
        .when(pages_exist & ~wants_visual, "base has a visual index")
        .when(text_exists & ~pages_exist & wants_visual, "base is text-only")
        .otherwise("ok")
    )
