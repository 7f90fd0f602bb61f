"""State and job queue as append-only events, read through the latest event of
each key.  Events are (key columns, id, status, ts, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses of a job or stage.
QUEUED, RUNNING, DONE, FAILED, STOPPED = "queued", "running", "done", "failed", "stopped"


def latest(events: DataFrame, keys: list[str]) -> DataFrame:
    """The last event of each key, by ts and id.  A maximum over structs merges
    before the shuffle, where a window would move every event."""
    rest = [c for c in events.columns if c not in keys]
    order = F.struct("ts", "id", *[c for c in rest if c not in ("ts", "id")])
    held = events.groupBy(*keys).agg(F.max(order).alias("e"))
    return held.select(*keys, *(F.col(f"e.{c}").alias(c) for c in rest))


def todo(work: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose latest event isn't done; null keys are equal to each other."""
    done = latest(events, keys).where(F.col("status") == DONE).select(*(F.col(k).alias(f"done_{k}") for k in keys))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"done_{k}"))
    return work.join(done, match, "left_anti")


def claim_next(jobs: DataFrame) -> DataFrame:
    """The oldest queued job: a top-1, without a sort of the queue."""
    return jobs.where(F.col("status") == QUEUED).orderBy("id").limit(1)


def recent(jobs: DataFrame, n: int = 20) -> DataFrame:
    return jobs.orderBy(F.desc("id")).limit(n)


def recovered(jobs: DataFrame) -> DataFrame:
    """After a crash: running jobs go back to the queue, those asked to stop
    are stopped."""
    status = F.when((F.col("status") == RUNNING) & F.col("stop"), STOPPED).when(F.col("status") == RUNNING, QUEUED).otherwise(F.col("status"))
    return jobs.withColumn("status", status)


def stop_requested(jobs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Ask jobs to stop, all of them or those in ``ids``: a queued job is
    stopped at once, a running one is flagged."""
    asked = F.lit(True)
    if ids is not None:
        jobs = jobs.join(ids.select("id", F.lit(True).alias("asked")).distinct(), "id", "left")
        asked = F.coalesce("asked", F.lit(False))
    open_ = F.col("status").isin(QUEUED, RUNNING) & asked
    out = jobs.withColumn("stop", F.when(open_, True).otherwise(F.col("stop")))
    return out.withColumn("status", F.when(open_ & (F.col("status") == QUEUED), STOPPED).otherwise(F.col("status"))).drop("asked")


def unfinished(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("status").isin(DONE, FAILED, STOPPED))


def without_stage(runs: DataFrame, stage: str) -> DataFrame:
    """Runs left when a stage and its colon-suffixed variants are cleared."""
    return runs.where(~((F.col("stage") == stage) | F.col("stage").startswith(stage + ":")))


def eta_minutes(jobs: DataFrame) -> DataFrame:
    """(id, minutes): the time left at the pace so far; null before the first
    unit is done.  ``jobs``: (id, started, now, done, total)."""
    spent = F.unix_timestamp("now") - F.unix_timestamp("started")
    left = F.ceil(spent / F.col("done") * (F.col("total") - F.col("done")) / 60)
    return jobs.select("id", F.when(F.col("done") > 0, left).alias("minutes"))


# what a queue or a stage writes: events, never changes in place


def enqueued(work: DataFrame, stage: str, model: str, at: Column) -> DataFrame:
    """Events that queue a job for every row of work (id, book, total)."""
    return work.select("id", "book", F.lit(stage).alias("stage"), F.lit(model).alias("model"), F.lit(QUEUED).alias("status"), at.alias("ts"), F.lit(0).alias("done"), F.coalesce("total", F.lit(0)).alias("total"))


def claims(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, ts) of the claim that holds: of the running events after the
    last queued one of each key the first, by ts and id.  Several workers may
    append a claim at once; each reads here whether its own is the one."""
    queued = F.max(F.when(F.col("status") == QUEUED, F.struct("ts", "id"))).over(Window.partitionBy(*keys))
    after = events.withColumn("queued", queued).where((F.col("status") == RUNNING) & (F.struct("ts", "id") > F.col("queued")))
    held = after.groupBy(*keys).agg(F.min(F.struct("ts", "id")).alias("e"))
    return held.select(*keys, "e.id", "e.ts")


def stage_runs(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, started, finished, error): what a table of runs would
    hold after all events: a start clears what an earlier run left, an end
    keeps the start.  ``events``: keys, id, status, ts, error."""
    order = F.struct("ts", "id")
    started = F.max(F.when(F.col("status") == RUNNING, order)).alias("s")
    ended = F.max(F.when(F.col("status").isin(DONE, FAILED, STOPPED), F.struct("ts", "id", "error"))).alias("e")
    per = events.groupBy(*keys).agg(started, ended, F.max(F.struct("ts", "id", "status")).alias("last"))
    over = F.col("e").isNotNull() & (F.col("s").isNull() | (F.struct("e.ts", "e.id") > F.col("s")))
    return per.select(*keys, "last.status", F.col("s.ts").alias("started"), F.when(over, F.col("e.ts")).alias("finished"), F.when(over, F.col("e.error")).alias("error"))


def progress(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, done, total): how far each job says it is, by its last event that
    says so."""
    told = events.where("total IS NOT NULL").groupBy(*keys).agg(F.max(F.struct("ts", "id", F.coalesce("done", F.lit(0)).alias("done"), "total")).alias("e"))
    return told.select(*keys, "e.done", "e.total")


def reusable(runs: DataFrame, batch: list[str], settings: list[str]) -> DataFrame:
    """Of each batch the run that can be used again: the last that finished,
    if its settings are those of the last that began.  ``runs``: batch,
    settings, id, started, finished, ...; repeated rows count once."""
    wanted = runs.where("started IS NOT NULL").groupBy(*batch).agg(F.max_by(F.struct(*settings), F.struct("started", "id")).alias("wanted"))
    done = latest(runs.where("finished IS NOT NULL").distinct().withColumn("ts", F.col("finished")), batch).drop("ts")
    return done.join(wanted, batch).where(F.struct(*settings).eqNullSafe(F.col("wanted"))).drop("wanted")


def merged(runs: DataFrame, key: str) -> DataFrame:
    """(key, batches, figures, ocr_pages, headings): the results of the runs of
    a book, one per batch, put together in page order; headings has for each
    batch the heading it begins under, the last one of the batches before."""
    over = Window.partitionBy(key).orderBy("first_page").rowsBetween(Window.unboundedPreceding, -1)
    held = runs.withColumn("under", F.last("last_heading", ignorenulls=True).over(over))
    per = held.groupBy(key).agg(
        F.count("*").alias("batches"), F.sum("figure_count").alias("figures"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ocr_pages")))).alias("ocr_pages"),
        F.sort_array(F.collect_list(F.struct("first_page", F.coalesce("under", F.lit("")).alias("under")))).alias("h"),
    )
    return per.select(key, "batches", "figures", "ocr_pages", F.col("h.under").alias("headings"))


def job_table(jobs: DataFrame, n: int = 20) -> DataFrame:
    """(id, stage, status, done, minutes, model, error) of the newest jobs as
    they are shown: a running job that is asked to stop is stopping, and only
    a running one has time left.  ``jobs``: id, stage, model, status, stop,
    started, now, done, total, error."""
    running = F.col("status") == RUNNING
    left = eta_minutes(jobs.where(running & F.col("started").isNotNull()))
    shown = recent(jobs, n).join(left, "id", "left")
    status = F.when(running & F.col("stop"), "stopping").otherwise(F.col("status"))
    return shown.select("id", "stage", status.alias("status"), F.concat_ws("/", "done", "total").alias("done"), "minutes", "model", F.substring(F.coalesce("error", F.lit("")), 1, 120).alias("error"))
