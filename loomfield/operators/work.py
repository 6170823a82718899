"""Work tracking: plans, claims, stages, spans, attempts, failure budgets, capacity and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.columns import first_failure


def plan(items: DataFrame, k: int, status: str | None = None) -> DataFrame:
    """The k collected items of the lowest position with the status (none: not completed)."""
    wanted = F.col("status") == status if status else F.col("status") != "completed"
    return items.where(F.col("currently_collected") & wanted).orderBy("last_position", "job_id").limit(k)


def fixed_plan(wanted: DataFrame, items: DataFrame) -> DataFrame:
    """job_id, problem of a fixed list (job_id, expected_status): repeated, missing, uncollected, status changed, or ok."""
    counted = wanted.groupBy("job_id").agg(F.count(F.lit(1)).alias("times"), F.min("expected_status").alias("expected_status"))
    problem = first_failure(
        (F.col("times") > 1, "repeated"), (F.col("status").isNull(), "missing"), (~F.col("currently_collected"), "uncollected"),
        (F.col("status") != F.col("expected_status"), "status_changed"))
    j = counted.join(items.select("job_id", "status", "currently_collected"), "job_id", "left")
    return j.select("job_id", F.coalesce(problem, F.lit("ok")).alias("problem"))


def claimed_jobs(batch_items: DataFrame, finished: DataFrame) -> DataFrame:
    """Jobs (batch_id, job_id) of batches that are not finished."""
    return batch_items.join(finished, "batch_id", "left_anti").select("job_id").distinct()


def overlap(wanted: DataFrame, claimed: DataFrame) -> DataFrame:
    return wanted.join(claimed, "job_id", "left_semi")


def job_stages(items: DataFrame, publications: DataFrame, checkpoints: DataFrame, candidates: DataFrame, drafts: DataFrame, packets: DataFrame, analyses: DataFrame, media: DataFrame) -> DataFrame:
    """job_id, stage, error_code of items (job_id, status, currently_collected).

    publications: the latest of a job (job_id, state, targets_verified);
    checkpoints: job_id, paused, error; candidates: job_id, current, imported; the
    others: job_id, one row for each job that has the artifact.
    """
    j = items.select("job_id", "status", "currently_collected")
    for df in (publications, checkpoints, candidates):
        j = j.join(df, "job_id", "left")
    for name, df in (("drafted", drafts), ("packed", packets), ("analysed", analyses), ("fetched", media)):
        j = j.join(df.select("job_id", F.lit(True).alias(name)).distinct(), "job_id", "left")
    accepted = F.col("status").eqNullSafe("completed") & F.col("state").eqNullSafe("accepted")
    whole, paused = F.coalesce("targets_verified", F.lit(False)), F.coalesce("paused", F.lit(False))
    stage = (
        F.when(accepted & whole, "accepted").when(accepted, "failed").when(~F.coalesce("currently_collected", F.lit(True)), "failed")
        .when(paused | F.col("status").isin("failed", "incomplete"), "failed").when(F.col("imported") & F.col("drafted"), "staged")
        .when(F.col("current"), "semantic_ready").when(F.col("packed"), "packet_ready").when(F.col("analysed"), "analyzed").when(F.col("fetched"), "downloaded").otherwise("planned"))
    code = F.when(accepted & ~whole, "publication_target_drift").when(~accepted & ~F.coalesce("currently_collected", F.lit(True)), "job_no_longer_collected").otherwise(F.col("error"))
    return j.select("job_id", stage.alias("stage"), code.alias("error_code"))


def job_spans(events: DataFrame, batches: DataFrame) -> DataFrame:
    """job_id, first_at, last_at, elapsed_s of each job (job_id, created_at) over its events (job_id, at) from then on; without any, its creation and 0."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    counted = batches.join(events.select("job_id", "at"), "job_id", "left").withColumn("at", F.when(F.col("at") >= F.col("created_at"), F.col("at")))
    per = counted.groupBy("job_id", "created_at").agg(F.min("at").alias("a"), F.max("at").alias("z"))
    spans = per.select("job_id", F.coalesce("a", "created_at").alias("first_at"), F.coalesce("z", "created_at").alias("last_at"))
    return spans.withColumn("elapsed_s", F.round(F.greatest(F.lit(0.0), (micros("last_at") - micros("first_at")) / 1e6), 3))


def batch_rollup(stages: DataFrame) -> DataFrame:
    """batch_id, jobs, accepted, failed, by_stage (map of counts, by name), state: complete, blocked (some job failed) or running."""
    counts = stages.groupBy("batch_id", "stage").agg(F.count(F.lit(1)).alias("n"))
    of = lambda stage: F.coalesce(F.sum(F.when(F.col("stage") == stage, F.col("n"))), F.lit(0))
    per = counts.groupBy("batch_id").agg(
        F.sum("n").alias("jobs"), of("accepted").alias("accepted"), of("failed").alias("failed"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n")))).alias("by_stage"))
    state = F.when(F.col("accepted") == F.col("jobs"), "complete").when(F.col("failed") > 0, "blocked").otherwise("running")
    return per.withColumn("state", state)


def recommend(stages: DataFrame, assigned: DataFrame, available: int, cpu_busy: bool = False) -> DataFrame:
    """batch_id, kind, place, job_id: what to do next in each batch (batch_id, job_id, position, stage, active).

    cpu: the first job that is planned, downloaded or analyzed, if none is active
    and the processor is free; semantic: packets that nobody works on (assigned:
    job_id), as many as places are available; import: all ready answers; publish:
    the first staged job; failed: all of them.
    """
    taken = assigned.select("job_id", F.lit(True).alias("taken")).distinct()
    busy = stages.where("active").select("batch_id", F.lit(True).alias("busy")).distinct()
    stage = F.col("stage")
    kind = (
        F.when(stage.isin("planned", "downloaded", "analyzed") & F.col("busy").isNull() & F.lit(not cpu_busy), "cpu")
        .when((stage == "packet_ready") & F.col("taken").isNull(), "semantic").when(stage == "semantic_ready", "import")
        .when(stage == "staged", "publish").when(stage == "failed", "failed"))
    j = stages.join(taken, "job_id", "left").join(busy, "batch_id", "left").withColumn("kind", kind).where("kind IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("batch_id", "kind").orderBy("position", "job_id")).cast("long")
    most = F.when(F.col("kind").isin("cpu", "publish"), 1).when(F.col("kind") == "semantic", available).otherwise(F.lit(2**62))
    return j.withColumn("place", place).where(F.col("place") <= most).select("batch_id", "kind", "place", "job_id")


def stage_attempts(events: DataFrame) -> DataFrame:
    """job_id, stage, attempt, started_at, ended_at, status, duration_s, reused of events (job_id, stage, event_id, at, event, reused).

    A start opens an attempt, which is running until the stage's next event ends it
    (completed or failed) or starts another; an end without a start is an attempt
    without start and duration.
    """
    w = Window.partitionBy("job_id", "stage").orderBy("at", "event_id")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    following = F.lead(F.struct("event", "at", "reused")).over(w)
    marked = events.withColumns({"next": following, "before": F.lag("event").over(w)})
    opens, ends = F.col("event") == "started", F.col("next.event") != "started"
    rows = marked.where(opens | ~F.col("before").eqNullSafe("started")).select(
        "job_id", "stage", "event_id", "at", F.when(opens, F.col("at")).alias("started_at"), F.when(~opens, F.col("at")).when(ends, F.col("next.at")).alias("ended_at"),
        F.when(~opens, F.col("event")).when(ends, F.col("next.event")).otherwise("running").alias("status"),
        F.coalesce(F.when(~opens, F.col("reused")).when(ends, F.col("next.reused")), F.lit(False)).alias("reused"))
    duration = F.round(F.greatest(F.lit(0.0), (micros("ended_at") - micros("started_at")) / 1e6), 3)
    lasted = F.when(F.col("started_at").isNotNull() & F.col("ended_at").isNotNull(), duration)
    return rows.select("job_id", "stage", F.row_number().over(w).cast("long").alias("attempt"), "started_at", "ended_at", "status", lasted.alias("duration_s"), "reused")


def failure_budget(events: DataFrame, limit: int = 2) -> DataFrame:
    """job_id, stage, error_code, failures, blocked: failures since the stage's last success."""
    w = Window.partitionBy("job_id", "stage").orderBy("at", "event_id")
    marked = events.withColumn("island", F.count_if(F.col("outcome") == "completed").over(w))
    last = marked.groupBy("job_id", "stage").agg(F.max("island").alias("island"))
    run = marked.where("outcome = 'failed'").join(last, ["job_id", "stage", "island"])
    per = run.groupBy("job_id", "stage", "error_code").agg(F.count(F.lit(1)).alias("failures"))
    return per.withColumn("blocked", F.col("failures") >= limit)


def stale_leases(leases: DataFrame, now: Column, seconds: int = 7200) -> DataFrame:
    """Leases (acquired_at) older than ``seconds`` at ``now``."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("acquired_at").cast("timestamp"))
    return leases.where(age > seconds * 1_000_000)


def capacity(assignments: DataFrame, cap: int) -> DataFrame:
    """pool, active, available, repeated (jobs assigned twice) of assignments (pool, job_id, active)."""
    twice = assignments.where("active").groupBy("pool", "job_id").count().groupBy("pool").agg(F.count_if(F.col("count") > 1).alias("repeated"))
    used = assignments.groupBy("pool").agg(F.count_if("active").alias("active"))
    return used.join(twice, "pool", "left").select("pool", "active", F.greatest(F.lit(0), F.lit(cap) - F.col("active")).alias("available"), F.coalesce("repeated", F.lit(0)).alias("repeated"))


def assignment_mismatches(assignments: DataFrame, manifests: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field of each field in which an assignment and its manifest differ; field ``manifest`` if there is none."""
    m = manifests.select(key, F.lit(True).alias("there"), *[F.col(f).alias(f"m_{f}") for f in fields])
    marks = [F.when(F.col("there") & ~F.col(f).eqNullSafe(F.col(f"m_{f}")), F.lit(f)) for f in fields]
    found = F.array_compact(F.array(F.when(F.col("there").isNull(), F.lit("manifest")), *marks))
    return assignments.join(m, key, "left").select(key, F.explode(found).alias("field"))


def run_report(before: DataFrame, after: DataFrame, records: DataFrame) -> DataFrame:
    """outcome, job_id, title, category, accepted, jobs: a row for each job completed in this run, and a count of each outcome.

    before, after: job_id, status; records: job_id, title, category, accepted. The
    outcomes are completed_now, completed_before, remaining, new and gone.
    """
    j = before.select("job_id", F.col("status").alias("was")).join(after.select("job_id", F.col("status").alias("is")), "job_id", "full_outer")
    done = F.col("is") == "completed"
    outcome = (
        F.when(F.col("is").isNull(), "gone").when(done & ~F.col("was").eqNullSafe("completed"), "completed_now").when(done, "completed_before")
        .when(F.col("was").isNull(), "new").otherwise("remaining"))
    marked = j.select("job_id", outcome.alias("outcome"))
    counts = marked.groupBy("outcome").agg(F.count(F.lit(1)).alias("jobs"))
    now = marked.where("outcome = 'completed_now'").join(records.select("job_id", "title", "category", "accepted"), "job_id", "left")
    lines = now.withColumns({"title": F.coalesce("title", F.lit("untitled")), "accepted": F.coalesce("accepted", F.lit(False)), "jobs": F.lit(1).cast("long")})
    return lines.unionByName(counts, allowMissingColumns=True).select("outcome", "job_id", "title", "category", "accepted", "jobs")
