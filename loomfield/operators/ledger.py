"""Ledgers of publications and reviews: idempotent begins, reconciled targets, states, acceptance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.columns import first_failure, one_line

#: The checks that an acceptance needs.
REQUIRED_CHECKS = ["sqlite_integrity", "privacy", "content"]
DIGEST = "^[0-9a-f]{64}$"
#: Handles that are empty, absolute or climb up; a backslash counts as a slash.
UNSAFE = r"^$|^/|(^|/)\.\.(/|$)"


def request_hash(targets: DataFrame) -> DataFrame:
    """saga_id, targets, request_sha256 over the sorted (name, expected digest) pairs, in compact JSON."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col("target_name").alias("n"), F.coalesce("expected_sha256", F.lit("")).alias("s"))))
    body = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('["'), p["n"], F.lit('","'), p["s"], F.lit('"]'))), ",")
    return targets.groupBy("saga_id").agg(F.count(F.lit(1)).alias("targets"), F.sha2(F.concat(F.lit("["), body, F.lit("]")), 256).alias("request_sha256"))


def begin(requests: DataFrame, sagas: DataFrame, items: DataFrame) -> DataFrame:
    """request_id, outcome of requests (request_id, job_ref, idempotency_key, request_sha256, draft_sha256, media_sha256, targets).

    targets is a map from names to (handle, sha256); sagas have the same columns
    but request_id, and state, with targets from names to (handle, status). A known
    key with another request is retargeted only while it is an intent for the same
    job, draft, media and target names, without digests, and if handles of targets
    changed that are not verified. Of requests with one new key in a batch the first
    is taken and the others are judged against it.
    """
    same = ["request_sha256", "job_ref", "draft_sha256", "media_sha256"]
    held = F.struct(*same, F.col("state"), F.transform_values("targets", lambda _, t: F.struct(t["handle"].alias("handle"), t["status"].alias("status"))).alias("targets"))
    lower = {c: F.lower(c) for c in ("draft_sha256", "media_sha256")}
    lower["targets"] = F.transform_values("targets", lambda _, t: F.struct(F.replace(t["handle"], F.lit("\\"), F.lit("/")).alias("handle"), F.lower(t["sha256"]).alias("sha256")))
    w = Window.partitionBy("idempotency_key").orderBy("request_id")
    as_saga = F.struct(*same, F.lit("intent").alias("state"), F.transform_values("targets", lambda _, t: F.struct(t["handle"].alias("handle"), F.lit("pending").alias("status"))).alias("targets"))
    r = requests.withColumns(lower)
    r = r.withColumns({"turn": F.row_number().over(w), "first": F.first(as_saga).over(w)})
    r = r.join(sagas.select("idempotency_key", held.alias("known")), "idempotency_key", "left").withColumn("was", F.coalesce("known", F.when(F.col("turn") > 1, F.col("first"))))
    r = r.join(items.select(F.col("job_id").alias("job_ref"), F.lit(True).alias("known_job")).distinct(), "job_ref", "left")
    now, names = F.map_values("targets"), F.array_sort(F.map_keys("targets"))
    handles = F.transform(names, lambda n: F.struct(F.col("targets")[n]["handle"].alias("now"), F.col("was.targets")[n]["handle"].alias("was"), F.col("was.targets")[n]["status"].alias("status")))
    changed = F.filter(handles, lambda h: h["now"] != h["was"])
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    bad = lambda c: ~F.coalesce(F.regexp_like(c, F.lit(DIGEST)), F.lit(False))
    movable = (
        (F.col("was.state") == "intent") & F.forall(F.array(*[F.col(f"was.{c}").eqNullSafe(F.col(c)) for c in same[1:]]), lambda x: x)
        & (names == F.array_sort(F.map_keys("was.targets"))) & F.forall(now, lambda t: t["sha256"].isNull())
        & (F.size(changed) > 0) & ~F.exists(changed, lambda h: h["status"] == "verified"))
    outcome = F.coalesce(
        first_failure(
            (blank("job_ref") | blank("idempotency_key") | (F.coalesce(F.size("targets"), F.lit(0)) < 1) | F.exists(names, blank), "bad_request"),
            (F.exists(now, lambda t: F.regexp_like(F.coalesce(t["handle"], F.lit("")), F.lit(UNSAFE))), "bad_handle"),
            (F.exists(now, lambda t: t["sha256"].isNotNull() & bad(t["sha256"])) | bad("draft_sha256") | bad("media_sha256"), "bad_digest"),
            (F.col("known_job").isNull(), "unknown_job"), (F.col("was").isNull(), "new"), (F.col("was.request_sha256") == F.col("request_sha256"), "reused"), (movable, "retargeted")),
        F.lit("conflict"))
    return r.select("request_id", outcome.alias("outcome"))


def seal(targets: DataFrame, expected: DataFrame, sagas: DataFrame) -> DataFrame:
    """saga_id, outcome: sealed, resealed, reused, name_mismatch or conflict.

    targets: saga_id, target_name, expected_sha256, status; expected: saga_id,
    target_name, sha256; sagas: saga_id, state. Another digest is taken while the
    saga is an intent and the target not verified, which then starts anew; an
    accepted saga takes none.
    """
    t, e = targets.alias("t"), expected.alias("e")
    on = (F.col("t.saga_id") == F.col("e.saga_id")) & (F.col("t.target_name") == F.col("e.target_name"))
    had, verified = F.nullif(F.col("t.expected_sha256"), F.lit("")), F.col("t.status").eqNullSafe("verified")
    j = t.join(e, on, "full_outer").select(
        F.coalesce("t.saga_id", "e.saga_id").alias("saga_id"), (F.col("t.target_name").isNull() | F.col("e.target_name").isNull()).alias("odd"),
        (had != F.col("e.sha256")).alias("other"), (verified & (had != F.col("e.sha256"))).alias("fixed"), had.isNull().alias("open"))
    per = j.groupBy("saga_id").agg(*[F.count_if(c).alias(c) for c in ("odd", "other", "fixed", "open")]).join(sagas.select("saga_id", "state"), "saga_id", "left")
    accepted, intent = F.col("state").eqNullSafe("accepted"), F.col("state").eqNullSafe("intent")
    outcome = (
        F.when(F.col("odd") > 0, "name_mismatch").when(accepted & (F.col("other") + F.col("open") > 0), "conflict").when((F.col("other") > 0) & ~intent, "conflict")
        .when(F.col("fixed") > 0, "conflict").when(F.col("other") > 0, "resealed").when(F.col("open") > 0, "sealed").otherwise("reused"))
    return per.select("saga_id", outcome.alias("outcome"))


def reconcile_targets(targets: DataFrame) -> DataFrame:
    """Adds target_status: planned (no digest yet), missing, verified or mismatch."""
    status = (
        F.when(F.coalesce("expected_sha256", F.lit("")) == "", "planned").when(F.col("observed_sha256").isNull(), "missing")
        .when(F.col("observed_sha256") == F.col("expected_sha256"), "verified").otherwise("mismatch"))
    return targets.withColumn("target_status", status)


def latest_sagas(sagas: DataFrame) -> DataFrame:
    """The newest saga of each job (created_at, then saga_id)."""
    rank = F.row_number().over(Window.partitionBy("job_ref").orderBy(F.desc("created_at"), F.desc("saga_id")))
    return sagas.withColumn("rank", rank).where("rank = 1").drop("rank")


def saga_states(sagas: DataFrame, targets: DataFrame) -> DataFrame:
    """saga_id, state: of latest sagas published_unaccepted if all targets are verified, else intent; accepted stays."""
    good = reconcile_targets(targets).groupBy("saga_id").agg(F.bool_and(F.col("target_status") == "verified").alias("good"))
    newest = latest_sagas(sagas).select("saga_id", F.lit(True).alias("newest"))
    j = sagas.join(good, "saga_id", "left").join(newest, "saga_id", "left")
    state = F.when((F.col("state") == "accepted") | F.col("newest").isNull(), F.col("state")).when(F.coalesce("good", F.lit(False)), "published_unaccepted").otherwise("intent")
    return j.select("saga_id", state.alias("state"))


def backfill_superseded(sagas: DataFrame, acceptances: DataFrame) -> DataFrame:
    """saga_id, superseded_by, superseded_at: for accepted sagas without superseded_at, the earliest newer accepted one of the job.

    The time is that of the newer one's acceptance (saga_id, accepted_at), or else of its last update.
    """
    w = Window.partitionBy("job_ref").orderBy("created_at", "saga_id")
    accepted = sagas.where("state = 'accepted'").join(acceptances.select("saga_id", "accepted_at"), "saga_id", "left")
    at = F.lead(F.coalesce("accepted_at", "updated_at")).over(w)
    marked = accepted.select("saga_id", F.col("superseded_at").isNull().alias("open"), F.lead("saga_id").over(w).alias("superseded_by"), at.alias("superseded_at"))
    return marked.where("open AND superseded_by IS NOT NULL").drop("open")


def accept(sagas: DataFrame, checks: DataFrame, items: DataFrame, required: Sequence[str] = REQUIRED_CHECKS) -> DataFrame:
    """saga_id, outcome of acceptances (saga_id, checks map<string, boolean>): accepted or why not; a check that is null has failed."""
    newer = sagas.where("state = 'accepted'").groupBy("job_ref").agg(F.max(F.struct("created_at", "saga_id")).alias("top"))
    j = checks.join(sagas, "saga_id", "left").join(newer, "job_ref", "left")
    j = j.join(items.select(F.col("job_id").alias("job_ref"), F.lit(True).alias("known_job")).distinct(), "job_ref", "left")
    missing = F.coalesce(F.size(F.array_except(F.array(*map(F.lit, required)), F.map_keys("checks"))) > 0, F.lit(True))
    passed = F.forall(F.map_values("checks"), lambda c: c.eqNullSafe(F.lit(True)))
    outcome = F.coalesce(
        first_failure(
            (F.col("state").isNull(), "unknown_saga"), (F.col("state") == "accepted", "already_accepted"), (F.col("state") != "published_unaccepted", "not_published"),
            (F.col("top") > F.struct("created_at", "saga_id"), "superseded"), (missing, "missing_checks"), (~passed, "failed_checks"), (F.col("known_job").isNull(), "unknown_job")),
        F.lit("accepted"))
    return j.select("saga_id", outcome.alias("outcome"))


def after_acceptance(sagas: DataFrame, items: DataFrame, outcomes: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Sagas and items after the outcomes of ``accept``.

    An accepted saga is accepted and superseded by none; the job's other accepted
    ones, unless superseded before, are superseded now, by the newest; the job's
    item is completed.
    """
    at = F.to_timestamp_ntz(F.lit(now))
    done = outcomes.where("outcome = 'accepted'").select("saga_id", F.lit(True).alias("now_accepted"))
    j = sagas.join(done, "saga_id", "left")
    top = j.where("now_accepted").groupBy("job_ref").agg(F.max(F.struct("created_at", "saga_id"))["saga_id"].alias("top"))
    j = j.join(top, "job_ref", "left")
    newest = F.col("saga_id").eqNullSafe(F.col("top"))
    over = F.col("top").isNotNull() & ~newest & ((F.col("state") == "accepted") & F.col("superseded_at").isNull() | F.coalesce("now_accepted", F.lit(False)))
    after = j.withColumns({
        "superseded_by": F.when(over, F.col("top")).when(~newest, F.col("superseded_by")),
        "superseded_at": F.when(over, at).when(~newest, F.col("superseded_at")),
        "updated_at": F.when(F.col("now_accepted"), at).otherwise(F.col("updated_at")),
        "state": F.when(F.col("now_accepted"), "accepted").otherwise(F.col("state")),
    }).select(*sagas.columns)
    completed = items.join(top.select(F.col("job_ref").alias("job_id"), "top"), "job_id", "left")
    return after, completed.withColumn("status", F.when(F.col("top").isNotNull(), "completed").otherwise(F.col("status"))).select(*items.columns)


def completed_without_acceptance(items: DataFrame, sagas: DataFrame) -> DataFrame:
    """Completed items without an accepted saga."""
    accepted = sagas.where("state = 'accepted'").select(F.col("job_ref").alias("job_id"))
    return items.where("status = 'completed'").join(accepted, "job_id", "left_anti")


def ledger_status(sagas: DataFrame, targets: DataFrame) -> DataFrame:
    """state, jobs on latest sagas, and a row ``drifted``: accepted jobs with a target that is not verified."""
    latest = latest_sagas(sagas)
    counts = latest.groupBy("state").agg(F.count(F.lit(1)).alias("jobs"))
    off = reconcile_targets(targets).where("target_status <> 'verified'").select("saga_id").distinct()
    drift = latest.where("state = 'accepted'").join(off, "saga_id", "left_semi").agg(F.lit("drifted").alias("state"), F.count_distinct("job_ref").alias("jobs"))
    return counts.union(drift)


def append_reviews(reviews: DataFrame, new: DataFrame) -> DataFrame:
    """New reviews (job_ref, candidate_sha256, decision, note) that differ from the latest of their candidate; notes become hashes."""
    note = F.left(one_line(F.coalesce("note", F.lit(""))), F.lit(2000))
    hashed = new.select("job_ref", "candidate_sha256", "decision", F.sha2(note, 256).alias("note_sha256"))
    last = reviews.groupBy("job_ref", "candidate_sha256").agg(F.max_by(F.struct("decision", "note_sha256"), "review_id").alias("last"))
    j = hashed.join(last, ["job_ref", "candidate_sha256"], "left")
    return j.where("last IS NULL OR last.decision <> decision OR last.note_sha256 <> note_sha256").drop("last")


def latest_decisions(reviews: DataFrame) -> DataFrame:
    """job_ref, candidate_sha256, decision, review_id: the newest review of each candidate."""
    return reviews.groupBy("job_ref", "candidate_sha256").agg(F.max_by("decision", "review_id").alias("decision"), F.max("review_id").alias("review_id"))


def approved_and_current(reviews: DataFrame, cands: DataFrame) -> DataFrame:
    """Candidates (job_ref, candidate_sha256) whose newest review approves."""
    ok = latest_decisions(reviews).where("decision = 'approve'").select("job_ref", "candidate_sha256")
    return cands.join(ok, ["job_ref", "candidate_sha256"], "left_semi")


def list_reviews(reviews: DataFrame, job=None) -> DataFrame:
    """Reviews without their private note, in order of id."""
    out = reviews if job is None else reviews.where(F.col("job_ref") == job)
    return out.drop("note").orderBy("review_id")


def upsert_projection(projections: DataFrame, new: DataFrame) -> DataFrame:
    """key, location, first_published_at, updated_at after an upsert that keeps the first time."""
    p, n = projections.alias("p"), new.alias("n")
    return p.join(n, F.col("p.key") == F.col("n.key"), "full_outer").select(
        F.coalesce("p.key", "n.key").alias("key"), F.coalesce("n.location", "p.location").alias("location"),
        F.coalesce("p.first_published_at", "n.published_at").alias("first_published_at"), F.coalesce("n.published_at", "p.updated_at").alias("updated_at"))
