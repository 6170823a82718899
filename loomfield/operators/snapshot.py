"""Collection snapshots: page chains, positions, merging a snapshot into the registry, and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.columns import canonical_id, filled, first_failure, stable_key

#: The states of a registry item.
STATUSES = ["new", "processing", "downloaded", "analyzed", "completed", "failed", "incomplete"]


def canonical_ids(df: DataFrame, first: str, second: str) -> DataFrame:
    """Adds id and id_error (missing)."""
    out = df.withColumn("id", canonical_id(F.col(first), F.col(second)))
    return out.withColumn("id_error", F.when(F.col("id").isNull(), "missing_id"))


def stable_keys(df: DataFrame, col: str, prefix: str = "item-") -> DataFrame:
    return df.withColumn("job_id", stable_key(F.col(col), prefix))


def project_items(items: DataFrame) -> DataFrame:
    """Typed items of raw page rows (id, title, author, duration_ms, width, height); zero sizes are unknown."""
    return items.select(
        filled(F.col("id")).alias("source_id"), filled(F.col("title")).alias("title"), filled(F.col("author")).alias("author"),
        F.round(F.nullif(F.col("duration_ms"), F.lit(0)) / 1000, 3).alias("duration_s"),
        F.nullif(F.col("width"), F.lit(0)).alias("width"), F.nullif(F.col("height"), F.lit(0)).alias("height"),
    )


def validate_chain(pages: DataFrame, page_limit: int = 10_000) -> DataFrame:
    """snapshot_id, pages, error: the first broken rule of each snapshot's page chain, null if it is whole."""
    w = Window.partitionBy("snapshot_id").orderBy("page_seq")
    marked = pages.select(
        "snapshot_id", "page_seq", "page_cursor", "next_cursor", "has_more",
        F.lag("next_cursor").over(w).alias("expected"), F.lag("has_more").over(w).alias("more"), F.row_number().over(w).alias("i"),
        F.lead("page_seq").over(w).isNull().alias("last"),
    )
    code = first_failure(
        ((F.col("i") == 1) & ~F.col("page_cursor").eqNullSafe(F.lit("0")), "1_bad_start"),
        ((F.col("i") > 1) & ~F.col("more"), "2_after_last_page"),
        ((F.col("i") > 1) & ~F.col("page_cursor").eqNullSafe(F.col("expected")), "3_discontinuity"),
        (F.col("has_more") & F.col("next_cursor").eqNullSafe(F.col("page_cursor")), "4_not_advanced"),
        (F.col("last") & F.col("has_more"), "6_incomplete"),
    )
    per = marked.withColumn("code", code).groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("pages"), F.min("code").alias("code"), F.countDistinct("page_cursor").alias("cursors")
    )
    error = F.least(F.col("code"), F.when(F.col("cursors") < F.col("pages"), "5_cursor_cycle"), F.when(F.col("pages") > page_limit, "7_page_limit"))
    return per.select("snapshot_id", "pages", F.substring(error, 3, 40).alias("error"))


def assign_positions(items: DataFrame) -> DataFrame:
    """snapshot_id, source_id, position (from 1) of the first occurrence of each id over a snapshot's pages.

    Items are numbered within their page, and pages add what lies before them,
    so that no window holds more than a page's items or a snapshot's pages.
    """
    first = items.groupBy("snapshot_id", "source_id").agg(F.min(F.struct("seq", "pos")).alias("at"))
    placed = first.select("snapshot_id", "source_id", "at.seq", "at.pos")
    inside = placed.withColumn("i", F.row_number().over(Window.partitionBy("snapshot_id", "seq").orderBy("pos", "source_id")))
    pages = placed.groupBy("snapshot_id", "seq").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("snapshot_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = pages.select("snapshot_id", "seq", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return inside.join(before, ["snapshot_id", "seq"]).select("snapshot_id", "source_id", (F.col("before") + F.col("i")).alias("position"))


def page_conflicts(pages: DataFrame) -> DataFrame:
    """Pages that were delivered more than once with different continuations."""
    versions = F.countDistinct(F.struct("next_cursor", "has_more"))
    return pages.groupBy("snapshot_id", "page_cursor").agg(F.count(F.lit(1)).alias("deliveries"), versions.alias("versions")).where("versions > 1")


def snapshot_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("item_count"))


def _merged(items: DataFrame, seen: DataFrame) -> DataFrame:
    alt = F.col("alt_id") if "alt_id" in seen.columns else F.lit(None).cast("string")
    s = seen.select("source_id", "position", F.col("media_sha256").alias("new_sha256"), alt.alias("new_alt"), F.lit(True).alias("seen")).alias("s")
    return items.alias("i").join(s, F.col("i.source_id") == F.col("s.source_id"), "full_outer")


def _reset(version: str) -> Column:
    changed = F.col("new_sha256").isNotNull() & ~F.col("new_sha256").eqNullSafe(F.col("i.media_sha256"))
    return F.col("seen") & (F.col("status") == "completed") & (~F.col("pipeline_version").eqNullSafe(F.lit(version)) | changed)


def reconcile(items: DataFrame, seen: DataFrame, snapshots: DataFrame, snapshot_id: str, version: str, now: str, prefix: str = "item-") -> DataFrame:
    """The registry after a snapshot; one that is not completed changes nothing.

    New ids are inserted; seen ones are collected at their new position, keep an
    alternative id or hash that the snapshot lacks, and are last seen now; a
    completed item starts anew, without its error, when the pipeline version or
    the known media hash changed; collected ids that were not seen are kept as no
    longer collected, since the time that was first noticed.
    """
    at, there = F.to_timestamp_ntz(F.lit(now)), F.col("i.source_id").isNotNull()
    whole = snapshots.where("state = 'completed'").select(F.col("snapshot_id").alias("of"), F.lit(True).alias("whole")).distinct()
    merged = _merged(items, seen.where(F.col("snapshot_id") == snapshot_id)).withColumn("of", F.lit(snapshot_id)).join(whole, "of", "left")
    seen_now, missed = F.coalesce(F.col("whole") & F.col("seen"), F.lit(False)), F.col("whole") & F.col("seen").isNull()
    fresh = seen_now & (~there | _reset(version))
    lost = missed & F.col("currently_collected")
    return merged.where("whole OR i.source_id IS NOT NULL").select(
        F.coalesce("i.source_id", "s.source_id").alias("source_id"),
        F.coalesce(F.when(seen_now, F.col("new_alt")), "i.alt_id").alias("alt_id"),
        F.coalesce("job_id", stable_key(F.col("s.source_id"), prefix)).alias("job_id"),
        F.coalesce("first_seen_at", at).alias("first_seen_at"),
        F.when(seen_now, at).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(seen_now, True).when(missed, False).otherwise(F.col("currently_collected")).alias("currently_collected"),
        F.when(lost, F.coalesce("uncollected_at", at)).when(~seen_now, F.col("uncollected_at")).alias("uncollected_at"),
        F.coalesce(F.when(seen_now, F.col("position")), "last_position").alias("last_position"),
        F.when(fresh, "new").otherwise(F.col("status")).alias("status"),
        F.when(seen_now, F.lit(version)).otherwise(F.col("pipeline_version")).alias("pipeline_version"),
        F.coalesce(F.when(seen_now, F.col("new_sha256")), "i.media_sha256").alias("media_sha256"),
        F.when(~fresh, F.col("error")).alias("error"),
        F.when(seen_now, F.lit(snapshot_id)).otherwise(F.col("i.snapshot_id")).alias("snapshot_id"),
    )


def diff(items: DataFrame, seen: DataFrame, version: str) -> DataFrame:
    """source_id, change: new, reset, recollected, kept, uncollected or gone."""
    change = (
        F.when(F.col("i.source_id").isNull(), "new")
        .when(F.col("seen").isNull(), F.when(F.col("currently_collected"), "uncollected").otherwise("gone"))
        .when(_reset(version), "reset")
        .when(~F.col("currently_collected"), "recollected")
        .otherwise("kept")
    )
    return _merged(items, seen).select(F.coalesce("i.source_id", "s.source_id").alias("source_id"), change.alias("change"))


def completed_only(snapshot_items: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Only completed snapshots may change the registry."""
    return snapshot_items.join(snapshots.where("state = 'completed'"), "snapshot_id", "left_semi")


def audit_registry(items: DataFrame, snapshots: DataFrame) -> DataFrame:
    """code, key of each broken constraint: repeated job_id, alt_id or (snapshot, position), unknown status or snapshot."""
    def repeated(code: str, *keys: str) -> DataFrame:
        filled_in = items.dropna(subset=list(keys))
        return filled_in.groupBy(*keys).count().where("count > 1").select(F.lit(code).alias("code"), F.concat_ws("/", *keys).alias("key"))

    status = items.where(~F.col("status").isin(STATUSES)).select(F.lit("bad_status").alias("code"), F.col("source_id").alias("key"))
    orphan = items.where("snapshot_id IS NOT NULL").join(snapshots, "snapshot_id", "left_anti")
    out = repeated("repeated_job", "job_id").union(repeated("repeated_alt", "alt_id")).union(repeated("repeated_position", "snapshot_id", "last_position"))
    return out.union(status).union(orphan.select(F.lit("unknown_snapshot"), "source_id"))


def needs_processing(items: DataFrame, version: str, artifacts: DataFrame) -> DataFrame:
    """Adds needs: collected, and not completed, of another version, or without valid artifacts (source_id in ``artifacts``)."""
    there = artifacts.select("source_id", F.lit(True).alias("valid")).distinct()
    done = F.col("status").eqNullSafe("completed") & F.col("pipeline_version").eqNullSafe(F.lit(version)) & F.col("valid").isNotNull()
    return items.join(there, "source_id", "left").withColumn("needs", F.coalesce("currently_collected", F.lit(False)) & ~done).drop("valid")


def next_items(items: DataFrame, snapshot_items: DataFrame, snapshots: DataFrame, k: int = 1) -> DataFrame:
    """snapshot_id, place, source_id, position: of each completed snapshot the k first of its items that need processing.

    items: source_id, needs; snapshot_items: snapshot_id, source_id, position.
    """
    seen = completed_only(snapshot_items, snapshots).join(items.where("needs").select("source_id"), "source_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("snapshot_id").orderBy("position", "source_id"))
    return seen.withColumn("place", place).where(F.col("place") <= k).select("snapshot_id", "place", "source_id", "position")


def claim_decisions(items: DataFrame, observed: DataFrame, artifacts: DataFrame, version: str) -> DataFrame:
    """source_id, decision, process, new_status (null: as before) for each wanted media observation (source_id, observed_sha256).

    Only a completed item of this version is checked against its media and its
    artifacts (source_id in ``artifacts``); an item of another version starts
    anew whatever its status; the rest are tried (again).
    """
    valid = artifacts.select("source_id", F.lit(True).alias("valid")).distinct()
    joined = observed.join(items, "source_id", "left").join(valid, "source_id", "left")
    seen = F.nullif(F.col("observed_sha256"), F.lit(""))
    same = F.col("pipeline_version").eqNullSafe(F.lit(version))
    current = same & (F.col("status") == "completed")
    decision = (
        F.when(~F.coalesce("currently_collected", F.lit(False)), "not_collected")
        .when(current & seen.isNull(), "media_missing")
        .when(current & ~F.col("media_sha256").eqNullSafe(seen), "hash_changed")
        .when(current & F.col("valid").isNotNull(), "completed_current")
        .when(current, "artifacts_invalid")
        .when(~same, "version_changed")
        .when(F.col("status").isin("failed", "incomplete"), "retry")
        .otherwise(F.col("status"))
    )
    marked = joined.select("source_id", decision.alias("decision"))
    process = ~F.col("decision").isin("not_collected", "completed_current")
    status = F.when(F.col("decision").isin("media_missing", "hash_changed", "artifacts_invalid"), "incomplete").when(F.col("decision") == "version_changed", "new").otherwise("processing")
    return marked.withColumns({"process": process, "new_status": F.when(process, status)})


def select_fixed(wanted: DataFrame, items: DataFrame, seen: DataFrame) -> DataFrame:
    """source_id, reason of each wanted id: unknown, not in the snapshot, not collected, already completed, or ok."""
    i = items.select("source_id", "currently_collected", "status", F.lit(True).alias("known"))
    s = seen.select("source_id", F.lit(True).alias("listed")).distinct()
    reason = first_failure(
        (F.col("known").isNull(), "unknown"), (F.col("listed").isNull(), "not_in_snapshot"),
        (~F.col("currently_collected"), "not_collected"), (F.col("status") == "completed", "already_completed"),
    )
    return wanted.join(i, "source_id", "left").join(s, "source_id", "left").select("source_id", F.coalesce(reason, F.lit("ok")).alias("reason"))


def identity_conflicts(items: DataFrame, observed: DataFrame, prefix: str = "item-") -> DataFrame:
    """source_id, conflict of items whose id, key, author or hash disagree with what was observed (alt_id, author, observed_sha256)."""
    o = observed.select("source_id", "alt_id", F.col("author").alias("author_now"), "observed_sha256")
    conflict = first_failure(
        (F.col("alt_id") != F.col("source_id"), "alt_id"),
        (F.col("job_id") != stable_key(F.col("source_id"), prefix), "job_id"),
        (F.col("author") != F.col("author_now"), "author"),
        (F.col("media_sha256") != F.col("observed_sha256"), "hash"),
    )
    return items.join(o, "source_id").withColumn("conflict", conflict).where("conflict IS NOT NULL").select("source_id", "conflict")


def apply_status(items: DataFrame, updates: DataFrame, keep_completed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Items after updates (source_id, new_status, new_error and, if there, new_media_sha256, new_library_path), and refused updates.

    The error is set to the new one, also to none; the other fields change only
    where a value is given. Completion needs an accepted publication and is
    refused here, as are unknown states and items; with ``keep_completed`` a
    completed item stays as it is.
    """
    allowed = F.col("new_status").isin(STATUSES) & (F.col("new_status") != "completed")
    good = updates.where(allowed).withColumn("updated", F.lit(True))
    hold = (F.col("status") == "completed") if keep_completed else F.lit(False)
    use = F.coalesce(F.col("updated") & ~hold, F.lit(False))
    changed = {"status": F.when(use, F.col("new_status")).otherwise(F.col("status")), "error": F.when(use, F.col("new_error")).otherwise(F.col("error"))}
    changed |= {f: F.when(use, F.coalesce(f"new_{f}", f)).otherwise(F.col(f)) for f in ("media_sha256", "library_path") if f"new_{f}" in updates.columns}
    done = items.join(good, "source_id", "left").withColumns(changed).select(*items.columns)
    reason = F.when(F.col("new_status") == "completed", "needs_acceptance").otherwise("bad_status")
    refused = updates.where(~F.coalesce(allowed, F.lit(False))).select("source_id", reason.alias("reason"))
    missing = good.join(items, "source_id", "left_anti").select("source_id", F.lit("unknown_item").alias("reason"))
    return done, refused.union(missing)


def status_counts(items: DataFrame) -> DataFrame:
    """status (null: all), items, collected."""
    collected = F.sum(F.col("currently_collected").cast("long")).alias("collected")
    return items.rollup("status").agg(F.count(F.lit(1)).alias("items"), collected)


def position_drift(observations: DataFrame) -> DataFrame:
    """Observations (source_id, at, position) that differ from the one before."""
    before = F.lag("position").over(Window.partitionBy("source_id").orderBy("at", "position"))
    return observations.withColumn("before", before).where("before IS NULL OR before <> position")


def project_state(items: DataFrame, projections: DataFrame) -> DataFrame:
    """source_id, state of stored projections (source_id, stored_state) that differ from what the registry says."""
    state = F.when(F.col("currently_collected"), "active").otherwise("uncollected")
    return items.join(projections, "source_id").select("source_id", state.alias("state"), "stored_state").where("NOT (state <=> stored_state)").select("source_id", "state")


def unchanged_except(before: DataFrame, after: DataFrame, key: str, target) -> DataFrame:
    """Rows other than the target's that are only before or only after (side)."""
    b, a = (df.where(~F.col(key).eqNullSafe(F.lit(target))) for df in (before, after))
    return b.exceptAll(a).withColumn("side", F.lit("before")).union(a.exceptAll(b).withColumn("side", F.lit("after")))
