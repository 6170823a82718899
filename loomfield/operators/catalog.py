"""The catalog of published entries, names, and migration of older libraries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.columns import NAME_CHARS, first_failure, fold, safe_component
from loomfield.operators.ranks import numbered

SOURCES = ["manifest", "checkpoint", "registry", "fingerprint"]
#: Characters of a name that its number may take.
NUMBER_CHARS = 12


def index_all(entries: DataFrame) -> DataFrame:
    """Entries ordered by category and title (a range-partitioned sort)."""
    return entries.orderBy("category", "title", "entry_ref")


def index_by_category(entries: DataFrame) -> DataFrame:
    """category, place (from 1), title, entry_ref: the entries of each category by title."""
    return numbered(entries.select("category", "title", "entry_ref"), ["category"], ["title", "entry_ref"], "place")


def index_by_tag(entries: DataFrame) -> DataFrame:
    """tag, place (from 1), entry_ref: the entries (entry_ref, tags) of each tag, each once."""
    tagged = entries.select("entry_ref", F.explode("tags").alias("tag")).distinct()
    return numbered(tagged.select("tag", "entry_ref"), ["tag"], ["entry_ref"], "place")


def recent(entries: DataFrame, k: int = 50) -> DataFrame:
    return entries.orderBy(F.desc("added_at"), "entry_ref").limit(k)


def normalize_tags(entries: DataFrame) -> DataFrame:
    """entry_ref, tags, error: tags as safe names, the first spelling of each, in order; unsafe_tag if one is refused, tags_required if there is none."""
    rows = entries.select("entry_ref", F.posexplode_outer("tags").alias("i", "tag")).withColumn("name", safe_component(F.coalesce("tag", F.lit(""))))
    first = rows.groupBy("entry_ref", fold(F.col("name")).alias("k")).agg(F.min(F.struct("i", "name")).alias("m"))
    per = first.groupBy("entry_ref").agg(F.array_sort(F.collect_list("m")).alias("m"))
    error = first_failure((F.forall("m", lambda m: m["i"].isNull()), "tags_required"), (F.exists("m", lambda m: m["name"].isNull()), "unsafe_tag"))
    return per.select("entry_ref", F.when(error.isNull(), F.transform("m", lambda m: m["name"])).alias("tags"), error.alias("error"))


def assign_names(entries: DataFrame, registered: DataFrame) -> DataFrame:
    """job_id, category, name without collisions, within 80 characters.

    A job keeps its registered name. Of new jobs whose cut stems are equal the first
    takes the stem itself if no name of the category is that; the others take the
    smallest numbers from (2) on that no name of the category has. Stems are cut
    further to make room for the number, and lose trailing spaces, dots and hyphens.
    entries: job_id, category, stem; registered: job_id, category, name.
    """
    end = r"[ .-]+$"
    plain = F.regexp_replace(F.left("stem", F.lit(NAME_CHARS)), end, "")
    fresh = entries.join(registered.select("job_id"), "job_id", "left_anti").withColumn("name", plain)
    taken = registered.select("category", "name").distinct()
    won = fresh.groupBy("category", "name").agg(F.min("job_id").alias("job_id")).join(taken, ["category", "name"], "left_anti").select("job_id", "category", "name")
    # stems that are equal once there is room for a number are numbered together
    key = F.regexp_replace(F.left("stem", F.lit(NAME_CHARS - NUMBER_CHARS)), end, "")
    lost = fresh.join(won.select("job_id"), "job_id", "left_anti").withColumn("key", key)
    lost = numbered(lost, ["category", "key"], ["job_id"], "r")
    counted = r"^(.*) \(([0-9]{1,9})\)$"
    names = taken.union(won.select("category", "name")).select("category", F.regexp_extract("name", counted, 1).alias("stem"), F.regexp_extract("name", counted, 2).try_cast("int").alias("n"))
    held = numbered(names.where("n >= 2").select("category", key.alias("key"), "n").distinct(), ["category", "key"], ["n"], "m")
    held = held.select("category", "key", (F.col("n") - 1 - F.col("m")).alias("r"))
    line = lost.select("category", "key", "r", F.lit(0).alias("held"), "job_id", "stem").unionByName(held.withColumn("held", F.lit(1)), allowMissingColumns=True)
    # a loser's place among losers and held numbers, less its place among losers, is how many held numbers come before
    placed = numbered(line, ["category", "key"], ["r", "held"], "at").where("held = 0").withColumn("n", F.col("at") + 1)
    placed = placed.withColumn("suffix", F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(")")))
    name = F.concat(F.regexp_replace(F.expr(f"left(stem, {NAME_CHARS} - length(suffix))"), end, ""), F.col("suffix"))
    kept = registered.join(entries.select("job_id"), "job_id", "left_semi").select("job_id", "category", "name")
    return placed.select("job_id", "category", name.alias("name")).union(won).union(kept)


def verify_entries(entries: DataFrame, artifacts: DataFrame, required: Sequence[str], frames: tuple[int, int] = (3, 8)) -> DataFrame:
    """entry_ref, problem: artifacts (entry_ref, rel_path, sha256, expected_sha256) missing or changed, or too few or many frames."""
    per = artifacts.groupBy("entry_ref").agg(
        F.size(F.array_except(F.array(*map(F.lit, required)), F.collect_set("rel_path"))).alias("missing"),
        F.count_if(~F.col("sha256").eqNullSafe(F.col("expected_sha256"))).alias("changed"), F.count_if(F.col("rel_path").startswith("frames/")).alias("frames"))
    problem = first_failure(
        (F.col("missing").isNull() | (F.col("missing") > 0), "missing_artifact"), (F.col("changed") > 0, "digest_mismatch"), (~F.col("frames").between(*frames), "frame_count"))
    return entries.select("entry_ref").join(per, "entry_ref", "left").select("entry_ref", F.coalesce(problem, F.lit("ok")).alias("problem"))


def inspect_legacy(artifacts: DataFrame, required: Sequence[str], repairable: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Issues (entry_ref, issue) of each missing artifact, and state counts: complete, repairable, blocked."""
    per = artifacts.groupBy("entry_ref").agg(F.array_except(F.array(*map(F.lit, required)), F.collect_set("rel_path")).alias("missing"))
    issues = per.select("entry_ref", F.explode("missing").alias("issue"))
    fixable = F.size(F.array_except("missing", F.array(*map(F.lit, repairable)))) == 0
    state = F.when(F.size("missing") == 0, "complete").when(fixable, "repairable").otherwise("blocked")
    return issues, per.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("entries"))


def resolve_entry_refs(entries: DataFrame, by_source: dict[str, DataFrame]) -> DataFrame:
    """entry_ref, job_id, source: by manifest, checkpoint, registry (entry_ref, job_id) or unique media hash (media_sha256, job_id)."""
    out = entries
    for s in SOURCES:
        key = "media_sha256" if s == "fingerprint" else "entry_ref"
        unique = by_source[s].groupBy(key).agg(F.count_distinct("job_id").alias("n"), F.min("job_id").alias(f"job_{s}")).where("n = 1").drop("n")
        out = out.join(unique, key, "left")
    source = F.coalesce(*[F.when(F.col(f"job_{s}").isNotNull(), F.lit(s)) for s in SOURCES], F.lit("blocked"))
    return out.select("entry_ref", F.coalesce(*[F.col(f"job_{s}") for s in SOURCES]).alias("job_id"), source.alias("source"))


def authoritative_sources(refs: DataFrame) -> DataFrame:
    """entry_ref, source_ref, verdict of refs (entry_ref, source_ref, kind): the one non-fingerprint source, else conflict."""
    strong = F.count_if(F.col("kind") != "fingerprint").over(Window.partitionBy("entry_ref"))
    alone = F.count(F.lit(1)).over(Window.partitionBy("entry_ref"))
    verdict = (
        F.when((F.col("strong") == 1) & (F.col("kind") != "fingerprint"), "authoritative").when(F.col("strong") == 1, "skipped")
        .when((F.col("strong") == 0) & (F.col("alone") == 1), "authoritative").otherwise("conflict"))
    return refs.withColumns({"strong": strong, "alone": alone}).select("entry_ref", "source_ref", verdict.alias("verdict"))


def migration_plan(sources: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """entry_ref, action of sources (entry_ref, source_sha256) against a checkpoint (entry_ref, source_sha256, target_sha256, observed_sha256)."""
    s, c = sources.alias("s"), checkpoint.alias("c")
    action = (
        F.when(F.col("c.entry_ref").isNull(), "new").when(F.col("s.entry_ref").isNull(), "source_missing").when(F.col("s.source_sha256") != F.col("c.source_sha256"), "source_changed")
        .when(~F.col("target_sha256").eqNullSafe(F.col("observed_sha256")), "target_differs").otherwise("reuse"))
    return s.join(c, F.col("s.entry_ref") == F.col("c.entry_ref"), "full_outer").select(F.coalesce("s.entry_ref", "c.entry_ref").alias("entry_ref"), action.alias("action"))


def migration_ready(sources: DataFrame, checkpoint: DataFrame, registry: DataFrame) -> DataFrame:
    """entries, unmatched, off_target, unbound, ready: whether checkpoint, targets and registry (entry_ref, target_sha256) agree."""
    plan = migration_plan(sources, checkpoint).join(registry.select("entry_ref", F.lit(True).alias("bound")).distinct(), "entry_ref", "left")
    return plan.agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("action").isin("new", "source_missing", "source_changed")).alias("unmatched"),
        F.count_if(F.col("action") == "target_differs").alias("off_target"), F.count_if(F.col("bound").isNull()).alias("unbound"),
        F.bool_and((F.col("action") == "reuse") & F.col("bound").isNotNull()).alias("ready"))


def rebind_targets(items: DataFrame, moves: DataFrame) -> DataFrame:
    """job_id, library_path, outcome of moves (job_id, from_path, to_path): moved, already, mismatch or unknown_job."""
    i = items.select("job_id", "library_path", F.lit(True).alias("known"))
    outcome = (
        F.when(F.col("known").isNull(), "unknown_job").when(F.col("library_path").eqNullSafe(F.col("to_path")), "already")
        .when(F.col("library_path").eqNullSafe(F.col("from_path")), "moved").otherwise("mismatch"))
    return moves.join(i, "job_id", "left").select("job_id", F.when(outcome == "moved", F.col("to_path")).otherwise(F.col("library_path")).alias("library_path"), outcome.alias("outcome"))


def checkpoint_violations(checkpoint: DataFrame) -> DataFrame:
    """entry_ref, code of checkpoint rows (entry_ref, target_path, sha256): repeated target, unsafe path, bad digest."""
    twice = checkpoint.groupBy("target_path").agg(F.count(F.lit(1)).alias("times"))
    unsafe = F.col("target_path").startswith("/") | F.regexp_like("target_path", F.lit(r"(^|/)\.\.(/|$)"))
    marks = F.array_compact(F.array(
        F.when(F.col("times") > 1, "repeated_target"), F.when(unsafe, "unsafe_path"), F.when(~F.regexp_like("sha256", F.lit("^[0-9a-f]{64}$")), "bad_digest")))
    return checkpoint.join(twice, "target_path").select("entry_ref", F.explode(marks).alias("code"))
