"""Content quality: rules over payload tables that return violations (job_id, code, path)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions.columns import DRAFT_WORDS, ID_WORDS, JOB_NAME, LINK, LONG_DIGITS, first_failure, one_line, parse_time, similarity_key

#: Names that say nothing, and states.
GENERIC_CATEGORIES = ["misc", "other", "unknown", "general", ""]
PLACEHOLDER_TAGS = ["tag", "todo", "none", "n/a"]
VERDICTS = ["confirmed", "rejected", "uncertain"]
REPORT_WORDS = r"(?i)\b(cookie|signature|request[_ -]?url)\b"
#: The fields of a candidate.
CANDIDATE_FIELDS = ["protocol_version", "schema_version", "job_ref", "packet_sha256", "content"]
#: A link with its label, a time, and a number, which stands apart from letters, digits and _.
INLINE_LINK = r"!?\[([^\]\n]+)\]\((?:[^()\n]|\([^()\n]*\))*\)"
TIME_CODE = r"(?U)(?<!\d)(?:\d{1,2}:)?\d{1,2}:\d{2}(?:\.\d+)?(?!\d)"
NUMBER = r"(?U)(?<![A-Za-z0-9_])\d+(?:\.\d+)?%?(?![A-Za-z0-9_])"
PRIVACY = [("link", LINK), ("secret_word", DRAFT_WORDS), ("id_word", ID_WORDS), ("job_name", JOB_NAME), ("long_digits", LONG_DIGITS)]


def _violations(df: DataFrame, *rules: tuple[Column, str, str]) -> DataFrame:
    """Rows (job_id, code, path) of each rule whose condition holds; null does not hold."""
    marks = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"))) for c, code, path in rules])
    return df.select("job_id", F.explode(F.array_compact(marks)).alias("v")).select("job_id", "v.code", "v.path")


def privacy_violations(df: DataFrame, col: str, patterns: Sequence[tuple[str, str]] = PRIVACY) -> DataFrame:
    return _violations(df, *[(F.regexp_like(col, F.lit(p)), code, col) for code, p in patterns])


def taxonomy_violations(df: DataFrame) -> DataFrame:
    """A category that is generic, fewer than two distinct tags, placeholder or blank tags (job_id, category, tags); tags count as one line each."""
    tags = F.transform("tags", lambda t: F.coalesce(one_line(t), F.lit("")))
    return _violations(
        df, (F.lower(F.trim("category")).isin(GENERIC_CATEGORIES) | F.col("category").isNull(), "generic_category", "category"),
        (F.size(F.array_distinct(tags)) < 2, "too_few_tags", "tags"),
        (F.exists(tags, lambda t: (t == "") | F.lower(t).isin(PLACEHOLDER_TAGS)), "placeholder_tag", "tags"))


def review_violations(df: DataFrame) -> DataFrame:
    """Unresolved and pending rows go together, and the status needs review just if rows are pending (job_id, unresolved_count, pending_count, review_status)."""
    unresolved, pending = F.col("unresolved_count") > 0, F.col("pending_count") > 0
    return _violations(
        df, (unresolved & ~pending, "unresolved_without_pending", "pending"), (~unresolved & pending, "pending_without_unresolved", "unresolved"),
        ((F.col("review_status") == "needs_review") != pending, "status_mismatch", "review_status"))


def review_row_violations(rows: DataFrame, verdicts: Sequence[str] = VERDICTS) -> DataFrame:
    """Review rows (job_id, claim, evidence, verdict) that are incomplete or of none of the verdicts."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return _violations(rows, (blank("claim") | blank("evidence"), "incomplete_row", "review"), (~F.col("verdict").isin(list(verdicts)) | F.col("verdict").isNull(), "bad_verdict", "review"))


def quality_link_violations(payloads: DataFrame, coverage: DataFrame) -> DataFrame:
    """Poor screen text forces a review (payloads: job_id, review_status; coverage: job_id, quality)."""
    joined = payloads.join(coverage, "job_id")
    return _violations(joined, ((F.col("quality") == "needs_review") & (F.col("review_status") != "needs_review"), "review_required", "review_status"))


def coverage_violations(df: DataFrame) -> DataFrame:
    """Topics (job_id, topic, covered, destination) that are empty or repeated once normalised, or covered just if not published."""
    keyed = df.withColumn("k", F.coalesce(similarity_key(F.col("topic")), F.lit("")))
    own = _violations(
        keyed, (F.col("k") == "", "empty_topic", "coverage"),
        (F.col("covered") != ~F.col("destination").eqNullSafe("not_published"), "destination_mismatch", "coverage"))
    repeated = keyed.where("k <> ''").groupBy("job_id", "k").count().where("count > 1")
    return own.union(repeated.select("job_id", F.lit("repeated_topic").alias("code"), F.lit("coverage").alias("path")).distinct())


def duplicate_units(units: DataFrame, least: int = 16) -> DataFrame:
    """job_id, k, times, sections of texts (job_id, section, text) of at least so many characters that a job has twice once normalised.

    Sections of a job are compared with each other and within themselves.
    """
    keyed = units.select("job_id", "section", similarity_key(F.col("text")).alias("k")).where(F.length("k") >= least)
    named = keyed.groupBy("job_id", F.xxhash64("k").alias("h"), "k").agg(F.count(F.lit(1)).alias("times"), F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"))
    return named.where("times > 1").select("job_id", "k", "times", "sections")


def timeline_coverage(points: DataFrame, durations: DataFrame) -> DataFrame:
    """job_id, first_ok, middle_ok, last_ok of points (job_id, t) against durations (job_id, duration_s); no row where no time is known."""
    j = points.join(durations.where("duration_s > 0"), "job_id")
    d = F.col("duration_s")
    return j.groupBy("job_id", "duration_s").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.bool_or(F.col("t").between(0.2 * d, 0.8 * d)).alias("middle_ok")).select(
        "job_id", (F.col("lo") <= F.greatest(F.lit(30.0), 0.15 * d)).alias("first_ok"), "middle_ok", (F.col("hi") >= 0.8 * d).alias("last_ok"))


def resolve_related(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """ref_id, title, entry_ref, code: references by title; only titles that are unique in the catalog resolve."""
    unique = catalog.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min("entry_ref").alias("entry_ref"))
    code = F.when(F.col("n").isNull(), "unknown_title").when(F.col("n") > 1, "ambiguous_title").otherwise("ok")
    joined = refs.join(unique, "title", "left")
    return joined.select("ref_id", "title", F.when(F.col("n") == 1, F.col("entry_ref")).alias("entry_ref"), code.alias("code"))


def visual_violations(refs: DataFrame, frames: DataFrame, steps: DataFrame) -> DataFrame:
    """Frame references (job_id, frame_id, step): unknown, repeated, or at an unknown step; and jobs that place some frames and not all."""
    f, s = frames.select("job_id", "frame_id", F.lit(True).alias("known")).distinct(), steps.select("job_id", "step", F.lit(True).alias("placed")).distinct()
    joined = refs.join(f, ["job_id", "frame_id"], "left").join(s, ["job_id", "step"], "left")
    own = _violations(
        joined, (F.col("known").isNull(), "unknown_frame", "visuals"), (F.col("step").isNotNull() & F.col("placed").isNull(), "unknown_step", "visuals"))
    twice = refs.groupBy("job_id", "frame_id").count().where("count > 1").select("job_id", F.lit("repeated_frame").alias("code"), F.lit("visuals").alias("path"))
    placed = refs.groupBy("job_id").agg(F.count("step").alias("placed"), F.count(F.lit(1)).alias("n")).where("placed > 0 AND placed < n")
    return own.union(twice).union(placed.select("job_id", F.lit("partly_placed").alias("code"), F.lit("visuals").alias("path")))


def section_violations(docs: DataFrame, headings: Sequence[str], least: int = 8, body: int = 600) -> DataFrame:
    """Sections missing or too short, a short body, no top heading that is the title (job_id, title, text)."""
    sections = [F.length(F.trim(F.regexp_extract("text", rf"(?ms)^## \Q{h}\E[ \t]*$(.*?)(?=^## |\z)", 1), F.lit(" \t\r\n"))) for h in headings]
    rules = [(n < least, "short_section", h) for n, h in zip(sections, headings, strict=True)]
    quoted = F.concat(F.lit(r"\Q"), F.replace("title", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    headed = F.regexp_like("text", F.concat(F.lit(r"(?m)^#\s+"), quoted, F.lit(r"\s*$")))
    return _violations(docs, *rules, (F.length("text") < body, "short_body", ""), (~headed, "title_mismatch", "title"))


def unreviewed_numbers(docs: DataFrame, reviewed: DataFrame, skipped: Sequence[str] = ("Timeline", "Visuals", "Related")) -> DataFrame:
    """job_id, numbers: numbers of documents (job_id, text) that the reviewed text (job_id, reviewed) does not contain.

    What the skipped sections say is left out wherever it stands; of links the label
    counts; times of day or of a video are no numbers.
    """
    text = F.col("text")
    for h in skipped:
        said = F.trim(F.regexp_extract("text", rf"(?ms)^## \Q{h}\E\s*$\n(.*?)(?=^## |\z)", 1), F.lit(" \t\r\n"))
        text = F.when(said != "", F.replace(text, said, F.lit(""))).otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, INLINE_LINK, "$1"), TIME_CODE, "")
    known = F.coalesce("reviewed", F.lit(""))
    numbers = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(NUMBER), 0)), lambda n: ~F.contains(known, n))
    return docs.join(reviewed, "job_id", "left").select("job_id", numbers.alias("numbers")).where("size(numbers) > 0")


def number_tokens(docs: DataFrame, key: str, col: str, reviewed: DataFrame) -> DataFrame:
    """key, token: whole-token numbers of a text that are not among the reviewed tokens (key, token)."""
    tokens = docs.select(key, F.explode(F.split(col, r"[ \n]+")).alias("token")).where(F.regexp_like("token", F.lit(r"^[0-9]+(\.[0-9]+)?$"))).distinct()
    return tokens.join(reviewed, [key, "token"], "left_anti")


def broken_links(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """ref_id, code of links (ref_id, target) that leave the root or lead nowhere."""
    outside = F.col("target").startswith("/") | F.regexp_like("target", F.lit(r"(^|/)\.\.(/|$)"))
    there = entries.select(F.col("path").alias("target"), F.lit(True).alias("there")).distinct()
    code = first_failure((outside, "outside_root"), (F.col("there").isNull(), "missing_target"))
    return refs.join(there, "target", "left").select("ref_id", code.alias("code")).where("code IS NOT NULL")


def draft_verdicts(jobs: DataFrame, violations: DataFrame, order: Sequence[str]) -> DataFrame:
    """job_id, verdict: the first failing code in the given order of gates, or ok."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("code"))
    first = violations.groupBy("job_id").agg(F.min_by("code", F.struct(F.when(place == 0, len(order) + 1).otherwise(place), "code")).alias("code"))
    return jobs.select("job_id").join(first, "job_id", "left").select("job_id", F.coalesce("code", F.lit("ok")).alias("verdict"))


#: The sections of a document with their headings, and texts for what is not there.
HEADINGS = {
    "about": "About", "one_sentence_summary": "In one sentence", "content_summary": "Summary", "core_points": "Core points", "argument_structure": "Steps", "cases_and_data": "Cases and data", "reviews": "Reviewed terms and numbers",
    "timeline_interpretation": "Timeline", "reusable_knowledge": "Reusable", "action_items": "Actions", "keywords": "Keywords", "related_knowledge": "Related", "visual_evidence": "Visuals", "pending_review": "Pending"}
ABOUT, NO_RELATED, NO_PENDING, PLACED = "Compiled from speech, screen text, timeline and frames, and checked.", "Nothing related so far.", "Nothing pending.", "Frames stand at their steps:"


def render_documents(payloads: DataFrame, headings: dict[str, str] = HEADINGS) -> DataFrame:
    """job_id, document: front matter, title and fourteen sections of each payload, in one projection.

    A payload has title, primary_category, tags, review_status, one_sentence_summary,
    the lists content_summary, core_points, reusable_knowledge, action_items,
    keywords, pending_review, and rows: argument_structure (step, claim, evidence),
    cases_and_data (claim, evidence), proper_noun_review (term, normalized, evidence,
    verdict), numeric_review (value, ...), timeline_interpretation (timestamp,
    explanation), related_knowledge (title, path, reason), visual_evidence (frame,
    argument_step, claim). Frames stand in the step that they belong to, and in an
    index. Front matter is YAML, its values in JSON, which is YAML too. Texts count as
    one line each; null lists and texts are empty.
    """
    line = lambda c: F.coalesce(one_line(c), F.lit(""))
    kinds = {f.name: f.dataType.simpleString() for f in payloads.schema}
    rows = lambda name: F.coalesce(F.col(name), F.array().cast(kinds[name]))
    joined = lambda name, f, by="\n": F.array_join(F.transform(rows(name), f), by)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else line(p) for p in parts])
    bullets = lambda name: joined(name, lambda x: text("- ", x))
    reviewed = lambda name, what, key: F.transform(rows(name), lambda r: text(f"- **{what} `", r[key], "`** → `", r["normalized"], "`: ", r["evidence"], " (", r["verdict"], ")"))

    def step(s: Column) -> Column:
        own = F.filter(rows("visual_evidence"), lambda v: v["argument_step"] == s["step"])
        shown = F.array_join(F.transform(own, lambda v: text("\n\n![", v["claim"], "](frames/", v["frame"], ")\n\n*", v["claim"], "*")), "")
        return F.concat(text("### ", s["claim"], "\n\n**Evidence**: ", s["evidence"]), shown)

    placed = F.forall(rows("visual_evidence"), lambda v: v["argument_step"].isNotNull())
    index = F.when(placed, F.concat(F.lit(PLACED + "\n\n"), joined("visual_evidence", lambda v: text("- **Step ", v["argument_step"].cast("string"), " / ", v["frame"], "**: ", v["claim"])))).otherwise(
        joined("visual_evidence", lambda v: text("- **", v["frame"], "**: ", v["claim"])))
    sections = {
        "about": F.lit(ABOUT), "one_sentence_summary": line(F.col("one_sentence_summary")), "content_summary": joined("content_summary", lambda x: text(x), "\n\n"), "core_points": bullets("core_points"),
        "argument_structure": joined("argument_structure", step, "\n\n"), "cases_and_data": joined("cases_and_data", lambda c: text("- **Claim**: ", c["claim"], "\n  - **Basis**: ", c["evidence"])),
        "reviews": F.array_join(F.concat(reviewed("proper_noun_review", "Term", "term"), reviewed("numeric_review", "Number", "value")), "\n"),
        "timeline_interpretation": joined("timeline_interpretation", lambda t: text("- **", t["timestamp"], "**: ", t["explanation"])), "reusable_knowledge": bullets("reusable_knowledge"), "action_items": bullets("action_items"),
        "keywords": joined("keywords", lambda x: text(x), ", "),
        "related_knowledge": F.when(F.size(rows("related_knowledge")) > 0, joined("related_knowledge", lambda r: text("- **[", r["title"], "](", r["path"], ")**: ", r["reason"]))).otherwise(F.lit(NO_RELATED)),
        "visual_evidence": index, "pending_review": F.when(F.size(rows("pending_review")) > 0, bullets("pending_review")).otherwise(F.lit(NO_PENDING))}
    keep = {"ignoreNullFields": "false"}
    whole = lambda value: F.to_json(F.struct(value.alias("x")), keep)
    quoted = lambda value: F.substr(whole(value), F.lit(6), F.length(whole(value)) - 6)
    facts = [("schema_version", F.lit("2")), *[(c, quoted(line(F.col(c)))) for c in ("title", "primary_category", "review_status")], ("tags", F.to_json(F.transform(rows("tags"), line)))]
    facts += [(c, F.to_json(rows(c), keep)) for c in ("proper_noun_review", "numeric_review", "related_knowledge", "visual_evidence", "pending_review")]
    front = F.concat(F.lit("---\n"), *[p for name, value in facts for p in (F.lit(f"{name}: "), value, F.lit("\n"))], F.lit("---\n\n"))
    body = [p for name, value in sections.items() for p in (F.lit(f"\n\n## {headings[name]}\n\n"), value)]
    return payloads.select("job_id", F.concat(front, F.lit("# "), line(F.col("title")), *body, F.lit("\n")).alias("document"))


def admit_candidates(cands: DataFrame, packets: DataFrame, current: DataFrame, reviews: DataFrame, fields: Sequence[str] = CANDIDATE_FIELDS, version: int = 1, schema_version: int = 2) -> DataFrame:
    """job_id, outcome of candidates against packets, the current candidate and its review.

    cands: job_id that was asked for, names of the candidate's fields, and its
    version, schema_version, job_ref, packet_sha256, candidate_sha256.
    """
    c = cands.join(packets.select("job_id", F.col("sha256").alias("packet_now")), "job_id", "left")
    c = c.join(current.select("job_id", F.col("candidate_sha256").alias("current_sha256"), F.col("packet_sha256").alias("current_packet")), "job_id", "left")
    c = c.join(reviews.select("job_id", "decision"), "job_id", "left")
    outcome = (
        F.when(F.col("packet_now").isNull(), "unknown_job").when(~F.array_sort("fields").eqNullSafe(F.array(*map(F.lit, sorted(fields)))), "bad_fields")
        .when(~F.col("version").eqNullSafe(F.lit(version)), "bad_version").when(~F.col("schema_version").eqNullSafe(F.lit(schema_version)), "bad_schema_version")
        .when(~F.col("job_ref").eqNullSafe(F.col("job_id")), "wrong_job").when(~F.col("packet_sha256").eqNullSafe(F.col("packet_now")), "stale_packet")
        .when(F.col("current_sha256").isNull(), "admitted").when(F.col("current_sha256") == F.col("candidate_sha256"), "reused")
        .when((F.col("current_packet") != F.col("packet_now")) | F.col("decision").eqNullSafe("reject"), "replaced").otherwise("conflict"))
    return c.select("job_id", outcome.alias("outcome"))


def current_candidates(cands: DataFrame, packets: DataFrame) -> DataFrame:
    """Candidates made for the packet that their job has now."""
    return cands.join(packets.select("job_id", F.col("sha256").alias("packet_sha256")), ["job_id", "packet_sha256"], "left_semi")


def repair_routes(rejections: DataFrame, repairable: DataFrame) -> DataFrame:
    """job_id, code, route: one repair of the content if the code allows it (repairable: code) and none was tried (repairs), else regenerate."""
    marked = rejections.join(repairable.select("code", F.lit(True).alias("may")).distinct(), "code", "left")
    route = F.when(F.col("may").isNotNull() & (F.col("repairs") == 0), "repair").otherwise("regenerate")
    return marked.select("job_id", "code", route.alias("route"))


def acceptance_matrix(items: DataFrame, media: DataFrame, manifests: DataFrame, notes: DataFrame, projections: DataFrame, sections: Sequence[str], mode: str = "high") -> DataFrame:
    """job_id, the nine checks, accepted (all of them) of items (job_id, media_sha256, status).

    media: job_id, sha256 of the file there is; manifests: job_id, source_sha256;
    notes: job_id, text, category, tags, mode; projections: job_id, text, of the
    notes published elsewhere. Each table has at most one row for a job.
    """
    j = (
        items.select("job_id", "media_sha256", "status").join(media.select("job_id", F.col("sha256").alias("found")), "job_id", "left")
        .join(manifests.select("job_id", "source_sha256"), "job_id", "left")
        .join(notes.select("job_id", F.col("text").alias("note"), "category", "tags", "mode"), "job_id", "left")
        .join(projections.select("job_id", F.col("text").alias("projected")), "job_id", "left"))
    note, tags = F.coalesce("note", F.lit("")), F.coalesce("tags", F.array().cast("array<string>"))
    both = F.concat(note, F.lit("\n"), F.coalesce("projected", F.lit("")))
    checks = {
        "source_hash": F.col("found") == F.col("media_sha256"),
        "manifest": F.col("source_sha256") == F.col("found"),
        "structured_note": F.forall(F.array(*map(F.lit, sections)), lambda s: F.contains(note, s)),
        "high_quality": F.col("mode") == mode,
        "real_classification": (F.coalesce("category", F.lit("")) != "") & ~F.lower("category").isin(GENERIC_CATEGORIES) & (F.size(tags) >= 2)
        & ~F.arrays_overlap(F.transform(tags, lambda t: F.lower(t)), F.array(*map(F.lit, PLACEHOLDER_TAGS))),
        "privacy": ~F.regexp_like(both, F.lit(REPORT_WORDS)) & ~F.regexp_like(both, F.lit(JOB_NAME)),
        "library": F.col("note").isNotNull(),
        "projection": F.col("projected").isNotNull(),
        "registry": F.col("status") == "completed",
    }
    flags = [F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()]
    return j.select("job_id", *flags).withColumn("accepted", F.forall(F.array(*checks), lambda c: c))


def timecodes(points: DataFrame) -> DataFrame:
    """Adds t of timecode texts (column code)."""
    return points.withColumn("t", parse_time(F.col("code")))
