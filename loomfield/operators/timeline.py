"""Transcripts, screen text and the timeline that joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.columns import format_time
from loomfield.operators.ranks import numbered

#: The languages that speech recognition handles well.
SPOKEN = ["zh", "yue"]
TRANSCRIPT = "struct<language:string,segments:array<struct<start:double,end:double,text:string,confidence:double,words:array<struct<start:double,end:double,text:string,confidence:double>>>>>"
SCREEN = "struct<frames:array<struct<keyframe_id:long,timestamp:double,file:string,lines:array<struct<text:string,confidence:double>>>>>"


def flatten_transcript(docs: DataFrame, col: str = "json") -> DataFrame:
    """job_id, segment_id, start_s, end_s, text, confidence, words of transcript documents; empty slots are dropped, and counted in ``dropped`` of each row.

    A document whose slots are all empty is one row without segment_id.
    """
    parsed = docs.select("job_id", F.from_json(col, TRANSCRIPT)["segments"].alias("all"))
    kept = F.filter(F.transform("all", lambda s, i: F.struct(i.cast("long").alias("i"), s.alias("s"))), lambda x: x["s"]["text"].isNotNull())
    rows = parsed.withColumn("kept", kept).select("job_id", (F.size("all") - F.size("kept")).alias("dropped"), F.explode_outer("kept").alias("x")).where("x IS NOT NULL OR dropped > 0")
    fields = [F.col("x.s.start").alias("start_s"), F.col("x.s.end").alias("end_s"), "x.s.text", "x.s.confidence", "x.s.words"]
    return rows.select("job_id", F.col("x.i").alias("segment_id"), *fields, "dropped")


def flatten_screen_text(docs: DataFrame, col: str = "json") -> DataFrame:
    """job_id, frame_id, t, file, line (from 1), text, confidence of screen-text documents."""
    frames = docs.select("job_id", F.explode(F.from_json(col, SCREEN)["frames"]).alias("f"))
    lines = frames.select("job_id", F.col("f.keyframe_id").alias("frame_id"), F.col("f.timestamp").alias("t"), "f.file", F.posexplode("f.lines").alias("i", "l"))
    return lines.select("job_id", "frame_id", "t", "file", (F.col("i") + 1).cast("long").alias("line"), "l.text", "l.confidence")


def document_lines(docs: DataFrame, key: str, col: str) -> DataFrame:
    """key, line_no (from 1), line of non-blank lines."""
    rows = docs.select(key, F.posexplode(F.split(col, "\n", -1)).alias("i", "line"))
    return rows.where("trim(line) <> ''").select(key, (F.col("i") + 1).cast("long").alias("line_no"), "line")


def segment_confidence(words: DataFrame) -> DataFrame:
    """job_id, segment_id, confidence: the mean over words (job_id, segment_id, confidence), null if none has one."""
    return words.groupBy("job_id", "segment_id").agg(F.round(F.avg("confidence"), 6).alias("confidence"))


def array_confidence(words: Column) -> Column:
    """The same of an array of words."""
    known = F.filter(F.transform(words, lambda w: w["confidence"]), lambda c: c.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, c: a + c)
    return F.when(F.size(known) > 0, F.bround(total / F.size(known), 6))


def stitch_chunks(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """job_id, segment_id, start_s, end_s, text, and words if there, over all chunks of a job.

    segments: job_id, chunk, i, start_s, end_s, text, and words (an array of start,
    end, text, confidence); chunks: job_id, chunk, duration_s. A chunk starts where
    those before it end, and its words move with it; segments are numbered within
    their chunk, and chunks add what lies before them.
    """
    counts = segments.groupBy("job_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("job_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = chunks.join(counts, ["job_id", "chunk"], "left").select(
        "job_id", "chunk", F.coalesce(F.sum("duration_s").over(w), F.lit(0.0)).alias("offset"), F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(w), F.lit(0)).alias("before")
    )
    inside = segments.withColumn("k", F.row_number().over(Window.partitionBy("job_id", "chunk").orderBy("start_s", "i")) - 1)
    moved = lambda c: F.round(F.coalesce(c, F.lit(0.0)) + F.col("offset"), 3)
    words = [shift_words(F.col("words"), F.col("offset")).alias("words")] if "words" in segments.columns else []
    return inside.join(placed, ["job_id", "chunk"]).select(
        "job_id", (F.col("before") + F.col("k")).alias("segment_id"), moved("start_s").alias("start_s"), moved("end_s").alias("end_s"), "text", *words)


def combined_facts(chunks: DataFrame) -> DataFrame:
    """job_id, language_probability (the mean over chunks, unknown ones as 0), duration_s (the sum) of chunks (job_id, language_probability, duration_s)."""
    known = lambda c: F.coalesce(c, F.lit(0.0))
    return chunks.groupBy("job_id").agg(F.round(F.avg(known("language_probability")), 6).alias("language_probability"), F.round(F.sum(known("duration_s")), 3).alias("duration_s"))


def shift_words(words: Column, offset: Column) -> Column:
    """Words of a segment moved by its chunk's offset."""
    moved = lambda c: F.round(F.coalesce(c, F.lit(0.0)) + offset, 3)
    return F.transform(words, lambda w: F.struct(moved(w["start"]).alias("start"), moved(w["end"]).alias("end"), w["text"].alias("text"), w["confidence"].alias("confidence")))


def pending_chunks(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks that have no valid result yet."""
    return chunks.join(results.where("valid"), ["job_id", "chunk"], "left_anti")


def duration_check(df: DataFrame, low: float = 0.95, high: float = 1.05) -> DataFrame:
    """Adds ratio and in_range of reported_s to source_s."""
    ratio = F.col("reported_s") / F.nullif(F.col("source_s"), F.lit(0.0))
    return df.withColumns({"ratio": F.round(ratio, 6), "in_range": F.coalesce(ratio.between(low, high), F.lit(False))})


def speech_quality(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """job_id, low, quality of docs (job_id, has_audio, language, language_probability)."""
    low = segments.groupBy("job_id").agg(F.count_if(F.col("confidence") < 0.5).alias("low"))
    doubtful = ~F.col("language").isin(SPOKEN) | F.col("language").isNull() | F.col("language_probability").isNull() | (F.col("language_probability") < 0.7) | (F.col("low") > 0)
    quality = F.when(~F.col("has_audio"), "not_applicable").when(doubtful, "needs_review").otherwise("ok")
    joined = docs.join(low, "job_id", "left").withColumn("low", F.coalesce("low", F.lit(0)))
    return joined.select("job_id", "low", quality.alias("quality"))


def screen_quality(jobs: DataFrame, lines: DataFrame, threshold: float = 0.5) -> DataFrame:
    """job_id, lines, low, frames_with_text, quality of screen text."""
    per = lines.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("confidence") < threshold).alias("low"), F.count_distinct("frame_id").alias("frames_with_text")
    )
    joined = jobs.select("job_id").distinct().join(per, "job_id", "left").fillna(0, ["lines", "low", "frames_with_text"])
    return joined.withColumn("quality", F.when((F.col("lines") == 0) | (4 * F.col("low") > F.col("lines")), "needs_review").otherwise("ok"))


def timeline(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """job_id, i (from 1), t, source, text of both sources by time, source and text."""
    both = segments.select("job_id", F.col("start_s").alias("t"), F.lit("asr").alias("source"), "text").unionByName(
        lines.select("job_id", "t", F.lit("ocr").alias("source"), "text"))
    return numbered(both, ["job_id"], ["t", "source", "text"])


def near_segments(frames: DataFrame, segments: DataFrame, radius: float = 7.5, width: float | None = None) -> DataFrame:
    """Pairs of frames (job_id, frame_id, t) and segments that overlap t - radius to t + radius, ends included.

    With ``width`` the join also has a time bucket as an equal key: a segment
    goes to each bucket it touches and a frame to those of its reach, and a pair
    is kept in the first bucket that both have. Long jobs then spread over tasks.
    """
    f, s = frames.alias("f"), segments.alias("s")
    touch = (F.col("s.start_s") <= F.col("f.t") + radius) & (F.col("s.end_s") >= F.col("f.t") - radius)
    if width is None:
        return f.join(s, (F.col("f.job_id") == F.col("s.job_id")) & touch).select("f.job_id", "f.frame_id", "f.t", "s.segment_id", "s.start_s", "s.end_s", "s.text")
    bucket = lambda low, high: F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
    fb = frames.withColumn("bucket", bucket(F.col("t") - radius, F.col("t") + radius)).alias("f")
    sb = segments.withColumn("bucket", bucket(F.col("start_s"), F.greatest("start_s", "end_s"))).alias("s")
    first = F.greatest(F.floor((F.col("f.t") - radius) / width), F.floor(F.col("s.start_s") / width))
    on = (F.col("f.job_id") == F.col("s.job_id")) & (F.col("f.bucket") == F.col("s.bucket")) & touch & (F.col("f.bucket") == first)
    return fb.join(sb, on).select("f.job_id", "f.frame_id", "f.t", "s.segment_id", "s.start_s", "s.end_s", "s.text")


def frame_digest(frames: DataFrame, lines: DataFrame, segments: DataFrame, radius: float = 7.5, width: float | None = None) -> DataFrame:
    """job_id, frame_id, screen_text, speech, start_s, end_s: what is shown and said around each frame."""
    shown = lines.groupBy("job_id", "frame_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " / ").alias("screen_text"))
    said = near_segments(frames, segments, radius, width).groupBy("job_id", "frame_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_s", "segment_id", "text"))), lambda x: x["text"]), " ").alias("speech"),
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"),
    )
    keys = ["job_id", "frame_id"]
    return frames.select(*keys).join(shown, keys, "left").join(said, keys, "left")


def uncovered_segments(segments: DataFrame, frames: DataFrame, radius: float = 7.5, width: float | None = None) -> DataFrame:
    """Segments that are near no frame; ``width`` as in ``near_segments``."""
    keys = ["job_id", "segment_id"]
    return segments.join(near_segments(frames, segments, radius, width).select(*keys).distinct(), keys, "left_anti")


def overview(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """job_id, segments, segment_chars, lines, frames."""
    a = segments.groupBy("job_id").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("text")).alias("segment_chars"))
    b = lines.groupBy("job_id").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("frame_id").alias("frames"))
    return a.join(b, "job_id", "full_outer").fillna(0)


def render_tables(rows: DataFrame, title: str, empty: str = "(none)") -> DataFrame:
    """job_id, document: a table of rows (job_id, t, text; a null text makes no row) in order of time."""
    line = F.concat(F.lit("| "), format_time(F.col("t")), F.lit(" | "), F.replace("text", F.lit("|"), F.lit("\\|")), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct(F.col("t"), F.col("text"), line.alias("line"))))), lambda x: x["line"])
    body = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(empty))
    return rows.groupBy("job_id").agg(F.concat(F.lit(f"# {title}\n\n"), body, F.lit("\n")).alias("document"))
