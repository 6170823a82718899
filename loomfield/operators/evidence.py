"""Evidence: cleaning, fragments, unified records, byte budgets, coverage order, packets and digests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.columns import cleaned, cleaned_whole, format_time, line_key, one_line, redact
from loomfield.operators.ranks import numbered

#: Order of sources at equal times.
SOURCES = ["asr", "ocr", "timeline", "summary"]
#: A digit, or a word of two or more capitals, digits and hyphens.
FACT = r"(?U)\d|\b[A-Z][A-Z0-9-]{1,}\b"
#: In a packet: shares of the room for timeline records and for facts, and the sources of facts and of passages in order.
TIMELINE_SHARE, FACT_SHARE = 0.45, 0.30
FACT_SOURCES, PASSAGE_SOURCES = ["ocr", "summary", "asr"], ["summary", "asr", "ocr"]
CLASSES = ["timeline", "facts", "passages"]


def clean_records(df: DataFrame, limit: int = 800) -> DataFrame:
    """Records (text) cleaned; private and empty ones are dropped, cut ones flagged (truncated)."""
    out = df.withColumn("clean", cleaned_whole(F.col("text"))).where("clean IS NOT NULL")
    return out.withColumns({"truncated": F.length("clean") > limit, "text": F.trim(F.left("clean", F.lit(limit)))}).drop("clean")


def fragment(df: DataFrame, key: str, width: int = 600) -> DataFrame:
    """key, part (from 1 over kept windows), text, omitted: texts as one line, cut into windows of ``width`` characters, each cleaned.

    omitted counts the windows of the text that cleaning drops; a text that has no others is one row without part.
    """
    windows = F.regexp_extract_all(one_line(F.col("text")), F.lit(f"(?s).{{1,{width}}}"), 0)
    found = df.select(key, F.transform(windows, lambda w: cleaned(w)).alias("all")).withColumn("kept", F.array_compact("all"))
    rows = found.select(key, (F.size("all") - F.size("kept")).alias("omitted"), F.posexplode_outer("kept").alias("i", "text"))
    return rows.where("text IS NOT NULL OR omitted > 0").select(key, (F.col("i") + 1).cast("long").alias("part"), "text", "omitted")


def dedup_lines(lines: DataFrame, key: str) -> DataFrame:
    """Lines (key, line_no, line) of which no earlier one of the document reads alike."""
    marked = lines.withColumn("k", line_key(F.col("line"))).where("k <> ''")
    first = marked.groupBy(key, "k").agg(F.min(F.struct("line_no", "line")).alias("m"))
    return first.select(key, "m.line_no", "m.line")


def evidence_records(asr: DataFrame, ocr: DataFrame, timeline: DataFrame, summary: DataFrame) -> DataFrame:
    """One table of all sources, ordered within a job by time (none: last), source and line (column i, from 1)."""
    parts = [df.withColumn("source", F.lit(s)) for s, df in zip(SOURCES, (asr, ocr, timeline, summary), strict=True)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    return numbered(both, ["job_id"], [F.coalesce("t", F.lit(float("inf"))), rank, F.coalesce("line", F.lit(0)), "text"])


def evidence_counts(records: DataFrame, omitted: DataFrame) -> DataFrame:
    """job_id, records of each source, omitted (job_id, omitted) summed."""
    counts = records.groupBy("job_id").pivot("source", SOURCES).count().fillna(0)
    dropped = omitted.groupBy("job_id").agg(F.sum("omitted").alias("omitted"))
    return counts.join(dropped, "job_id", "full_outer").fillna(0)


def _in_order(rows: DataFrame, keys: list[str], step, schema: str) -> DataFrame:
    """Rows of each job dealt together, sorted by keys, and passed through a task that keeps what ``step`` needs of one job at a time.

    They are dealt by a hash of the job: dealing by the job itself is left out after a
    join on it, and where that join turns into a broadcast while it runs, nothing
    keeps a job in one task.
    """
    return rows.repartition(F.xxhash64("job_id")).sortWithinPartitions("job_id", *keys).mapInArrow(step, schema)


def pack_chunks(records: DataFrame, max_bytes: int, columns: Sequence[str] = ("line", "source", "t", "text")) -> DataFrame:
    """job_id, chunk (from 1), chunks, first, last, records, bytes, sha256, error: records in order, next-fit by encoded size.

    A chunk is the compact JSON of job_ref, chunk_index, chunk_count and its
    records, with a line end; while chunks are filled, the count is taken to be
    the number of records. A record that does not fit alone is a chunk of its own
    with error ``oversize``. Jobs stream through their task in order, so a job of
    any length needs no room there.
    """
    rows = records.select("job_id", "i", F.to_json(F.struct(*[c for c in columns if c in records.columns])).alias("record"))
    total = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("most"))
    bare = F.octet_length(_chunk("job_id", F.lit(""), F.col("most"), F.lit("")))  # all but the digits of the index
    sized = rows.join(total, "job_id").select("job_id", "i", "record", bare.cast("long").alias("bare"), F.octet_length("record").cast("long").alias("n"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, chunk, used = None, 0, 0
        for b in batches:
            out = []
            for this, bare_, n in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if this != job or not chunk:
                    job, chunk, used = this, 1, bare_ + 1 + n
                elif used + 1 + n <= max_bytes:
                    used += 1 + n
                else:
                    chunk += 1
                    used = bare_ + len(str(chunk)) + n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.int64())], ["job_id", "i", "record", "chunk"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    placed = _in_order(sized, ["i"], place, f"job_id {kinds['job_id']}, i {kinds['i']}, record string, chunk long")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "record"))), lambda x: x["record"]), ",")
    chunks = placed.groupBy("job_id", "chunk").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("records"), body.alias("body"))
    chunks = chunks.withColumn("chunks", F.count(F.lit(1)).over(Window.partitionBy("job_id")))
    chunks = chunks.withColumn("body", _chunk("job_id", F.col("chunk"), F.col("chunks"), F.col("body"))).withColumn("bytes", F.octet_length("body").cast("long"))
    return chunks.select("job_id", "chunk", "chunks", "first", "last", "records", "bytes", F.sha2("body", 256).alias("sha256"), F.when(F.col("bytes") > max_bytes, "oversize").alias("error"))


def _chunk(job: str, index: Column, count: Column, body: Column) -> Column:
    """The text of a chunk."""
    return F.concat(F.lit('{"job_ref":"'), F.col(job).cast("string"), F.lit('","chunk_index":'), index.cast("string"), F.lit(',"chunk_count":'), count.cast("string"), F.lit(',"records":['), body, F.lit("]}\n"))


def coverage_order(records: DataFrame) -> DataFrame:
    """Adds visit (from 0): the place of each record (job_id, i) in coverage order, which depends on the count alone.

    A record finds the level at which halving the job's range meets its place, and
    where that range began; visits follow levels, and places within them.
    """
    counted = numbered(records, ["job_id"], ["i"], "place", "n").withColumn("place", F.col("place") - 1)

    def halve(s: Column, k: Column) -> Column:
        middle = F.floor((s["a"] + s["b"]) / 2)
        met, left = middle == F.col("place"), F.col("place") < middle
        narrowed = F.struct(
            F.when(met | left, s["a"]).otherwise(middle).alias("a"), F.when(left, middle).otherwise(s["b"]).alias("b"), F.when(met, k).alias("level"))
        return F.when(s["level"].isNotNull(), s).otherwise(narrowed)

    start = F.struct(F.lit(0).cast("long").alias("a"), (F.col("n") - 1).alias("b"), F.lit(None).cast("int").alias("level"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(62)), start, halve)
    level = F.when(F.col("place") == 0, -1).when(F.col("place") == F.col("n") - 1, 0).otherwise(F.col("found.level"))
    marked = counted.withColumn("found", found).withColumns({"level": level, "begin": F.col("found.a")})
    visited = numbered(marked.drop("place", "n", "found"), ["job_id"], ["level", "begin"], "visit")
    return visited.withColumn("visit", F.col("visit") - 1).drop("level", "begin")


def fact_records(records: DataFrame) -> DataFrame:
    """Records with a digit or a word in capitals."""
    return records.where(F.regexp_like("text", F.lit(FACT)))


class Room:
    """What a packet has taken of the rows that are offered in order of class and place.

    Timeline records take up to 45 % of the room and facts up to 30 %; passages that
    were not taken before get the rest. A row that does not fit is passed over and
    the next is tried.
    """

    def __init__(self, max_bytes: int):
        self.max_bytes, self.used, self.texts, self.for_facts = max_bytes, 0, set(), None

    def takes(self, kind: str, text: str, n: int) -> bool:
        if kind == "facts" and self.for_facts is None:
            self.for_facts = min(self.max_bytes, self.used + int(self.max_bytes * FACT_SHARE))
        limit = {"timeline": int(self.max_bytes * TIMELINE_SHARE), "facts": self.for_facts}.get(kind, self.max_bytes)
        if self.used + n > limit or (kind == "passages" and text in self.texts):
            return False
        self.used += n
        self.texts.add(text)
        return True


def evidence_classes(records: DataFrame) -> DataFrame:
    """job_id, class, place, i, source, text of records (job_id, i, source, text): the lists that a packet is filled from.

    Records that read alike count once in each list, where they stand first: the
    timeline in coverage order; facts of screen, summary and speech; passages of
    summary, speech and screen.
    """
    keyed = records.withColumn("k", line_key(F.col("text"))).where("k <> ''").select("job_id", "i", "source", "text", "k")

    def unlike(sources: list[str]) -> DataFrame:
        rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
        first = keyed.where(rank > 0).groupBy("job_id", "k").agg(F.min(F.struct(rank.alias("rank"), "i", "source", "text")).alias("m"))
        return first.select("job_id", "m.*")

    marks = coverage_order(unlike(["timeline"])).select("job_id", F.lit("timeline").alias("class"), F.struct(F.lit(0).cast("long").alias("rank"), F.col("visit").alias("at")).alias("place"), "i", "source", "text")
    for name, sources in zip(CLASSES[1:], (FACT_SOURCES, PASSAGE_SOURCES), strict=True):
        rows = unlike(sources)
        rows = fact_records(rows) if name == "facts" else rows
        marks = marks.union(rows.select("job_id", F.lit(name), F.struct(F.col("rank").cast("long").alias("rank"), F.col("i").alias("at")), "i", "source", "text"))
    return marks


def select_evidence(records: DataFrame, max_bytes: int) -> DataFrame:
    """job_id, class, place, i, source, text of records (job_id, i, source, text) that fit into each job's packet.

    A text counts as its JSON string and a comma. Jobs stream through their task in
    order, which holds the texts taken so far: at most the budget.
    """
    lists = evidence_classes(records).withColumns({"n": F.octet_length(_quoted(F.col("text"))).cast("long") + 1, "turn": F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class"))})
    names = ["job_id", "class", "place", "i", "source", "text"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, room = None, None
        for b in batches:
            kept = []
            for this, kind, text, n in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("job_id", "class", "text", "n")], strict=True):
                if room is None or this != job:
                    job, room = this, Room(max_bytes)
                kept.append(room.takes(kind, text, n))
            yield b.filter(pa.array(kept, pa.bool_())).select(names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lists.select(*names).schema)
    return _in_order(lists, ["turn", "place"], pick, schema)


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def source_coverage(records: DataFrame, selected: DataFrame) -> DataFrame:
    """job_id, source, total, included, truncated, first_included, last_included."""
    marked = records.join(selected.select("job_id", "i", F.lit(True).alias("in")).distinct(), ["job_id", "i"], "left").withColumn("in", F.coalesce("in", F.lit(False)))
    return marked.groupBy("job_id", "source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("in").alias("included"), F.count_if("truncated").alias("truncated"),
        F.min_by("in", "i").alias("first_included"), F.max_by("in", "i").alias("last_included"))


def manifest_facts(manifests: DataFrame, fields: list[str]) -> DataFrame:
    """job_id, facts (map of the named top-level fields of a JSON manifest, cleaned; lists and objects as JSON)."""
    pairs = [x for f in fields for x in (F.lit(f), cleaned(F.get_json_object("json", f"$.{f}"), 200))]
    return manifests.select("job_id", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("facts"))


def build_packets(selected: DataFrame, coverage: DataFrame, facts: DataFrame, hashes: DataFrame, frames: DataFrame, max_bytes: int) -> DataFrame:
    """job_id, json, bytes, tokens, sha256: a deterministic packet of each job in ``facts``; error if it passes the budget.

    selected: job_id, class, place, text; coverage: job_id, source and what
    ``source_coverage`` counts; facts: job_id, facts (map); hashes: job_id, name,
    file, size_bytes, sha256; frames: job_id, frame_index, file, timestamp_s,
    size_bytes, sha256. Fields stand in alphabetical order, lists in theirs.
    """
    texts = lambda c: F.transform(F.array_sort(F.filter(F.coalesce("rows", F.array().cast(rows_type)), lambda r: r["class"] == c)), lambda r: r["text"])
    rows = selected.groupBy("job_id").agg(F.collect_list(F.struct("class", "place", "text")).alias("rows"))
    rows_type = rows.schema["rows"].dataType.simpleString()
    stats = ["first_included", "included", "last_included", "total", "truncated"]
    per = {
        "source_coverage": coverage.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("source", *stats))).alias("source_coverage")),
        "source_file_hashes": hashes.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("name", "file", "sha256", "size_bytes"))).alias("source_file_hashes")),
        "selected_keyframes": frames.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("frame_index", "file", "sha256", "size_bytes", "timestamp_s"))).alias("selected_keyframes")),
    }
    j = facts.select("job_id", F.col("facts").alias("manifest_facts")).join(rows, "job_id", "left")
    for df in per.values():
        j = j.join(df, "job_id", "left")
    lists = F.struct(texts("passages").alias("key_passages"), texts("facts").alias("numeric_and_proper_nouns"), texts("timeline").alias("timeline"))
    fields = [
        lists.alias("evidence"), F.col("job_id").cast("string").alias("job_ref"), F.struct(F.lit(max_bytes).alias("max_bytes")).alias("limits"), F.map_from_entries(F.array_sort(F.map_entries("manifest_facts"))).alias("manifest_facts"),
        F.lit(1).alias("schema_version"), "selected_keyframes", "source_coverage", "source_file_hashes"]
    packet = j.select("job_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))
    size = F.octet_length("json")
    return packet.select("job_id", "json", size.alias("bytes"), F.ceil(F.length("json") / 4).alias("tokens"), F.sha2("json", 256).alias("sha256"), F.when(size > max_bytes, "over_budget").alias("error"))


def bundle_manifest(chunks: DataFrame, frames: DataFrame) -> DataFrame:
    """job_id, chunks (list), chunk_count, records, frame_ids, complete."""
    a = chunks.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "sha256", "bytes"))).alias("chunks"), F.count(F.lit(1)).alias("chunk_count"),
        F.sum("records").alias("records"), F.bool_and(F.col("error").isNull()).alias("complete"))
    b = frames.groupBy("job_id").agg(F.array_sort(F.collect_set("frame_id")).alias("frame_ids"))
    return a.join(b, "job_id", "left").withColumn("complete", F.col("complete") & F.col("frame_ids").isNotNull())


def redacted(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, redact(F.col(col)))


def extractive_digest(segments: DataFrame) -> DataFrame:
    """job_id, short (140), long (600), leads (first 5 texts), timed (first 8), numeric (first 5 with a digit).

    A longer text ends in an ellipsis within its limit. Only what can count is
    gathered: the first rows of a job, by their places, and the first characters of each.
    """
    rows = segments.select("job_id", "start_s", "segment_id", "text")
    order, most = ["start_s", "segment_id", "text"], 600
    first = numbered(rows, ["job_id"], order).where(F.col("i") <= most).withColumn("text", F.when(F.col("i") > 8, F.left("text", F.lit(most + 1))).otherwise(F.col("text")))
    with_digit = numbered(rows.where(F.regexp_like("text", F.lit("[0-9]"))), ["job_id"], order).where("i <= 5")
    ordered = first.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("i", "start_s", "text"))).alias("a"))
    digits = with_digit.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("numeric"))
    joined = F.array_join(F.transform("a", lambda x: x["text"]), " ")
    cut = lambda n: F.when(F.length("joined") > n, F.concat(F.regexp_replace(F.left("joined", F.lit(n - 1)), r"(?U)\s+$", ""), F.lit("…"))).otherwise(F.col("joined"))
    out = ordered.withColumn("joined", joined).join(digits, "job_id", "left")
    return out.select(
        "job_id", cut(140).alias("short"), cut(600).alias("long"), F.transform(F.slice("a", 1, 5), lambda x: x["text"]).alias("leads"),
        F.transform(F.slice("a", 1, 8), lambda x: F.concat(format_time(x["start_s"]), F.lit(" "), x["text"])).alias("timed"),
        F.coalesce("numeric", F.array().cast("array<string>")).alias("numeric"))


def read_progress(required: DataFrame, reads: DataFrame) -> DataFrame:
    """job_id, required, read, missing (list): which required handles were read."""
    done = reads.select("job_id", "handle", F.lit(True).alias("r")).distinct()
    joined = required.select("job_id", "handle").distinct().join(done, ["job_id", "handle"], "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("r").isNull(), F.col("handle"))))
    return joined.groupBy("job_id").agg(F.count(F.lit(1)).alias("required"), F.count("r").alias("read"), missing.alias("missing"))
