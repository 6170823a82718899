"""Queries over snapshots, media and timelines (S, C, M, T), each with its SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from loomfield.functions.columns import format_time, parse_time
from loomfield.operators import media, snapshot, timeline
from loomfield.plans.fixtures import NOW, sql, view
from loomfield.sources import files, media_files
from loomfield.streaming import ingest, pages

CONVERSATION_WORDS = "SELECT conv_id AS job_id, turn AS segment_id, CAST(length(text) % 100 AS DOUBLE) / 100 AS confidence FROM conversations"
CHUNKS = "SELECT DISTINCT job_id, segment_id % 3 AS chunk, CAST(600 + job_id % 7 AS DOUBLE) AS duration_s, CASE WHEN segment_id % 3 < 2 THEN CAST(job_id % 10 AS DOUBLE) / 10 END AS language_probability FROM v_segments"
CHUNKED = "SELECT job_id, segment_id % 3 AS chunk, segment_id AS i, CASE WHEN segment_id % 4 > 0 THEN start_s END AS start_s, end_s, text FROM v_segments"
RESULTS = "SELECT job_id, segment_id % 3 AS chunk, confidence > 0.3 AS valid FROM v_segments"
SPEECH_DOCS = """SELECT job_id, job_id % 11 <> 0 AS has_audio, CASE job_id % 3 WHEN 0 THEN 'zh' WHEN 1 THEN 'yue' ELSE 'en' END AS language,
    CASE WHEN job_id % 7 = 0 THEN NULL ELSE CAST(job_id % 10 AS DOUBLE) / 10 END AS language_probability FROM v_segments WHERE segment_id =
        0"""
DURATIONS = "SELECT c_custkey AS job_id, CAST(c_custkey % 100 AS DOUBLE) AS source_s, CAST(c_custkey % 100 AS DOUBLE) * (0.9 + CAST(c_custkey % 20 AS DOUBLE) / 100) AS reported_s FROM customer"
RAW_ITEMS = """SELECT concat(' ', CAST(p_partkey AS STRING)) AS id, CASE WHEN p_partkey % 5 = 0 THEN '  ' ELSE concat(p_name, ' ') END AS
        title, p_brand AS author,
    p_partkey * 37 % 100000 AS duration_ms, p_size % 10 AS width, p_size % 7 AS height FROM part"""
VARIANT_ROWS = """SELECT l_orderkey AS item_id, l_linenumber AS width, CAST(l_quantity AS BIGINT) AS height, l_suppkey AS bitrate,
    concat(CASE WHEN l_partkey % 6 = 0 THEN 'http' ELSE 'https' END, '://v/', CAST(l_partkey AS STRING)) AS url FROM lineitem"""
MANIFESTS = """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 9 = 0 THEN 'v0' ELSE 'v1' END AS version, o_orderkey % 8 <> 0 AS
        reached_end, SHA(CAST(o_orderkey AS STRING)) AS source_sha256,
    CASE WHEN o_orderkey % 5 = 0 THEN array('ocr') ELSE array('asr', 'ocr', 'timeline') END AS artifacts FROM orders"""
HASHES_NOW = "SELECT o_orderkey AS job_id, SHA(CAST(o_orderkey + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS STRING)) AS observed_sha256 FROM orders WHERE o_orderkey % 4 <> 0"
ARRIVALS = """SELECT o_custkey % 97 AS snapshot_id,
    CAST(o_orderkey % 300 AS STRING) AS page_cursor,
    o_orderkey AS page_seq,
    CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_custkey % 2 AS STRING) ELSE 'n' END AS next_cursor,
    true AS has_more,
    array(CAST(o_custkey % 50 AS STRING), CAST(o_orderkey % 1000 AS STRING)) AS items"""
CHAINED = """SELECT CAST(o_custkey AS STRING) AS snapshot_id,
    o_orderkey AS page_seq,
    CAST(o_orderkey % 3 AS STRING) AS page_cursor,
    CAST(o_orderkey * 7 % 3 AS STRING) AS next_cursor,
    o_orderkey % 5 <> 0 AS has_more"""
NOTES = """SELECT page_id, html, CASE WHEN page_id % 13 = 2 THEN '_index' ELSE concat('c', CAST(page_id % 4 AS STRING)) END AS category,
        concat('f', CAST(page_id AS STRING)) AS folder,
    concat('---', chr(10), CASE WHEN page_id % 11 = 0 THEN ': [' ELSE concat('category: c', chr(10), CASE WHEN page_id % 3 = 0 THEN '' ELSE
        concat('title: T', CAST(page_id AS STRING), chr(10)) END,
        CASE WHEN page_id % 5 = 0 THEN 'more: 1' ELSE concat('tags: [', CASE WHEN page_id % 13 = 2 THEN '_index' ELSE concat('c',
        CAST(page_id % 4 AS STRING)) END, ', page]') END) END, chr(10), '---', chr(10), html) AS text FROM pages"""
REJECTS = "SELECT user_id AS job_id, event_type AS body, CASE WHEN value > 50 THEN event_type END AS code FROM events"

AUDITED = """SELECT source_id, job_id, alt_id, snapshot_id, last_position, CASE WHEN last_position % 97 = 5 THEN 'lost' ELSE status END AS
        status FROM v_items"""
VALID = "SELECT source_id FROM v_items WHERE last_position % 4 <> 1"

RESET = "s.source_id IS NOT NULL AND i.status = 'completed' AND (i.pipeline_version <> 'v1' OR (s.media_sha256 IS NOT NULL AND s.media_sha256 IS DISTINCT FROM i.media_sha256))"
MERGE = "v_items i FULL OUTER JOIN v_seen s ON i.source_id = s.source_id"


def _v(name):
    return lambda s, d: view(s, d, name)


def _q(statement):
    return lambda s, d: sql(s, d, statement)


items, seen, chain, segs, frames_seen = _v("v_items"), _v("v_seen"), _v("v_chain"), _v("v_segments"), _v("v_shown")
spoken, screen, observed = _v("v_spoken"), _v("v_screen"), _v("v_observed")


def _artifacts(s, d):
    return sql(s, d, "SELECT source_id FROM v_observed WHERE observed_sha256 IS NOT NULL")


def _needs(s, d):
    return snapshot.needs_processing(items(s, d), "v1", _artifacts(s, d))


def _updates(s, d):
    return sql(s, d, UPDATES)


UPDATES = """SELECT source_id, CASE k % 8 WHEN 0 THEN 'processing' WHEN 1 THEN 'analyzed' WHEN 2 THEN 'lost' WHEN 3 THEN 'completed' WHEN 4
        THEN 'downloaded' WHEN 5 THEN 'incomplete' WHEN 6 THEN 'failed' ELSE NULL END AS new_status,
    CASE WHEN k % 7 = 1 THEN 'late' END AS new_error, CASE WHEN k % 5 = 1 THEN 'm' END AS new_media_sha256 FROM v_src WHERE k % 3 = 0 OR k %
        30 = 1"""
LISTED = "SELECT o_custkey % 200 AS snapshot_id, CAST(o_orderkey AS STRING) AS source_id, o_orderkey * 7919 % 100003 AS position FROM orders WHERE o_orderkey % 7 <> 0"
SNAPSHOT_STATES = "SELECT DISTINCT o_custkey % 200 AS snapshot_id, CASE o_custkey % 200 % 4 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'failed' ELSE 'completed' END AS state FROM orders"
NEEDS = """SELECT i.*, currently_collected AND NOT (status = 'completed' AND pipeline_version = 'v1' AND o.source_id IS NOT NULL) AS needs
    FROM v_items i LEFT JOIN (SELECT source_id FROM v_observed WHERE observed_sha256 IS NOT NULL) o ON i.source_id = o.source_id"""


def _variants(s, d):
    rows = sql(s, d, VARIANT_ROWS)
    grouped = rows.groupBy("item_id").agg(F.collect_list(F.struct("width", "height", "bitrate", "url")).alias("variants"))
    return media.rank_variants(grouped.withColumn("plain_url", F.concat(F.lit("https://p/"), F.col("item_id").cast("string")))).select("item_id", F.array_join("urls", ",").alias("urls"))


def _dumped(s, d):
    """Items of pages that were dumped as JSON arrays and read again; every second slot is no object."""
    item = lambda n: F.struct(F.concat(F.col("page_id"), F.lit(f"/{n}")).alias("id"), (F.col("page_id") * 100 + n).alias("duration_ms"))
    slots = F.concat(F.lit("["), F.to_json(item(0)), F.lit(",null,"), F.to_json(item(2)), F.lit("]"))
    snapshot_ = F.concat(F.lit("d"), F.col("page_id") % 8)
    body = F.concat(
        F.lit('{"status_code":'), F.when(F.col("page_id") % 7 == 1, "4").otherwise("0"), F.lit(',"items":'), F.when(F.col("page_id") % 5 == 1, "null").otherwise(slots),
        F.lit(',"snapshot_id":"'), snapshot_, F.lit('","page_seq":'), F.col("page_id").cast("string"), F.lit("}"))
    rows = view(s, d, "pages").select((F.col("page_id") % 64).alias("part"), F.struct("page_id", body.alias("body")).alias("p"))
    path = files.shared_folder(s)
    arrays = rows.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("p.body")), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("part").text(path)
    items_ = files.page_items(files.read_pages(s, f"{path}/part=*"))
    return items_.select("snapshot_id", "seq", (F.col("pos") * 2).alias("pos"), "id", "duration_ms")


def _versions(s, d):
    """The second of two versions of a table."""
    path, orders = files.shared_folder(s), view(s, d, "orders").select("o_orderkey", "o_orderstatus")
    files.write_version(orders.where("o_orderkey % 3 = 1"), path)
    files.write_version(orders.where("o_orderkey % 3 <> 1"), path)
    return files.read_version(s, path)


def _ingested(s, d):
    """Pages that arrive as a stream: those stored, those that differ from them, and items with their positions."""
    path = files.shared_folder(s)
    ingest.ingest_pages_stream(_stream(s, d, "orders", ARRIVALS), path, f"{path}/state").awaitTermination()
    log = s.read.parquet(f"{path}/log").where("kind <> 'item'").select("kind", "snapshot_id", F.col("page_cursor").alias("name"), "page_seq", "next_cursor", F.lit(None).cast("long").alias("position"))
    items = s.read.parquet(f"{path}/items").select(F.lit("item"), "snapshot_id", "item_id", "page_seq", F.lit(None).cast("string"), "position")
    return log.union(items)


def _chained(s, d):
    """The outcome of each page of a stream, by the state of its snapshot's chain."""
    path = files.shared_folder(s)
    pages.chain_state_stream(_stream(s, d, "orders", CHAINED)).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(pages.CHAIN).parquet(f"{path}/out")


def _stream(s, d, name, statement):
    """A table as a stream; the pattern stands for a table that is one file as well as for a folder."""
    return s.readStream.schema(view(s, d, name).schema).parquet(f"{d}/{name}.parque[t]").selectExpr(*columns_of(statement))


def columns_of(statement):
    """The column expressions of a SELECT without FROM, one in each line."""
    return [line.strip().rstrip(",") for line in statement.removeprefix("SELECT").strip().splitlines()]


def _shaped(s, d):
    """Pages with a status and items; some are denied, lack their list, or hold what is no object."""
    item = F.struct(F.col("page_id").cast("string").alias("id"))
    items = F.when(F.col("page_id") % 5 != 1, F.array(item, F.when(F.col("page_id") % 3 != 0, item)))
    status = F.when(F.col("page_id") % 7 == 1, 4).when(F.col("page_id") % 2 == 0, 0)
    return view(s, d, "pages").select("page_id", status.alias("status_code"), items.alias("items"))


def _transcripts(s, d):
    """A JSON transcript of each conversation, with empty slots."""
    word = F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.lit("w").alias("text"), "confidence")
    segment = F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", "confidence", F.array(word).alias("words"))
    ordered = F.array_sort(F.collect_list(F.struct("segment_id", F.when(F.col("segment_id") % 5 != 4, segment).alias("s"))))
    slots = F.transform(F.transform(ordered, lambda x: F.coalesce(F.to_json(x["s"]), F.lit("null"))), lambda x: x)
    grouped = segs(s, d).groupBy("job_id").agg(slots.alias("slots"))
    return grouped.select("job_id", F.concat(F.lit('{"language":"en","segments":['), F.array_join("slots", ","), F.lit("]}")).alias("json"))


def _stitched(s, d):
    """Segments over all chunks, with the times of their one word, and what is known of the whole."""
    word = F.struct(F.col("end_s").alias("start"), F.lit(None).cast("double").alias("end"), F.lit("w").alias("text"), F.lit(None).cast("double").alias("confidence"))
    chunks = sql(s, d, CHUNKS)
    joined = timeline.stitch_chunks(sql(s, d, CHUNKED).withColumn("words", F.array(word)), chunks).join(timeline.combined_facts(chunks), "job_id")
    return joined.select("job_id", "segment_id", "start_s", "end_s", "text", F.col("words")[0]["start"].alias("word_start"), F.col("words")[0]["end"].alias("word_end"), "language_probability", "duration_s")


def _screens(s, d):
    """A JSON of the screen text of each conversation: frames of two lines."""
    lines = F.array(F.struct("text", "confidence"), F.struct(F.lit("second").alias("text"), F.lit(None).cast("double").alias("confidence")))
    frame = F.struct(F.col("frame_id").alias("keyframe_id"), F.col("t").alias("timestamp"), F.concat(F.lit("f"), F.col("frame_id")).alias("file"), lines.alias("lines"))
    return screen(s, d).groupBy("job_id").agg(F.to_json(F.struct(F.collect_list(frame).alias("frames"))).alias("json"))


def _contents(s, d):
    """Files made of documents: a container's leading bytes, for some a protection box or one that is none, and the text."""
    doc = F.col("doc_id")
    packets = ("47" + "00" * 187) * 2 + "47"
    heads = ["000000186674797069736F6D", "1A45DFA3", "464C56", "4F676753", packets]
    head = F.lit("")
    for n, h in enumerate(heads):
        head = F.when(doc % 7 == n, h).otherwise(head)
    boxes = F.when(doc % 5 == 1, "0000002070737368" + "01000000" + "AABBCCDD").when(doc % 5 == 2, "0000001F70737368" + "01000000" + "AABBCCDD").otherwise("")
    content = F.concat(F.unhex(F.concat(head, boxes)), F.coalesce("text", F.lit("")).cast("binary"))
    out = view(s, d, "documents").select("doc_id", content.alias("content")).withColumn("length", F.length("content").cast("long"))
    return out.withColumn("expected_length", F.when(doc % 9 == 8, F.col("length") + 1).when(doc % 2 == 0, F.col("length")))


#: The same files in SQL.
CONTENTS = """SELECT doc_id, unhex(CASE doc_id % 7 WHEN 0 THEN '000000186674797069736F6D' WHEN 1 THEN '1A45DFA3' WHEN 2 THEN '464C56' WHEN 3
        THEN '4F676753' WHEN 4 THEN repeat('47' || repeat('00', 187), 2) || '47' ELSE '' END || CASE doc_id % 5 WHEN 1 THEN
        '000000207073736801000000AABBCCDD' WHEN 2 THEN '0000001F7073736801000000AABBCCDD' ELSE '' END) || encode(coalesce(text, '')) AS
        content FROM documents"""


def _written_media(s, d, ending):
    """The folder of the files, written from rows of 1,000 bytes; a folder in it has 1,000 numbers."""
    root = files.shared_folder(s)
    cut = _contents(s, d).select(F.concat(F.expr("doc_id DIV 1000"), F.lit("/"), "doc_id", F.lit("."), F.expr(ending)).alias("name"), "content", F.explode(F.expr("sequence(0, length DIV 1000)")).alias("part"))
    media_files.write_files(cut.select("name", "part", F.expr("substring(content, part * 1000 + 1, 1000)").alias("content")), root, together=True)
    return root


def _facts_of_files(s, d):
    """What ranges of 300 bytes tell about the files."""
    facts = media.file_facts(media_files.read_ranges(s, _written_media(s, d, "'mp4'"), 300))
    return facts.withColumn("doc_id", media_files.named_as("media_path").cast("long"))


TESTS: dict = {
    "S-1": (
        lambda s, d: _dumped(s, d),
        """SELECT 'd' || page_id % 8 AS snapshot_id, page_id AS seq, n AS pos, page_id || '/' || n AS id, page_id * 100 + n AS duration_ms
        FROM pages, (VALUES (0), (2)) AS slots(n) WHERE page_id % 7 <> 1 AND page_id % 5 <> 1""",
    ),
    "S-10": (
        lambda s, d: _versions(s, d),
        "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 1",
    ),
    "S-2": (
        lambda s, d: files.classify_pages(_shaped(s, d)).select("page_id", "page_status", F.size("items").alias("items")),
        """SELECT page_id, CASE WHEN page_id % 7 = 1 THEN 'denied' WHEN page_id % 5 = 1 THEN 'invalid' ELSE 'ok' END AS page_status, CASE
        WHEN page_id % 5 <> 1 THEN CASE WHEN page_id % 3 = 0 THEN 1 ELSE 2 END END AS items FROM pages""",
    ),
    "S-4": (
        lambda s, d: media_files.scan_media(s, _written_media(s, d, f"CASE WHEN doc_id % 4 = 3 THEN 'txt' WHEN doc_id % 3 = 0 THEN 'MOV' ELSE 'mp4' END")).select(media_files.named_as("media_path").cast("long").alias("doc_id"), "size_bytes", "content_hash"),
        f"SELECT doc_id, octet_length(content) AS size_bytes, sha256(content) AS content_hash FROM ({CONTENTS}) c WHERE doc_id % 4 <> 3",
    ),
    "S-5": (
        lambda s, d: timeline.flatten_transcript(_transcripts(s, d)).select("job_id", "segment_id", "start_s", "end_s", "text", "confidence", F.size("words").alias("words"), "dropped"),
        """WITH t AS (SELECT * EXCLUDE (segment_id), segment_id % 5 <> 4 AND text IS NOT NULL AS good, row_number() OVER (PARTITION BY job_id ORDER BY segment_id) - 1 AS segment_id FROM v_segments),
        n AS (SELECT job_id, count(*) FILTER (NOT good) AS dropped, bool_or(good) AS has FROM t GROUP BY 1)
        SELECT job_id, segment_id, start_s, end_s, text, confidence, 1 AS words, dropped FROM t JOIN n USING (job_id) WHERE good
        UNION ALL SELECT job_id, NULL, NULL, NULL, NULL, NULL, NULL, dropped FROM n WHERE NOT has""",
    ),
    "S-6": (
        lambda s, d: timeline.flatten_screen_text(_screens(s, d)),
        """SELECT job_id, frame_id, t, 'f' || frame_id AS file, n AS line, CASE n WHEN 1 THEN text ELSE 'second' END AS text, CASE n WHEN 1
        THEN confidence END AS confidence FROM v_screen, (VALUES (1), (2)) AS lines(n)""",
    ),
    "S-8": (
        lambda s, d: files.split_front_matter(sql(s, d, NOTES)).select("page_id", F.col("front")["title"].alias("title"), F.col("front")["tags"].alias("tags"), "front_error", "body"),
        f"""SELECT page_id, CASE WHEN page_id % 3 <> 0 AND page_id % 11 <> 0 THEN 'T' || page_id END AS title, CASE WHEN page_id % 5 <> 0
        AND page_id % 11 <> 0 THEN '[' || chr(39) || category || chr(39) || ', ' || chr(39) || 'page' || chr(39) || ']' END AS tags,
        CASE WHEN page_id % 11 = 0 THEN 'malformed' END AS front_error, html AS body FROM ({NOTES}) n""",
    ),
    "S-3": (lambda s, d: snapshot.project_items(sql(s, d, RAW_ITEMS)), f"""SELECT nullif(trim(id), '') AS source_id, nullif(trim(title), '')
        AS title, nullif(trim(author), '') AS author,
        round(nullif(duration_ms, 0) / 1000.0, 3) AS duration_s, nullif(width, 0) AS width, nullif(height, 0) AS height FROM ({RAW_ITEMS})
        t"""),
    "S-7": (lambda s, d: timeline.document_lines(view(s, d, "documents"), "doc_id", "text"), """SELECT doc_id, i AS line_no, line FROM (
        SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM
        documents)) WHERE trim(line) <> ''"""),
    "S-9": (
        lambda s, d: files.entries_of(sql(s, d, NOTES)).select("category", "folder", "title", F.array_join("tags", ",").alias("tags")),
        f"""SELECT category, folder, 'T' || page_id AS title, category || ',page' AS tags FROM ({NOTES}) n WHERE category <> '_index' AND
        page_id % 3 <> 0 AND page_id % 5 <> 0 AND page_id % 11 <> 0""",
    ),
    "S-11": (lambda s, d: files.quarantine(sql(s, d, REJECTS), "code", "body")[1],
        f"SELECT job_id, SHA(body) AS sha256, min(code) AS code FROM ({REJECTS}) t WHERE code IS NOT NULL GROUP BY job_id, SHA(body)"),
    "S-12": (
        lambda s, d: _ingested(s, d),
        f"""WITH t AS ({ARRIVALS.replace("array(", "list_value(")} FROM orders), p AS (SELECT *, row_number() OVER w AS r, first_value(row(next_cursor, has_more)) OVER w AS first FROM t WINDOW w AS (PARTITION BY snapshot_id, page_cursor ORDER BY page_seq)),
        i AS (SELECT snapshot_id, item, page_seq, place, row_number() OVER (PARTITION BY snapshot_id, item ORDER BY page_seq, place) AS r FROM
            (SELECT snapshot_id, page_seq, unnest(items) AS item, unnest([0, 1]) AS place FROM p WHERE r = 1) q)
        SELECT CASE r WHEN 1 THEN 'page' ELSE 'conflict' END AS kind, snapshot_id, page_cursor AS name, page_seq, next_cursor, NULL::BIGINT AS position FROM p WHERE r = 1 OR row(next_cursor, has_more) <> first
        UNION ALL SELECT 'item', snapshot_id, item, page_seq, NULL, row_number() OVER (PARTITION BY snapshot_id ORDER BY page_seq, place) FROM i WHERE r = 1""",
    ),
    "S-13": (
        lambda s, d: _chained(s, d),
        f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY page_seq) AS i FROM ({CHAINED} FROM orders) t),
        p AS (SELECT DISTINCT snapshot_id, CAST(0 AS BIGINT) AS i, '' AS outcome, NULL::VARCHAR AS expected, NULL::BOOLEAN AS more FROM o
        UNION ALL
            SELECT snapshot_id, i, outcome, CASE WHEN outcome = 'accepted' THEN next_cursor ELSE expected END, CASE WHEN outcome =
        'accepted' THEN has_more ELSE more END FROM
            (SELECT o.*, p.expected, p.more, CASE WHEN p.more IS NULL THEN CASE WHEN page_cursor = '0' THEN 'accepted' ELSE 'bad_start' END
        WHEN NOT p.more THEN 'after_last_page' WHEN page_cursor = p.expected THEN 'accepted'
                ELSE 'discontinuity' END AS outcome FROM p JOIN o ON o.snapshot_id = p.snapshot_id AND o.i = p.i + 1) q)
        SELECT o.snapshot_id, page_seq, outcome FROM p JOIN o USING (snapshot_id, i)""",
    ),
    "C-1": (
        lambda s, d: snapshot.canonical_ids(sql(s, d, "SELECT source_id AS item, CASE WHEN k % 4 = 0 THEN ' ' ELSE source_id END AS first_id, CASE WHEN k % 8 = 0 THEN NULL ELSE concat(source_id, ' ') END AS second_id FROM v_src"), "first_id", "second_id").select("item", "id", "id_error"),
        """SELECT item, id, CASE WHEN id IS NULL THEN 'missing_id' END AS id_error FROM (SELECT source_id AS item,
        coalesce(nullif(trim(CASE WHEN k % 4 = 0 THEN ' ' ELSE source_id END), ''), nullif(trim(CASE WHEN k % 8 = 0 THEN NULL ELSE
        concat(source_id, ' ') END), '')) AS id FROM v_src) t""",
    ),
    "C-2": (
        lambda s, d: snapshot.stable_keys(sql(s, d, "SELECT source_id FROM v_src"), "source_id"),
        "SELECT source_id, concat('item-', substr(SHA(source_id), 1, 20)) AS job_id FROM v_src",
    ),
    "C-3": (lambda s, d: snapshot.validate_chain(chain(s, d)), """WITH m AS (SELECT *, lag(next_cursor) OVER w AS expected, lag(has_more)
        OVER w AS more, row_number() OVER w AS i, lead(page_seq) OVER w IS NULL AS last
            FROM v_chain WINDOW w AS (PARTITION BY snapshot_id ORDER BY page_seq)),
        c AS (SELECT snapshot_id, count(*) AS pages, count(DISTINCT page_cursor) AS cursors, min(CASE WHEN i = 1 AND page_cursor IS DISTINCT
        FROM '0' THEN '1_bad_start' WHEN i > 1 AND NOT more THEN '2_after_last_page'
            WHEN i > 1 AND page_cursor IS DISTINCT FROM expected THEN '3_discontinuity' WHEN has_more AND next_cursor = page_cursor THEN
        '4_not_advanced' WHEN last AND has_more THEN '6_incomplete' END) AS code FROM m GROUP BY snapshot_id)
        SELECT snapshot_id, pages, substr(least(code, CASE WHEN cursors < pages THEN '5_cursor_cycle' END, CASE WHEN pages > 10000 THEN
        '7_page_limit' END), 3) AS error FROM c"""),
    "C-4": (lambda s, d: snapshot.assign_positions(view(s, d, "v_page_items")), """SELECT snapshot_id, source_id, row_number() OVER
        (PARTITION BY snapshot_id ORDER BY seq, pos) AS position FROM (
        SELECT *, row_number() OVER (PARTITION BY snapshot_id, source_id ORDER BY seq, pos) AS r FROM v_page_items) t WHERE r = 1"""),
    "C-5": (lambda s, d: snapshot.page_conflicts(view(s, d, "v_replays")), """SELECT snapshot_id, page_cursor, count(*) AS deliveries,
        count(DISTINCT concat(next_cursor, CAST(has_more AS VARCHAR))) AS versions
        FROM v_replays GROUP BY 1, 2 HAVING count(DISTINCT concat(next_cursor, CAST(has_more AS VARCHAR))) > 1"""),
    "C-6": (
        lambda s, d: snapshot.snapshot_counts(view(s, d, "v_page_items")),
        "SELECT snapshot_id, count(*) AS item_count FROM v_page_items GROUP BY 1",
    ),
    "C-7": (
        lambda s, d: snapshot.reconcile(items(s, d), seen(s, d), view(s, d, "v_snapshots"), "s2", "v1", NOW),
        f"""SELECT coalesce(i.source_id, s.source_id) AS source_id, coalesce(s.alt_id, i.alt_id) AS alt_id,
        coalesce(job_id, concat('item-', substr(SHA(s.source_id), 1, 20))) AS job_id, coalesce(first_seen_at, TIMESTAMP '{NOW}') AS
        first_seen_at,
        CASE WHEN s.source_id IS NULL THEN last_seen_at ELSE TIMESTAMP '{NOW}' END AS last_seen_at, s.source_id IS NOT NULL AS
        currently_collected,
        CASE WHEN s.source_id IS NOT NULL THEN NULL WHEN currently_collected THEN coalesce(uncollected_at, TIMESTAMP '{NOW}') ELSE
        uncollected_at END AS uncollected_at,
        coalesce(s.position, last_position) AS last_position, CASE WHEN i.source_id IS NULL OR ({RESET}) THEN 'new' ELSE i.status END AS
        status,
        CASE WHEN s.source_id IS NOT NULL THEN 'v1' ELSE pipeline_version END AS pipeline_version, coalesce(s.media_sha256, i.media_sha256)
        AS media_sha256,
        CASE WHEN i.source_id IS NULL OR ({RESET}) THEN NULL ELSE error END AS error, coalesce(s.snapshot_id, i.snapshot_id) AS snapshot_id
        FROM {MERGE}""",
    ),
    "C-8": (lambda s, d: snapshot.diff(items(s, d), seen(s, d), "v1").groupBy("change").agg(F.count(F.lit(1)).alias("n")), f"""SELECT CASE
        WHEN i.source_id IS NULL THEN 'new' WHEN s.source_id IS NULL THEN CASE WHEN currently_collected THEN 'uncollected' ELSE 'gone' END
        WHEN {RESET} THEN 'reset' WHEN NOT currently_collected THEN 'recollected' ELSE 'kept' END AS change, count(*) AS n FROM {MERGE}
        GROUP BY 1"""),
    "C-9": (
        lambda s, d: snapshot.completed_only(sql(s, d, "SELECT CASE WHEN k % 2 = 0 THEN 's2' ELSE 's3' END AS snapshot_id, source_id FROM v_src"), view(s, d, "v_snapshots")),
        "SELECT 's2' AS snapshot_id, source_id FROM v_src WHERE k % 2 = 0",
    ),
    "C-10": (lambda s, d: snapshot.audit_registry(sql(s, d, AUDITED), view(s, d, "v_snapshots")), """SELECT 'bad_status' AS code, source_id
        AS key FROM v_items WHERE last_position % 97 = 5 UNION ALL SELECT 'repeated_job' AS code, job_id AS key FROM v_items GROUP BY job_id
        HAVING count(*) > 1
        UNION ALL SELECT 'repeated_alt', alt_id FROM v_items WHERE alt_id IS NOT NULL GROUP BY alt_id HAVING count(*) > 1
        UNION ALL SELECT 'repeated_position', concat(snapshot_id, '/', last_position) FROM v_items GROUP BY snapshot_id, last_position
        HAVING count(*) > 1
        UNION ALL SELECT 'unknown_snapshot', source_id FROM v_items WHERE snapshot_id NOT IN (SELECT snapshot_id FROM v_snapshots)"""),
    "C-11": (lambda s, d: _needs(s, d).select("source_id", "needs"), f"SELECT source_id, needs FROM ({NEEDS}) t"),
    "C-12": (lambda s, d: snapshot.next_items(_needs(s, d), sql(s, d, LISTED), sql(s, d, SNAPSHOT_STATES), 2), f"""SELECT snapshot_id, place, source_id, position FROM
        (SELECT l.*, row_number() OVER (PARTITION BY l.snapshot_id ORDER BY position, l.source_id) AS place FROM ({LISTED}) l JOIN ({NEEDS}) t ON l.source_id = t.source_id
        WHERE needs AND l.snapshot_id IN (SELECT snapshot_id FROM ({SNAPSHOT_STATES}) s WHERE state = 'completed')) q WHERE place <= 2"""),
    "C-13": (
        lambda s, d: snapshot.claim_decisions(items(s, d), observed(s, d).select("source_id", "observed_sha256"), sql(s, d, VALID), "v1"),
        f"""SELECT *, decision NOT IN ('not_collected', 'completed_current') AS process, CASE WHEN decision IN ('not_collected',
        'completed_current') THEN NULL
        WHEN decision IN ('media_missing', 'hash_changed', 'artifacts_invalid') THEN 'incomplete' WHEN decision = 'version_changed' THEN
        'new' ELSE 'processing' END AS new_status
        FROM (SELECT o.source_id, CASE WHEN NOT coalesce(currently_collected, false) THEN 'not_collected' WHEN pipeline_version <> 'v1' THEN
        'version_changed'
        WHEN status = 'completed' THEN CASE WHEN observed_sha256 IS NULL THEN 'media_missing' WHEN media_sha256 <> observed_sha256 THEN
        'hash_changed'
        WHEN a.source_id IS NULL THEN 'artifacts_invalid' ELSE 'completed_current' END WHEN status IN ('failed', 'incomplete') THEN 'retry'
        ELSE status END AS decision
        FROM v_observed o LEFT JOIN v_items i ON i.source_id = o.source_id LEFT JOIN ({VALID}) a ON a.source_id = o.source_id) t""",
    ),
    "C-14": (
        lambda s, d: snapshot.select_fixed(sql(s, d, "SELECT source_id FROM v_src WHERE k % 2 = 0"), items(s, d), seen(s, d)),
        """SELECT
        w.source_id, CASE WHEN i.source_id IS NULL THEN 'unknown' WHEN s.source_id IS NULL THEN 'not_in_snapshot'
        WHEN NOT currently_collected THEN 'not_collected' WHEN i.status = 'completed' THEN 'already_completed' ELSE 'ok' END AS reason
        FROM (SELECT source_id FROM v_src WHERE k % 2 = 0) w LEFT JOIN v_items i ON w.source_id = i.source_id LEFT JOIN v_seen s ON
        w.source_id = s.source_id""",
    ),
    "C-15": (lambda s, d: snapshot.identity_conflicts(items(s, d).drop("alt_id"), observed(s, d)), """SELECT * FROM (SELECT i.source_id,
        CASE WHEN o.alt_id <> i.source_id THEN 'alt_id' WHEN i.author <> o.author THEN 'author'
        WHEN media_sha256 <> observed_sha256 THEN 'hash' END AS conflict FROM v_items i JOIN v_observed o ON i.source_id = o.source_id) t
        WHERE conflict IS NOT NULL"""),
    "C-16": (
        lambda s, d: snapshot.apply_status(items(s, d), _updates(s, d))[0].select("source_id", "status", "error", "media_sha256"),
        f"""SELECT i.source_id, CASE WHEN use THEN new_status ELSE status END AS status, CASE WHEN use THEN new_error ELSE error END AS
        error,
        CASE WHEN use THEN coalesce(new_media_sha256, media_sha256) ELSE media_sha256 END AS media_sha256 FROM (SELECT i.*, u.* EXCLUDE
        (source_id), u.source_id IS NOT NULL AND status <> 'completed' AS use
        FROM v_items i LEFT JOIN (SELECT * FROM ({UPDATES}) t WHERE new_status IN ('new', 'processing', 'downloaded', 'analyzed', 'failed',
        'incomplete')) u ON i.source_id = u.source_id) i""",
    ),
    "C-17": (
        lambda s, d: snapshot.status_counts(items(s, d)),
        "SELECT status, count(*) AS items, CAST(sum(CAST(currently_collected AS INT)) AS BIGINT) AS collected FROM v_items GROUP BY ROLLUP(status)",
    ),
    "C-18": (
        lambda s, d: snapshot.position_drift(sql(s, d, "SELECT user_id AS source_id, event_id AS at, CAST(value AS INT) % 3 AS position FROM events")),
        """SELECT
        * FROM (SELECT user_id AS source_id, event_id AS at, CAST(trunc(value) AS INT) % 3 AS position,
        lag(CAST(trunc(value) AS INT) % 3) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) t WHERE before IS NULL OR
        before <> position""",
    ),
    "C-19": (
        lambda s, d: snapshot.project_state(items(s, d), sql(s, d, "SELECT source_id, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 2 = 0 THEN 'active' ELSE 'uncollected' END AS stored_state FROM v_src")),
        """SELECT
        i.source_id, CASE WHEN currently_collected THEN 'active' ELSE 'uncollected' END AS state FROM v_items i
        JOIN (SELECT source_id, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 2 = 0 THEN 'active' ELSE 'uncollected' END AS stored_state FROM
        v_src) p ON i.source_id = p.source_id
        WHERE CASE WHEN currently_collected THEN 'active' ELSE 'uncollected' END IS DISTINCT FROM stored_state""",
    ),
    "C-20": (
        lambda s, d: snapshot.unchanged_except(sql(s, d, "SELECT source_id, status FROM v_src"), sql(s, d, "SELECT source_id, CASE WHEN k % 50 = 1 THEN 'moved' ELSE status END AS status FROM v_src WHERE k % 70 <> 2"), "source_id", "1"),
        """
        SELECT source_id, status, 'before' AS side FROM (SELECT source_id, status FROM v_src WHERE source_id <> '1' EXCEPT ALL SELECT
        source_id, CASE WHEN k % 50 = 1 THEN 'moved' ELSE status END FROM v_src WHERE k % 70 <> 2) a
        UNION ALL SELECT source_id, status, 'after' FROM (SELECT source_id, CASE WHEN k % 50 = 1 THEN 'moved' ELSE status END AS status FROM
        v_src WHERE k % 70 <> 2 AND source_id <> '1' EXCEPT ALL SELECT source_id, status FROM v_src) b""",
    ),
    "M-1": (lambda s, d: media.inventory_diff(view(s, d, "v_inv_prev"), view(s, d, "v_inv_scan")), """SELECT coalesce(p.media_path,
        s.media_path) AS media_path, change, CASE WHEN change IN ('inserted', 'updated') THEN 'new' WHEN change = 'missing' THEN 'missing'
        ELSE p.status END AS status,
        coalesce(s.content_hash, p.content_hash) AS content_hash FROM (SELECT p, s, CASE WHEN p.media_path IS NULL THEN 'inserted' WHEN
        s.media_path IS NULL THEN 'missing' WHEN p.size_bytes IS NOT DISTINCT FROM s.size_bytes
        AND p.modified_ns IS NOT DISTINCT FROM s.modified_ns AND p.content_hash IS NOT DISTINCT FROM s.content_hash THEN 'unchanged' ELSE
        'updated' END AS change
        FROM v_inv_prev p FULL OUTER JOIN v_inv_scan s ON p.media_path = s.media_path) t"""),
    "M-2": (lambda s, d: media.inventory_status(view(s, d, "v_inv_prev")), "SELECT status, count(*) AS files FROM v_inv_prev GROUP BY 1"),
    "M-3": (
        lambda s, d: media.media_kind(_contents(s, d)).select("doc_id", "kind"),
        "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'iso-bmff' WHEN 1 THEN 'ebml' WHEN 2 THEN 'flv' WHEN 3 THEN 'ogg' WHEN 4 THEN 'mpeg-ts' END AS kind FROM documents",
    ),
    "M-4": (
        lambda s, d: _facts_of_files(s, d).select("doc_id", "protected"),
        "SELECT doc_id, doc_id % 5 = 1 AS protected FROM documents",
    ),
    "M-7": (
        lambda s, d: media.media_outcome(media.protected_media(media.media_kind(_contents(s, d))), 4000).select("doc_id", "outcome"),
        """SELECT doc_id, CASE WHEN length > 4000 THEN 'too_large' WHEN doc_id % 9 = 8 THEN 'length_mismatch' WHEN doc_id % 5 = 1 THEN
        'protected' WHEN doc_id % 7 >= 5 THEN 'bad_signature' WHEN doc_id % 7 > 0 THEN 'unsupported_container' ELSE 'ok' END AS outcome
        FROM (SELECT doc_id, strlen(coalesce(text, '')) + CASE doc_id % 7 WHEN 4 THEN 377 WHEN 2 THEN 3 WHEN 0 THEN 12 WHEN 1 THEN 4 WHEN 3
        THEN 4 ELSE 0 END + CASE doc_id % 5 WHEN 1 THEN 16 WHEN 2 THEN 16 ELSE 0 END AS length FROM documents) t""",
    ),
    "M-5": (_variants, f"""WITH r AS ({VARIANT_ROWS}), o AS (SELECT item_id, url, least(width, height) AS a, width * height AS b, bitrate
        FROM r WHERE width > 0 AND height > 0 AND starts_with(url, 'https://')),
        f AS (SELECT item_id, url, row_number() OVER (PARTITION BY item_id ORDER BY a DESC, b DESC, bitrate DESC, url) AS n FROM o), g AS
        (SELECT item_id, url, min(n) AS n FROM f GROUP BY 1, 2),
        h AS (SELECT item_id, string_agg(url, ',' ORDER BY n) AS u FROM g GROUP BY 1)
        SELECT i.item_id, concat_ws(',', u, 'https://p/' || CAST(i.item_id AS VARCHAR)) AS urls FROM (SELECT DISTINCT item_id FROM r) i LEFT
        JOIN h ON i.item_id = h.item_id"""),
    "M-6": (
        lambda s, d: media.allowed_urls(view(s, d, "pages").select("page_id", "url"), ["example.com", "example.org"]).select("page_id", "allowed"),
        """SELECT
        page_id, coalesce(regexp_matches(url, '^https://([a-z0-9.-]+[.])?example[.](com|org)(:443)?([/?#]|$)'), false) AS allowed FROM
        pages""",
    ),
    "M-8": (
        lambda s, d: media.tree_digest(view(s, d, "v_artifacts")),
        "SELECT bundle, count(*) AS files, SHA(string_agg(rel_path || ':' || sha256, chr(10) ORDER BY rel_path || ':' || sha256)) AS digest FROM v_artifacts GROUP BY 1",
    ),
    "M-9": (lambda s, d: media.verify_inventory(view(s, d, "v_artifacts"), view(s, d, "v_artifacts_now")), """SELECT * FROM (SELECT
        coalesce(e.bundle, a.bundle) AS bundle, coalesce(e.rel_path, a.rel_path) AS rel_path, CASE WHEN a.rel_path IS NULL THEN 'missing'
        WHEN e.rel_path IS NULL THEN 'unexpected'
        WHEN e.size <> a.size THEN 'size' WHEN e.sha256 <> a.sha256 THEN 'sha256' END AS problem FROM v_artifacts e FULL OUTER JOIN
        v_artifacts_now a ON e.bundle = a.bundle AND e.rel_path = a.rel_path) t WHERE problem IS NOT NULL"""),
    "M-10": (lambda s, d: media.analysis_current(sql(s, d, MANIFESTS), sql(s, d, HASHES_NOW), "v1", ["asr", "ocr"]), f"""SELECT m.job_id,
        coalesce(version = 'v1' AND reached_end AND source_sha256 = observed_sha256 AND list_contains(artifacts, 'asr') AND
        list_contains(artifacts, 'ocr'), false) AS current
        FROM ({MANIFESTS.replace('array(', 'list_value(')}) m LEFT JOIN ({HASHES_NOW}) h ON m.job_id = h.job_id"""),
    "M-11": (lambda s, d: media.hash_drift(view(s, d, "v_inv_prev"), view(s, d, "v_inv_scan"), "media_path", "content_hash"), """SELECT
        coalesce(p.media_path, s.media_path) AS media_path, p.content_hash AS before, s.content_hash AS after
        FROM v_inv_prev p FULL OUTER JOIN v_inv_scan s ON p.media_path = s.media_path WHERE p.content_hash IS DISTINCT FROM
        s.content_hash"""),
    "T-1": (
        lambda s, d: timeline.segment_confidence(sql(s, d, CONVERSATION_WORDS)),
        f"SELECT job_id, segment_id, round(avg(confidence), 6) AS confidence FROM ({CONVERSATION_WORDS}) t GROUP BY 1, 2",
    ),
    "T-2": (lambda s, d: _stitched(s, d), f"""WITH c AS (SELECT job_id, chunk,
        coalesce(sum(duration_s) OVER (PARTITION BY job_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM
        ({CHUNKS}) t), f AS (SELECT job_id, round(sum(coalesce(language_probability, 0)) / count(*), 6) AS language_probability, round(sum(duration_s), 3) AS duration_s FROM ({CHUNKS}) t GROUP BY 1)
        SELECT g.job_id, row_number() OVER (PARTITION BY g.job_id ORDER BY g.chunk, start_s NULLS FIRST, i) - 1 AS segment_id, round(coalesce(start_s, 0) + o, 3) AS
        start_s, round(end_s + o, 3) AS end_s, text, round(end_s + o, 3) AS word_start, round(o, 3) AS word_end, language_probability, duration_s FROM ({CHUNKED}) g JOIN c ON g.job_id = c.job_id AND g.chunk = c.chunk JOIN f ON g.job_id = f.job_id"""),
    "T-3": (
        lambda s, d: timeline.pending_chunks(sql(s, d, CHUNKS), sql(s, d, RESULTS)),
        f"SELECT c.* FROM ({CHUNKS}) c WHERE NOT EXISTS (SELECT 1 FROM ({RESULTS}) r WHERE r.valid AND r.job_id = c.job_id AND r.chunk = c.chunk)",
    ),
    "T-4": (lambda s, d: timeline.duration_check(sql(s, d, DURATIONS)), f"""SELECT job_id, source_s, reported_s, round(reported_s /
        nullif(source_s, 0), 6) AS ratio, coalesce(reported_s / nullif(source_s, 0) BETWEEN 0.95 AND 1.05, false) AS in_range FROM
        ({DURATIONS}) t"""),
    "T-5": (lambda s, d: timeline.speech_quality(sql(s, d, SPEECH_DOCS), segs(s, d)), f"""SELECT t.job_id, coalesce(low, 0) AS low, CASE
        WHEN NOT has_audio THEN 'not_applicable' WHEN language NOT IN ('zh', 'yue') OR language_probability IS NULL OR language_probability
        < 0.7 OR low > 0 THEN 'needs_review' ELSE 'ok' END AS quality
        FROM ({SPEECH_DOCS}) t LEFT JOIN (SELECT job_id, count(*) FILTER (confidence < 0.5) AS low FROM v_segments GROUP BY 1) l ON t.job_id
        = l.job_id"""),
    "T-6": (lambda s, d: timeline.screen_quality(segs(s, d), screen(s, d)), """SELECT *, CASE WHEN lines = 0 OR 4 * low > lines THEN
        'needs_review' ELSE 'ok' END AS quality FROM (SELECT j.job_id, count(s.job_id) AS lines, count(*) FILTER (s.confidence < 0.5) AS
        low,
        count(DISTINCT s.frame_id) AS frames_with_text FROM (SELECT DISTINCT job_id FROM v_segments) j LEFT JOIN v_screen s ON j.job_id =
        s.job_id GROUP BY 1) t"""),
    "T-7": (lambda s, d: timeline.timeline(spoken(s, d), frames_seen(s, d)), """SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t,
        source, text) AS i FROM (SELECT job_id, start_s AS t, 'asr' AS source, text FROM v_spoken
        UNION ALL SELECT job_id, t, 'ocr', text FROM v_shown) u"""),
    "T-8": (
        lambda s, d: timeline.near_segments(frames_seen(s, d), spoken(s, d), 3600, width=14400).select("job_id", "frame_id", "segment_id"),
        """SELECT
        f.job_id, frame_id, segment_id FROM v_shown f JOIN v_spoken s
        ON f.job_id = s.job_id AND start_s <= f.t + 3600 AND end_s >= f.t - 3600""",
    ),
    "T-9": (lambda s, d: timeline.frame_digest(screen(s, d), screen(s, d), segs(s, d), width=60.0), """WITH sh AS (SELECT job_id, frame_id,
        string_agg(text, ' / ' ORDER BY line, text) AS screen_text FROM v_screen GROUP BY 1, 2),
        sa AS (SELECT f.job_id, f.frame_id, string_agg(s.text, ' ' ORDER BY start_s, segment_id) AS speech, min(start_s) AS start_s,
        max(end_s) AS end_s FROM v_screen f JOIN v_segments s ON f.job_id = s.job_id AND start_s <= f.t + 7.5 AND end_s >= f.t - 7.5 GROUP
        BY 1, 2)
        SELECT f.job_id, f.frame_id, screen_text, speech, sa.start_s, sa.end_s FROM v_screen f LEFT JOIN sh USING (job_id, frame_id) LEFT
        JOIN sa USING (job_id, frame_id)"""),
    "T-10": (
        lambda s, d: timeline.uncovered_segments(spoken(s, d), frames_seen(s, d), 3600, width=14400).select("job_id", "segment_id"),
        """SELECT
        job_id, segment_id FROM v_spoken s WHERE NOT EXISTS (SELECT 1 FROM v_shown f
        WHERE f.job_id = s.job_id AND s.start_s <= f.t + 3600 AND s.end_s >= f.t - 3600)""",
    ),
    "T-11": (lambda s, d: timeline.overview(segs(s, d), screen(s, d)), """SELECT job_id, coalesce(segments, 0) AS segments,
        coalesce(segment_chars, 0) AS segment_chars, coalesce(lines, 0) AS lines, coalesce(frames, 0) AS frames
        FROM (SELECT job_id, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS segment_chars FROM v_segments GROUP BY 1) a FULL
        OUTER JOIN (SELECT job_id, count(*) AS lines, count(DISTINCT frame_id) AS frames FROM v_screen GROUP BY 1) b USING (job_id)"""),
    "T-12": (
        lambda s, d: segs(s, d).select("job_id", "segment_id", format_time(F.col("start_s")).alias("shown")).withColumn("back", F.round(parse_time(F.col("shown")), 3)),
        """SELECT
        job_id, segment_id, shown, round(start_s, 3) AS back FROM (SELECT job_id, segment_id, start_s, ms,
        printf('%02d:%02d', ms // 60000, ms // 1000 % 60) || CASE WHEN ms % 1000 > 0 THEN printf('.%03d', ms % 1000) ELSE '' END AS shown
        FROM (SELECT *, CAST(round(start_s * 1000) AS BIGINT) AS ms FROM v_segments) a) t""",
    ),
    "T-13": (lambda s, d: timeline.render_tables(segs(s, d).select("job_id", F.col("start_s").alias("t"), "text"), "Transcript"), """WITH f
        AS (SELECT job_id, start_s AS t, text, CAST(round(start_s * 1000) AS BIGINT) AS ms FROM v_segments)
        SELECT job_id, '# Transcript' || chr(10) || chr(10) || string_agg('| ' || printf('%02d:%02d', ms // 60000, ms // 1000 % 60) || CASE
        WHEN ms % 1000 > 0 THEN printf('.%03d', ms % 1000) ELSE '' END || ' | ' || replace(text, '|', '\\|') || ' |', chr(10) ORDER BY t,
        text) || chr(10) AS document FROM f GROUP BY 1"""),
}
