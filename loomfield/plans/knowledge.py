"""Queries over evidence, frames, content quality, ledgers, work and the catalog (E, K, Q, L, W, B), each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.functions.columns import safe_component
from loomfield.operators import catalog, evidence, frames, ledger, quality, schema, selection, timeline, work
from loomfield.plans.fixtures import NOW, sql, view
from loomfield.sources import files


def _v(name):
    return lambda s, d: view(s, d, name)


segs, screen, entries, items = _v("v_segments"), _v("v_screen"), _v("v_entries"), _v("v_items")
sagas, targets, reviews, stage_events, payload = _v("v_sagas"), _v("v_targets"), _v("v_reviews"), _v("v_stage_events"), _v("v_payload")

#: The cleaning of a record in SQL; the documents have no words at whose edges the engines differ.
CLEAN = r"""regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '([A-Za-z]:\\|/(Users|home)/)\S+', '[private-path-removed]', 'g')"""
PRIVATE = r"""(regexp_matches({0}, '(?i)\b(cookie|session(id)?|signature|request[_ -]?url|authorization|chat(s|log)?|run\.log|registry)\b') OR regexp_matches({0}, '(?i)https?://\S+') OR regexp_matches({0}, '^[|:\-\s]+$'))"""
LINES = """SELECT doc_id, i AS line_no, line FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS line FROM (SELECT doc_id,
        string_split(text, chr(10)) AS a FROM documents)) WHERE trim(line) <> ''"""
EVIDENCE = """SELECT job_id, 'asr' AS source, start_s AS t, NULL AS line, text FROM v_segments UNION ALL SELECT job_id, 'ocr', t, line, text
        FROM v_screen
    UNION ALL SELECT job_id, 'timeline', end_s, NULL, role FROM v_segments UNION ALL SELECT job_id, 'summary', NULL, segment_id, text FROM
        v_segments WHERE role = 'assistant'"""
ORDERED = f"""SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY coalesce(t, 'inf'::DOUBLE), CASE source WHEN 'asr' THEN 1 WHEN 'ocr'
        THEN 2 WHEN 'timeline' THEN 3 ELSE 4 END, coalesce(line, 0), text) AS i FROM ({EVIDENCE}) e"""


def _evidence(s, d):
    asr = sql(s, d, "SELECT job_id, start_s AS t, text FROM v_segments")
    ocr = sql(s, d, "SELECT job_id, t, line, text FROM v_screen")
    marks = sql(s, d, "SELECT job_id, end_s AS t, role AS text FROM v_segments")
    summary = sql(s, d, "SELECT job_id, segment_id AS line, text FROM v_segments WHERE role = 'assistant'")
    return evidence.evidence_records(asr, ocr, marks, summary)


def _lines(s, d):
    return timeline.document_lines(view(s, d, "documents"), "doc_id", "text")


def _picked(s, d):
    return evidence.select_evidence(_evidence(s, d), 1500).select("job_id", "class", "i")


#: A record as JSON in SQL, its number, and the chunks: BYTES is the budget.
RECORD = """'{' || concat_ws(',', '"line":' || line, '"source":"' || source || '"', '"t":' || t, '"text":' || CAST(to_json(text) AS VARCHAR)) || '}'"""
BYTES = 4000
CHUNK = """'{"job_ref":"' || job_id || '","chunk_index":' || chunk || ',"chunk_count":' || %s || ',"records":[' || %s || ']}' || chr(10)"""
PACK = f"""WITH ordered AS ({ORDERED}), r AS (SELECT job_id, i, {RECORD} AS record, count(*) OVER (PARTITION BY job_id) AS most FROM
        ordered),
    s AS (SELECT *, strlen(record) AS n, strlen({(CHUNK % ("most", "''")).replace("|| chunk ||", "|| '' ||")}) AS bare FROM r),
    p AS (SELECT job_id, i, CAST(1 AS BIGINT) AS chunk, CAST(bare + 1 + n AS BIGINT) AS used FROM s WHERE i = 1 UNION ALL
        SELECT s.job_id, s.i, CASE WHEN p.used + 1 + s.n <= {BYTES} THEN p.chunk ELSE p.chunk + 1 END, CASE WHEN p.used + 1 + s.n <= {BYTES}
        THEN p.used + 1 + s.n ELSE bare + strlen(CAST(p.chunk + 1 AS VARCHAR)) + s.n END
        FROM p JOIN s ON s.job_id = p.job_id AND s.i = p.i + 1),
    g AS (SELECT p.job_id, p.chunk, min(p.i) AS first, max(p.i) AS last, count(*) AS records, string_agg(s.record, ',' ORDER BY s.i) AS body
        FROM p JOIN s USING (job_id, i) GROUP BY 1, 2),
    h AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS chunks FROM g), w AS (SELECT * REPLACE ({CHUNK % ("chunks", "body")} AS body)
        FROM h),
    b AS (SELECT * EXCLUDE (body), strlen(body) AS bytes, SHA(body) AS sha256 FROM w)
    SELECT *, CASE WHEN bytes > {BYTES} THEN 'oversize' END AS error FROM b"""

#: Coverage order in SQL: the ends, then the middles of the gaps, level by level.
VISITS = f"""WITH ordered AS ({ORDERED}), c AS (SELECT DISTINCT count(*) AS n FROM ordered GROUP BY job_id),
    gaps AS (SELECT n, CAST(0 AS BIGINT) AS a, n - 1 AS b, 1 AS level FROM c UNION ALL
        SELECT n, CASE side WHEN 0 THEN a ELSE (a + b) // 2 END, CASE side WHEN 0 THEN (a + b) // 2 ELSE b END, level + 1 FROM gaps, (VALUES
        (0), (1)) AS sides(side) WHERE b - a > 1),
    places AS (SELECT n, (a + b) // 2 AS place, level, a FROM gaps WHERE b - a > 1 UNION ALL SELECT n, 0, -1, 0 FROM c UNION ALL SELECT n, n
        - 1, 0, 0 FROM c WHERE n > 1),
    v AS (SELECT n, place, row_number() OVER (PARTITION BY n ORDER BY level, a) - 1 AS visit FROM places)
    SELECT job_id, i, visit FROM (SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM ordered) o JOIN v ON o.n = v.n AND o.i = v.place +
        1"""

#: What fits into packets of 1,500 bytes in SQL, row by row: the lists without repeats, the timeline in coverage order.
PICKED = rf"""WITH ordered AS ({ORDERED}), k AS (SELECT *, lower(replace(regexp_replace(text, '[\s|*_`#>-]+', '', 'g'), 'ß', 'ss')) AS k FROM ordered),
    m AS (SELECT job_id, i, text FROM (SELECT *, row_number() OVER (PARTITION BY job_id, k ORDER BY i) AS r FROM k WHERE k <> '' AND source = 'timeline') x WHERE r = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY i) - 1 AS place, count(*) OVER (PARTITION BY job_id) AS n FROM m),
    gaps AS (SELECT DISTINCT n, CAST(0 AS BIGINT) AS a, n - 1 AS b, 1 AS level FROM n UNION ALL
        SELECT n, CASE side WHEN 0 THEN a ELSE (a + b) // 2 END, CASE side WHEN 0 THEN (a + b) // 2 ELSE b END, level + 1 FROM gaps, (VALUES (0), (1)) AS sides(side) WHERE b - a > 1),
    v AS (SELECT n, (a + b) // 2 AS place, level, a FROM gaps WHERE b - a > 1 UNION ALL SELECT DISTINCT n, 0, -1, 0 FROM n UNION ALL SELECT DISTINCT n, n - 1, 0, 0 FROM n WHERE n > 1),
    f AS (SELECT class, rank, job_id, i, text FROM (SELECT *, row_number() OVER (PARTITION BY class, job_id, k ORDER BY rank, i) AS r FROM
        (SELECT k.*, class, CASE class WHEN 'facts' THEN list_position(['ocr', 'summary', 'asr'], source) ELSE list_position(['summary', 'asr', 'ocr'], source) END AS rank FROM k, (VALUES ('facts'), ('passages')) AS c(class) WHERE k <> '') x WHERE rank > 0) y
        WHERE r = 1 AND (class = 'passages' OR regexp_matches(text, '\p{{Nd}}|(^|[^\p{{L}}\p{{N}}_])[A-Z]([A-Z0-9-]*[A-Z0-9]($|[^\p{{L}}\p{{N}}_])|[A-Z0-9-]*-[\p{{L}}\p{{N}}_])'))),
    l AS (SELECT 'timeline' AS class, 1 AS turn, level AS x, a AS y, job_id, i, text FROM n JOIN v USING (n, place) UNION ALL SELECT class, CASE class WHEN 'facts' THEN 2 ELSE 3 END, rank, i, job_id, i, text FROM f),
    s AS (SELECT *, strlen(CAST(to_json(text) AS VARCHAR)) + 1 AS size, row_number() OVER (PARTITION BY job_id ORDER BY turn, x, y) AS q FROM l),
    p AS (SELECT job_id, CAST(0 AS BIGINT) AS q, CAST(0 AS BIGINT) AS used, NULL::BIGINT AS room, CAST([] AS VARCHAR[]) AS texts, false AS took FROM (SELECT DISTINCT job_id FROM s) j UNION ALL
        SELECT job_id, q, used + CASE WHEN took THEN size ELSE 0 END, room, CASE WHEN took THEN list_append(texts, text) ELSE texts END, took FROM
        (SELECT *, used + size <= CASE turn WHEN 1 THEN 675 WHEN 2 THEN room ELSE 1500 END AND NOT (turn = 3 AND list_contains(texts, text)) AS took FROM
            (SELECT s.job_id, s.q, s.turn, s.size, s.text, p.used, p.texts, CASE WHEN s.turn = 2 THEN coalesce(p.room, least(1500, p.used + 450)) ELSE p.room END AS room FROM p JOIN s ON p.job_id = s.job_id AND s.q = p.q + 1) a) b)
    SELECT job_id, class, i FROM s JOIN p USING (job_id, q) WHERE took"""

BITS = """SELECT job_id, frame_id, t, list_transform(vec, lambda x: x >= list_sum(vec) / len(vec)) AS b FROM v_frames"""


def _signed(s, d):
    return frames.with_signatures(view(s, d, "v_frames"))


def _scored(s, d):
    return frames.scene_scores(view(s, d, "v_frames"), scale=1.0)


def _selected(s, d):
    return sql(s, d, "SELECT job_id, t FROM v_frames WHERE frame_id % 3 = 0")


#: What the packets of E-12 hold: records by number and source, two files of each job, and frames.
LISTS = {"timeline": "source = 'timeline'", "facts": "source = 'ocr' AND i % 3 = 1", "passages": "source <> 'timeline' AND i % 3 = 2"}
HASHES = """SELECT DISTINCT job_id, name, concat(name, '.json') AS file, job_id % 1000 AS size_bytes, SHA(concat(name, CAST(job_id AS
        STRING))) AS sha256
    FROM v_segments, (VALUES ('ocr'), ('transcript')) AS files(name)"""
SHOWN = "SELECT DISTINCT job_id, frame_id AS frame_index, concat('f', CAST(frame_id AS STRING)) AS file, frame_id * 20 AS timestamp_s, frame_id % 7 AS size_bytes, SHA(CAST(frame_id AS STRING)) AS sha256 FROM v_screen"


def _listed(s, d):
    parts = [_evidence(s, d).where(w).select("job_id", F.lit(n).alias("class"), F.col("i").alias("place"), "text") for n, w in LISTS.items()]
    return parts[0].union(parts[1]).union(parts[2])


def _facts(s, d):
    pairs = [F.lit("engine"), F.concat(F.lit("e"), (F.col("job_id") % 3).cast("string")), F.lit("turns"), (F.col("job_id") % 5).cast("string")]
    return segs(s, d).select("job_id").distinct().select("job_id", F.create_map(*pairs).alias("facts"))


SCORED = """SELECT job_id, frame_id, t, CASE WHEN p IS NULL THEN 1.0 ELSE round(list_sum(list_transform(list_zip(vec, p), lambda z: abs(z[1]
        - z[2]))) / len(vec), 6) END AS scene_score
        FROM (SELECT *, lag(vec) OVER (PARTITION BY job_id ORDER BY t, frame_id) AS p FROM v_frames) t"""
#: How long videos are; of a third it is not known.
DURATIONS = "SELECT DISTINCT job_id, CASE WHEN job_id % 3 = 0 THEN 21.0D ELSE 0.4D END AS duration_s FROM v_frames WHERE job_id % 3 < 2"
#: The candidates and the even choice in SQL, frame by frame and target by target.
OBSERVED = f"SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t, frame_id) AS i, count(*) OVER (PARTITION BY job_id) AS n, least(15.0, greatest(0.2, CASE WHEN job_id % 3 = 0 THEN 21.0 WHEN job_id % 3 = 1 THEN 0.4 ELSE max(t) OVER (PARTITION BY job_id) END / 4)) AS step FROM ({SCORED}) q"
SAMPLED = f"""WITH o AS ({OBSERVED}), p AS (SELECT job_id, i, CASE WHEN t + step >= step THEN t ELSE -step END AS covered, true AS kept FROM
        o WHERE i = 1 UNION ALL
    SELECT o.job_id, o.i, CASE WHEN o.t - p.covered >= o.step THEN o.t ELSE p.covered END, o.i = o.n OR scene_score >= 0.155 OR o.t -
        p.covered >= o.step FROM p JOIN o ON o.job_id = p.job_id AND o.i = p.i + 1)
    SELECT o.job_id, frame_id, t, scene_score, CASE WHEN o.i = 1 THEN 'first' WHEN o.i = n THEN 'tail' WHEN scene_score >= 0.155 THEN
        'scene_change' ELSE 'coverage' END AS reason FROM o JOIN p USING (job_id, i) WHERE kept"""
EVENLY = f"""WITH o AS ({OBSERVED}), m AS (SELECT job_id, min(t) AS a, greatest(max(t) - min(t), 1.0) AS span FROM o GROUP BY 1),
    p AS (SELECT job_id, 1 AS k, [CAST(1 AS BIGINT)] AS chosen FROM m UNION ALL SELECT o.job_id, p.k + 1, list_append(any_value(p.chosen),
        arg_min(o.i, row(abs(o.t - (a + span * p.k / 7)) / span - 0.05 * least(1.0, greatest(0.0, scene_score)), o.i)))
        FROM p JOIN o ON o.job_id = p.job_id JOIN m ON m.job_id = p.job_id WHERE p.k < 7 AND o.i > 1 AND o.i < o.n AND NOT
        list_contains(p.chosen, o.i) GROUP BY o.job_id, p.k)
    SELECT o.job_id, o.frame_id, o.t FROM o JOIN (SELECT * FROM p WHERE k = 7) p ON o.job_id = p.job_id WHERE n <= 8 OR i = n OR
        list_contains(chosen, i)"""
#: The choice among candidates in SQL, one after the other: 12 frames at most, of which 8 at even times, apart by more than 0.3 of their bits.
CHOICE = SAMPLED.replace("\n    SELECT o.job_id, frame_id,", ", c0 AS (SELECT o.job_id, frame_id,") + f"""),
    c1 AS (SELECT c0.*, x.b, row_number() OVER (PARTITION BY c0.job_id ORDER BY c0.t, c0.frame_id) AS i, max(c0.t) OVER (PARTITION BY c0.job_id) AS tail FROM c0 JOIN ({BITS}) x USING (job_id, frame_id)),
    c2 AS (SELECT *, CASE job_id % 3 WHEN 0 THEN 21.0 WHEN 1 THEN 0.4 ELSE tail END AS video FROM c1),
    c AS (SELECT *, least(12, greatest(3, least(CAST(ceil(video / least(15.0, greatest(0.2, video / 4))) AS BIGINT) + 1, 8))) AS slots FROM c2
        JOIN (SELECT x.job_id, x.i, list(y.i) AS near FROM c1 x JOIN c1 y ON x.job_id = y.job_id WHERE len(list_filter(list_zip(x.b, y.b), lambda z: z[1] <> z[2])) / 64.0 <= 0.3 GROUP BY 1, 2) n USING (job_id, i)),
    r AS (SELECT job_id, CAST(0 AS BIGINT) AS k, [arg_min(i, row(abs(t), -scene_score, i))] AS chosen FROM c GROUP BY job_id UNION ALL
        SELECT job_id, k + 1, CASE WHEN pick IS NULL OR list_contains(chosen, pick) THEN chosen ELSE list_append(chosen, pick) END FROM
        (SELECT r.job_id, r.k, any_value(chosen) AS chosen, CASE WHEN r.k + 1 < any_value(slots) - 1 THEN arg_min(c.i, row(abs(t - (r.k + 1) * tail / (slots - 1)), -scene_score, c.i)) FILTER (NOT list_has_any(near, chosen))
            WHEN r.k + 1 = any_value(slots) - 1 THEN arg_min(c.i, row(abs(t - tail), -scene_score, c.i))
            ELSE arg_min(c.i, row(-scene_score, t, c.i)) FILTER (NOT list_has_any(near, chosen) AND len(chosen) < 12) END AS pick
        FROM r JOIN c ON r.job_id = c.job_id WHERE r.k < 30 GROUP BY r.job_id, r.k) q),
    e AS (SELECT job_id, arg_min(i, row(abs(t - tail), -scene_score, i)) AS ending, any_value(slots) AS slots FROM c GROUP BY 1)
    SELECT job_id, frame_id, t, CASE WHEN i = f.chosen[1] THEN 'first' WHEN i = ending THEN 'tail' WHEN list_contains(g.chosen, i) THEN 'coverage' ELSE reason END AS reason
    FROM c JOIN e USING (job_id) JOIN (SELECT job_id, chosen FROM r WHERE k = 30) f USING (job_id) JOIN r g USING (job_id) WHERE g.k = e.slots - 1 AND list_contains(f.chosen, i)"""
META = """SELECT job_id, CASE WHEN job_id = 7 THEN 0.0 WHEN job_id = 8 THEN 9.0 ELSE max(t) + 2 END AS duration_s, count(*) AS sampled, max(t) +
        2 AS expected_tail_s, max(t) + CAST(job_id % 5 AS DOUBLE) / 2 AS last_decodable_s, 0.5 AS tolerance_s FROM v_frames GROUP BY job_id"""
UNITS = "SELECT doc_id AS job_id, text FROM documents"
REFS = "SELECT page_id AS ref_id, concat(regexp_extract(html, '<title>([^<]*)', 1), CASE WHEN page_id % 7 = 0 THEN '?' ELSE '' END) AS title FROM pages"
COVERAGE = """SELECT user_id AS job_id, CASE WHEN event_id % 17 = 0 THEN ' ' ELSE concat(CASE WHEN event_id % 4 = 0 THEN 'Topic ' ELSE
        'TOPIC-' END, CAST(event_id % 40 AS STRING)) END AS topic, event_id % 2 = 0 AS covered,
    CASE WHEN event_id % 3 = 0 THEN 'summary' ELSE 'not_published' END AS destination FROM events"""
FRAME_REFS = """SELECT user_id AS job_id, event_id % 30 AS frame_id, CASE WHEN event_id % 4 = 0 AND user_id % 3 = 0 OR user_id % 7 = 1 THEN NULL ELSE event_id % 6 END AS step FROM events"""
KNOWN_FRAMES = "SELECT DISTINCT user_id AS job_id, event_id % 30 AS frame_id FROM events WHERE event_id % 3 <> 0"
STEPS = "SELECT DISTINCT user_id AS job_id, event_id % 6 AS step FROM events WHERE event_id % 6 < 5"
LINKS = "SELECT page_id AS ref_id, CASE WHEN page_id % 10 = 0 THEN '../x' WHEN page_id % 15 = 1 THEN '/abs' ELSE concat('p/', CAST(page_id % 200 AS STRING)) END AS target FROM pages"
PATHS = "SELECT concat('p/', CAST(page_id AS STRING)) AS path FROM pages WHERE page_id % 3 <> 0"
NUMBERED = """SELECT doc_id AS job_id, concat('# T', chr(10), '## Body', chr(10), coalesce(regexp_replace(text, '[^A-Za-z0-9]+', ' '), ''), chr(10), 'uses 10px and 1,000 or 3.5% at 01:20:05 see ![7](x(99).md)', chr(10),
        '## Timeline', chr(10), 'planted 55 here', chr(10), '## End', chr(10), 'planted 55 here') AS text FROM documents"""
REVIEWED = "SELECT doc_id AS job_id, '3.5% and 112' AS reviewed FROM documents WHERE doc_id % 3 <> 0"
CANDS = """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 13 = 0 THEN array('content', 'job_ref') ELSE array('protocol_version', 'schema_version', 'job_ref', 'packet_sha256', 'content') END AS fields,
        CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 2 END AS schema_version, CASE WHEN o_orderkey % 19 = 0 THEN 0 ELSE o_orderkey END AS job_ref, CASE WHEN o_orderkey % 10 = 9 THEN 2 ELSE 1 END AS version, SHA(CAST(o_orderkey % 100 AS STRING)) AS
        packet_sha256, SHA(CAST(o_custkey AS STRING)) AS candidate_sha256 FROM orders"""
PACKETS = "SELECT o_orderkey AS job_id, SHA(CAST(o_orderkey % 100 + CASE WHEN o_orderkey % 8 = 0 THEN 1 ELSE 0 END AS STRING)) AS sha256 FROM orders WHERE o_orderkey % 21 <> 0"
CURRENT = """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 4 = 1 THEN SHA(CAST(o_custkey AS STRING)) ELSE 'c' END AS candidate_sha256,
        CASE WHEN o_orderkey % 6 = 1 THEN 'p' ELSE SHA(CAST(o_orderkey % 100 AS STRING)) END AS packet_sha256 FROM orders WHERE o_orderkey %
        2 = 1"""
DECIDED = "SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 9 < 4 THEN 'reject' ELSE 'approve' END AS decision FROM orders WHERE o_orderkey % 3 = 0"
REPAIRABLE = "SELECT DISTINCT CASE event_type WHEN 'click' THEN 'duplicate_text' ELSE 'short_section' END AS code FROM events WHERE event_type IN ('click', 'view')"
REJECTIONS = "SELECT event_id AS job_id, CASE event_type WHEN 'click' THEN 'duplicate_text' WHEN 'view' THEN 'short_section' ELSE 'privacy' END AS code, event_id % 2 AS repairs FROM events"
MATRIX = {
    "items": "SELECT doc_id AS job_id, SHA(CAST(doc_id AS STRING)) AS media_sha256, CASE WHEN doc_id % 12 = 1 THEN 'failed' ELSE 'completed' END AS status FROM documents",
    "media": "SELECT doc_id AS job_id, SHA(CAST(doc_id + CASE WHEN doc_id % 9 = 2 THEN 1 ELSE 0 END AS STRING)) AS sha256 FROM documents WHERE doc_id % 9 <> 1",
    "manifests": "SELECT doc_id AS job_id, SHA(CAST(doc_id + CASE WHEN (doc_id % 9 = 2) <> (doc_id % 8 = 2) THEN 1 ELSE 0 END AS STRING)) AS source_sha256 FROM documents WHERE doc_id % 8 <> 1",
    "notes": """SELECT doc_id AS job_id, concat(CASE WHEN doc_id % 5 = 2 THEN '' ELSE '## Note ' END, coalesce(text, '')) AS text, source AS
        category, CASE WHEN doc_id % 11 = 1 THEN array('a') WHEN doc_id % 13 = 1 THEN array('a', 'TODO')
        ELSE array('a', 'b') END AS tags, CASE WHEN doc_id % 6 = 1 THEN 'low' ELSE 'high' END AS mode FROM documents WHERE doc_id % 7 <>
        1""",
    "projections": "SELECT doc_id AS job_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 10 <> 1",
}
TAXONOMY = "SELECT doc_id AS job_id, CASE WHEN source = 'src3' THEN 'Misc' ELSE source END AS category, array('a', CASE WHEN doc_id % 5 = 0 THEN ' a ' WHEN doc_id % 7 = 0 THEN 'TODO' WHEN doc_id % 7 = 1 THEN ' ' ELSE 'b' END) AS tags FROM documents"
OCR_STATE = "SELECT doc_id AS job_id, CASE WHEN doc_id % 3 = 0 THEN 'needs_review' ELSE 'ok' END AS quality FROM documents"
JSONS = """SELECT page_id AS job_id, concat('{"title":"', CASE WHEN page_id % 4 = 0 THEN '' ELSE 'page' END, '","kind":"', CASE WHEN page_id
        % 5 = 0 THEN 'x' ELSE 'page' END, '","tags":["a",', CASE WHEN page_id % 3 = 0 THEN '"a"' ELSE '"b"' END, '],"score":', CAST(page_id
        % 20 AS STRING), CASE WHEN page_id % 11 = 0 THEN ',"odd":1' ELSE '' END, '}') AS json FROM pages"""
NESTED = """SELECT page_id AS job_id, concat('{"schema_version":', CASE WHEN page_id % 13 = 0 THEN '1' ELSE '2' END, ',"title":', CASE WHEN
        page_id % 4 = 0 THEN '7' ELSE '"page"' END, ',"tags":["aa",', CASE WHEN page_id % 3 = 0 THEN '"aa"' WHEN page_id % 7 = 1 THEN '"b"'
        ELSE '"bb"' END, '],"state":', CASE WHEN page_id % 5 = 0 THEN '"x"' ELSE '"verified"' END, ',"steps":[{"step":', CAST(page_id % 25
        AS STRING), ',"claim":"', CASE WHEN page_id % 6 = 0 THEN 'c' ELSE 'claim' END, '"},{"step":', CASE WHEN page_id % 9 = 0 THEN '"2"'
        ELSE '2' END, ',"claim":"claim","at":"', CASE WHEN page_id % 10 = 0 THEN '1:20' ELSE '01:20' END, '"', CASE WHEN page_id % 11 = 0
        THEN ',"odd":1' ELSE '' END, '}],"review":[{"term":"t","verdict":"', CASE WHEN page_id % 8 = 0 THEN 'maybe' ELSE 'verified' END,
        '"}', CASE WHEN page_id % 14 = 0 THEN ',{"verdict":"unresolved"}' ELSE '' END, ']}') AS json FROM pages"""
STEP = {
    "type": "object", "additionalProperties": False, "required": ["step", "claim"],
    "properties": {"step": {"type": "integer", "minimum": 1, "maximum": 20}, "claim": {"type": "string", "minLength": 4}, "at": {"type": "string", "pattern": "[0-9]{2}:[0-9]{2}"}}}
SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["schema_version", "title", "tags", "steps", "review"],
    "properties": {
        "schema_version": {"const": 2}, "title": {"type": "string", "minLength": 2, "maxLength": 40}, "state": {"enum": ["verified", "needs_review"]},
        "tags": {"type": "array", "minItems": 2, "uniqueItems": True, "items": {"type": "string", "minLength": 2}},
        "steps": {"type": "array", "minItems": 1, "maxItems": 3, "items": STEP}, "review": {"type": "array", "items": {"$ref": "#/$defs/row"}}},
    "$defs": {
        "row": {"type": "object", "required": ["term", "verdict"], "properties": {"term": {"type": "string", "minLength": 1}, "verdict": {"$ref": "#/$defs/verdict"}}},
        "verdict": {"enum": ["verified", "unresolved"]}}}
#: What the texts of NESTED break.
BROKEN = [
    ("const", "$.schema_version", "% 13 = 0"), ("type=string", "$.title", "% 4 = 0"), ("uniqueItems", "$.tags", "% 3 = 0"), ("minLength", "$.tags[1]", "% 3 <> 0 AND page_id % 7 = 1"),
    ("enum", "$.state", "% 5 = 0"), ("minimum", "$.steps[0].step", "% 25 = 0"), ("maximum", "$.steps[0].step", "% 25 > 20"), ("minLength", "$.steps[0].claim", "% 6 = 0"),
    ("type=integer", "$.steps[1].step", "% 9 = 0"), ("pattern", "$.steps[1].at", "% 10 = 0"), ("additionalProperty", "$.steps[1].odd", "% 11 = 0"), ("enum", "$.review[0].verdict", "% 8 = 0"),
    ("required", "$.review[1].term", "% 14 = 0")]
GATES = ["unresolved_without_pending", "status_mismatch", "long_digits"]
REQUESTS = """SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 71 = 0 THEN ' ' ELSE CAST(o_custkey % 300 AS STRING) END AS job_ref,
        concat('k', CAST(o_orderkey % 400 AS STRING)) AS idempotency_key,
    SHA(CAST(o_orderkey % 3 AS STRING)) AS request_sha256, CASE WHEN o_orderkey % 41 = 0 THEN 'short' ELSE upper(SHA(CAST(o_orderkey % 400 %
        7 AS STRING))) END AS draft_sha256, SHA('m') AS media_sha256,
    CASE WHEN o_orderkey % 43 = 0 THEN 'a/../up' WHEN o_orderkey % 47 = 0 THEN '' ELSE concat('a/', CAST(o_orderkey % 2 AS STRING)) END AS
        h1, concat('b', chr(92), CAST(o_orderkey % 4 AS STRING)) AS h2,
    CASE WHEN o_orderkey % 5 = 0 THEN SHA('d') WHEN o_orderkey % 53 = 0 THEN 'bad' END AS s2 FROM orders"""
HELD = """SELECT DISTINCT concat('k', CAST(o_orderkey % 400 AS STRING)) AS idempotency_key, SHA('1') AS request_sha256, CAST(o_orderkey %
        400 % 300 AS STRING) AS job_ref, SHA(CAST(o_orderkey % 400 % 7 AS STRING)) AS draft_sha256,
    CASE WHEN o_orderkey % 400 % 11 = 0 THEN SHA('n') ELSE SHA('m') END AS media_sha256, CASE WHEN o_orderkey % 400 % 9 = 0 THEN 'accepted'
        ELSE 'intent' END AS state, 'a/0' AS h1, 'b/0' AS h2,
    CASE WHEN o_orderkey % 400 % 6 = 0 THEN 'verified' ELSE 'pending' END AS st2 FROM orders WHERE o_orderkey % 400 % 4 <> 1"""
JOBS = "SELECT CAST(c_custkey AS STRING) AS job_id FROM customer WHERE c_custkey % 50 <> 0"
EXPECTED = "SELECT saga_id, target_name, expected_sha256, CASE WHEN expected_sha256 = '' THEN SHA(target_name) WHEN saga_id LIKE '%7' THEN SHA('z') ELSE expected_sha256 END AS sha256 FROM v_targets WHERE NOT (saga_id LIKE '%3' AND target_name = 't1')"
FLAGS = "SELECT CAST(o_orderkey AS STRING) AS saga_id, o_orderkey % 6 AS m FROM orders WHERE o_orderkey % 2 = 0"
ACCEPTANCES = "SELECT CAST(o_orderkey AS STRING) AS saga_id, o_orderdate + INTERVAL '2' DAY AS accepted_at FROM orders WHERE o_orderkey % 3 <> 0"
ITEM_STATES = "SELECT CAST(c_custkey AS STRING) AS job_id, 'new' AS status FROM customer WHERE c_custkey % 50 <> 0"
NEW_REVIEWS = "SELECT user_id AS job_ref, event_type AS candidate_sha256, CASE WHEN user_id % 2 = 0 THEN 'approve' ELSE 'reject' END AS decision, CAST(user_id AS STRING) AS note FROM events WHERE event_id % 50 = 0"
PUBLISHED = "SELECT CAST(o_orderkey AS STRING) AS key, concat('a/', CAST(o_custkey AS STRING)) AS location, o_orderdate AS first_published_at, o_orderdate AS updated_at FROM orders WHERE o_orderkey % 3 <> 0"
REPUBLISHED = f"SELECT CAST(o_orderkey AS STRING) AS key, concat('b/', CAST(o_custkey AS STRING)) AS location, TIMESTAMP '{NOW}' AS published_at FROM orders WHERE o_orderkey % 4 <> 0"
LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_ref ORDER BY created_at DESC, saga_id DESC) AS r FROM v_sagas) q WHERE r = 1"
STATUS = "CASE WHEN coalesce(expected_sha256, '') = '' THEN 'planned' WHEN observed_sha256 IS NULL THEN 'missing' WHEN observed_sha256 = expected_sha256 THEN 'verified' ELSE 'mismatch' END"
WANTED = "SELECT concat('item-', substr(SHA(source_id), 1, 20)) AS job_id, CASE WHEN k % 9 = 0 THEN 'lost' ELSE status END AS expected_status FROM v_src WHERE k % 5 = 2 OR k % 10 = 0"
BATCHES = "SELECT o_orderkey % 40 AS batch_id, job_id FROM (SELECT o_orderkey, concat('item-', substr(SHA(CAST(o_orderkey AS STRING)), 1, 20)) AS job_id FROM orders) b"
FINISHED = "SELECT DISTINCT o_orderkey % 40 AS batch_id FROM orders WHERE o_orderkey % 40 < 25"
JOB_FLAGS = """SELECT o_orderkey AS job_id, CASE o_orderkey % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'incomplete' ELSE
        'processing' END AS status, o_orderkey % 11 <> 0 AS currently_collected FROM orders"""
PUBLICATIONS = "SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 4 = 0 THEN 'accepted' ELSE 'intent' END AS state, o_orderkey % 5 <> 0 AS targets_verified FROM orders WHERE o_orderkey % 8 <> 1"
CHECKPOINTS = "SELECT o_orderkey AS job_id, o_orderkey % 13 = 0 AS paused, CASE WHEN o_orderkey % 13 = 0 THEN 'e' END AS error FROM orders WHERE o_orderkey % 9 <> 2"
ANSWERS = "SELECT o_orderkey AS job_id, o_orderkey % 4 < 2 AS current, o_orderkey % 4 = 0 AS imported FROM orders WHERE o_orderkey % 3 = 0"
HAVE = {n: f"SELECT o_orderkey AS job_id FROM orders WHERE o_orderkey % {k} < 2" for n, k in (("drafts", 7), ("packets", 5), ("analyses", 4), ("media", 3))}
JOB_BATCHES = "SELECT DISTINCT user_id AS job_id, CASE WHEN user_id % 5 = 0 THEN TIMESTAMP '2024-06-01 00:00:00' ELSE TIMESTAMP '2024-01-05 00:00:00' END AS created_at FROM events UNION ALL SELECT -1, TIMESTAMP '2024-01-07 00:00:00'"
STAGED = """SELECT o_custkey % 60 AS batch_id, o_orderkey AS job_id, o_orderkey % 97 AS position, o_custkey % 60 < 30 AND o_orderkey % 31 =
        0 AS active,
    CASE WHEN o_custkey % 60 < 5 OR o_orderstatus = 'F' THEN 'accepted' WHEN o_custkey % 60 < 9 AND o_orderkey % 5 = 0 THEN 'failed'
    ELSE CASE o_orderkey % 6 WHEN 0 THEN 'planned' WHEN 1 THEN 'downloaded' WHEN 2 THEN 'analyzed' WHEN 3 THEN 'packet_ready' WHEN 4 THEN
        'semantic_ready' ELSE 'staged' END END AS stage FROM orders"""
ATTEMPTS = "SELECT job_id, stage, event_id, v.at, CASE WHEN event_id % 2 = 0 THEN 'started' ELSE outcome END AS event, event_id % 5 = 0 AS reused FROM v_stage_events v"
LEASES = "SELECT event_id AS lease_id, ts AS acquired_at FROM events"
POOLS = "SELECT event_type AS pool, user_id AS job_id, value > 30 AS active FROM events"
ASSIGNED = "SELECT p_partkey, p_brand, p_size, p_type FROM part"
DECLARED = "SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN 'b' ELSE p_brand END AS p_brand, p_size + CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END AS p_size, p_type FROM part WHERE p_partkey % 10 <> 0"
RECORDS = "SELECT source_id AS job_id, CASE WHEN k % 5 = 0 THEN NULL ELSE concat('Title ', source_id) END AS title, collection AS category, k % 3 = 0 AS accepted FROM v_src WHERE k % 7 <> 0"
BEFORE = "SELECT source_id AS job_id, status FROM v_src WHERE k % 9 <> 0"
AFTER = "SELECT source_id AS job_id, CASE WHEN k % 4 = 0 THEN 'completed' ELSE status END AS status FROM v_src WHERE k % 8 <> 3"
TAGGED = "SELECT doc_id AS entry_ref, array(lang, source, CASE WHEN doc_id % 3 = 0 THEN upper(lang) ELSE 'x' END) AS tags FROM documents"
SPELLED = "SELECT doc_id AS entry_ref, CASE WHEN doc_id % 11 = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array(concat(' ', coalesce(lang, 'x')), concat('.', coalesce(source, 'y'), '-'), CASE doc_id % 7 WHEN 0 THEN 'con' WHEN 1 THEN ' - ' WHEN 2 THEN 'a/b' ELSE upper(coalesce(lang, 'x')) END) END AS tags FROM documents"
DATED = "SELECT o_orderkey AS entry_ref, o_orderdate AS added_at FROM orders"
STEMS = "SELECT p_partkey AS job_id, p_brand AS category, CASE WHEN p_partkey % 4 = 1 THEN concat(p_type, ' .') WHEN p_partkey % 17 = 2 THEN concat(p_type, ' (3)') ELSE p_type END AS stem FROM part"
NAMED = """SELECT p_partkey AS job_id, p_brand AS category, CASE WHEN p_partkey % 30 = 0 THEN concat(p_type, ' (', CAST(p_partkey % 7 + 2 AS
        STRING), ')') WHEN p_partkey % 20 = 0 THEN p_type
    ELSE concat(p_type, ' #', CAST(p_partkey AS STRING)) END AS name FROM part WHERE p_partkey % 10 = 0"""
PARTS = """SELECT l_orderkey AS entry_ref, CASE CAST(l_linenumber AS INT) WHEN 1 THEN 'note.md' WHEN 2 THEN 'media.mp4' WHEN 3 THEN
        'data.json' ELSE concat('frames/', CAST(l_partkey AS STRING)) END AS rel_path,
    SHA(CAST(l_partkey AS STRING)) AS sha256, CASE WHEN l_partkey % 97 = 0 THEN 'x' ELSE SHA(CAST(l_partkey AS STRING)) END AS
        expected_sha256 FROM lineitem"""
REF_KEYS = "SELECT o_orderkey AS entry_ref, SHA(CAST(o_custkey AS STRING)) AS media_sha256 FROM orders"
BY_SOURCE = {
    "manifest": "SELECT o_orderkey AS entry_ref, concat('m', CAST(o_orderkey AS STRING)) AS job_id FROM orders WHERE o_orderkey % 5 = 0",
    "checkpoint": "SELECT o_orderkey AS entry_ref, concat('c', CAST(o_custkey AS STRING)) AS job_id FROM orders WHERE o_orderkey % 4 = 0",
    "registry": "SELECT l_orderkey AS entry_ref, concat('r', CAST(l_suppkey AS STRING)) AS job_id FROM lineitem WHERE l_orderkey % 3 = 0",
    "fingerprint": "SELECT SHA(CAST(c_custkey AS STRING)) AS media_sha256, concat('f', CAST(c_nationkey AS STRING)) AS job_id FROM customer WHERE c_custkey % 2 = 0",
}
SOURCE_REFS = "SELECT l_orderkey AS entry_ref, l_partkey AS source_ref, CASE WHEN l_partkey % 3 = 0 THEN 'manifest' ELSE 'fingerprint' END AS kind FROM lineitem"
MOVE_SOURCES = "SELECT o_orderkey AS entry_ref, SHA(CAST(o_custkey AS STRING)) AS source_sha256 FROM orders WHERE o_orderkey % 9 <> 0"
MOVE_STATE = """SELECT o_orderkey AS entry_ref, SHA(CAST(o_custkey + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS STRING)) AS
        source_sha256, SHA('t') AS target_sha256,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE SHA('t') END AS observed_sha256 FROM orders WHERE o_orderkey % 7 <> 0"""
BOUND = "SELECT o_orderkey AS entry_ref FROM orders WHERE o_orderkey % 8 <> 0"
MOVES = "SELECT concat('item-', substr(SHA(source_id), 1, 20)) AS job_id, CASE WHEN k % 12 = 1 THEN 'old/x' ELSE concat('lib/', source_id) END AS from_path, CASE WHEN k % 13 = 1 THEN concat('lib/', source_id) ELSE concat('new/', source_id) END AS to_path FROM v_src"
CHECKPOINT = "SELECT p_partkey AS entry_ref, CASE WHEN p_partkey % 20 = 0 THEN '../a' WHEN p_partkey % 30 = 1 THEN '/a' ELSE concat('t/', CAST(p_partkey % 1900 AS STRING)) END AS target_path, CASE WHEN p_partkey % 40 = 3 THEN 'zz' ELSE SHA(p_name) END AS sha256 FROM part"
REQUIRED = ["note.md", "media.mp4", "data.json"]
#: The sections of the documents of Q-15 in SQL.
RENDERED = {
    "about": f"'{quality.ABOUT}'", "one_sentence_summary": "first", "content_summary": "paras", "core_points": "bullets", "argument_structure": "steps", "cases_and_data": "cases", "reviews": "terms || chr(10) || numbers", "timeline_interpretation": "times",
    "reusable_knowledge": "bullets", "action_items": "bullets", "keywords": "words", "related_knowledge": f"CASE WHEN job_id % 3 = 0 THEN '{quality.NO_RELATED}' ELSE related END",
    "visual_evidence": f"CASE WHEN job_id % 4 = 0 THEN '' ELSE '{quality.PLACED}' || chr(10) || chr(10) END || shown", "pending_review": f"CASE WHEN job_id % 2 = 1 THEN bullets ELSE '{quality.NO_PENDING}' END"}


def _a(s, d, statement):
    return sql(s, d, statement)


def duck(statement: str) -> str:
    return statement.replace("array(", "list_value(").replace("ARRAY<STRING>", "VARCHAR[]")


def _dict_sources(s, d):
    return {k: sql(s, d, q) for k, q in BY_SOURCE.items()}


def _checks(s, d):
    """Acceptance checks: 0 has a failed one, 2 lacks one, 3 has one that is null."""
    m = F.col("m")
    pairs = F.create_map(
        F.lit("sqlite_integrity"), m != 0, F.lit("content"), F.when(m != 3, F.lit(True)), F.when(m == 2, F.lit("other")).otherwise(F.lit("privacy")), F.lit(True))
    return sql(s, d, FLAGS).select("saga_id", pairs.alias("checks"))


def _accepted(s, d):
    outcomes = ledger.accept(sagas(s, d), _checks(s, d), sql(s, d, ITEM_STATES))
    held = sagas(s, d).withColumn("superseded_by", F.lit(None).cast("string"))
    after, _ = ledger.after_acceptance(held, sql(s, d, ITEM_STATES), outcomes, NOW)
    return after.select("saga_id", "state", "superseded_by").join(outcomes, "saga_id", "left")


def _requests(s, d):
    named = lambda h, sha: F.struct(F.col(h).alias("handle"), sha.alias("sha256"))
    targets = F.create_map(F.lit("t1"), named("h1", F.lit(None).cast("string")), F.lit("t2"), named("h2", F.col("s2")))
    return sql(s, d, REQUESTS).withColumn("targets", targets).drop("h1", "h2", "s2")


def _held(s, d):
    named = lambda h, status: F.struct(F.col(h).alias("handle"), status.alias("status"))
    targets = F.create_map(F.lit("t1"), named("h1", F.lit("pending")), F.lit("t2"), named("h2", F.col("st2")))
    return sql(s, d, HELD).withColumn("targets", targets)


def _violations(s, d):
    p = payload(s, d)
    return quality.review_violations(p).union(quality.privacy_violations(p, "body"))


TESTS: dict = {
    "E-1": (lambda s, d: evidence.clean_records(sql(s, d, "SELECT doc_id, text FROM documents")), f"""SELECT doc_id, trim(left(c, 800)) AS
        text, length(c) > 800 AS truncated FROM (SELECT doc_id, {CLEAN.format('text')} AS c FROM documents) t WHERE c <> '' AND NOT
        {PRIVATE.format('c')}"""),
    "E-2": (lambda s, d: evidence.fragment(view(s, d, "documents"), "doc_id"), f"""WITH l AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS
        text FROM documents), w AS (SELECT doc_id, i, {CLEAN.format('substr(text, i * 600 + 1, 600)')} AS c FROM (SELECT doc_id, text,
        unnest(range(0, CAST(ceil(length(text) / 600.0) AS BIGINT))) AS i FROM l)),
        k AS (SELECT *, c <> '' AND NOT {PRIVATE.format('c')} AS kept FROM w), n AS (SELECT doc_id, count(*) FILTER (NOT kept) AS omitted FROM k GROUP BY 1)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS part, trim(left(c, 800)) AS text, omitted FROM k JOIN n USING (doc_id) WHERE kept
        UNION ALL SELECT doc_id, NULL, NULL, omitted FROM n WHERE omitted > 0 AND doc_id NOT IN (SELECT doc_id FROM k WHERE kept)"""),
    "E-3": (lambda s, d: evidence.dedup_lines(_lines(s, d), "doc_id"), f"""SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER
        (PARTITION BY doc_id, k ORDER BY line_no) AS r FROM (SELECT *, lower(replace(regexp_replace(line, '[\\s|*_`#>-]+', '', 'g'), 'ß',
        'ss')) AS k FROM ({LINES}) l) m WHERE k <> '') q WHERE r = 1"""),
    "E-4": (_evidence, ORDERED),
    "E-5": (
        lambda s, d: evidence.evidence_counts(_evidence(s, d), sql(s, d, "SELECT job_id, segment_id AS omitted FROM v_segments")),
        f"""SELECT
        job_id, coalesce(asr, 0) AS asr, coalesce(ocr, 0) AS ocr, coalesce(timeline, 0) AS timeline, coalesce(summary, 0) AS summary,
        coalesce(omitted, 0) AS omitted FROM
        (SELECT job_id, count(*) FILTER (source = 'asr') AS asr, count(*) FILTER (source = 'ocr') AS ocr, count(*) FILTER (source =
        'timeline') AS timeline, count(*) FILTER (source = 'summary') AS summary FROM ({EVIDENCE}) e GROUP BY 1) a
        FULL OUTER JOIN (SELECT job_id, CAST(sum(segment_id) AS BIGINT) AS omitted FROM v_segments GROUP BY 1) b USING (job_id)""",
    ),
    "E-6": (lambda s, d: evidence.pack_chunks(_evidence(s, d), BYTES), PACK),
    "E-7": (lambda s, d: evidence.coverage_order(_evidence(s, d)).select("job_id", "i", "visit"), VISITS),
    "E-8": (
        lambda s, d: evidence.fact_records(view(s, d, "documents")).select("doc_id"),
        r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\p{Nd}|(^|[^\p{L}\p{N}_])[A-Z]([A-Z0-9-]*[A-Z0-9]($|[^\p{L}\p{N}_])|[A-Z0-9-]*-[\p{L}\p{N}_])')",
    ),
    "E-9": (_picked, PICKED),
    "E-10": (
        lambda s, d: evidence.source_coverage(_evidence(s, d).withColumn("truncated", F.length("text") > 50), _evidence(s, d).where("i % 3 = 1")),
        f"""WITH
        ordered AS ({ORDERED}) SELECT job_id, source, count(*) AS total, count(*) FILTER (i % 3 = 1) AS included, count(*) FILTER
        (length(text) > 50) AS truncated,
        arg_min(i % 3 = 1, i) AS first_included, arg_max(i % 3 = 1, i) AS last_included FROM ordered GROUP BY 1, 2""",
    ),
    "E-11": (
        lambda s, d: evidence.manifest_facts(sql(s, d, JSONS), ["title", "kind", "score", "tags"]).select("job_id", F.col("facts")["kind"].alias("kind"), F.col("facts")["score"].alias("score")),
        f"SELECT job_id, json_extract_string(json, '$.kind') AS kind, json_extract_string(json, '$.score') AS score FROM ({JSONS}) t",
    ),
    "E-12": (
        lambda s, d: evidence.build_packets(_listed(s, d), evidence.source_coverage(_evidence(s, d).withColumn("truncated", F.length("text") > 50), _evidence(s, d).where("i % 3 = 1")), _facts(s, d), sql(s, d, HASHES), sql(s, d, SHOWN), 40000),
        f"""WITH ordered AS ({ORDERED}), e AS (SELECT job_id,
      
         {', '.join(f"coalesce(string_agg(CAST(to_json(text) AS VARCHAR), ',' ORDER BY i) FILTER ({w}), '') AS {n}" for n, w in LISTS.items())}
        FROM ordered GROUP BY 1),
        c AS (SELECT job_id, string_agg('{{"source":"' || source || '","first_included":' || a || ',"included":' || k || ',"last_included":'
        || z || ',"total":' || n || ',"truncated":' || x || '}}', ',' ORDER BY source) AS c FROM
            (SELECT job_id, source, count(*) AS n, count(*) FILTER (i % 3 = 1) AS k, count(*) FILTER (length(text) > 50) AS x, arg_min(i % 3
        = 1, i) AS a, arg_max(i % 3 = 1, i) AS z FROM ordered GROUP BY 1, 2) q GROUP BY 1),
        h AS (SELECT job_id, string_agg('{{"name":"' || name || '","file":"' || file || '","sha256":"' || sha256 || '","size_bytes":' ||
        size_bytes || '}}', ',' ORDER BY name) AS h FROM ({HASHES}) t GROUP BY 1),
        f AS (SELECT job_id, string_agg('{{"frame_index":' || frame_index || ',"file":"' || file || '","sha256":"' || sha256 ||
        '","size_bytes":' || size_bytes || ',"timestamp_s":' || timestamp_s || '}}', ',' ORDER BY frame_index) AS f FROM ({SHOWN}) t GROUP
        BY 1),
        j AS (SELECT e.job_id, '{{"evidence":{{"key_passages":[' || passages || '],"numeric_and_proper_nouns":[' || facts ||
        '],"timeline":[' || timeline || ']}},"job_ref":"' || e.job_id || '","limits":{{"max_bytes":40000}},"manifest_facts":{{"engine":"e'
        || e.job_id % 3
            || '","turns":"' || e.job_id % 5 || '"}},"schema_version":1,"selected_keyframes":' || coalesce('[' || f || ']', 'null') ||
        ',"source_coverage":[' || c || '],"source_file_hashes":[' || h || ']}}' AS json FROM e LEFT JOIN c USING (job_id) LEFT JOIN h USING
        (job_id) LEFT JOIN f USING (job_id))
        SELECT job_id, json, strlen(json) AS bytes, CAST(ceil(length(json) / 4.0) AS BIGINT) AS tokens, SHA(json) AS sha256, CASE WHEN
        strlen(json) > 40000 THEN 'over_budget' END AS error FROM j""",
    ),
    "E-13": (
        lambda s, d: evidence.bundle_manifest(evidence.pack_chunks(_evidence(s, d), BYTES), screen(s, d)).select("job_id", "chunk_count", "records", "complete"),
        PACK.replace(f"SELECT *, CASE WHEN bytes > {BYTES} THEN 'oversize' END AS error FROM b", f"""SELECT job_id, count(*) AS chunk_count,
        CAST(sum(records) AS BIGINT) AS records,
        bool_and(bytes <= {BYTES}) AND job_id IN (SELECT job_id FROM v_screen) AS complete FROM b GROUP BY job_id"""),
    ),
    "E-14": (lambda s, d: evidence.redacted(sql(s, d, "SELECT doc_id, text FROM documents"), "text"), r"""SELECT doc_id,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)https?://\S+', '[REDACTED_URL]', 'g'),
        '(?i)\b(cookie|session|signature|token)\b\s*[=:]\s*\S+', '\1=[REDACTED]', 'g'),
        '(?i)\bitem-[0-9a-f]{20}\b', '[REDACTED_JOB]', 'g'), '\b[0-9]{15,24}\b', '[REDACTED_ID]', 'g') AS text FROM documents"""),
    "E-15": (
        lambda s, d: evidence.extractive_digest(segs(s, d)).select("job_id", "short", "long", *[F.array_join(c, "|").alias(c) for c in ("leads", "numeric")], F.size("timed").alias("timed")),
        """WITH
        j AS (SELECT job_id, string_agg(text, ' ' ORDER BY start_s, segment_id, text) AS t, list(text ORDER BY start_s, segment_id, text) AS
        a FROM v_segments GROUP BY 1)
        SELECT job_id, CASE WHEN length(t) > 140 THEN regexp_replace(left(t, 139), '\\s+$', '') || '…' ELSE t END AS short, CASE WHEN
        length(t) > 600 THEN regexp_replace(left(t, 599), '\\s+$', '') || '…' ELSE t END AS long, array_to_string(a[1:5], '|') AS leads,
        array_to_string(list_filter(a, lambda x: regexp_matches(x, '[0-9]'))[1:5], '|') AS numeric, least(len(a), 8) AS timed FROM j""",
    ),
    "E-16": (
        lambda s, d: evidence.read_progress(sql(s, d, "SELECT user_id AS job_id, concat('h', CAST(event_id % 20 AS STRING)) AS handle FROM events"), sql(s, d, "SELECT user_id AS job_id, concat('h', CAST(event_id % 20 AS STRING)) AS handle FROM events WHERE value > 60")).select("job_id", "required", "read", F.array_join("missing", ",").alias("missing")),
        """SELECT q.job_id, count(*) AS required, count(r.handle) AS read, coalesce(string_agg(q.handle, ',' ORDER BY q.handle) FILTER
        (r.handle IS NULL), '') AS missing FROM (SELECT DISTINCT user_id AS job_id, concat('h', CAST(event_id % 20 AS STRING)) AS handle
        FROM events) q
        LEFT JOIN (SELECT DISTINCT user_id AS job_id, concat('h', CAST(event_id % 20 AS STRING)) AS handle FROM events WHERE value > 60) r
        ON q.job_id = r.job_id AND q.handle = r.handle GROUP BY 1""",
    ),
    "K-1": (
        lambda s, d: _signed(s, d).select("job_id", "frame_id", F.lpad(F.conv(F.hex(F.col("signature")[0]), 16, 2), 64, "0").alias("bits")),
        f"SELECT job_id, frame_id, array_to_string(list_transform(b, lambda x: CASE WHEN x THEN '1' ELSE '0' END), '') AS bits FROM ({BITS}) t",
    ),
    "K-2": (lambda s, d: _neighbours(s, d), f"""WITH b AS ({BITS}) SELECT x.job_id, x.frame_id AS a, y.frame_id AS b,
        round(len(list_filter(list_zip(x.b, y.b), lambda z: z[1] <> z[2])) / 64.0, 6) AS ratio FROM b x JOIN b y ON x.job_id = y.job_id AND
        y.t = x.t + 5"""),
    "K-3": (
        lambda s, d: _scored(s, d).select("job_id", "frame_id", "scene_score"),
        f"SELECT job_id, frame_id, scene_score FROM ({SCORED}) q",
    ),
    "K-4": (lambda s, d: frames.frame_candidates(_scored(s, d), sql(s, d, DURATIONS), threshold=0.155), SAMPLED),
    "K-5": (lambda s, d: selection.select_frames(_candidates(s, d), sql(s, d, DURATIONS), most=12, apart=0.3).where("reason IN ('first', 'tail', 'coverage')"), f"{CHOICE} AND (i = f.chosen[1] OR i = ending OR list_contains(g.chosen, i) OR reason IN ('first', 'tail', 'coverage'))"),
    "K-6": (lambda s, d: selection.select_frames(_candidates(s, d), sql(s, d, DURATIONS), most=12, apart=0.3), CHOICE),
    "K-7": (lambda s, d: frames.nearest_distance(_signed(s, d)), f"""WITH b AS ({BITS}) SELECT x.job_id, x.frame_id, CASE WHEN count(y.t) =
        0 THEN 1.0 ELSE round(min(len(list_filter(list_zip(x.b, y.b), lambda z: z[1] <> z[2])) / 64.0), 6) END AS nearest FROM b x LEFT JOIN
        b y ON x.job_id = y.job_id AND y.t < x.t GROUP BY 1, 2"""),
    "K-8": (lambda s, d: frames.pick_k(_scored(s, d), 8), EVENLY),
    "K-9": (lambda s, d: frames.frame_coverage(_selected(s, d).where("job_id <> 9"), sql(s, d, META)), f"""WITH m AS ({META}), s AS (SELECT job_id, t, t - lag(t,
        1, 0.0) OVER (PARTITION BY job_id ORDER BY t) AS gap FROM v_frames WHERE frame_id % 3 = 0 AND job_id <> 9), p AS (SELECT job_id, count(*) AS n,
        max(gap) AS gap, min(t) AS lo, max(t) AS hi FROM s GROUP BY 1)
        SELECT job_id, coalesce(n, 0) AS frames, round(greatest(gap, duration_s - coalesce(hi, 0), 0.0), 3) AS max_gap, round(greatest(0.0, duration_s -
        coalesce(hi, 0)), 3) AS tail_gap, round(CASE WHEN duration_s = 0 THEN 1 WHEN n IS NULL THEN 0 ELSE least(1, greatest(0, (hi - lo) / duration_s)) END, 6) AS span_ratio,
        2 - CAST(job_id % 5 AS DOUBLE) / 2 <= 0.5 AS reached_end, greatest(0, sampled - coalesce(n, 0)) AS omitted FROM m LEFT JOIN p USING
        (job_id)"""),
    "K-10": (lambda s, d: frames.near_duplicate_frames(_signed(s, d), 0.36), f"""WITH b AS ({BITS}) SELECT * FROM (SELECT x.job_id,
        x.frame_id AS a, y.frame_id AS b, round(len(list_filter(list_zip(x.b, y.b), lambda z: z[1] <> z[2])) / 64.0, 6) AS ratio FROM b x
        JOIN b y ON x.job_id = y.job_id AND x.frame_id < y.frame_id) t WHERE ratio <= 0.36"""),
    "K-10-classes": (
        lambda s, d: _classes(s, d),
        f"""WITH b AS ({BITS} UNION ALL SELECT job_id, frame_id + 1000000, t, b FROM ({BITS}) c), c AS (SELECT job_id, b, min(frame_id) AS id, count(*) AS n FROM b GROUP BY 1, 2)
        SELECT job_id, id AS a, NULL::BIGINT AS b, n, NULL::DOUBLE AS ratio FROM c UNION ALL
        SELECT * FROM (SELECT x.job_id, least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, NULL::BIGINT AS n, round(len(list_filter(list_zip(x.b, y.b), lambda z: z[1] <> z[2])) / 64.0, 6) AS ratio FROM c x
        JOIN c y ON x.job_id = y.job_id AND x.id < y.id) t WHERE ratio <= 0.24""",
    ),
    "Q-1": (
        lambda s, d: schema.schema_violations(sql(s, d, NESTED), SCHEMA),
        " UNION ALL ".join(f"SELECT page_id AS job_id, '{code}' AS code, '{path}' AS path FROM pages WHERE page_id {where}" for code, path, where in BROKEN),
    ),
    "Q-2": (lambda s, d: quality.privacy_violations(payload(s, d), "body"), r"""SELECT job_id, code, 'body' AS path FROM (SELECT job_id,
        body, unnest(['link', 'secret_word', 'id_word', 'job_name', 'long_digits']) AS code FROM v_payload) t WHERE CASE code WHEN 'link'
        THEN regexp_matches(body, '(?i)https?://\S+')
        WHEN 'secret_word' THEN regexp_matches(body, '(?i)\b(cookie|sessionid?|signature|request[_ -]?url)\b') WHEN 'id_word' THEN
        regexp_matches(body, '(?i)\b(job|source|item)[_ -]?id\b') WHEN 'job_name' THEN regexp_matches(body, '(?i)\bitem-[0-9a-f]{20}\b')
        ELSE regexp_matches(body, '(^|[^0-9])[0-9]{15,24}($|[^0-9])') END"""),
    "Q-3": (lambda s, d: quality.taxonomy_violations(sql(s, d, TAXONOMY)), """SELECT doc_id AS job_id, 'generic_category' AS code, 'category' AS path
        FROM documents WHERE source = 'src3' OR source IS NULL UNION ALL SELECT doc_id, 'too_few_tags', 'tags' FROM documents WHERE doc_id % 5 = 0
        UNION ALL SELECT doc_id, 'placeholder_tag', 'tags' FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 < 2"""),
    "Q-4": (lambda s, d: quality.review_violations(payload(s, d)), """SELECT job_id, 'unresolved_without_pending' AS code, 'pending' AS path
        FROM v_payload WHERE unresolved_count > 0 AND pending_count = 0 UNION ALL SELECT job_id, 'pending_without_unresolved', 'unresolved'
        FROM v_payload WHERE unresolved_count = 0 AND pending_count > 0
        UNION ALL SELECT job_id, 'status_mismatch', 'review_status' FROM v_payload WHERE (review_status = 'needs_review') <> (pending_count
        > 0)"""),
    "Q-5": (
        lambda s, d: quality.quality_link_violations(payload(s, d), sql(s, d, OCR_STATE)),
        "SELECT job_id, 'review_required' AS code, 'review_status' AS path FROM v_payload WHERE job_id % 3 = 0 AND review_status <> 'needs_review'",
    ),
    "Q-6": (
        lambda s, d: quality.coverage_violations(sql(s, d, COVERAGE)),
        f"""WITH c AS (SELECT *, regexp_replace(lower(topic), '[^0-9a-z]+', '', 'g') AS k FROM ({COVERAGE}) a) SELECT job_id, 'empty_topic'
        AS code, 'coverage' AS path FROM c WHERE k = ''
        UNION ALL SELECT job_id, 'destination_mismatch', 'coverage' FROM c WHERE covered <> (destination <> 'not_published')
        UNION ALL SELECT DISTINCT job_id, 'repeated_topic', 'coverage' FROM (SELECT job_id FROM c WHERE k <> '' GROUP BY job_id, k HAVING
        count(*) > 1) q""",
    ),
    "Q-7": (
        lambda s, d: quality.duplicate_units(_lines(s, d).select(F.col("doc_id").alias("job_id"), F.concat(F.lit("s"), F.col("line_no") % 3).alias("section"), F.col("line").alias("text"))),
        f"""SELECT doc_id AS job_id, k, count(*) AS times, string_agg(DISTINCT section, ',' ORDER BY section) AS sections FROM (SELECT
        doc_id, 's' || line_no % 3 AS section, regexp_replace(lower(replace(replace(replace(line, 'ß', 'ss'), 'ª', 'a'), 'º', 'o')),
        '[^0-9a-z一-鿿]+', '', 'g') AS k FROM ({LINES}) l) t
        WHERE length(k) >= 16 GROUP BY 1, 2 HAVING count(*) > 1""",
    ),
    "Q-8": (
        lambda s, d: quality.timeline_coverage(sql(s, d, "SELECT job_id, start_s AS t FROM v_segments"), sql(s, d, "SELECT job_id, CASE WHEN job_id % 4 = 0 THEN 0.0D ELSE max(end_s) END AS duration_s FROM v_segments GROUP BY job_id")),
        """SELECT
        job_id, min(start_s) <= greatest(30.0, 0.15 * any_value(d)) AS first_ok, bool_or(start_s BETWEEN 0.2 * d AND 0.8 * d) AS middle_ok,
        max(start_s) >= 0.8 * any_value(d) AS last_ok
        FROM (SELECT *, max(end_s) OVER (PARTITION BY job_id) AS d FROM v_segments) t WHERE job_id % 4 <> 0 AND d > 0 GROUP BY 1""",
    ),
    "Q-9": (lambda s, d: quality.resolve_related(sql(s, d, REFS), entries(s, d)), f"""SELECT ref_id, r.title,
        CASE WHEN n = 1 THEN e END AS entry_ref, CASE WHEN n IS NULL THEN 'unknown_title' WHEN n > 1 THEN 'ambiguous_title' ELSE 'ok' END AS
        code FROM ({REFS}) r
        LEFT JOIN (SELECT title, count(*) AS n, min(entry_ref) AS e FROM v_entries GROUP BY 1) c ON r.title =
        c.title"""),
    "Q-10": (lambda s, d: quality.visual_violations(sql(s, d, FRAME_REFS), sql(s, d, KNOWN_FRAMES), sql(s, d, STEPS)), f"""WITH r AS
        ({FRAME_REFS}), f AS ({KNOWN_FRAMES}), s AS ({STEPS}) SELECT job_id, 'unknown_frame' AS code, 'visuals' AS path FROM r ANTI JOIN f
        USING (job_id, frame_id) UNION ALL SELECT job_id, 'unknown_step', 'visuals' FROM (SELECT * FROM r WHERE step IS NOT NULL) r ANTI
        JOIN s USING (job_id, step)
        UNION ALL SELECT job_id, 'repeated_frame', 'visuals' FROM r GROUP BY job_id, frame_id HAVING count(*) > 1
        UNION ALL SELECT job_id, 'partly_placed', 'visuals' FROM r GROUP BY job_id HAVING bool_or(step IS NULL) AND NOT bool_and(step IS NULL)"""),
    "Q-11": (
        lambda s, d: quality.section_violations(sql(s, d, "SELECT doc_id AS job_id, 'A (b) [c' AS title, concat(CASE WHEN doc_id % 2 = 0 THEN concat('# Other', chr(10)) ELSE '' END, '# ', CASE WHEN doc_id % 3 = 0 THEN 'A (b)' ELSE 'A (b) [c' END, chr(10), '## Summary', chr(10), CASE WHEN doc_id % 4 = 0 THEN 'short' ELSE replace(text, chr(10), ' ') END, chr(10), '## Steps', chr(10), 'one two three') AS text FROM documents"), ["Summary", "Steps"]),
        """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'short' ELSE replace(text, chr(10), ' ') END AS s, CASE WHEN doc_id % 2 = 0 THEN 8 ELSE 0 END + CASE WHEN doc_id % 3 =
        0 THEN 5 ELSE 8 END AS h FROM documents)
        SELECT doc_id AS job_id, 'short_section' AS code, 'Summary' AS path FROM t WHERE length(trim(s)) < 8 UNION ALL SELECT doc_id,
        'short_body', '' FROM t WHERE h + length(s) + 37 < 600 UNION ALL SELECT doc_id, 'title_mismatch', 'title' FROM t WHERE doc_id % 3 = 0""",
    ),
    "Q-12": (
        lambda s, d: quality.unreviewed_numbers(sql(s, d, NUMBERED), sql(s, d, REVIEWED)).select("job_id", F.array_join(F.array_sort("numbers"), ",").alias("numbers")),
        r"""WITH w AS (SELECT doc_id AS job_id, unnest(string_split(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'), ' ')) AS n FROM documents UNION ALL SELECT doc_id, unnest(['1', '000', '3.5%', '7']) FROM documents)
        SELECT job_id, string_agg(n, ',' ORDER BY n) AS numbers FROM (SELECT DISTINCT job_id, n FROM w WHERE regexp_matches(n, '^[0-9][0-9.%]*$') AND NOT (job_id % 3 <> 0 AND contains('3.5% and 112', n))) t GROUP BY 1""",
    ),
    "Q-13": (lambda s, d: quality.broken_links(sql(s, d, LINKS), sql(s, d, PATHS)), f"""SELECT * FROM (SELECT ref_id, CASE WHEN target LIKE
        '/%' OR target LIKE '../%' THEN 'outside_root' WHEN path IS NULL THEN 'missing_target' END AS code FROM ({LINKS}) l LEFT JOIN
        ({PATHS}) p ON l.target = p.path) t WHERE code IS NOT NULL"""),
    "Q-14": (lambda s, d: quality.draft_verdicts(payload(s, d), _violations(s, d), GATES), r"""SELECT job_id, CASE WHEN unresolved_count > 0
        AND pending_count = 0 THEN 'unresolved_without_pending' WHEN (review_status = 'needs_review') <> (pending_count > 0) THEN
        'status_mismatch'
        WHEN regexp_matches(body, '(^|[^0-9])[0-9]{15,24}($|[^0-9])') THEN 'long_digits' WHEN regexp_matches(body,
        '(?i)\b(job|source|item)[_ -]?id\b') THEN 'id_word' WHEN regexp_matches(body, '(?i)\bitem-[0-9a-f]{20}\b') THEN 'job_name' WHEN
        regexp_matches(body, '(?i)https?://\S+') THEN 'link'
        WHEN unresolved_count = 0 AND pending_count > 0 THEN 'pending_without_unresolved' WHEN regexp_matches(body,
        '(?i)\b(cookie|sessionid?|signature|request[_ -]?url)\b') THEN 'secret_word' ELSE 'ok' END AS verdict FROM v_payload"""),
    "Q-15": (lambda s, d: quality.render_documents(_payloads(s, d)), f"""WITH t AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS l, CAST(to_json(text) AS VARCHAR) AS j FROM v_segments),
        g AS (SELECT job_id, string_agg(l, chr(10) || chr(10) ORDER BY segment_id) AS paras, string_agg('- ' || l, chr(10) ORDER BY segment_id) AS bullets, arg_min(l, segment_id) AS first,
        string_agg('### ' || role || ' ' || segment_id || chr(10) || chr(10) || '**Evidence**: ' || l || CASE WHEN job_id % 4 = 0 THEN '' ELSE chr(10) || chr(10) || '![' || role || '](frames/f' || segment_id || '.jpg)' || chr(10) || chr(10) || '*' || role || '*' END, chr(10) || chr(10) ORDER BY segment_id) AS steps,
        string_agg('- **Claim**: ' || role || chr(10) || '  - **Basis**: ' || l, chr(10) ORDER BY segment_id) AS cases,
        string_agg('- **Term `' || role || '`** → `' || upper(role) || '`: ' || l || ' (verified)', chr(10) ORDER BY segment_id) AS terms, string_agg('- **Number `' || segment_id || '`** → `n`: ' || l || ' (unresolved)', chr(10) ORDER BY segment_id) AS numbers,
        string_agg('- **00:0' || segment_id % 10 || '**: ' || l, chr(10) ORDER BY segment_id) AS times, string_agg(role, ', ' ORDER BY segment_id) AS words,
        string_agg('- **[T' || segment_id || '](p/' || segment_id || ')**: ' || l, chr(10) ORDER BY segment_id) AS related,
        string_agg('- **' || CASE WHEN job_id % 4 = 0 THEN '' ELSE 'Step ' || segment_id + 1 || ' / ' END || 'f' || segment_id || '.jpg**: ' || role, chr(10) ORDER BY segment_id) AS shown,
        string_agg('{{"term":"' || role || '","normalized":"' || upper(role) || '","evidence":' || j || ',"verdict":"verified"}}', ',' ORDER BY segment_id) AS jt,
        string_agg('{{"value":"' || segment_id || '","normalized":"n","evidence":' || j || ',"verdict":"unresolved"}}', ',' ORDER BY segment_id) AS jn,
        string_agg('{{"title":"T' || segment_id || '","path":"p/' || segment_id || '","reason":' || j || '}}', ',' ORDER BY segment_id) AS jr,
        string_agg('{{"frame":"f' || segment_id || '.jpg","argument_step":' || CASE WHEN job_id % 4 = 0 THEN 'null' ELSE CAST(segment_id + 1 AS VARCHAR) END || ',"claim":"' || role || '"}}', ',' ORDER BY segment_id) AS jv, string_agg(j, ',' ORDER BY segment_id) AS jp
        FROM t GROUP BY 1)
        SELECT job_id, '---' || chr(10) || 'schema_version: 2' || chr(10) || 'title: "Conversation ' || job_id || '"' || chr(10) || 'primary_category: "talk"' || chr(10) || 'review_status: "' || CASE WHEN job_id % 2 = 1 THEN 'needs_review' ELSE 'verified' END || '"' || chr(10) || 'tags: ["a","b c"]' || chr(10)
        || 'proper_noun_review: [' || jt || ']' || chr(10) || 'numeric_review: [' || jn || ']' || chr(10) || 'related_knowledge: [' || CASE WHEN job_id % 3 = 0 THEN '' ELSE jr END || ']' || chr(10) || 'visual_evidence: [' || jv || ']' || chr(10) || 'pending_review: [' || CASE WHEN job_id % 2 = 1 THEN jp ELSE '' END || ']' || chr(10) || '---' || chr(10) || chr(10) || '# Conversation ' || job_id
        || {" || ".join(f"chr(10) || chr(10) || '## {quality.HEADINGS[h]}' || chr(10) || chr(10) || {x}" for h, x in RENDERED.items())} || chr(10) AS document FROM g"""),
    "Q-16": (lambda s, d: quality.admit_candidates(sql(s, d, CANDS), sql(s, d, PACKETS), sql(s, d, CURRENT), sql(s, d, DECIDED)), f"""SELECT
        c.job_id, CASE WHEN p.sha256 IS NULL THEN 'unknown_job' WHEN c.job_id % 13 = 0 THEN 'bad_fields' WHEN version <> 1 THEN 'bad_version' WHEN schema_version <> 2 THEN 'bad_schema_version' WHEN job_ref <> c.job_id THEN 'wrong_job' WHEN c.packet_sha256 <> p.sha256 THEN
        'stale_packet' WHEN u.candidate_sha256 IS NULL THEN 'admitted'
        WHEN u.candidate_sha256 = c.candidate_sha256 THEN 'reused' WHEN u.packet_sha256 <> p.sha256 OR decision IS NOT DISTINCT FROM
        'reject' THEN 'replaced' ELSE 'conflict' END AS outcome FROM ({duck(CANDS)}) c LEFT JOIN ({PACKETS}) p USING (job_id) LEFT JOIN
        ({CURRENT}) u USING (job_id) LEFT JOIN ({DECIDED}) r USING (job_id)"""),
    "Q-17": (
        lambda s, d: quality.current_candidates(sql(s, d, CANDS), sql(s, d, PACKETS)).select("job_id", "candidate_sha256"),
        f"SELECT c.job_id, candidate_sha256 FROM ({duck(CANDS)}) c SEMI JOIN ({PACKETS}) p ON c.job_id = p.job_id AND c.packet_sha256 = p.sha256",
    ),
    "Q-18": (
        lambda s, d: quality.repair_routes(sql(s, d, REJECTIONS), sql(s, d, REPAIRABLE)),
        f"SELECT job_id, code, CASE WHEN code IN ('duplicate_text', 'short_section') AND repairs = 0 THEN 'repair' ELSE 'regenerate' END AS route FROM ({REJECTIONS}) t",
    ),
    "Q-19": (
        lambda s, d: quality.acceptance_matrix(*[sql(s, d, q) for q in MATRIX.values()], ["## Note", "##"]),
        """SELECT *, source_hash AND manifest AND structured_note AND high_quality AND real_classification AND privacy AND library AND
        projection AND registry AS accepted FROM (
        SELECT doc_id AS job_id, doc_id % 9 NOT IN (1, 2) AS source_hash, doc_id % 9 <> 1 AND doc_id % 8 NOT IN (1, 2) AS manifest, doc_id %
        7 <> 1 AND doc_id % 5 <> 2 AS structured_note, doc_id % 7 <> 1 AND doc_id % 6 <> 1 AS high_quality,
        doc_id % 7 <> 1 AND source IS NOT NULL AND source <> '' AND doc_id % 11 <> 1 AND doc_id % 13 <> 1 AS real_classification,
        NOT regexp_matches(CASE WHEN doc_id % 7 <> 1 THEN coalesce(text, '') ELSE '' END || chr(10) || CASE WHEN doc_id % 10 <> 1 THEN
        coalesce(text, '') ELSE '' END, '(?i)\\b(cookie|signature|request[_ -]?url)\\b|\\bitem-[0-9a-f]{20}\\b') AS privacy,
        doc_id % 7 <> 1 AS library, doc_id % 10 <> 1 AS projection, doc_id % 12 <> 1 AS registry FROM documents) t""",
    ),
    "L-1": (lambda s, d: ledger.request_hash(targets(s, d)), """SELECT saga_id, count(*) AS targets, SHA('[' || string_agg('["' ||
        target_name || '","' || coalesce(expected_sha256, '') || '"]', ',' ORDER BY target_name) || ']') AS request_sha256 FROM v_targets
        GROUP BY 1"""),
    "L-2": (
        lambda s, d: ledger.begin(_requests(s, d), _held(s, d), sql(s, d, JOBS)),
        f"""WITH q AS (SELECT * REPLACE (lower(draft_sha256) AS draft_sha256, replace(h2, chr(92), '/') AS h2) FROM ({REQUESTS}) t),
        r AS (SELECT *, row_number() OVER w AS turn, first_value(request_sha256) OVER w AS r1, first_value(job_ref) OVER w AS j1,
        first_value(draft_sha256) OVER w AS d1, first_value(h1) OVER w AS f1, first_value(h2) OVER w AS f2
            FROM q WINDOW w AS (PARTITION BY idempotency_key ORDER BY request_id)),
        j AS (SELECT r.*, k.job_id, h.idempotency_key IS NOT NULL AS held, h.idempotency_key IS NOT NULL OR turn > 1 AS known,
        coalesce(h.request_sha256, r1) AS rq, coalesce(h.job_ref, j1) AS jr, coalesce(h.draft_sha256, d1) AS dr,
            coalesce(h.media_sha256, SHA('m')) AS mr, coalesce(h.state, 'intent') AS state, coalesce(h.h1, f1) AS o1, coalesce(h.h2, f2) AS
        o2, coalesce(h.st2, 'pending') AS st2
            FROM r LEFT JOIN ({HELD}) h ON r.idempotency_key = h.idempotency_key LEFT JOIN ({JOBS}) k ON r.job_ref = k.job_id)
        SELECT request_id, CASE WHEN trim(job_ref) = '' THEN 'bad_request' WHEN h1 = '' OR h1 LIKE '%..%' THEN 'bad_handle' WHEN s2 = 'bad'
        OR draft_sha256 = 'short' THEN 'bad_digest' WHEN job_id IS NULL THEN 'unknown_job'
        WHEN NOT known THEN 'new' WHEN rq = request_sha256 THEN 'reused' WHEN state = 'intent' AND jr = job_ref AND dr = draft_sha256 AND mr
        = media_sha256 AND s2 IS NULL AND (h1 <> o1 OR h2 <> o2) AND NOT (h2 <> o2 AND st2 = 'verified')
        THEN 'retargeted' ELSE 'conflict' END AS outcome FROM j""",
    ),
    "L-3": (
        lambda s, d: ledger.seal(ledger.reconcile_targets(targets(s, d)).withColumnRenamed("target_status", "status"), sql(s, d, EXPECTED), sagas(s, d)),
        f"""SELECT q.saga_id, CASE WHEN odd > 0 THEN 'name_mismatch' WHEN state = 'accepted' THEN CASE WHEN other + op > 0 THEN 'conflict' ELSE 'reused' END
        WHEN other > 0 AND (state <> 'intent' OR fixed > 0) THEN 'conflict' WHEN other > 0 THEN 'resealed' WHEN op > 0 THEN 'sealed' ELSE 'reused' END AS outcome FROM (SELECT coalesce(t.saga_id, e.saga_id) AS
        saga_id, count(*) FILTER (t.target_name IS NULL OR e.target_name IS NULL) AS odd,
        count(*) FILTER (nullif(t.expected_sha256, '') <> e.sha256) AS other, count(*) FILTER (nullif(t.expected_sha256, '') <> e.sha256 AND t.observed_sha256 = t.expected_sha256) AS fixed, count(*) FILTER (nullif(t.expected_sha256, '') IS NULL) AS op
        FROM v_targets t FULL OUTER JOIN ({EXPECTED}) e ON t.saga_id = e.saga_id AND t.target_name = e.target_name GROUP BY 1) q LEFT JOIN v_sagas s ON q.saga_id = s.saga_id""",
    ),
    "L-4": (
        lambda s, d: ledger.reconcile_targets(targets(s, d)).select("saga_id", "target_name", "target_status"),
        f"SELECT saga_id, target_name, {STATUS} AS target_status FROM v_targets",
    ),
    "L-5": (lambda s, d: ledger.saga_states(sagas(s, d), targets(s, d)), f"""SELECT s.saga_id, CASE WHEN s.state = 'accepted' OR l.saga_id
        IS NULL THEN s.state WHEN coalesce(good, false) THEN 'published_unaccepted' ELSE 'intent' END AS state FROM v_sagas s LEFT JOIN
        ({LATEST}) l ON s.saga_id = l.saga_id
        LEFT JOIN (SELECT saga_id, bool_and({STATUS} = 'verified') AS good FROM v_targets GROUP BY 1) g ON s.saga_id = g.saga_id"""),
    "L-6": (
        lambda s, d: ledger.latest_sagas(sagas(s, d)).select("saga_id", "job_ref", "state"),
        f"SELECT saga_id, job_ref, state FROM ({LATEST}) l",
    ),
    "L-7": (
        lambda s, d: ledger.backfill_superseded(sagas(s, d), sql(s, d, ACCEPTANCES)),
        f"""SELECT saga_id, superseded_by, since AS superseded_at FROM (SELECT v.saga_id, superseded_at, lead(v.saga_id) OVER w AS
        superseded_by, lead(coalesce(accepted_at, updated_at)) OVER w AS since
        FROM v_sagas v LEFT JOIN ({ACCEPTANCES}) a ON v.saga_id = a.saga_id WHERE state = 'accepted' WINDOW w AS (PARTITION BY job_ref ORDER
        BY created_at, v.saga_id)) t WHERE superseded_by IS NOT NULL AND superseded_at IS NULL""",
    ),
    "L-8": (
        lambda s, d: _accepted(s, d),
        f"""WITH n AS (SELECT job_ref, max(row(created_at, saga_id)) AS top FROM v_sagas WHERE state = 'accepted' GROUP BY 1),
        o AS (SELECT f.saga_id, s.job_ref, s.created_at, CASE WHEN s.state IS NULL THEN 'unknown_saga' WHEN s.state = 'accepted' THEN
        'already_accepted' WHEN s.state <> 'published_unaccepted' THEN 'not_published'
            WHEN coalesce(n.top > row(s.created_at, s.saga_id), false) THEN 'superseded' WHEN m = 2 THEN 'missing_checks' WHEN m IN (0, 3)
        THEN 'failed_checks' WHEN i.job_id IS NULL THEN 'unknown_job' ELSE 'accepted' END AS outcome
            FROM ({FLAGS}) f LEFT JOIN v_sagas s ON f.saga_id = s.saga_id LEFT JOIN n ON s.job_ref = n.job_ref LEFT JOIN ({ITEM_STATES}) i
        ON s.job_ref = i.job_id),
        a AS (SELECT job_ref, max(row(created_at, saga_id)) AS top, arg_max(saga_id, row(created_at, saga_id)) AS id FROM o WHERE outcome =
        'accepted' GROUP BY 1)
        SELECT s.saga_id, outcome, CASE WHEN outcome = 'accepted' THEN 'accepted' ELSE state END AS state,
        CASE WHEN a.id IS NOT NULL AND a.id <> s.saga_id AND (outcome = 'accepted' OR (state = 'accepted' AND superseded_at IS NULL)) THEN
        a.id END AS superseded_by
        FROM v_sagas s LEFT JOIN o ON s.saga_id = o.saga_id LEFT JOIN a ON s.job_ref = a.job_ref""",
    ),
    "L-9": (
        lambda s, d: ledger.completed_without_acceptance(sql(s, d, "SELECT collection AS job_id, source_id, status FROM v_src"), sagas(s, d)).select("job_id", "source_id"),
        "SELECT collection AS job_id, source_id FROM v_src WHERE status = 'completed' AND collection NOT IN (SELECT job_ref FROM v_sagas WHERE state = 'accepted')",
    ),
    "L-10": (lambda s, d: ledger.ledger_status(sagas(s, d), targets(s, d)), f"""SELECT state, count(*) AS jobs FROM ({LATEST}) l GROUP BY 1
        UNION ALL SELECT 'drifted', count(DISTINCT job_ref) FROM ({LATEST}) l WHERE state = 'accepted' AND saga_id IN (SELECT saga_id FROM
        v_targets WHERE {STATUS} <> 'verified')"""),
    "L-11": (lambda s, d: ledger.append_reviews(reviews(s, d), sql(s, d, NEW_REVIEWS)), f"""SELECT n.job_ref, n.candidate_sha256,
        n.decision, SHA(note) AS note_sha256 FROM ({NEW_REVIEWS}) n LEFT JOIN (SELECT job_ref, candidate_sha256, arg_max(decision,
        review_id) AS d, arg_max(note_sha256, review_id) AS h FROM v_reviews GROUP BY 1, 2) l
        ON n.job_ref = l.job_ref AND n.candidate_sha256 = l.candidate_sha256 WHERE d IS NULL OR d <> n.decision OR h <> SHA(note)"""),
    "L-12": (
        lambda s, d: ledger.latest_decisions(reviews(s, d)),
        "SELECT job_ref, candidate_sha256, arg_max(decision, review_id) AS decision, max(review_id) AS review_id FROM v_reviews GROUP BY 1, 2",
    ),
    "L-13": (lambda s, d: ledger.list_reviews(reviews(s, d), 7), "SELECT * FROM v_reviews WHERE job_ref = 7"),
    "L-14": (lambda s, d: ledger.upsert_projection(sql(s, d, PUBLISHED), sql(s, d, REPUBLISHED)), f"""SELECT coalesce(p.key, n.key) AS key,
        coalesce(n.location, p.location) AS location, coalesce(p.first_published_at, n.published_at) AS first_published_at,
        coalesce(n.published_at, p.updated_at) AS updated_at FROM ({PUBLISHED}) p FULL OUTER JOIN ({REPUBLISHED}) n ON p.key = n.key"""),
    "W-1": (
        lambda s, d: work.plan(items(s, d), 5).select("job_id", "status", "last_position"),
        "SELECT job_id, status, last_position FROM v_items WHERE currently_collected AND status <> 'completed' ORDER BY last_position, job_id LIMIT 5",
    ),
    "W-2": (
        lambda s, d: work.fixed_plan(sql(s, d, f"{WANTED} UNION ALL SELECT concat('item-', substr(SHA(source_id), 1, 20)), status FROM v_src WHERE k % 35 = 2"), items(s, d)),
        f"""WITH
        w AS ({WANTED} UNION ALL SELECT concat('item-', substr(SHA(source_id), 1, 20)), status FROM v_src WHERE k % 35 = 2), c AS (SELECT
        job_id, count(*) AS n, min(expected_status) AS e FROM w GROUP BY 1)
        SELECT c.job_id, CASE WHEN n > 1 THEN 'repeated' WHEN status IS NULL THEN 'missing' WHEN NOT currently_collected THEN 'uncollected'
        WHEN status <> e THEN 'status_changed' ELSE 'ok' END AS problem FROM c LEFT JOIN v_items i ON c.job_id = i.job_id""",
    ),
    "W-3": (
        lambda s, d: work.overlap(items(s, d).select("job_id"), work.claimed_jobs(sql(s, d, BATCHES), sql(s, d, FINISHED))),
        f"SELECT job_id FROM v_items WHERE job_id IN (SELECT job_id FROM ({BATCHES}) b WHERE batch_id NOT IN (SELECT batch_id FROM ({FINISHED}) f))",
    ),
    "W-4": (
        lambda s, d: work.job_stages(*[sql(s, d, q) for q in (JOB_FLAGS, PUBLICATIONS, CHECKPOINTS, ANSWERS)], **{n: sql(s, d, q) for n, q in HAVE.items()}),
        f"""SELECT j.job_id, CASE WHEN done AND coalesce(targets_verified, false) THEN 'accepted' WHEN done OR NOT currently_collected OR
        coalesce(paused, false) OR status IN ('failed', 'incomplete') THEN 'failed'
        WHEN imported AND j.job_id % 7 < 2 THEN 'staged' WHEN current THEN 'semantic_ready' WHEN j.job_id % 5 < 2 THEN 'packet_ready' WHEN
        j.job_id % 4 < 2 THEN 'analyzed' WHEN j.job_id % 3 < 2 THEN 'downloaded' ELSE 'planned' END AS stage,
        CASE WHEN done AND NOT coalesce(targets_verified, false) THEN 'publication_target_drift' WHEN NOT done AND NOT currently_collected
        THEN 'job_no_longer_collected' ELSE error END AS error_code
        FROM (SELECT f.*, p.targets_verified, c.paused, c.error, a.current, a.imported, status = 'completed' AND state IS NOT DISTINCT FROM
        'accepted' AS done FROM ({JOB_FLAGS}) f LEFT JOIN ({PUBLICATIONS}) p ON f.job_id = p.job_id
        LEFT JOIN ({CHECKPOINTS}) c ON f.job_id = c.job_id LEFT JOIN ({ANSWERS}) a ON f.job_id = a.job_id) j""",
    ),
    "W-5": (lambda s, d: work.job_spans(stage_events(s, d), sql(s, d, JOB_BATCHES)), f"""SELECT *, round((epoch_us(last_at) - epoch_us(first_at)) / 1000000.0, 3) AS elapsed_s FROM
        (SELECT b.job_id, coalesce(min(v.at), any_value(created_at)) AS first_at, coalesce(max(v.at), any_value(created_at)) AS last_at FROM ({JOB_BATCHES}) b LEFT JOIN
        v_stage_events v ON b.job_id = v.job_id AND v.at >= created_at GROUP BY 1) t"""),
    "W-6": (lambda s, d: work.batch_rollup(sql(s, d, STAGED)).withColumn("by_stage", F.array_join(F.transform(F.map_entries("by_stage"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")), f"""SELECT t.*, by_stage, CASE WHEN accepted = jobs THEN 'complete' WHEN failed > 0 THEN
        'blocked' ELSE 'running' END AS state FROM (SELECT batch_id, count(*) AS jobs, count(*) FILTER (stage = 'accepted') AS accepted,
        count(*) FILTER (stage = 'failed') AS failed FROM ({STAGED}) s GROUP BY 1) t
        JOIN (SELECT batch_id, string_agg(stage || ':' || n, ',' ORDER BY stage) AS by_stage FROM (SELECT batch_id, stage, count(*) AS n FROM ({STAGED}) s GROUP BY 1, 2) c GROUP BY 1) u ON t.batch_id = u.batch_id"""),
    "W-7": (
        lambda s, d: work.recommend(sql(s, d, STAGED), sql(s, d, "SELECT o_orderkey AS job_id FROM orders WHERE o_orderkey % 4 = 3"), 2),
        f"""WITH b AS (SELECT DISTINCT batch_id FROM ({STAGED}) t WHERE active), k AS (SELECT *, CASE WHEN stage IN ('planned',
        'downloaded', 'analyzed') AND batch_id NOT IN (SELECT batch_id FROM b) THEN 'cpu'
            WHEN stage = 'packet_ready' AND job_id % 4 <> 3 THEN 'semantic' WHEN stage = 'semantic_ready' THEN 'import' WHEN stage =
        'staged' THEN 'publish' WHEN stage = 'failed' THEN 'failed' END AS kind FROM ({STAGED}) t)
        SELECT batch_id, kind, place, job_id FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, kind ORDER BY position, job_id) AS
        place FROM k WHERE kind IS NOT NULL) q
        WHERE CASE WHEN kind IN ('cpu', 'publish') THEN place <= 1 WHEN kind = 'semantic' THEN place <= 2 ELSE true END""",
    ),
    "W-8": (
        lambda s, d: work.stage_attempts(sql(s, d, ATTEMPTS)),
        f"""WITH m AS (SELECT *, lead(event) OVER w AS ne, lead(q.at) OVER w AS na, lead(reused) OVER w AS nr, lag(event) OVER w AS pe FROM
        ({ATTEMPTS}) q WINDOW w AS (PARTITION BY job_id, stage ORDER BY q.at, event_id)),
        a AS (SELECT job_id, stage, event_id, m.at, CASE WHEN event = 'started' THEN m.at END AS started_at, CASE WHEN event <> 'started'
        THEN m.at WHEN ne <> 'started' THEN na END AS ended_at,
            CASE WHEN event <> 'started' THEN event WHEN ne <> 'started' THEN ne ELSE 'running' END AS status, coalesce(CASE WHEN event <>
        'started' THEN reused WHEN ne <> 'started' THEN nr END, false) AS reused
            FROM m WHERE event = 'started' OR pe IS DISTINCT FROM 'started')
        SELECT job_id, stage, row_number() OVER (PARTITION BY job_id, stage ORDER BY a.at, event_id) AS attempt, started_at, ended_at,
        status, reused,
        CASE WHEN started_at IS NOT NULL AND ended_at IS NOT NULL THEN round((epoch_us(ended_at) - epoch_us(started_at)) / 1000000.0, 3) END
        AS duration_s FROM a""",
    ),
    "W-9": (lambda s, d: work.failure_budget(stage_events(s, d)), """WITH m AS (SELECT *, count(*) FILTER (outcome = 'completed') OVER
        (PARTITION BY job_id, stage ORDER BY v.at, event_id) AS island, count(*) FILTER (outcome = 'completed') OVER (PARTITION BY job_id,
        stage) AS last FROM v_stage_events v)
        SELECT job_id, stage, error_code, count(*) AS failures, count(*) >= 2 AS blocked FROM m WHERE outcome = 'failed' AND island = last
        GROUP BY 1, 2, 3"""),
    "W-10": (
        lambda s, d: work.stale_leases(sql(s, d, LEASES), F.to_timestamp_ntz(F.lit("2024-01-15 12:00:00"))),
        f"SELECT * FROM ({LEASES}) l WHERE acquired_at < TIMESTAMP '2024-01-15 10:00:00'",
    ),
    "W-11": (lambda s, d: work.capacity(sql(s, d, POOLS), 900), f"""SELECT pool, count(*) FILTER (active) AS active, greatest(0, 900 -
        count(*) FILTER (active)) AS available, (SELECT count(*) FROM (SELECT job_id FROM ({POOLS}) q WHERE active AND q.pool = p.pool GROUP
        BY job_id HAVING count(*) > 1) z) AS repeated FROM ({POOLS}) p GROUP BY pool"""),
    "W-12": (
        lambda s, d: work.assignment_mismatches(sql(s, d, ASSIGNED), sql(s, d, DECLARED), "p_partkey", ["p_brand", "p_size", "p_type"]),
        """SELECT
        p_partkey, 'manifest' AS field FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT p_partkey, 'p_brand' FROM part WHERE p_partkey %
        8 = 0 AND p_partkey % 10 <> 0 UNION ALL SELECT p_partkey, 'p_size' FROM part WHERE p_partkey % 9 = 0 AND p_partkey % 10 <> 0""",
    ),
    "W-13": (
        lambda s, d: work.run_report(sql(s, d, BEFORE), sql(s, d, AFTER), sql(s, d, RECORDS)),
        f"""WITH j AS (SELECT coalesce(b.job_id, a.job_id) AS job_id, CASE WHEN a.status IS NULL THEN 'gone' WHEN a.status = 'completed' AND
        b.status IS DISTINCT FROM 'completed' THEN 'completed_now'
        WHEN a.status = 'completed' THEN 'completed_before' WHEN b.status IS NULL THEN 'new' ELSE 'remaining' END AS outcome FROM ({BEFORE})
        b FULL OUTER JOIN ({AFTER}) a ON b.job_id = a.job_id)
        SELECT outcome, j.job_id, coalesce(title, 'untitled') AS title, category, coalesce(accepted, false) AS accepted, 1 AS jobs FROM j
        LEFT JOIN ({RECORDS}) r ON j.job_id = r.job_id WHERE outcome = 'completed_now'
        UNION ALL SELECT outcome, NULL, NULL, NULL, NULL, count(*) FROM j GROUP BY 1""",
    ),
    "B-1": (lambda s, d: catalog.index_all(entries(s, d)), "SELECT * FROM v_entries"),
    "B-2": (
        lambda s, d: catalog.index_by_category(entries(s, d)),
        "SELECT category, row_number() OVER (PARTITION BY category ORDER BY title, entry_ref) AS place, title, entry_ref FROM v_entries",
    ),
    "B-3": (
        lambda s, d: catalog.index_by_tag(sql(s, d, TAGGED)),
        f"SELECT tag, row_number() OVER (PARTITION BY tag ORDER BY entry_ref) AS place, entry_ref FROM (SELECT DISTINCT entry_ref, unnest(tags) AS tag FROM ({duck(TAGGED)}) t) u",
    ),
    "B-4": (lambda s, d: catalog.recent(sql(s, d, DATED)), f"SELECT * FROM ({DATED}) t ORDER BY added_at DESC, entry_ref LIMIT 50"),
    "B-5": (
        lambda s, d: sql(s, d, "SELECT page_id, CASE WHEN page_id % 9 = 0 THEN ' .-' WHEN page_id % 9 = 1 THEN 'con' WHEN page_id % 9 = 2 THEN 'con.x' ELSE concat(' -', regexp_extract(url, '://(.*)', 1), '/. ') END AS name FROM pages").select("page_id", safe_component(F.col("name")).alias("name")),
        r"""SELECT
        page_id, CASE WHEN page_id % 9 = 2 THEN 'con.x' WHEN page_id % 9 > 2 THEN rtrim(left(trim(regexp_replace(regexp_extract(url, '://(.*)', 1), '[<>:"/\\|?*]', '-', 'g'), ' .-'), 80), ' .-') END AS name FROM pages""",
    ),
    "B-6": (lambda s, d: catalog.normalize_tags(sql(s, d, SPELLED)).select("entry_ref", F.array_join("tags", ",").alias("tags"), "error"), f"""SELECT
        entry_ref, CASE WHEN bool_and(name <> '' AND upper(name) <> 'CON') THEN string_agg(name, ',' ORDER BY i) FILTER (r = 1) END AS tags, CASE WHEN NOT bool_and(name <> '' AND upper(name) <> 'CON') THEN 'unsafe_tag' END AS error
        FROM (SELECT *, row_number() OVER (PARTITION BY entry_ref, lower(name) ORDER BY i) AS r
        FROM (SELECT entry_ref, trim(replace(unnest(tags), '/', '-'), ' .-') AS name, unnest(range(len(tags))) AS i FROM ({duck(SPELLED)}) t) u) q GROUP BY 1
        UNION ALL SELECT entry_ref, NULL, 'tags_required' FROM ({duck(SPELLED)}) t WHERE len(tags) = 0"""),
    "B-7": (
        lambda s, d: catalog.assign_names(sql(s, d, STEMS), sql(s, d, NAMED)),
        f"""WITH n AS ({NAMED}), f AS (SELECT job_id, category, rtrim(stem, ' .-') AS name FROM ({STEMS}) s WHERE job_id NOT IN (SELECT
        job_id FROM n)),
        won AS (SELECT job_id, category, name FROM (SELECT *, row_number() OVER (PARTITION BY category, name ORDER BY job_id) AS turn FROM
        f) t WHERE turn = 1 AND (category, name) NOT IN (SELECT (category, name) FROM n)),
        lost AS (SELECT *, row_number() OVER (PARTITION BY category, name ORDER BY job_id) AS r FROM f WHERE job_id NOT IN (SELECT job_id
        FROM won)),
        held AS (SELECT DISTINCT category, regexp_extract(name, '^(.*) [(]([0-9]+)[)]$', 1) AS name, TRY_CAST(regexp_extract(name,
        '^(.*) [(]([0-9]+)[)]$', 2) AS BIGINT) AS n FROM (SELECT category, name FROM n UNION SELECT category, name FROM won) x),
        free AS (SELECT category, name, k, row_number() OVER (PARTITION BY category, name ORDER BY k) AS r FROM (SELECT DISTINCT category,
        name FROM lost) l, (SELECT unnest(range(2, 2000)) AS k) g
            WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.category = l.category AND h.name = l.name AND h.n = g.k))
        SELECT job_id, category, name || ' (' || k || ')' AS name FROM lost JOIN free USING (category, name, r) UNION ALL SELECT job_id,
        category, name FROM won UNION ALL SELECT job_id, category, name FROM n""",
    ),
    "B-8": (
        lambda s, d: _exported(s, d),
        "SELECT entry_ref, title, coalesce(nullif(category, ''), '__HIVE_DEFAULT_PARTITION__') AS category FROM v_entries",
    ),
    "B-9": (
        lambda s, d: catalog.verify_entries(sql(s, d, "SELECT o_orderkey AS entry_ref FROM orders"), sql(s, d, PARTS), REQUIRED),
        f"""WITH
        a AS (SELECT entry_ref, 3 - count(DISTINCT CASE WHEN rel_path IN ('note.md', 'media.mp4', 'data.json') THEN rel_path END) AS
        missing, count(*) FILTER (sha256 <> expected_sha256) AS changed, count(*) FILTER (rel_path LIKE 'frames/%') AS frames FROM ({PARTS})
        p GROUP BY 1)
        SELECT o_orderkey AS entry_ref, CASE WHEN missing IS NULL OR missing > 0 THEN 'missing_artifact' WHEN changed > 0 THEN
        'digest_mismatch' WHEN NOT frames BETWEEN 3 AND 8 THEN 'frame_count' ELSE 'ok' END AS problem FROM orders LEFT JOIN a ON o_orderkey
        = entry_ref""",
    ),
    "B-10": (lambda s, d: _legacy(s, d), f"""WITH a AS (SELECT entry_ref, bool_or(rel_path = 'note.md') AS n, bool_or(rel_path =
        'media.mp4') AS m, bool_or(rel_path = 'data.json') AS j FROM ({PARTS}) p GROUP BY 1)
        SELECT kind, count(*) AS n FROM (SELECT CASE WHEN n AND m AND j THEN 'complete' WHEN n AND m THEN 'repairable' ELSE 'blocked' END AS
        kind FROM a UNION ALL SELECT 'note.md' FROM a WHERE NOT n UNION ALL SELECT 'media.mp4' FROM a WHERE NOT m UNION ALL SELECT
        'data.json' FROM a WHERE NOT j) t GROUP BY 1"""),
    "B-11": (
        lambda s, d: catalog.resolve_entry_refs(sql(s, d, REF_KEYS), _dict_sources(s, d)),
        "WITH " + ", ".join(f"u_{k} AS (SELECT {'media_sha256' if k == 'fingerprint' else 'entry_ref'} AS k, min(job_id) AS j FROM ({q}) t GROUP BY 1 HAVING count(DISTINCT job_id) = 1)" for k, q in BY_SOURCE.items()) + f"""
        SELECT e.entry_ref, coalesce(m.j, c.j, r.j, f.j) AS job_id, CASE WHEN m.j IS NOT NULL THEN 'manifest' WHEN c.j IS NOT NULL THEN
        'checkpoint' WHEN r.j IS NOT NULL THEN 'registry' WHEN f.j IS NOT NULL THEN 'fingerprint' ELSE 'blocked' END AS source
        FROM ({REF_KEYS}) e LEFT JOIN u_manifest m ON e.entry_ref = m.k LEFT JOIN u_checkpoint c ON e.entry_ref = c.k LEFT JOIN u_registry r
        ON e.entry_ref = r.k LEFT JOIN u_fingerprint f ON e.media_sha256 = f.k""",
    ),
    "B-12": (lambda s, d: catalog.authoritative_sources(sql(s, d, SOURCE_REFS)), f"""SELECT entry_ref, source_ref, CASE WHEN strong = 1 AND
        kind <> 'fingerprint' THEN 'authoritative' WHEN strong = 1 THEN 'skipped' WHEN strong = 0 AND alone = 1 THEN 'authoritative' ELSE
        'conflict' END AS verdict
        FROM (SELECT *, count(*) FILTER (kind <> 'fingerprint') OVER (PARTITION BY entry_ref) AS strong, count(*) OVER (PARTITION BY
        entry_ref) AS alone FROM ({SOURCE_REFS}) r) t"""),
    "B-13": (lambda s, d: catalog.migration_plan(sql(s, d, MOVE_SOURCES), sql(s, d, MOVE_STATE)), f"""SELECT coalesce(s.entry_ref,
        c.entry_ref) AS entry_ref, CASE WHEN c.entry_ref IS NULL THEN 'new' WHEN s.entry_ref IS NULL THEN 'source_missing' WHEN
        s.source_sha256 <> c.source_sha256 THEN 'source_changed' WHEN target_sha256 IS DISTINCT FROM observed_sha256 THEN 'target_differs'
        ELSE 'reuse' END AS action
        FROM ({MOVE_SOURCES}) s FULL OUTER JOIN ({MOVE_STATE}) c ON s.entry_ref = c.entry_ref"""),
    "B-14": (lambda s, d: catalog.migration_ready(sql(s, d, MOVE_SOURCES), sql(s, d, MOVE_STATE), sql(s, d, BOUND)), f"""WITH p AS (SELECT
        coalesce(s.entry_ref, c.entry_ref) AS e, CASE WHEN c.entry_ref IS NULL OR s.entry_ref IS NULL OR s.source_sha256 <> c.source_sha256
        THEN 'unmatched' WHEN target_sha256 IS DISTINCT FROM observed_sha256 THEN 'off' ELSE 'reuse' END AS a
        FROM ({MOVE_SOURCES}) s FULL OUTER JOIN ({MOVE_STATE}) c ON s.entry_ref = c.entry_ref) SELECT count(*) AS entries, count(*) FILTER
        (a = 'unmatched') AS unmatched, count(*) FILTER (a = 'off') AS off_target, count(*) FILTER (e % 8 = 0) AS unbound, bool_and(a =
        'reuse' AND e % 8 <> 0) AS ready FROM p"""),
    "B-15": (lambda s, d: catalog.rebind_targets(items(s, d), sql(s, d, MOVES)), f"""SELECT m.job_id, CASE WHEN i.job_id IS NOT NULL AND
        library_path <> to_path AND library_path = from_path THEN to_path ELSE library_path END AS library_path, CASE WHEN i.job_id IS NULL
        THEN 'unknown_job' WHEN library_path = to_path THEN 'already' WHEN library_path = from_path THEN 'moved' ELSE 'mismatch' END AS
        outcome
        FROM ({MOVES}) m LEFT JOIN v_items i ON m.job_id = i.job_id"""),
    "B-16": (lambda s, d: catalog.checkpoint_violations(sql(s, d, CHECKPOINT)), f"""WITH c AS (SELECT *, count(*) OVER (PARTITION BY
        target_path) AS n FROM ({CHECKPOINT}) t) SELECT entry_ref, 'repeated_target' AS code FROM c WHERE n > 1 UNION ALL SELECT entry_ref,
        'unsafe_path' FROM c WHERE target_path LIKE '/%' OR target_path LIKE '../%'
        UNION ALL SELECT entry_ref, 'bad_digest' FROM c WHERE NOT regexp_matches(sha256, '^[0-9a-f]{{64}}$')"""),
}


def _exported(s, d):
    """The entries that were exported by category, read again."""
    path = files.shared_folder(s)
    files.export_entries(entries(s, d).select("entry_ref", "title", "category"), path)
    back = s.read.schema("entry_ref long, title string, category string").json(path)
    return back.select("entry_ref", "title", F.coalesce("category", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("category"))


def _classes(s, d):
    """The sizes of classes of equal frames, each frame being there twice, and the links between classes."""
    twice = _signed(s, d).select("job_id", "frame_id", "signature", "bits")
    members, links = frames.near_duplicate_classes(twice.union(twice.withColumn("frame_id", F.col("frame_id") + 1000000)), 0.24)
    sizes = members.groupBy("job_id", F.col("class_id").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("job_id", "a", F.lit(None).cast("long").alias("b"), "n", F.lit(None).cast("double").alias("ratio")).union(links.select("job_id", "a", "b", F.lit(None).cast("long"), "ratio"))


def _candidates(s, d):
    return frames.frame_candidates(_scored(s, d), sql(s, d, DURATIONS), threshold=0.155).join(_signed(s, d).select("job_id", "frame_id", "signature", "bits"), ["job_id", "frame_id"])


def _neighbours(s, d):
    a = _signed(s, d)
    b = a.select("job_id", F.col("frame_id").alias("b"), (F.col("t") - 5).alias("t"), F.col("signature").alias("sb"))
    ratio = F.round(frames.hamming_ratio(F.col("signature"), F.col("sb"), F.col("bits")), 6)
    return a.join(b, ["job_id", "t"]).select("job_id", F.col("frame_id").alias("a"), "b", ratio.alias("ratio"))


def _payloads(s, d):
    """A payload of each conversation: its turns are what every section lists."""
    turns = F.array_sort(F.collect_list(F.struct("segment_id", "role", "text")))
    rows = segs(s, d).groupBy("job_id").agg(turns.alias("a"))
    each = lambda **fields: F.transform("a", lambda x: F.struct(*[f(x).alias(n) for n, f in fields.items()]))
    texts, none = F.transform("a", lambda x: x["text"]), F.array().cast("array<string>")
    number, said, role = (lambda x: x["segment_id"].cast("string")), (lambda x: x["text"]), (lambda x: x["role"])
    fixed = lambda v: lambda x: F.lit(v)
    named = lambda before, after="": lambda x: F.concat(F.lit(before), number(x), F.lit(after))
    odd, related = F.col("job_id") % 2 == 1, each(title=named("T"), path=named("p/"), reason=said)
    return rows.select(
        "job_id", F.concat(F.lit("Conversation "), F.col("job_id")).alias("title"), F.lit("talk").alias("primary_category"), F.array(F.lit(" a"), F.lit("b  c")).alias("tags"), F.when(odd, "needs_review").otherwise("verified").alias("review_status"),
        F.col("a")[0]["text"].alias("one_sentence_summary"), *[texts.alias(c) for c in ("content_summary", "core_points", "reusable_knowledge", "action_items")], F.transform("a", role).alias("keywords"),
        each(step=lambda x: x["segment_id"] + 1, claim=lambda x: F.concat(role(x), F.lit("  "), number(x)), evidence=said).alias("argument_structure"), each(claim=role, evidence=said).alias("cases_and_data"),
        each(term=role, normalized=lambda x: F.upper(role(x)), evidence=said, verdict=fixed("verified")).alias("proper_noun_review"), each(value=number, normalized=fixed("n"), evidence=said, verdict=fixed("unresolved")).alias("numeric_review"),
        each(timestamp=lambda x: F.concat(F.lit("00:0"), x["segment_id"] % 10), explanation=said).alias("timeline_interpretation"), F.when(F.col("job_id") % 3 != 0, related).alias("related_knowledge"),
        each(frame=named("f", ".jpg"), argument_step=lambda x: F.when(F.col("job_id") % 4 != 0, x["segment_id"] + 1), claim=role).alias("visual_evidence"), F.when(odd, texts).otherwise(none).alias("pending_review"))


def _legacy(s, d):
    issues, states = catalog.inspect_legacy(sql(s, d, PARTS), REQUIRED, ["data.json"])
    return issues.groupBy(F.col("issue").alias("kind")).agg(F.count(F.lit(1)).alias("n")).union(states)
