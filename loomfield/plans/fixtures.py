"""Logical tables of the operators, derived from the driver tables by SQL that both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = "2024-02-01 00:00:00"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: SHA(x): hex SHA-256; EPOCH(x): seconds since 1970; CELL(html): the title of a page.
VIEWS = {
    "v_src": """SELECT CAST(o_orderkey AS STRING) AS source_id, CAST(o_custkey AS STRING) AS collection, o_orderkey AS k, o_custkey,
        CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE
        'incomplete' END
            ELSE CASE o_orderkey % 5 WHEN 0 THEN 'processing' WHEN 1 THEN 'downloaded' WHEN 2 THEN 'analyzed' ELSE 'new' END END AS status
        FROM orders""",
    "v_items": """SELECT source_id, concat('item-', substr(SHA(source_id), 1, 20)) AS job_id, collection, status, k % 11 <> 0 AS
        currently_collected,
        CASE WHEN k % 11 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS uncollected_at, k AS last_position,
        CASE WHEN k % 17 = 0 THEN 'v0' ELSE 'v1' END AS pipeline_version, SHA(source_id) AS media_sha256,
        CASE WHEN k % 3 = 0 THEN NULL ELSE concat('alt', CAST(k % 9000 AS STRING)) END AS alt_id,
        CASE WHEN k % 23 = 0 THEN 's9' ELSE 's1' END AS snapshot_id, concat('author', CAST(o_custkey % 50 AS STRING)) AS author,
        CASE WHEN k % 4 = 1 THEN 'e1' END AS error, concat('lib/', source_id) AS library_path,
        TIMESTAMP '2023-12-01 00:00:00' AS first_seen_at, CASE WHEN k % 11 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP
        '2024-01-15 00:00:00' END AS last_seen_at
        FROM v_src WHERE k % 10 <> 0""",
    "v_seen": """SELECT 's2' AS snapshot_id, source_id, k AS position,
        CASE WHEN k % 19 = 0 THEN NULL ELSE SHA(concat(source_id, CASE WHEN k % 13 = 0 THEN 'x' ELSE '' END)) END AS media_sha256,
        CASE WHEN k % 9 = 0 THEN NULL ELSE concat('alt', CAST(k % 9000 AS STRING)) END AS alt_id
        FROM v_src WHERE k % 7 <> 0""",
    "v_snapshots": "SELECT * FROM (VALUES ('s1', 'completed'), ('s2', 'completed'), ('s3', 'failed')) AS t(snapshot_id, state)",
    "v_chain": """SELECT snapshot_id, rn AS page_seq, CAST(rn - 1 AS STRING) AS page_cursor, CASE WHEN rn < n THEN CAST(rn AS STRING) END AS
        next_cursor, rn < n AS has_more
        FROM (SELECT o_custkey AS snapshot_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn,
              count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) q
        WHERE NOT (snapshot_id % 5 = 0 AND rn = 1) AND NOT (snapshot_id % 5 = 1 AND rn = 2) AND NOT (snapshot_id % 5 = 2 AND rn = n)""",
    "v_replays": """SELECT o_custkey AS snapshot_id, CAST(o_orderkey % 4 AS STRING) AS page_cursor,
        CASE WHEN o_custkey % 3 = 0 THEN CAST(o_orderkey % 8 AS STRING) ELSE 'n' END AS next_cursor, true AS has_more FROM orders""",
    "v_page_items": """SELECT l_suppkey AS snapshot_id, l_orderkey AS seq, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY
        l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) AS pos,
        CAST(l_partkey AS STRING) AS source_id FROM lineitem""",
    "v_observed": """SELECT source_id, CASE WHEN k % 29 = 0 THEN NULL ELSE SHA(concat(source_id, CASE WHEN k % 13 = 0 THEN 'x' ELSE '' END))
        END AS observed_sha256,
        CASE WHEN k % 31 = 0 THEN 'other' ELSE source_id END AS alt_id, concat('author', CAST(o_custkey % 50 + CASE WHEN k % 37 = 0 THEN 1
        ELSE 0 END AS STRING)) AS author FROM v_src WHERE k % 3 <> 0""",
    "v_inv_prev": """SELECT concat('m/', CAST(p_partkey AS STRING)) AS media_path, p_size AS size_bytes, p_partkey AS modified_ns,
        SHA(p_brand) AS content_hash,
        CASE WHEN p_partkey % 5 = 0 THEN 'missing' ELSE 'done' END AS status FROM part WHERE p_partkey % 9 <> 0""",
    "v_inv_scan": """SELECT concat('m/', CAST(p_partkey AS STRING)) AS media_path, p_size AS size_bytes, p_partkey AS modified_ns,
        SHA(concat(p_brand, CASE WHEN p_partkey % 6 = 0 THEN 'x' ELSE '' END)) AS content_hash FROM part WHERE p_partkey % 8 <> 0""",
    "v_artifacts": """SELECT o_custkey AS bundle, concat('f/', CAST(o_orderkey AS STRING)) AS rel_path, o_orderkey % 1000 AS size,
        SHA(CAST(o_orderkey AS STRING)) AS sha256 FROM orders WHERE o_orderkey % 12 <> 0""",
    "v_artifacts_now": """SELECT o_custkey AS bundle, concat('f/', CAST(o_orderkey AS STRING)) AS rel_path, o_orderkey % 1000 + CASE WHEN
        o_orderkey % 15 = 0 THEN 1 ELSE 0 END AS size,
        SHA(CASE WHEN o_orderkey % 14 = 0 THEN 'changed' ELSE CAST(o_orderkey AS STRING) END) AS sha256 FROM orders WHERE o_orderkey % 13 <>
        0""",
    "v_segments": """SELECT conv_id AS job_id, turn AS segment_id, role, text,
        CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS
        DOUBLE) / 10 AS start_s,
        CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS DOUBLE) / 10 AS end_s,
        CAST((conv_id * 31 + turn * 17) % 100 AS DOUBLE) / 100 AS confidence FROM conversations""",
    "v_screen": """SELECT conv_id AS job_id, turn AS frame_id, turn % 3 + 1 AS line, CAST(turn * 20 AS DOUBLE) AS t, text,
        CAST((conv_id * 13 + turn * 29) % 100 AS DOUBLE) / 100 AS confidence FROM conversations""",
    "v_timeline": """SELECT user_id AS job_id, CASE event_type WHEN 'click' THEN 'asr' ELSE 'ocr' END AS source, event_id, EPOCH(ts) AS t,
        EPOCH(ts) + value AS t_end, value / 500.0 AS confidence
        FROM events WHERE event_type IN ('click', 'view')""",
    "v_spoken": "SELECT job_id, event_id AS segment_id, t AS start_s, t_end AS end_s, CAST(event_id AS STRING) AS text, confidence FROM v_timeline WHERE source = 'asr'",
    "v_shown": "SELECT job_id, event_id AS frame_id, t, 1 AS line, CAST(event_id AS STRING) AS text, confidence FROM v_timeline WHERE source = 'ocr'",
    "v_frames": """SELECT CAST(label AS BIGINT) AS job_id, vec_id AS frame_id, CAST(embedding AS ARRAYDOUBLE) AS vec,
        CAST(5 * (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS DOUBLE) AS t FROM embeddings""",
    "v_sagas": """SELECT CAST(o_orderkey AS STRING) AS saga_id, CAST(o_custkey AS STRING) AS job_ref, o_orderdate AS created_at,
        o_orderdate + INTERVAL '1' DAY AS updated_at, CASE WHEN o_orderkey % 8 = 5 AND o_orderstatus = 'F' THEN o_orderdate END AS
        superseded_at,
        CASE WHEN o_orderstatus = 'F' THEN 'accepted' WHEN o_orderstatus = 'P' OR o_orderkey % 3 = 0 THEN 'published_unaccepted' ELSE
        'intent' END AS state FROM orders""",
    "v_targets": """SELECT saga_id, concat('t', CAST(n AS STRING)) AS target_name, CASE WHEN pk % 11 = 0 THEN '' ELSE SHA(CAST(pk AS
        STRING)) END AS expected_sha256,
        CASE WHEN pk % 7 = 0 THEN NULL WHEN pk % 5 = 0 THEN SHA('drift') ELSE SHA(CAST(pk AS STRING)) END AS observed_sha256
        FROM (SELECT CAST(l_orderkey AS STRING) AS saga_id, l_partkey AS pk,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
        l_shipdate) AS n FROM lineitem) q""",
    "v_reviews": """SELECT event_id AS review_id, user_id AS job_ref, event_type AS candidate_sha256, CASE WHEN value > 40 THEN 'approve'
        ELSE 'reject' END AS decision,
        SHA(CAST(user_id AS STRING)) AS note_sha256, ts AS reviewed_at FROM events""",
    "v_stage_events": """SELECT user_id AS job_id, event_id, ts AS at, CASE event_id % 3 WHEN 0 THEN 'download' WHEN 1 THEN 'analysis' ELSE
        'packet' END AS stage,
        CASE WHEN event_type IN ('error', 'view') THEN 'failed' ELSE 'completed' END AS outcome, CASE event_type WHEN 'error' THEN 'e1' WHEN
        'view' THEN 'e2' END AS error_code FROM events""",
    "v_entries": "SELECT page_id AS entry_ref, regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_extract(url, '://([^/:?]+)', 1) AS category, url FROM pages",
    "v_payload": """SELECT d.doc_id AS job_id, d.lang AS tag1, d.source AS tag2, d.text AS body, CASE WHEN coalesce(l.quality, 1) = 1 THEN 'verified'
        ELSE 'needs_review' END AS review_status,
        coalesce(l.toxic, 0) AS unresolved_count, CASE WHEN d.doc_id % 4 = 0 THEN 0 ELSE coalesce(l.toxic, 0) END AS pending_count FROM documents d
        LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}

_CALL = re.compile(r"\b(SHA|EPOCH)\(")
_ENGINES = {
    "spark": {"SHA": "sha2({}, 256)", "EPOCH": "(unix_micros(CAST({} AS TIMESTAMP)) / 1e6)", "ARRAYDOUBLE": "ARRAY<DOUBLE>", "TIMESTAMP '": "TIMESTAMP_NTZ '"},
    "duckdb": {"SHA": "sha256({})", "EPOCH": "epoch({})", "ARRAYDOUBLE": "DOUBLE[]", "TIMESTAMP '": "TIMESTAMP '"},
}


def translate(sql: str, engine: str) -> str:
    """SQL of one engine: SHA(...) and EPOCH(...) by balanced brackets, and type names."""
    forms = _ENGINES[engine]
    while m := _CALL.search(sql):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[: m.start()] + forms[m[1]].format(sql[m.end() : end - 1]) + sql[end:]
    for word in ("ARRAYDOUBLE", "TIMESTAMP '"):
        sql = sql.replace(word, forms[word])
    return sql


def needs(sql: str) -> list[str]:
    """The views that a statement needs, each after those that it needs itself."""
    out: list[str] = []
    for name in dict.fromkeys(re.findall(r"\bv_\w+", sql)):
        if name in VIEWS:
            out += [n for n in [*needs(VIEWS[name]), name] if n not in out]
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical or driver table as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return sql(spark, sf_dir, VIEWS[name])


def sql(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """A statement over logical and driver tables."""
    used = dict.fromkeys(re.findall(r"\b(?:v_\w+|" + "|".join(TABLES) + r")\b", statement))
    frames = {n: view(spark, sf_dir, n) for n in used if n in VIEWS or n in TABLES}
    if not frames:
        return spark.sql(translate(statement, "spark"))
    statement = statement.replace("{", "{{").replace("}", "}}")
    for n in frames:
        statement = re.sub(rf"(?i)\b(FROM|JOIN)\s+{n}\b(?!\.)", rf"\1 {{{n}}}", statement)
    return spark.sql(translate(statement, "spark"), **{n: f for n, f in frames.items() if "{" + n + "}" in statement})


def oracle(statement: str) -> str:
    """The statement for DuckDB with the views it needs."""
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needs(statement))
    statement = statement.strip()
    if re.match(r"WITH\s", statement, re.IGNORECASE):
        return translate(f"WITH RECURSIVE {views}{', ' if views else ''}{statement[5:]}", "duckdb")
    return translate(f"WITH {views} {statement}" if views else statement, "duckdb")
