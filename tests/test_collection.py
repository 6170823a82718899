"""Snapshots, media and timelines on hand-written rows."""

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from loomfield.functions.columns import canonical_id, format_time, parse_time, redact, safe_component
from loomfield.operators import media, snapshot, timeline
from loomfield.sources import files, media_files

ITEM = "source_id string, job_id string, currently_collected boolean, uncollected_at timestamp_ntz, last_position long, status string, pipeline_version string, media_sha256 string"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_reconcile_rules(spark):
    items = spark.sql("""SELECT * FROM VALUES
        ('a', 'ja', true, null, 1, 'completed', 'v1', 'h'), ('b', 'jb', true, null, 2, 'completed', 'v1', 'h'), ('c', 'jc', false, TIMESTAMP_NTZ'2024-01-01', 3, 'failed', 'v0', 'h'),
        ('d', 'jd', false, TIMESTAMP_NTZ'2023-01-01', 4, 'completed', 'v0', 'h'), ('e', 'je', true, null, 5, 'analyzed', 'v0', null)
        AS t(source_id, job_id, currently_collected, uncollected_at, last_position, status, pipeline_version, media_sha256)""").selectExpr(
        "*", "concat('alt', source_id) AS alt_id", "'bad' AS error", "'s0' AS snapshot_id", "TIMESTAMP_NTZ'2022-01-01' AS first_seen_at", "TIMESTAMP_NTZ'2022-02-01' AS last_seen_at")
    seen = spark.createDataFrame([("s", "a", 9, None), ("s", "b", 8, "other"), ("s", "c", 7, "h"), ("s", "n", 6, None), ("x", "e", 1, None)], "snapshot_id string, source_id string, position long, media_sha256 string")
    snapshots = spark.createDataFrame([("s", "completed"), ("x", "failed")], "snapshot_id string, state string")
    out = {r.source_id: r for r in snapshot.reconcile(items, seen, snapshots, "s", "v1", "2024-02-01 00:00:00").collect()}
    assert (out["a"].alt_id, out["a"].error, out["b"].error, out["n"].error) == ("alta", "bad", None, None)
    assert (out["a"].last_seen_at.year, out["d"].last_seen_at.year, out["a"].first_seen_at.year, out["n"].first_seen_at.year) == (2024, 2022, 2022, 2024)
    assert (out["a"].snapshot_id, out["d"].snapshot_id) == ("s", "s0")
    for inert in ("x", "unknown"):
        same = snapshot.reconcile(items, seen, snapshots, inert, "v1", "2024-02-01 00:00:00").select(*items.columns)
        assert same.exceptAll(items).isEmpty() and same.count() == 5
    assert (out["a"].status, out["a"].media_sha256, out["a"].last_position) == ("completed", "h", 9)  # an unknown hash is no change
    assert (out["b"].status, out["b"].media_sha256) == ("new", "other")
    assert (out["c"].status, out["c"].currently_collected, out["c"].uncollected_at, out["c"].pipeline_version) == ("failed", True, None, "v1")
    assert out["d"].uncollected_at.year == 2023 and not out["d"].currently_collected
    assert out["e"].uncollected_at.year == 2024 and out["e"].pipeline_version == "v0"
    assert out["n"].status == "new" and out["n"].job_id.startswith("item-")
    changes = dict(map(tuple, snapshot.diff(items, seen.where("snapshot_id = 's'"), "v1").collect()))
    assert changes == {"a": "kept", "b": "reset", "c": "recollected", "d": "gone", "e": "uncollected", "n": "new"}


def test_chain_rules(spark):
    pages = [
        ("ok", 1, "0", "1", True), ("ok", 2, "1", None, False), ("start", 1, "5", None, False), ("gap", 1, "0", "1", True), ("gap", 2, "2", None, False),
        ("after", 1, "0", None, False), ("after", 2, "1", None, False), ("stuck", 1, "0", "0", True), ("open", 1, "0", "1", True)]
    df = spark.createDataFrame(pages, "snapshot_id string, page_seq int, page_cursor string, next_cursor string, has_more boolean")
    got = {r.snapshot_id: r.error for r in snapshot.validate_chain(df).collect()}
    assert got == {"ok": None, "start": "bad_start", "gap": "discontinuity", "after": "after_last_page", "stuck": "not_advanced", "open": "incomplete"}


def test_positions_keep_the_first_occurrence(spark):
    df = spark.createDataFrame([("s", 1, 0, "x"), ("s", 1, 1, "y"), ("s", 2, 0, "x"), ("s", 2, 1, "z")], "snapshot_id string, seq int, pos int, source_id string")
    assert rows(snapshot.assign_positions(df), "source_id", "position") == [("x", 1), ("y", 2), ("z", 3)]


def test_status_updates(spark):
    items = spark.createDataFrame([("a", "completed", None), ("b", "new", "e"), ("d", "new", "e")], "source_id string, status string, error string")
    updates = spark.createDataFrame([("a", "failed", "x"), ("b", "downloaded", None), ("c", "failed", None), ("b2", "lost", None), ("d", "completed", None)], "source_id string, new_status string, new_error string")
    done, refused = snapshot.apply_status(items, updates)
    assert rows(done, "source_id", "status", "error") == [("a", "completed", None), ("b", "downloaded", None), ("d", "new", "e")]
    assert rows(refused, "source_id", "reason") == [("b2", "bad_status"), ("c", "unknown_item"), ("d", "needs_acceptance")]
    assert ("a", "failed", "x") in rows(snapshot.apply_status(items, updates, keep_completed=False)[0], "source_id", "status", "error")


def test_claims_and_open_items(spark):
    items = spark.createDataFrame(
        [("gone", "new", "v1", "h", False), ("media", "completed", "v1", "h", True), ("hash", "completed", "v1", "h", True), ("done", "completed", "v1", "h", True), ("off", "completed", "v1", "h", True),
         ("old", "analyzed", "v0", "h", True), ("again", "incomplete", "v1", "h", True), ("open", "downloaded", "v1", None, True)],
        "source_id string, status string, pipeline_version string, media_sha256 string, currently_collected boolean")
    observed = spark.createDataFrame([(n, None if n == "media" else "i" if n == "hash" else "h") for n in ("gone", "media", "hash", "done", "off", "old", "again", "open", "none")], "source_id string, observed_sha256 string")
    valid = spark.createDataFrame([("done",)], "source_id string")
    assert rows(snapshot.claim_decisions(items, observed, valid, "v1"), "source_id", "decision", "process", "new_status") == [
        ("again", "retry", True, "processing"), ("done", "completed_current", False, None), ("gone", "not_collected", False, None), ("hash", "hash_changed", True, "incomplete"),
        ("media", "media_missing", True, "incomplete"), ("none", "not_collected", False, None), ("off", "artifacts_invalid", True, "incomplete"), ("old", "version_changed", True, "new"), ("open", "downloaded", True, "processing")]
    assert rows(snapshot.needs_processing(items, "v1", valid).where("NOT needs"), "source_id") == [("done",), ("gone",)]


def test_paged_dumps(spark, tmp_path):
    page = {"status_code": 0, "snapshot_id": "s", "page_seq": 1, "cursor": "0", "next_cursor": "1", "has_more": True, "items": [{"id": "a", "duration_ms": 1500}, None]}
    (tmp_path / "a.json").write_text(json.dumps([page, {"status_code": 4}, {"status_code": 0}]))
    pages = files.read_pages(spark, str(tmp_path))
    assert rows(files.classify_pages(pages), "page_status") == [("denied",), ("invalid",), ("ok",)]
    assert rows(files.page_items(pages), "seq", "pos", "id") == [(1, 0, "a")]


def test_media_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    head = b"\0\0\0\x18ftypmp42" + b"\0" * 12
    (tmp_path / "x" / "one.mp4").write_bytes(head + b"\0\0\0\x30pssh\0\0\0\0abcdefgh")
    (tmp_path / "two.MKV").write_bytes(bytes.fromhex("1A45DFA3") + b"data pssh")
    (tmp_path / "three.Flv").write_bytes(b"FLV\1")
    (tmp_path / "no.m4v").write_bytes(head)
    facts = media.media_outcome(media.file_facts(media_files.read_ranges(spark, str(tmp_path), 7)).withColumn("expected_length", F.lit(None).cast("long")))
    assert rows(facts, "length", "kind", "protected", "outcome") == [(13, "ebml", False, "unsupported_container"), (4, "flv", False, "unsupported_container"), (44, "iso-bmff", True, "protected")]
    scan = media_files.scan_media(spark, f"file://{tmp_path}")
    assert rows(scan, media_files.named_as("media_path").alias("n"), "size_bytes", "content_hash") == sorted((f.stem, f.stat().st_size, hashlib.sha256(f.read_bytes()).hexdigest()) for f in tmp_path.rglob("*") if f.suffix.lower() in (".mp4", ".mkv", ".flv"))


def test_ranges_cover_files_and_hits_across_borders(spark, tmp_path):
    content = bytes(range(256)) * 40
    for name, data in (("a.mp4", content), ("b.mov", b""), ("d/c.webm", content[:100])):
        cut = [(name, n, data[n * 99 : n * 99 + 99]) for n in range(max(1, -(-len(data) // 99)))]
        media_files.write_files(spark.createDataFrame(cut[::-1], "name string, part long, content binary").repartition(3), str(tmp_path))
        assert (tmp_path / name).read_bytes() == data
    assert sorted(f.name for f in tmp_path.rglob("*.*")) == ["a.mp4", "b.mov", "c.webm"]
    got = media_files.read_ranges(spark, str(tmp_path), 1000, 19).where("media_path LIKE '%a.mp4'").orderBy("offset").collect()
    assert [r.offset for r in got] == list(range(0, 10240, 1000)) and b"".join(bytes(r.content[: 1000]) for r in got) == content
    assert all(bytes(r.content) == content[r.offset : r.offset + 1019] for r in got)
    box = (32).to_bytes(4, "big") + b"pssh" + bytes(8)
    for at in range(980, 1002):
        (tmp_path / f"x{at}.mp4").write_bytes(b"z" * at + box + b"z" * 500)
    facts = media.file_facts(media_files.read_ranges(spark, str(tmp_path), 1000, 19)).where("media_path LIKE '%/x%'")
    assert facts.count() == 22 and facts.where("protected").count() == 22


def test_files_are_listed_and_cut_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media_files, "TASK", 64)
    want = {}
    for n in range(60):
        path = tmp_path / f"{n % 4}" / f"{n % 3}" / f"{n}.{('mp4', 'MKV', 'txt')[n % 5 % 3]}" if n % 7 else tmp_path / f"{n}.mov"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(bytes(x % 251 for x in range(n * 9)))
        if path.suffix != ".txt":
            want[str(path)] = path.read_bytes()
    (tmp_path / "none" / "below").mkdir(parents=True)
    got = media_files.read_ranges(spark, str(tmp_path), 10, 3)
    plan = got._jdf.queryExecution().toString()
    assert "BatchScan" not in plan and "MapInArrow" in plan  # a scan's ranges are listed by the driver
    assert rows(got, "media_path", "size_bytes", "offset", "content") == sorted(((p, len(c), at, c[at : at + 13]) for p, c in want.items() for at in range(0, max(1, len(c)), 10)), key=repr)
    assert rows(media_files.list_media(spark, str(tmp_path)), "media_path", "size_bytes") == sorted((p, len(c)) for p, c in want.items())
    assert media_files.read_ranges(spark, str(tmp_path / "none")).count() == 0


def test_parts_that_come_together_are_not_dealt(spark, tmp_path):
    texts = [bytes(x % 251 for x in range(n * 40)) for n in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, whole binary").repartition(4)
    cut = df.select(F.concat(F.expr("n DIV 10"), F.lit("/"), "n", F.lit(".mp4")).alias("name"), "whole", F.explode(F.expr("sequence(0, length(whole) DIV 100)")).alias("part"))
    media_files.write_files(cut.select("name", "part", F.expr("substring(whole, part * 100 + 1, 100)").alias("content")), str(tmp_path), together=True)
    assert {p.relative_to(tmp_path).as_posix(): p.read_bytes() for p in tmp_path.rglob("*.*")} == {f"{n // 10}/{n}.mp4": t for n, t in enumerate(texts)}


def test_container_and_box_rules(spark):
    packets = bytes(377 * [0])
    packets = bytes([0x47 if n in (0, 188, 376) else c for n, c in enumerate(packets)])
    kinds = [(packets, "mpeg-ts"), (packets[:376], None), (b"\0\0\0\x18ftyp", None), (b"OggS", "ogg"), (b"RIFF" + bytes(20), None), (None, None)]
    df = spark.createDataFrame([(n, c) for n, (c, _) in enumerate(kinds)], "id long, content binary")
    assert rows(media.media_kind(df), "id", "kind") == sorted([(n, k) for n, (_, k) in enumerate(kinds)], key=repr)
    size = lambda n: n.to_bytes(4, "big")
    boxes = [
        (size(32) + b"pssh\0\0\0\0", True), (size(31) + b"pssh\0\0\0\0", False), (size(32) + b"pssh\2\0\0\0", False), (size(20) + b"schm\1\0\0\0", True), (size(1 << 31) + b"schm\0\0\0\0", False),
        (size(8) + b"encv" + bytes(7) + b"\1", True), (size(8) + b"enca" + bytes(8), False), (size(8) + b"enca" + bytes(5) + b"\1\0\1", False), (size(24) + b"sinf" + size(12) + b"frma", True),
        (size(24) + b"sinf" + size(17) + b"frma", False), (size(24) + b"sinf" + size(12) + b"xxxx", False), (b"pssh" + bytes(8), False), (size(99) + b"encvsinf" + size(33) + b"schi", False), (b"ps" + size(40) + b"pssh" + bytes(4), True)]
    df = spark.createDataFrame([(n, c) for n, (c, _) in enumerate(boxes)], "id long, content binary")
    assert rows(media.protected_media(df), "id", "protected") == sorted([(n, p) for n, (_, p) in enumerate(boxes)], key=repr)


def test_inventory_keeps_missing_status(spark):
    schema = "media_path string, size_bytes int, modified_ns int, content_hash string"
    prev = spark.createDataFrame([("a", 1, 1, "h", "missing"), ("b", 1, 1, "h", "done"), ("c", 1, 1, "h", "done")], schema + ", status string")
    scan = spark.createDataFrame([("a", 1, 1, "h"), ("b", 1, 1, "i"), ("d", 1, 1, "h")], schema)
    assert rows(media.inventory_diff(prev, scan), "media_path", "change", "status") == [("a", "unchanged", "missing"), ("b", "updated", "new"), ("c", "missing", "missing"), ("d", "inserted", "new")]


def test_nested_documents(spark):
    transcript = {"language": "zh", "segments": [{"start": 0.0, "end": 1.0, "text": "hi", "words": [{"confidence": 0.5}, {"confidence": None}]}, None]}
    screen = {"frames": [{"keyframe_id": 1, "timestamp": 2.0, "lines": [{"text": "a", "confidence": 0.9}, {"text": "b"}]}]}
    docs = spark.createDataFrame([(1, json.dumps(transcript), json.dumps(screen))], "job_id long, a string, b string")
    segs = timeline.flatten_transcript(docs, "a")
    assert rows(segs.select("text", timeline.array_confidence(F.col("words")).alias("c")), "text", "c") == [("hi", 0.5)]
    assert rows(segs, "segment_id", "text", "dropped") == [(0, "hi", 1)]
    empty = spark.createDataFrame([(1, '{"segments":[null,{"start":1}]}'), (2, "{}")], "job_id long, a string")
    assert rows(timeline.flatten_transcript(empty, "a"), "job_id", "segment_id", "dropped") == [(1, None, 2)]
    assert rows(timeline.flatten_screen_text(docs, "b"), "line", "text") == [(1, "a"), (2, "b")]


def test_chunks_are_combined(spark):
    word = "words array<struct<start:double,end:double,text:string,confidence:double>>"
    segs = spark.createDataFrame([(1, 0, 0, 1.0, 2.0, "a", []), (1, 1, 0, None, 3.0, "b", [(0.5, None, "w", 0.9)])], f"job_id long, chunk int, i int, start_s double, end_s double, text string, {word}")
    chunks = spark.createDataFrame([(1, 0, 10.0, 0.5), (1, 1, 20.0, None)], "job_id long, chunk int, duration_s double, language_probability double")
    got = sorted(map(tuple, timeline.stitch_chunks(segs, chunks).collect()))
    assert [(*g[:5], [tuple(w) for w in g[5]]) for g in got] == [(1, 0, 1.0, 2.0, "a", []), (1, 1, 10.0, 13.0, "b", [(10.5, 10.0, "w", 0.9)])]
    assert tuple(timeline.combined_facts(chunks).first()) == (1, 0.25, 30.0)


def test_next_items_come_from_completed_snapshots(spark):
    items = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("d", True)], "source_id string, needs boolean")
    seen = spark.createDataFrame([("s", "b", 1), ("s", "c", 2), ("s", "a", 3), ("s", "z", 0), ("t", "d", 1)], "snapshot_id string, source_id string, position long")
    states = spark.createDataFrame([("s", "completed"), ("t", "in_progress")], "snapshot_id string, state string")
    assert rows(snapshot.next_items(items, seen, states), "snapshot_id", "place", "source_id", "position") == [("s", 1, "c", 2)]


def test_near_segments_is_inclusive_and_bucketing_changes_nothing(spark):
    frames = spark.createDataFrame([(1, 1, 10.0), (1, 2, 40.0), (2, 3, 0.0)], "job_id long, frame_id long, t double")
    segs = spark.createDataFrame([(1, 1, 17.5, 20.0, "a"), (1, 2, 17.6, 60.0, "b"), (1, 3, 0.0, 2.5, "c"), (2, 4, 8.0, 9.0, "d")], "job_id long, segment_id long, start_s double, end_s double, text string")
    plain = rows(timeline.near_segments(frames, segs), "frame_id", "segment_id")
    assert plain == [(1, 1), (1, 3), (2, 2)]
    assert rows(timeline.near_segments(frames, segs, width=5.0), "frame_id", "segment_id") == plain


def test_column_functions(spark):
    df = spark.createDataFrame([(" ", " b ", 61.5, "01:02.500", "https://x.y token=abc item-0123456789abcdef0123 123456789012345678", " CON.txt")], "a string, b string, s double, c string, log string, name string")
    r = df.select(canonical_id(F.col("a"), F.col("b")), format_time(F.col("s")), parse_time(F.col("c")), redact(F.col("log")), safe_component(F.col("name")), parse_time(F.lit("1:02:03")), parse_time(F.lit("x"))).first()
    assert tuple(r) == ("b", "01:01.500", 62.5, "[REDACTED_URL] token=[REDACTED] [REDACTED_JOB] [REDACTED_ID]", "CON.txt", 3723.0, None)
    names = spark.createDataFrame([(n, x) for n, x in enumerate(["- a.b -", "con", "..", None, "a" * 79 + " -z", "x/y"])], "n long, name string")
    assert rows(names.select("n", safe_component(F.col("name")).alias("name")), "n", "name") == [(0, "a.b"), (1, None), (2, None), (3, None), (4, "a" * 79), (5, "x-y")]


def test_versions_and_front_matter(spark, tmp_path):
    path = str(tmp_path / "t")
    assert files.write_version(spark.range(3), path) == 1
    assert files.write_version(spark.range(5), path) == 2
    assert files.read_version(spark, path).count() == 5 and files.read_version(spark, path, 1).count() == 3
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda n: files.write_version(spark.range(10 + n), path), range(4)))
    assert sorted(numbers) == [3, 4, 5, 6] and [files.read_version(spark, path, m).count() for m in numbers] == [10, 11, 12, 13]
    (tmp_path / "t" / "_log" / f"{7:020d}.version").write_text("0123")  # a writer that stopped
    assert files.read_version(spark, path).count() == 10 + numbers.index(6) and files.write_version(spark.range(1), path) == 8
    with pytest.raises(FileNotFoundError):
        files.read_version(spark, str(tmp_path / "none"))
    docs = spark.createDataFrame([(1, "---\ntitle: A\ntags: [x, y]\n---\nbody"), (2, "no block"), (3, "---\n: [\n---\nb")], "id long, text string")
    out = {r.id: r for r in files.split_front_matter(docs).collect()}
    assert out[1].front["title"] == "A" and out[1].body == "body" and out[2].front == {} and out[3].front_error == "malformed"
    for where, front in (("cat/one", "title: One\ncategory: cat\ntags: [a, b]"), ("cat/two", "title: Two"), ("_index/x", "title: X\ncategory: c\ntags: [a]")):
        (tmp_path / "lib" / where).mkdir(parents=True)
        (tmp_path / "lib" / where / "note.md").write_text(f"---\n{front}\n---\nbody")
    assert rows(files.discover_entries(spark, str(tmp_path / "lib")), "category", "title", "tags") == [("cat", "One", ["a", "b"])]
    files.export_entries(files.discover_entries(spark, str(tmp_path / "lib")), str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").glob("category=*")] == ["category=cat"]
