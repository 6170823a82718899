"""Evidence, frames, quality, ledgers and catalog on hand-written rows and against plain specifications."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomfield.operators import catalog, evidence, frames, ledger, quality, work


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_cleaning_drops_private_records(spark):
    texts = ["see  *this* /home/u/x", "my token is", "at https://x.y", " | :-- ", "a" * 900, "the Session-log", "chats here", "b" * 799 + "  c", "C:\\dir\\f and /Users/me", "/mnt/x", " ", None, "registryx"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = {r.id: (r.text, r.truncated) for r in evidence.clean_records(df).collect()}
    assert out == {
        0: ("see *this* [private-path-removed]", False), 1: ("my token is", False), 4: ("a" * 800, True), 7: ("b" * 799, True), 8: ("[private-path-removed] and [private-path-removed]", False), 9: ("/mnt/x", False), 12: ("registryx", False)}


def test_fragments_are_cut_from_one_line(spark):
    df = spark.createDataFrame([(1, "a" * 10 + "   cookie    " + "b" * 5), (2, "\n\U0001F600x" * 6), (3, ""), (4, None), (5, "cookie"), (6, "a" * 595 + " " * 50 + "b" * 14)], "id long, text string")
    got = rows(evidence.fragment(df.where("id < 6"), "id", 10), "id", "part", "text", "omitted")
    assert got == [(1, 1, "a" * 10, 1), (1, 2, "bbb", 1), (2, 1, "\U0001F600x \U0001F600x \U0001F600x \U0001F600", 0), (2, 2, "x \U0001F600x \U0001F600x", 0), (5, None, None, 1)]
    assert rows(evidence.fragment(df.where("id = 6"), "id"), "part", "text") == [(1, "a" * 595 + " bbbb"), (2, "b" * 10)]


def test_digests_keep_their_limits(spark):
    long = [(1, float(n), n, f"{n} " + "w" * 30) for n in range(700)] + [(2, 0.0, 0, "x" * 140), (3, 0.0, 0, "y" * 141), (4, 0.0, 0, "z" * 138 + "  q"), (5, 0.0, 0, "no digit"), (6, 1.0, 1, "b"), (6, 0.0, 0, "a")]
    got = {r.job_id: r for r in evidence.extractive_digest(spark.createDataFrame(long, "job_id long, start_s double, segment_id long, text string")).collect()}
    whole = " ".join(t for j, _, _, t in long if j == 1)
    assert got[1].short == whole[:139].rstrip() + "…" and got[1].long == whole[:599].rstrip() + "…" and len(got[1].timed) == 8 and got[1].numeric == got[1].leads == [t for _, _, _, t in long[:5]]
    assert (got[2].short, got[3].short, got[4].short) == ("x" * 140, "y" * 139 + "…", "z" * 138 + "…") and got[5].numeric == [] and got[6].long == "a b"


def test_chunks_follow_next_fit(spark):
    rng = random.Random(1)
    data = [(job, i, "".join(rng.choice('ab"\\\né日') for _ in range(rng.randint(0, 60)))) for job in ("x", "yy") for i in range(1, 200)]
    df = spark.createDataFrame(data, "job_id string, i long, text string").repartition(5)
    for budget in (150, 400, 3000):
        want = []
        for job in ("x", "yy"):
            records = [(i, json.dumps({"text": t}, ensure_ascii=False, separators=(",", ":"))) for j, i, t in data if j == job]
            whole = lambda k, n, own: json_chunk(job, k, n, own)  # noqa: B023, E731
            chunks = []
            for i, r in records:
                if chunks and len(whole(len(chunks), len(records), [x for _, x in chunks[-1]] + [r]).encode()) <= budget:
                    chunks[-1].append((i, r))
                else:
                    chunks.append([(i, r)])
            for k, own in enumerate(chunks, 1):
                body = whole(k, len(chunks), [x for _, x in own]).encode()
                want.append((job, k, len(chunks), own[0][0], own[-1][0], len(body), hashlib.sha256(body).hexdigest(), "oversize" if len(body) > budget else None))
        assert rows(evidence.pack_chunks(df, budget), "job_id", "chunk", "chunks", "first", "last", "bytes", "sha256", "error") == sorted(want, key=repr)


@pytest.fixture
def late_broadcasts(spark):
    """Joins are planned as sort-merge joins; those with a side of at most 16 KB turn into broadcasts once sizes are known, and small partitions stay apart."""
    new = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "16KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n, None) for n in new}
    for n, value in new.items():
        spark.conf.set(n, value)
    yield
    for n, value in before.items():
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def test_chunks_of_jobs_after_a_late_broadcast(spark, late_broadcasts):
    data = [(job, i, "x" * (7 * i * job % 90)) for job in range(20) for i in range(1, 40)]
    df = spark.createDataFrame(data, "job_id long, i long, text string").repartition(5)
    want = []
    for job in range(20):
        chunks = []
        for _, i, t in data[39 * job : 39 * job + 39]:
            record = f'{{"text":"{t}"}}'
            if chunks and len(json_chunk(job, len(chunks), 39, [*chunks[-1][1], record])) <= 400:
                chunks[-1][1].append(record)
            else:
                chunks.append((i, [record]))
        want += [(job, k, len(chunks), i, len(own), len(json_chunk(job, k, len(chunks), own))) for k, (i, own) in enumerate(chunks, 1)]
    assert rows(evidence.pack_chunks(df, 400), "job_id", "chunk", "chunks", "first", "records", "bytes") == sorted(want, key=repr)


def test_bundles_of_jobs_after_a_late_broadcast(spark, late_broadcasts):
    data = [(job, i, "x" * (7 * i * job % 90)) for job in range(20) for i in range(1, 40)]
    df = spark.createDataFrame(data, "job_id long, i long, text string").repartition(5)
    fit = evidence.pack_chunks(df, 400)  # no record is too long for a chunk
    got = rows(evidence.bundle_manifest(fit, df.select("job_id", F.col("i").alias("frame_id")).where("job_id < 19")), "job_id", "records", "complete")
    assert got == sorted([(job, 39, job < 19) for job in range(20)], key=repr)


def json_chunk(job, index, count, records):
    return f'{{"job_ref":"{job}","chunk_index":{index},"chunk_count":{count},"records":[{",".join(records)}]}}\n'


def coverage_ranks(n: int) -> list[int]:
    """The order in which n places are visited: first, last, then midpoints breadth first."""
    order, gaps = ([0] if n else []) + ([n - 1] if n > 1 else []), [(0, n - 1)]
    while gaps:
        following = []
        for a, b in gaps:
            if b - a > 1:
                m = (a + b) // 2
                order.append(m)
                following += [(a, m), (m, b)]
        gaps = following
    return order


@given(st.integers(0, 300))
def test_coverage_order_is_a_permutation_from_the_ends(n):
    order = coverage_ranks(n)
    assert sorted(order) == list(range(n)) and order[:2] == [0, n - 1][: min(n, 2)] if n != 1 else order == [0]


def test_coverage_order_of_every_count(spark):
    counts = [*range(1, 40), 64, 65, 127, 1000]
    df = spark.createDataFrame([(n,) for n in counts], "job_id long").select("job_id", F.explode(F.sequence(F.lit(1), "job_id")).alias("i"))
    got = {}
    for r in evidence.coverage_order(df).orderBy("job_id", "visit").collect():
        got.setdefault(r.job_id, []).append(r.i - 1)
    assert got == {n: coverage_ranks(n) for n in counts}


def plain_evidence(records, max_bytes):
    """(class, i) that a packet takes of one job's records (i, source, text), list by list."""
    def unlike(sources):
        seen, out = set(), []
        for i, source, text in sorted((r for r in records if r[1] in sources), key=lambda r: (sources.index(r[1]), r[0])):
            key = re.sub(r"[\s|*_`#>-]+", "", text).casefold()
            if key and key not in seen:
                seen.add(key)
                out.append((i, text))
        return out

    size = lambda text: len(json.dumps(text, ensure_ascii=False).encode()) + 1
    chosen, used, texts = [], 0, set()
    marks = unlike(["timeline"])
    lists = [("timeline", [marks[k] for k in coverage_ranks(len(marks))]), ("facts", [r for r in unlike(["ocr", "summary", "asr"]) if re.search(r"\d|\b[A-Z][A-Z0-9-]{1,}\b", r[1])]), ("passages", unlike(["summary", "asr", "ocr"]))]
    for name, own in lists:
        limit = {"timeline": int(max_bytes * 0.45), "facts": min(max_bytes, used + int(max_bytes * 0.3))}.get(name, max_bytes)
        taken = set(texts)
        for i, text in own:
            if used + size(text) <= limit and not (name == "passages" and text in taken):
                chosen.append((name, i))
                texts.add(text)
                used += size(text)
    return chosen


def test_selection_equals_the_plain_version(spark):
    rng = random.Random(7)
    words = ["alpha", "Beta", "GPU-4", "A-b", "x 9", "quote \"q\"", "é", "A", "-", "same", "SAME"]
    data = [(job, i, rng.choice(["timeline", "asr", "ocr", "summary"]), " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for job in range(6) for i in range(rng.randint(1, 60))]
    df = spark.createDataFrame(data, "job_id long, i long, source string, text string").repartition(3)
    for budget in (40, 150, 600, 10**6):
        want = [(job, *x) for job in range(6) for x in plain_evidence([r[1:] for r in data if r[0] == job], budget)]
        assert rows(evidence.select_evidence(df, budget), "job_id", "class", "i") == sorted(want, key=repr)


def plain_picks(frames_, k):
    """Frames (t, frame_id, score) chosen of one job, in order."""
    own = sorted(frames_)
    if len(own) <= k:
        return own
    span, taken = max(own[-1][0] - own[0][0], 1.0), {0} if k == 1 else {0, len(own) - 1}
    for n in range(1, k - 1):
        target = own[0][0] + span * n / (k - 1)
        taken.add(min((i for i in range(1, len(own) - 1) if i not in taken), key=lambda i: (abs(own[i][0] - target) / span - 0.05 * min(1.0, max(0.0, own[i][2])), i)))
    return [own[i] for i in sorted(taken)]


def test_even_picks_equal_the_plain_version(spark):
    rng = random.Random(12)
    data = [(job, n, rng.choice([float(rng.randint(0, 9)), rng.random() * 100, rng.random() / 5]), rng.choice([0.0, 1.0, 3.0, rng.random()])) for job in range(30) for n in range(rng.randint(1, 30))]
    df = spark.createDataFrame(data, "job_id long, frame_id long, t double, scene_score double").repartition(3)
    for k in (1, 2, 3, 5, 8):
        want = [(job, f, t) for job in range(30) for t, f, _ in plain_picks([(t, f, s) for j, f, t, s in data if j == job], k)]
        assert rows(frames.pick_k(df, k), "job_id", "frame_id", "t") == sorted(want, key=repr)
    assert {r.job_id for r in frames.pick_k(df, 5, least=10).collect()} == {j for j in range(30) if sum(d[0] == j for d in data) >= 10}


def plain_candidates(observations, interval, threshold):
    """(t, reason) of one video's observations (t, score)."""
    out, last = [], -interval
    for n, (t, score) in enumerate(observations):
        tail, due = n == len(observations) - 1, t - last >= interval
        if not out or tail or score >= threshold or due:
            reason = "first" if n == 0 else "tail" if tail else "scene_change" if score >= threshold else "coverage"
            out = [*(out[:-1] if out and abs(out[-1][0] - t) < 1e-6 else out), (t, reason)]
            last = t if due else last
    return out


def test_candidates_equal_the_plain_version(spark):
    rng = random.Random(9)
    data = [(job, n, round(rng.choice([n * 0.5, n * 0.5, (n - 1) * 0.5]), 3) if n else 0.0, rng.choice([0.0, 0.05, 0.12, 0.5])) for job in range(8) for n in range(rng.randint(1, 90))]
    df = spark.createDataFrame(data, "job_id long, frame_id long, t double, scene_score double").repartition(3)
    want = []
    for job in range(8):
        own = sorted((t, n, s) for j, n, t, s in data if j == job)
        want += [(job, *c) for c in plain_candidates([(t, s) for t, _, s in own], min(15.0, max(0.2, own[-1][0] / 4)), 0.12)]
    none = spark.createDataFrame([], "job_id long, duration_s double")
    assert rows(frames.frame_candidates(df, none), "job_id", "t", "reason") == sorted(want, key=repr)
    known = spark.createDataFrame([(0, 4.0), (1, 400.0)], none.schema)
    again = [w for w in want if w[0] > 1]
    for job, interval in ((0, 1.0), (1, 15.0)):
        again += [(job, *c) for c in plain_candidates([(t, s) for t, _, s in sorted((t, n, s) for j, n, t, s in data if j == job)], interval, 0.12)]
    assert rows(frames.frame_candidates(df, known), "job_id", "t", "reason") == sorted(again, key=repr)


def test_signatures_match_the_definition(spark):
    vec = [float(x) for x in np.random.default_rng(1).normal(size=100)]
    r = frames.with_signatures(spark.createDataFrame([(vec,)], "vec array<double>")).first()
    bits = [x >= sum(vec) / 100 for x in vec]
    words = [int("".join("1" if b else "0" for b in bits[:64]), 2), int("".join("1" if b else "0" for b in bits[64:]), 2)]
    assert [w % 2**64 for w in r.signature] == words


def test_strips_find_the_same_pairs(spark):
    rng = np.random.default_rng(2)
    vecs = [(1, i, list(map(float, rng.normal(size=64) if i % 5 else np.ones(64) + rng.normal(size=64) * 0.01))) for i in range(40)]
    f = frames.with_signatures(spark.createDataFrame(vecs, "job_id long, frame_id long, vec array<double>"))
    every = f.alias("a").join(f.alias("b"), F.col("a.frame_id") < F.col("b.frame_id")).select(frames.hamming_ratio(F.col("a.signature"), F.col("b.signature"), F.lit(64)).alias("r"))
    for ratio in (0.05, 0.12, 0.4):
        assert frames.near_duplicate_frames(f, ratio).count() == every.where(F.col("r") <= ratio).count()


@pytest.mark.parametrize("ratio", [0.08, 0.36])
def test_large_jobs_meet_in_blocks(spark, monkeypatch, ratio):
    monkeypatch.setattr(frames, "BLOCK", 16)
    rng = random.Random(3)
    base = [[rng.random() for _ in range(64)] for _ in range(12)]
    vecs = [(n % 7 // 6, n, float(n // 2), [x if rng.random() > 0.05 else rng.random() for x in base[n % 12]]) for n in range(150)]
    vecs += [(1, 500 + n, 1.0, base[n][:50] + base[n]) for n in range(3)]
    f = frames.with_signatures(spark.createDataFrame(vecs, "job_id long, frame_id long, t double, vec array<double>"))
    kept = [(r.job_id, r.frame_id, r.t, r.signature, r.bits) for r in f.collect()]
    apart = lambda x, y: sum((p ^ q).bit_count() if (p < 0) == (q < 0) else ((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x[3], y[3], strict=True)) / x[4]
    near = [(x[0], x[1], y[1], round(apart(x, y), 6)) for x in kept for y in kept if x[0] == y[0] and x[1] < y[1] and x[4] == y[4]]
    pairs = frames.near_duplicate_frames(f, ratio)
    assert rows(pairs, "job_id", "a", "b", "ratio") == sorted((p for p in near if p[3] <= ratio), key=repr)
    first = [(x[0], x[1], min((round(apart(x, y), 6) for y in kept if x[0] == y[0] and x[4] == y[4] and (y[2], y[1]) < (x[2], x[1])), default=1.0)) for x in kept]
    assert rows(frames.nearest_distance(f), "job_id", "frame_id", "nearest") == sorted(first, key=repr)
    plan = frames.near_duplicate_frames(f, ratio)._jdf.queryExecution().toString()
    assert ("FlatMapCoGroupsInArrow" in plan) == (ratio == 0.36) and ("strip" in plan) == (ratio == 0.08)


def test_numbers_must_be_reviewed(spark):
    text = "# T\n## Body\nuses 12 and 3.5% at 01:20 see ![7](x(99).md)\n## Timeline\n55 s\n## End\n8 and 55 s"
    docs = spark.createDataFrame([(1, text), (2, "10px 1,000 a1 12%5 v2.5"), (3, "12"), (4, None)], "job_id long, text string")
    reviewed = spark.createDataFrame([(1, "112 and 7"), (3, "x112x")], "job_id long, reviewed string")
    assert rows(quality.unreviewed_numbers(docs, reviewed), "job_id", "numbers") == [(1, ["3.5%", "8"]), (2, ["1", "000", "12", "5"])]


@pytest.mark.parametrize(("bits", "ratio"), [(64, 0.08), (64, 0.2), (100, 0.1), (64, 0.45)])
def test_classes_and_links_expand_to_all_pairs(spark, bits, ratio):
    rng = random.Random(bits)
    marks = [rng.getrandbits(bits) for _ in range(12)]
    marks += [m ^ sum(1 << rng.randrange(bits) for _ in range(rng.randint(0, 9))) & (1 << bits) - 1 for m in marks * 6]
    signed = lambda m: [w - (1 << 64) if w >> 63 else w for w in (m >> 64 * n & (1 << 64) - 1 for n in range(-(-bits // 64)))]
    data = [(n % 2, n, signed(m), bits) for n, m in enumerate(marks + marks[:20])] + [(0, 900, signed(marks[0])[:1], 60), (None, 901, signed(marks[0]), bits)]
    df = spark.createDataFrame(data, "job_id long, frame_id long, signature array<long>, bits int").repartition(3)
    members, links = frames.near_duplicate_classes(df, ratio)
    of = {}
    for r in members.collect():
        of.setdefault((r.job_id, r.class_id), []).append(r.frame_id)
    got = [(j, *sorted((x, y))) for (j, _), own in of.items() for n, x in enumerate(own) for y in own[n + 1 :]]
    for r in links.collect():
        got += [(r.job_id, *sorted((x, y))) for x in of[r.job_id, r.a] for y in of[r.job_id, r.b]]
    apart = lambda x, y: sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x[2], y[2], strict=True))
    want = [(x[0], x[1], y[1]) for x in data for y in data if x[0] is not None and x[0] == y[0] and x[1] < y[1] and x[3] == y[3] and round(apart(x, y) / x[3], 6) <= ratio]
    assert sorted(got) == sorted(want)
    assert (frames.strip_plan(-(-bits // 64), int(bits * ratio)) is None) == (ratio == 0.45)


@pytest.mark.parametrize("cost", [0, 130])
def test_links_of_classes_broadcast_no_flips(spark, monkeypatch, cost):
    monkeypatch.setattr(frames, "ROW_COST", cost, raising=False)
    mask = F.expr("shiftleft(1L, CAST(6 * (id DIV 30) AS INT)) - 1")  # 0, 6, 12 or 18 bits of one of 30 signatures
    df = spark.range(120).select(F.lit(1).cast("long").alias("job_id"), F.col("id").alias("frame_id"), F.array(F.xxhash64(F.col("id") % 30).bitwiseXOR(mask)).alias("signature"), F.lit(64).alias("bits"))
    _, links = frames.near_duplicate_classes(df, 0.2)
    plan = links._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan if cost else "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    kept = {r.frame_id: r.signature[0] & (1 << 64) - 1 for r in df.collect()}
    want = [(1, a, b, round((x ^ y).bit_count() / 64, 6)) for a, x in kept.items() for b, y in kept.items() if a < b and (x ^ y).bit_count() <= 12]
    assert rows(links, "job_id", "a", "b", "ratio") == sorted(want, key=repr) and len(want) >= 150


def test_any_top_heading_may_be_the_title(spark):
    docs = spark.createDataFrame([(1, "A\\E(b", "# x\n#  A\\E(b \ntext"), (2, "A", "# AB"), (3, "A", "## A"), (4, "A", "#\n\nA")], "job_id long, title string, text string")
    assert rows(quality.section_violations(docs, [], body=0), "job_id", "code") == [(2, "title_mismatch"), (3, "title_mismatch")]


def test_frames_are_placed_all_or_none(spark):
    refs = spark.createDataFrame([(1, 1, 1), (1, 2, None), (2, 1, None), (2, 2, None), (3, 1, 1), (3, 1, 1), (4, 9, 7)], "job_id long, frame_id long, step long")
    known = spark.createDataFrame([(j, f) for j in range(1, 5) for f in (1, 2)], "job_id long, frame_id long")
    steps = spark.createDataFrame([(j, 1) for j in range(1, 5)], "job_id long, step long")
    assert rows(quality.visual_violations(refs, known, steps), "job_id", "code") == [(1, "partly_placed"), (3, "repeated_frame"), (4, "unknown_frame"), (4, "unknown_step")]


def test_tags_and_times_without_a_duration(spark):
    tags = spark.createDataFrame([(1, "x", ["a", " a "]), (2, "x", ["a", "b", " "]), (3, "x", ["a", None]), (4, "x", ["a", "b"])], "job_id long, category string, tags array<string>")
    assert rows(quality.taxonomy_violations(tags), "job_id", "code") == [(1, "too_few_tags"), (2, "placeholder_tag"), (3, "placeholder_tag")]
    points = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0)], "job_id long, t double")
    assert rows(quality.timeline_coverage(points, spark.createDataFrame([(1, 0.0), (2, None), (3, 10.0)], "job_id long, duration_s double")), "job_id", "middle_ok") == [(3, True)]


def test_candidates_are_admitted_in_order_of_checks(spark):
    full = quality.CANDIDATE_FIELDS
    cases = [(1, full[:-1], 1, 2, 1, "p"), (2, full[::-1], 3, 2, 2, "p"), (3, full, 1, 1, 3, "p"), (4, full, 1, 2, 5, "p"), (5, full, 1, 2, 5, "q"), (6, full, 1, 2, 6, "p"), (7, full, 1, 2, 7, "p")]
    cands = spark.createDataFrame([(*c, "c") for c in cases], "job_id long, fields array<string>, version int, schema_version int, job_ref long, packet_sha256 string, candidate_sha256 string")
    packets = spark.createDataFrame([(j, "p") for j in range(1, 7)], "job_id long, sha256 string")
    none = spark.createDataFrame([], "job_id long, candidate_sha256 string, packet_sha256 string, decision string")
    got = rows(quality.admit_candidates(cands, packets, none.drop("decision"), none.select("job_id", "decision")), "job_id", "outcome")
    assert got == [(1, "bad_fields"), (2, "bad_version"), (3, "bad_schema_version"), (4, "wrong_job"), (5, "stale_packet"), (6, "admitted"), (7, "unknown_job")]


def test_sealing_follows_the_saga_and_the_target(spark):
    had = [("i", "t", "a", "pending"), ("v", "t", "a", "verified"), ("p", "t", "a", "pending"), ("o", "t", "", "planned"), ("s", "t", "b", "verified"), ("x", "t", "a", "verified"), ("y", "t", "", "planned"), ("z", "t", "b", "verified"), ("n", "u", "b", "pending")]
    targets = spark.createDataFrame(had, "saga_id string, target_name string, expected_sha256 string, status string")
    expected = spark.createDataFrame([(s, "t", "b") for s in "ivposxyzn"], "saga_id string, target_name string, sha256 string")
    states = spark.createDataFrame([(s, "published_unaccepted" if s == "p" else "accepted" if s in "xyz" else "intent") for s in "ivposxyzn"], "saga_id string, state string")
    assert dict(rows(ledger.seal(targets, expected, states), "saga_id", "outcome")) == {
        "i": "resealed", "v": "conflict", "p": "conflict", "o": "sealed", "s": "reused", "x": "conflict", "y": "conflict", "z": "reused", "n": "name_mismatch"}


def test_spans_and_counts_of_batches(spark):
    import datetime as dt

    at = lambda d: dt.datetime(2024, 1, d)
    events = spark.createDataFrame([(1, at(1)), (1, at(3)), (1, at(4)), (2, at(1))], "job_id long, at timestamp_ntz")
    batches = spark.createDataFrame([(1, at(2)), (2, at(2)), (3, at(2))], "job_id long, created_at timestamp_ntz")
    assert rows(work.job_spans(events, batches), "job_id", "first_at", "last_at", "elapsed_s") == [(1, at(3), at(4), 86400.0), (2, at(2), at(2), 0.0), (3, at(2), at(2), 0.0)]
    stages = spark.createDataFrame([(1, "accepted"), (1, "planned"), (1, "planned"), (2, "accepted")], "batch_id long, stage string")
    got = {r.batch_id: (r.jobs, r.accepted, r.failed, r.by_stage, r.state) for r in work.batch_rollup(stages).collect()}
    assert got == {1: (3, 1, 0, {"accepted": 1, "planned": 2}, "running"), 2: (1, 1, 0, {"accepted": 1}, "complete")}


def test_coverage_of_odd_durations(spark):
    selected = spark.createDataFrame([(1, 2.0), (1, 8.0), (2, 1.0), (3, 5.0), (3, 50.0)], "job_id long, t double")
    meta = spark.createDataFrame([(1, 10.0, 4, 10.0, 9.6, 0.5), (2, 0.0, 1, 1.0, 0.0, 0.5), (3, 9.0, 2, None, 9.0, 0.5), (4, 7.0, 3, 7.0, 7.0, 0.2)], "job_id long, duration_s double, sampled long, expected_tail_s double, last_decodable_s double, tolerance_s double")
    got = rows(frames.frame_coverage(selected, meta), "job_id", "frames", "max_gap", "tail_gap", "span_ratio", "reached_end", "omitted")
    assert got == [(1, 2, 6.0, 2.0, 0.6, True, 2), (2, 1, 1.0, 0.0, 1.0, False, 0), (3, 2, 45.0, 0.0, 1.0, False, 0), (4, 0, 7.0, 7.0, 0.0, True, 3)]


def test_ledger_begin(spark):
    digest, other = "a" * 64, "b" * 64
    target = "targets map<string, struct<handle:string, sha256:string>>"
    moved, sealed = {"t": ("q", None)}, {"t": ("q", digest)}
    requests = [
        (1, "j", "k1", "r", digest, digest, {"t": ("p", None)}), (2, "j", "k1", "r", digest.upper(), digest, {"t": ("p", None)}), (3, "j", "k1", "s", digest, digest, moved), (4, "j", "k1", "s", other, digest, moved),
        (5, "x", "k2", "r", digest, digest, moved), (6, "j", "k3", "r", digest, digest, {"t": ("a\\..\\p", None)}), (7, "j", "k4", "r", "short", digest, moved), (8, " ", "k5", "r", digest, digest, moved),
        (9, "j", "old", "s", digest, digest, moved), (10, "j", "old", "s", digest, digest, sealed), (11, "j", "old", "s", digest, digest, {"t": ("p", None)}), (12, "j", "old", "s", digest, digest, {"u": ("q", None)}),
        (13, "j", "seen", "s", digest, digest, moved), (14, "j", "done", "s", digest, digest, moved), (15, "j", "k6", "r", digest, digest, {})]
    df = spark.createDataFrame(requests, "request_id long, job_ref string, idempotency_key string, request_sha256 string, draft_sha256 string, media_sha256 string, " + target)
    known = [(k, "r", "j", digest, digest, state, {"t": ("p", status)}) for k, state, status in (("old", "intent", "pending"), ("seen", "intent", "verified"), ("done", "accepted", "pending"))]
    sagas = spark.createDataFrame(known, "idempotency_key string, request_sha256 string, job_ref string, draft_sha256 string, media_sha256 string, state string, targets map<string, struct<handle:string, status:string>>")
    got = dict(map(tuple, ledger.begin(df, sagas, spark.createDataFrame([("j",)], "job_id string")).collect()))
    assert got == {
        1: "new", 2: "reused", 3: "retargeted", 4: "conflict", 5: "unknown_job", 6: "bad_handle", 7: "bad_digest", 8: "bad_request", 9: "retargeted", 10: "conflict", 11: "conflict", 12: "conflict",
        13: "conflict", 14: "conflict", 15: "bad_request"}


def test_acceptance(spark):
    day = lambda n: f"2024-01-0{n}"
    states = [("a1", "a", 1, "accepted"), ("a2", "a", 2, "published_unaccepted"), ("a0", "a", 0, "published_unaccepted"), ("b1", "b", 1, "published_unaccepted"), ("c1", "c", 1, "intent"), ("d1", "d", 1, "published_unaccepted"), ("e1", "e", 1, "published_unaccepted")]
    sagas = spark.createDataFrame([(s, j, day(n + 1), day(n + 1), st, None, None) for s, j, n, st in states], "saga_id string, job_ref string, created_at string, updated_at string, state string, superseded_at string, superseded_by string")
    sagas = sagas.withColumns({c: F.to_timestamp_ntz(c) for c in ("created_at", "updated_at", "superseded_at")})
    items = spark.createDataFrame([(j, "new") for j in "abcd"], "job_id string, status string")
    good = dict.fromkeys(ledger.REQUIRED_CHECKS, True)
    checks = [("a1", good), ("a2", good), ("a0", good), ("b1", good | {"privacy": None}), ("c1", good), ("d1", {"privacy": True}), ("e1", good), ("zz", good), ("b1", good | {"more": False})]
    outcomes = ledger.accept(sagas, spark.createDataFrame(checks, "saga_id string, checks map<string, boolean>"), items)
    assert rows(outcomes, "saga_id", "outcome") == [
        ("a0", "superseded"), ("a1", "already_accepted"), ("a2", "accepted"), ("b1", "failed_checks"), ("b1", "failed_checks"), ("c1", "not_published"), ("d1", "missing_checks"), ("e1", "unknown_job"), ("zz", "unknown_saga")]
    after, done = ledger.after_acceptance(sagas, items, outcomes, "2024-02-01 00:00:00")
    assert [r for r in rows(after, "saga_id", "state", "superseded_by") if r[0] in ("a1", "a2", "a0")] == [("a0", "published_unaccepted", None), ("a1", "accepted", "a2"), ("a2", "accepted", None)]
    assert rows(done.where("status = 'completed'"), "job_id") == [("a",)]


def test_names_do_not_collide(spark):
    long = "t" * 75
    entries = spark.createDataFrame(
        [(1, "c", "t"), (2, "c", "t"), (3, "c", "t"), (4, "d", "t" * 80), (5, "e", "t"), (6, "e", "t"), (7, "f", "t"), (8, "f", "t (2)"), (9, "f", "t. -"), (10, "g", long + "x"), (11, "g", long + "y"), (12, "g", long + "y"), (13, "g", long + "x")],
        "job_id long, category string, stem string")
    held = spark.createDataFrame([(2, "c", "t"), (90, "e", "t (2)"), (91, "h", "t")], "job_id long, category string, name string")
    got = dict(rows(catalog.assign_names(entries, held), "job_id", "name"))
    assert [got[i] for i in range(1, 10)] == ["t (2)", "t", "t (3)", "t" * 80, "t", "t (3)", "t", "t (2)", "t (3)"]
    assert (got[10], got[11]) == (long + "x", long + "y") and {got[12], got[13]} == {long + "y (2)", long + "x (3)"}
    assert len(set(zip([r.category for r in entries.orderBy("job_id").collect()], [got[i] for i in range(1, 14)], strict=True))) == 13
    tags = spark.createDataFrame([(1, ["A", "a ", "-Straße.", "STRASSE"]), (2, ["A", " "]), (3, []), (4, None), (5, ["nul", "x"]), (6, ["a/b"])], "entry_ref long, tags array<string>")
    got = {r.entry_ref: (r.tags, r.error) for r in catalog.normalize_tags(tags).collect()}
    assert got == {1: (["A", "Straße"], None), 2: (None, "unsafe_tag"), 3: (None, "tags_required"), 4: (None, "tags_required"), 5: (None, "unsafe_tag"), 6: (["a-b"], None)}
