"""Media inventory: change classes, container sniffing, variants, allowed links, digests and manifests."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading bytes (hex, from an offset) of media containers.
CONTAINERS = [(4, "66747970", "iso-bmff"), (0, "1A45DFA3", "ebml"), (0, "464C56", "flv"), (0, "4F676753", "ogg")]
#: A file name of 12 bytes at least; transport packets of 188 bytes begin with 47.
LEAST_NAMED, PACKET, SYNC = 12, 188, "47"
#: Box names that mark protected media with their least sizes, and the largest media file.
PROTECTED_BOXES = {b"pssh": 32, b"sinf": 8, b"schm": 20, b"encv": 8, b"enca": 8}
LARGEST = 1 << 30
#: The bytes around a box name: its size before, and what follows. The look-ahead finds names that overlap.
BOX = re.compile(rb"(?s)(.{4})(?=(" + b"|".join(PROTECTED_BOXES) + rb")(.{0,8}))")


def inventory_diff(prev: DataFrame, scan: DataFrame) -> DataFrame:
    """media_path, change (inserted, updated, unchanged, missing), status after the scan; a changed file starts anew."""
    p, s = prev.alias("p"), scan.alias("s")
    same = F.col("p.size_bytes").eqNullSafe(F.col("s.size_bytes")) & F.col("p.modified_ns").eqNullSafe(F.col("s.modified_ns")) & F.col("p.content_hash").eqNullSafe(F.col("s.content_hash"))
    change = (
        F.when(F.col("p.media_path").isNull(), "inserted").when(F.col("s.media_path").isNull(), "missing").when(same, "unchanged").otherwise("updated")
    )
    status = F.when(change.isin("inserted", "updated"), "new").when(change == "missing", "missing").otherwise(F.col("p.status"))
    return p.join(s, F.col("p.media_path") == F.col("s.media_path"), "full_outer").select(
        F.coalesce("p.media_path", "s.media_path").alias("media_path"), change.alias("change"), status.alias("status"),
        F.coalesce("s.content_hash", "p.content_hash").alias("content_hash"),
    )


def inventory_status(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def media_kind(scan: DataFrame) -> DataFrame:
    """Adds kind by the leading bytes of content, null if unknown."""
    packets = [F.hex(F.substring("content", n * PACKET + 1, 1)) == SYNC for n in range(3)]
    kind = F.when(packets[0] & packets[1] & packets[2], "mpeg-ts")
    for offset, magic, name in reversed(CONTAINERS):
        lead = F.hex(F.substring("content", offset + 1, len(magic) // 2)) == magic
        kind = F.when(lead & (F.length("content") >= (LEAST_NAMED if offset else 0)), name).otherwise(kind)
    return scan.withColumn("kind", kind)


def _plausible(size: int, name: bytes, rest: bytes) -> bool:
    """Whether what stands around a box name is a box: a size in range, and the fields that its kind begins with."""
    if not PROTECTED_BOXES[name] <= size <= LARGEST:
        return False
    if name == b"sinf":  # a container, whose first child has a known name
        return len(rest) == 8 and 8 <= int.from_bytes(rest[:4], "big") <= size - 8 and rest[4:] in (b"frma", b"schm", b"schi")
    if name in (b"pssh", b"schm"):  # version 0 or 1, and no flags
        return rest[:4] in (b"\0\0\0\0", b"\1\0\0\0")
    return len(rest) == 8 and rest[:6] == bytes(6) and rest[6:] != bytes(2)  # a sample entry: reserved bytes and an index


def _protected(content: bytes) -> bool:
    """Whether the header of a protection box occurs."""
    at = 0
    while m := BOX.search(content, at):
        if _plausible(int.from_bytes(m[1], "big"), m[2], m[3]):
            return True
        at = m.start() + 1
    return False


def protected_media(scan: DataFrame) -> DataFrame:
    """Adds protected."""

    @F.pandas_udf("boolean")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda c: _protected(bytes(c)) if c is not None else False)

    return scan.withColumn("protected", test("content"))


def file_facts(ranges: DataFrame) -> DataFrame:
    """media_path, length, kind, protected of files in overlapping ranges (media_path, size_bytes, offset, content).

    A range is searched by the task that read it; a protection box's header that begins
    in a range ends within its overlap. The kind is that of the first range, of at
    least 377 bytes where packets count. No row or group holds a file.
    """
    marked = protected_media(media_kind(ranges)).withColumn("kind", F.when(F.col("offset") == 0, F.col("kind")))
    return marked.groupBy("media_path").agg(F.max("size_bytes").alias("length"), F.max("kind").alias("kind"), F.bool_or("protected").alias("protected"))


def rank_variants(items: DataFrame) -> DataFrame:
    """item_id, urls: https links of valid variants, best first, each once; the plain address comes last.

    items: item_id, plain_url, variants array<struct<width, height, bitrate, url>>.
    Variants rank by shorter side, area and bitrate, all descending.
    """
    valid = F.filter("variants", lambda v: (v["width"] > 0) & (v["height"] > 0) & v["url"].startswith("https://"))
    keyed = F.transform(valid, lambda v: F.struct(
        (-F.least(v["width"], v["height"])).alias("a"), (-v["width"] * v["height"]).alias("b"), (-F.coalesce(v["bitrate"], F.lit(0))).alias("c"), v["url"].alias("url"),
    ))
    ordered = F.transform(F.array_sort(keyed), lambda v: v["url"])
    plain = F.when(F.col("plain_url").startswith("https://"), F.array("plain_url")).otherwise(F.array().cast("array<string>"))
    return items.select("item_id", F.array_distinct(F.concat(F.coalesce(ordered, F.array().cast("array<string>")), plain)).alias("urls"))


def allowed_urls(df: DataFrame, suffixes: Sequence[str], col: str = "url") -> DataFrame:
    """Adds allowed: https, no user, port absent or 443, and a host that is or ends in one of the suffixes."""
    url = F.col(col)
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    authority = F.try_parse_url(url, F.lit("AUTHORITY"))
    port = F.regexp_extract(authority, r":([0-9]*)$", 1)
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | (host == s) | host.endswith("." + s)
    ok = (F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & ~F.contains(authority, F.lit("@")) & port.isin("", "443") & ends
    return df.withColumn("allowed", F.coalesce(ok, F.lit(False)))


def media_outcome(scan: DataFrame, limit_bytes: int = 1 << 30) -> DataFrame:
    """Adds outcome for files with length, expected_length, kind and protected."""
    outcome = (
        F.when(F.col("length") > limit_bytes, "too_large").when(F.col("length") == 0, "empty")
        .when(F.col("expected_length").isNotNull() & (F.col("expected_length") != F.col("length")), "length_mismatch")
        .when(F.col("protected"), "protected").when(F.col("kind").isNull(), "bad_signature")
        .when(F.col("kind") != "iso-bmff", "unsupported_container").otherwise("ok")
    )
    return scan.withColumn("outcome", outcome)


def tree_digest(artifacts: DataFrame) -> DataFrame:
    """bundle, files, digest: a hash over the sorted (path, file hash) pairs; contents are hashed per file only."""
    pair = F.concat("rel_path", F.lit(":"), "sha256")
    return artifacts.groupBy("bundle").agg(
        F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), "\n"), 256).alias("digest")
    )


def verify_inventory(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """bundle, rel_path, problem: missing, unexpected, size or sha256 of artifacts (bundle, rel_path, size, sha256)."""
    e, a = expected.alias("e"), actual.alias("a")
    problem = (
        F.when(F.col("a.rel_path").isNull(), "missing").when(F.col("e.rel_path").isNull(), "unexpected")
        .when(F.col("e.size") != F.col("a.size"), "size").when(F.col("e.sha256") != F.col("a.sha256"), "sha256")
    )
    on = (F.col("e.bundle") == F.col("a.bundle")) & (F.col("e.rel_path") == F.col("a.rel_path"))
    joined = e.join(a, on, "full_outer").withColumn("problem", problem).where("problem IS NOT NULL")
    return joined.select(F.coalesce("e.bundle", "a.bundle").alias("bundle"), F.coalesce("e.rel_path", "a.rel_path").alias("rel_path"), "problem")


def analysis_current(manifests: DataFrame, observed: DataFrame, version: str, required: Sequence[str]) -> DataFrame:
    """job_id, current: version, end reached, source hash as observed, and all required artifacts present."""
    missing = F.array_except(F.array(*map(F.lit, required)), F.col("artifacts"))
    ok = (F.col("version") == version) & F.col("reached_end") & (F.col("source_sha256") == F.col("observed_sha256")) & (F.size(missing) == 0)
    return manifests.join(observed, "job_id", "left").select("job_id", F.coalesce(ok, F.lit(False)).alias("current"))


def hash_drift(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, before, after where they differ; a key may be on one side only."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return b.join(a, key, "full_outer").where("NOT (before <=> after)")
