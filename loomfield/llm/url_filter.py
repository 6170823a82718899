"""URL filters: host and path rules, and a Bloom filter cascade over listed domains.

Level 0 of the cascade encodes the listed keys. Level 1 encodes the keys of the
corpus that level 0 takes for listed although they are not, level 2 the listed
keys that level 1 takes for such, and so on until a level has no false positive
in the complete key universe. Membership is then exact for every key of the
corpus, and a task needs the few bits of the cascade instead of a join.

Keys are hosts and their parent domains. They are dealt into shards by CRC-32;
each shard has its own cascade, so no task sees more than about SHARD_KEYS keys.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.tables import materialise

#: Keys, about, whose cascade one task builds.
SHARD_KEYS = 50_000
#: Cascades of at most so many bytes are broadcast; larger ones are applied shard by shard.
BROADCAST_BYTES = 64 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FILTERS = "shard int, level int, hashes int, size long, bits binary"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_column(rules: Sequence[tuple[str, str]], value: int) -> Column:
    """The longest fitting rule (value 0) or its verdict (value 1); null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, path = rule[0].partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.lit(rule[value])).otherwise(out)
    return out


def _bits(keys: Sequence[str], level: int, hashes: int, size: int) -> np.ndarray:
    """(keys, hashes) bit places by double hashing, other ones at each level."""
    a = np.array([xxhash.xxh64_intdigest(k, 2 * level) for k in keys], np.uint64)
    b = np.array([xxhash.xxh64_intdigest(k, 2 * level + 1) | 1 for k in keys], np.uint64)
    return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(size)


def _holds(keys: Sequence[str], level: int, hashes: int, size: int, bits: bytes) -> np.ndarray:
    if not len(keys):
        return np.zeros(0, bool)
    flags, at = np.frombuffer(bits, np.uint8), _bits(keys, level, hashes, size)
    return ((flags[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(1)


def build_levels(listed: list[str], others: list[str]) -> list[tuple[int, int, int, bytes]]:
    """(level, hashes, size, bits) of a cascade that tells ``listed`` from ``others``."""
    levels: list[tuple[int, int, int, bytes]] = []
    encode, test = listed, others
    while encode:
        share = min(0.5, max(1e-6, len(encode) / max(1, len(test)) / math.sqrt(2))) if not levels else 0.5
        hashes = max(1, round(-math.log2(share)))
        size = max(8, math.ceil(1.4427 * len(encode) * hashes))
        flags = np.zeros(-(-size // 8), np.uint8)
        at = _bits(encode, len(levels), hashes, size).ravel()
        np.bitwise_or.at(flags, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        levels.append((len(levels), hashes, size, flags.tobytes()))
        wrong = _holds(test, *levels[-1])
        encode, test = [k for k, w in zip(test, wrong, strict=True) if w], encode
    return levels


def is_listed(keys: Sequence[str], levels: list[tuple[int, int, int, bytes]]) -> np.ndarray:
    """Exact membership of keys of the universe: a key is listed if the first level without it is odd."""
    out, left = np.zeros(len(keys), bool), np.arange(len(keys))
    for level in levels:
        held = _holds([keys[i] for i in left], *level)
        out[left[~held]] = level[0] % 2 == 1
        left = left[held]
    if levels:
        out[left] = (len(levels) - 1) % 2 == 0
    return out


def suffixes(host: str, most: int) -> list[str]:
    """The host and its parent domains of at most so many labels, longest first."""
    labels = host.rsplit(".", most)[-most:]
    return [".".join(labels[i:]) for i in range(len(labels))] if host else []


def _parents(most: int) -> Column:
    """The same of the column host."""
    labels = F.split("host", r"\.")
    return F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))


def most_labels(listed: DataFrame) -> int:
    """Labels of the longest listed key; a longer parent domain cannot be listed, so it is not asked for."""
    return max(1, listed.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 0)


def build_cascade(hosts: DataFrame, listed: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Cascades of all shards as a table, and the number of shards. hosts: host (distinct); listed: key, of at most so many labels."""
    universe = hosts.where("host <> ''").select(F.explode(_parents(most)).alias("key")).distinct()
    keys = universe.join(listed.select("key").distinct().withColumn("listed", F.lit(True)), "key", "left").fillna({"listed": False})
    keys = materialise(keys, "urls")
    shards = keys.count() // SHARD_KEYS + 1

    def build(shard: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mine = rows["listed"].astype(bool)
        levels = build_levels(sorted(rows["key"][mine]), sorted(rows["key"][~mine]))
        return pd.DataFrame([(shard[0], *level) for level in levels], columns=["shard", "level", "hashes", "size", "bits"])

    dealt = keys.withColumn("shard", F.pmod(F.crc32(F.encode("key", "UTF-8")), F.lit(shards)).cast("int"))
    return materialise(dealt.groupBy("shard").applyInPandas(build, FILTERS), "cascade"), shards


def _judge(hosts: Sequence[str], levels: dict[int, list], shards: int, most: int) -> dict[str, bool]:
    """Whether each host or a parent domain of it is listed."""
    keys = sorted({s for h in hosts for s in suffixes(h, most)})
    shard = np.array([zlib.crc32(k.encode()) % shards for k in keys], np.int64)
    listed: set[str] = set()
    for s in np.unique(shard):
        own = [keys[i] for i in np.flatnonzero(shard == s)]
        listed.update(k for k, w in zip(own, is_listed(own, levels.get(int(s), [])), strict=True) if w)
    return {h: any(s in listed for s in suffixes(h, most)) for h in hosts}


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], listed: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Judge every url: page_id, host, path, rule, verdict (allow or block).

    The longest rule (``host/path`` and its verdict) that fits decides; without
    one, the cascade blocks a url whose host or a parent domain is in ``listed``
    (a table with a string column key). Defined cases: a null url, or one without
    ``://``, has an empty host and path, fits no rule and is allowed; repeated
    rows are judged each; a host of any length costs no more than the labels of the
    longest listed key; an empty table or list works; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumns({"rule": rule_column(rules, 0), "ruled": rule_column(rules, 1)})
    hosts = parsed.select("host").distinct()
    most = most_labels(listed)
    cascade, shards = build_cascade(hosts, listed, most)
    if (cascade.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) <= broadcast_bytes:
        levels: dict[int, list] = {}
        for r in cascade.orderBy("shard", "level").collect():
            levels.setdefault(r["shard"], []).append((r["level"], r["hashes"], r["size"], bytes(r["bits"])))
        shared = pages.sparkSession.sparkContext.broadcast(levels)

        @F.pandas_udf("boolean")
        def listed_host(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield batch.map(_judge(batch.unique(), shared.value, shards, most)).astype(bool)

        judged = parsed.withColumn("listed", listed_host("host"))
    else:
        judged = parsed.join(_listed_hosts(hosts, cascade, shards, most), "host", "left").fillna({"listed": False})
    verdict = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _listed_hosts(hosts: DataFrame, cascade: DataFrame, shards: int, most: int) -> DataFrame:
    """host, listed (true) where the cascades are too large to broadcast: each meets the keys of its shard only."""
    keyed = hosts.where("host <> ''").select("host", F.explode(_parents(most)).alias("key"))
    keys = keyed.select("key").distinct().withColumn("shard", F.pmod(F.crc32(F.encode("key", "UTF-8")), F.lit(shards)).cast("int"))

    def test(keys_pd: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        own = list(keys_pd["key"])
        levels = [tuple(r) for r in filters.sort_values("level")[["level", "hashes", "size", "bits"]].itertuples(index=False)]
        return pd.DataFrame({"key": [k for k, w in zip(own, is_listed(own, levels), strict=True) if w]}, dtype=object)

    found = keys.groupBy("shard").cogroup(cascade.groupBy("shard")).applyInPandas(test, "key string")
    return keyed.join(found, "key", "left_semi").select("host").distinct().withColumn("listed", F.lit(True))
