"""Merkle manifest of a dataset: a tree over each source's documents, and one over the sources.

Every node carries the interval of leaf places that it covers. Leaves are
numbered within their source by ranges of ids; each run of consecutive nodes of a
level becomes a node of the next one, so a level has a sixteenth of the rows of
the level below. From the top down, nodes are joined with the parent whose
interval contains their own, by buckets of the level, and take over the parent's
path: the parent's children whose intervals lie before and after a node's own are
its siblings. Documents meet their ancestors as runs of leaves, once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.llm.tables import materialise
from loomfield.operators.ranks import numbered

#: Children of a node at most.
WIDTH = 16
#: Nodes of a level up to which it is broadcast to the level below (about 8 kB each); beyond, both are dealt by bucket.
BROADCAST_NODES = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Manifest(NamedTuple):
    """Levels of the documents' trees and of the tree over sources, lowest first.

    Rows are nodes: key (of the source), bucket, lo, hi (places of the leaves
    covered, from 0), digest, children (in order: lo, hi, digest; in the lowest level
    also what the leaves carry).
    """

    documents: list[DataFrame]
    sources: list[DataFrame]


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 of the values, each as its number of UTF-8 bytes, a colon and itself; null as -."""

    def value(col: Column) -> Column:
        col = col.cast("string")
        return F.coalesce(F.concat(F.octet_length(col).cast("string"), F.lit(":"), col), F.lit("-"))

    return F.sha2(F.concat(*map(value, (doc_id, source, lang, n_chars, text))), 256)


def _alone(children: Column) -> Column:
    """Whether these are all the nodes of a key: a single one, which is its root."""
    return (F.size(children) == 1) & (children[0]["lo"] == 0)


def _runs(nodes: DataFrame, label: str) -> DataFrame:
    """Each run of WIDTH nodes (key, bucket, lo, hi, digest and more) as a node; the only node of a key keeps its digest."""
    fields = [c for c in nodes.columns if c not in ("key", "bucket")]
    runs = nodes.groupBy("key", F.expr(f"bucket div {WIDTH}").alias("bucket")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("children"))
    first, children = F.col("children")[0], F.col("children")
    digest = F.when(_alone(children), first["digest"]).otherwise(F.sha2(F.array_join(F.transform(children, lambda c: c["digest"]), ""), 256))
    return materialise(runs.select("key", "bucket", first["lo"].alias("lo"), F.element_at(children, -1)["hi"].alias("hi"), digest.alias("digest"), "children"), label, True)


def _levels(leaves: DataFrame, label: str) -> list[DataFrame]:
    """Runs of leaves (key, place, digest and more), runs of those, and so on until each key has one node."""
    place = F.col("place") - 1
    carried = [c for c in leaves.columns if c not in ("key", "place")]
    levels = [_runs(leaves.select("key", place.alias("bucket"), place.alias("lo"), place.alias("hi"), *carried), label)]
    while (levels[-1].agg(F.max("bucket")).first()[0] or 0) > 0:
        levels.append(_runs(levels[-1].select("key", "bucket", "lo", "hi", "digest"), label))
    return levels


def build_manifest(leaves: DataFrame) -> Manifest:
    """The trees over leaves (source, doc_id, digest and more, which the leaves carry along).

    Leaves stand in the order of doc_id (null first; equal ids by digest), sources in
    the order of their UTF-8 bytes (null first). No window or group holds more of a
    source than a range of it. An empty table gives empty levels.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # in the order of sources, never null
    carried = [c for c in leaves.columns if c not in ("source", "digest")]
    placed = numbered(leaves.select(key.alias("key"), "digest", *carried), ["key"], [F.asc_nulls_first("doc_id"), "digest"], "place")
    documents = _levels(placed, "nodes")
    roots = numbered(documents[-1].select("key", "digest"), [], ["key"], "place")
    return Manifest(documents, _levels(roots.select(F.lit("").alias("key"), "place", "digest", F.col("key").alias("source_key")), "sources"))


def manifest_nodes(manifest: Manifest) -> DataFrame:
    """tree (documents or sources), key, level (from 1), lo, hi, digest of all nodes above the leaves, but for lone nodes carried up."""
    out = None
    for tree, levels in manifest._asdict().items():
        for n, level in enumerate(levels, 1):
            own = level if n == 1 else level.where(~_alone(F.col("children")))
            rows = own.select(F.lit(tree).alias("tree"), "key", F.lit(n).alias("level"), "lo", "hi", "digest")
            out = rows if out is None else out.unionByName(rows)
    return out


def _step(children: Column, lo: Column, hi: Column, path: Column) -> Column:
    """The path of the child with the interval lo to hi: what lies before and after it in the parent, then the parent's own path."""
    digests = lambda f: F.array_join(F.transform(F.filter(children, f), lambda c: c["digest"]), "")
    beside = F.struct(digests(lambda c: c["hi"] < lo).alias("before"), digests(lambda c: c["lo"] > hi).alias("after"))
    return F.when(_alone(children), path).otherwise(F.concat(F.array(beside), path))


def _small(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df``, for broadcast if ``rows``, which it is made from row by row, are few."""
    return F.broadcast(df) if rows.count() <= BROADCAST_NODES else df


def _ways(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The nodes of the lowest level with path, from their parent up, and what tops (_key, path and more) have for the roots."""
    kept = [c for c in tops.columns if c not in ("_key", "path")]
    held = levels[-1].join(_small(tops, levels[-1]), F.col("key") == F.col("_key")).drop("_key")
    for level in reversed(levels[:-1]):
        parents = held.select(*[F.col(c).alias(f"_{c}") for c in ("key", "bucket", "lo", "hi", "children", "path")], *kept)
        within = (F.col("key") == F.col("_key")) & (F.expr(f"bucket div {WIDTH}") == F.col("_bucket")) & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
        met = level.join(_small(parents, held), within)
        held = met.select(*level.columns, _step(F.col("_children"), F.col("lo"), F.col("hi"), F.col("_path")).alias("path"), *kept)
        if level is not levels[0]:
            held = materialise(held, "ways", True)
    return held


def _leaves(runs: DataFrame, kept: list[str]) -> DataFrame:
    """The children of the lowest level with their own path, and kept columns."""
    each = runs.select("children", "path", *kept, F.explode("children").alias("leaf"))
    return each.select("leaf.*", *kept, _step(F.col("children"), F.col("leaf.lo"), F.col("leaf.hi"), F.col("path")).alias("path"))


def inclusion_proofs(manifest: Manifest) -> DataFrame:
    """digest of each leaf and what it carries, subroot, root, and path: before and after, the joined digests of its siblings, level by level."""
    top = manifest.sources[-1].select(F.col("key").alias("_key"), F.col("digest").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    sources = _leaves(_ways(manifest.sources, top), ["root"])
    tops = materialise(sources.select(F.col("source_key").alias("_key"), F.col("digest").alias("subroot"), "root", "path"), "tops", True)
    return _leaves(_ways(manifest.documents, tops), ["subroot", "root"]).drop("lo", "hi")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, start, lambda d, p: F.sha2(F.concat(p["before"], d, p["after"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, from left to right and from the lowest level up."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def tamper_check(documents: DataFrame, every: int = 5) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    folded_root is recomputed from the leaf and its siblings; where ``every`` divides
    the CRC-32 of the id's digits, from the leaf of the document with A-Z of its
    text lower-cased, so ``verified`` tells whether that changed it. Defined cases:
    nulls in any column count as such in the leaf; a null doc_id comes first in its
    source and is not tampered with, a null source first of the sources; rows that
    repeat an id stand in the order of their leaves, equal rows are leaves each; a
    lone leaf is its subroot, a lone subroot the root; texts of any length are
    hashed whole; an empty table gives no rows; other columns are ignored.
    """
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, leaf_digest(*own, F.translate("text", UPPER, LOWER)))
    leaves = documents.select("doc_id", "source", leaf_digest(*own, F.col("text")).alias("digest"), altered.alias("altered"))
    proofs = inclusion_proofs(build_manifest(leaves))
    found = folded(F.coalesce("altered", "digest"), F.col("path"))
    out = proofs.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), found.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
