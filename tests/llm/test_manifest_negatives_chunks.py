"""Hard negatives, Merkle manifests and chunk reuse against plain versions."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomfield.llm import chunks, merkle, negatives, queries, reuse, vectors

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCUMENTS = "doc_id long, source string, lang string, n_chars int, text string"
EMBEDDINGS = "vec_id long, embedding array<double>, label int"


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(map(str, r)))


# hard negatives


def plain_negatives(rows, positives=5, wanted=3, low=50, high=95, every=50, scale=256):
    usable = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q, y in usable:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, z) for j, v, z in usable if j != i)
        for p, j, _ in [s for s in scored if s[2] == y][:positives]:
            fits = [(n, m) for n, m, z in scored if z != y and low * -p <= 100 * -n <= high * -p][:wanted]
            out += [(i, j, r, m, -p, -n) for r, (n, m) in enumerate(fits, 1)]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_negatives_equal_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives, "SAMPLE", 40)
    monkeypatch.setattr(negatives, "PAIRS", 64)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 20 * 8 * 19)
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, 19))
    rows = [(i, (centres[i % 4] * rng.random() + 0.7 * rng.standard_normal(19)).tolist(), int(rng.integers(0, 3))) for i in range(700)]
    rows += [(1000 + i, rows[50][1], i % 2) for i in range(120)] + [(2000, [0.0] * 19, 1), (2050, [0.0] * 19, 1), (None, [1.0] * 19, 1), (2051, None, 1), (2052, [1.0] * 19, None)]
    rows += [(2053, [float("nan")] + [1.0] * 18, 1), (2054, [None] + [1.0] * 18, 1)]
    df = spark.createDataFrame(rows, EMBEDDINGS).withColumn("score", F.lit("x")).withColumn("window", F.lit(1)).repartition(7)
    assert ordered(negatives.hard_negatives(df, every=25).collect()) == ordered(plain_negatives(rows, every=25))


def test_negatives_of_few_repeated_and_no_rows(spark):
    few = [(50, [1.0, 0.0], 1), (51, [1.0], 1), (52, [0.9, 0.1], 2), (52, [0.6, 0.1], 2), (53, [-1.0, 0.0], 1), (100, [0.0, 1.0], 3)]
    got = ordered(negatives.hard_negatives(spark.createDataFrame(few, EMBEDDINGS)).collect())
    assert got == [(50, 51, 1, 52, 65536, 230 * 256)]
    assert negatives.hard_negatives(spark.createDataFrame([], EMBEDDINGS)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], EMBEDDINGS)).collect() == []


def test_exact_products_beyond_doubles_and_longs():
    a, b = np.array([[2.0**31 + 1, 3.0], [2.0**40, 1.0], [1e30, 1.0]]), np.array([[2.0**29 + 1, 5.0], [-(2.0**30), 1.0], [0.0, 7.0]])
    want = [(2**31 + 1) * (2**29 + 1) + 15, -(2**63), 7]
    assert vectors.exact_products(a, b).tolist() == want


def test_lists_leave_out_covered_dimensions():
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((50, 24)) * np.r_[np.full(8, 100.0), np.full(16, 1.0)]
    block = negatives.Block(np.arange(50), np.zeros(50), rows, negatives._rest(rows))
    scores = rows @ rows.T
    least = np.full(50, 3000.0)
    found = {(int(a), int(c)) for q, z in negatives._candidates(block, np.arange(50), least, rows, block.rest, np.ones((50, 50), bool)) for a, c in zip(q, z, strict=True)}
    reach = {(int(a), int(c)) for a, c in zip(*np.nonzero(scores >= least[:, None]), strict=True)}
    assert reach <= found and len(found) < 1.3 * len(reach) + 20


# Merkle manifests


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    steps, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, w in enumerate(where):
            run = nodes[w // 16 * 16 :][:16]
            steps[leaf].append((run[: w % 16], run[w % 16 + 1 :]))
            where[leaf] = w // 16
        nodes = [H(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], steps


def plain_leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[s] = plain_tree([plain_leaf(r) for r in by[s]])
    root, above = plain_tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, above, strict=True):
        for r, steps in zip(by[s], trees[s][1], strict=True):
            path, found = steps + top, plain_leaf(r)
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                found = plain_leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for before, after in path:
                found = H(*before, found, *after)
            out.append((r[0], plain_leaf(r), trees[s][0], root, H(*[d for p in path for side in p for d in side]), found, found == root))
    return out


CASES = [(1, "a", "x", 3, "Abc"), (None, "a", None, None, None), (1, "a", "x", 3, "Abc"), (2, None, "x", 0, ""), (7, "ä", "x", 3, "Q"), (8, "", "x", 3, "É:-")]


@pytest.mark.parametrize("rows", [
    CASES + [(i, "b", "l", 1, "T" * i) for i in range(17)] + [(i, f"s{i}", "l", 1, "T" * i) for i in range(40)],
    CASES[:1], [(i, "b", "l", 1, "T" * i) for i in range(17)], [(i, "z", "l", 1, f"Z{i}") for i in range(300)], [(5, "r", "l", 1, "Same")] * 40,
])
def test_manifest_equals_the_plain_version(spark, monkeypatch, rows):
    monkeypatch.setattr(merkle, "BROADCAST_NODES", 2)
    df = spark.createDataFrame(rows, DOCUMENTS).withColumns({"digest": F.lit(1), "key": F.lit(2), "path": F.lit("p")})
    assert ordered(merkle.tamper_check(df).collect()) == ordered(plain_manifest(rows))


def test_manifest_of_the_tables_and_of_nothing(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = queries.op12_merkle_manifest(spark, small).collect()
    assert ordered(got) == ordered(plain_manifest(rows)) and not all(r.verified for r in got)
    assert merkle.tamper_check(spark.createDataFrame([], DOCUMENTS)).collect() == []


def test_manifest_nodes_cover_intervals(spark):
    df = spark.createDataFrame([(i, "z", "l", 1, f"Z{i}") for i in range(300)], DOCUMENTS)
    leaves = df.select("doc_id", "source", merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("digest"))
    nodes = merkle.manifest_nodes(merkle.build_manifest(leaves)).where("tree = 'documents'").collect()
    spans = sorted((n.level, n.lo, n.hi) for n in nodes)
    assert spans == [(1, i, min(i + 15, 299)) for i in range(0, 300, 16)] + [(2, 0, 255), (2, 256, 299), (3, 0, 299)]


# chunk reuse


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def plain_digests(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def odd_texts(seed, n):
    rng = random.Random(seed)
    bits = ["hello", "WORLD's", "<|endoftext|>", "é", "é", "日本語", " ", " ", "\n", "\t", "x" * 50, "123", "¡¿", "'re", " ", "Σς", "́", "ﬁ", "🙂", "<|startoftext|>", " "]
    shared = ["".join(rng.choice(bits) for _ in range(600)) for _ in range(6)]
    make = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(40))) + rng.choice(shared)[rng.randrange(300) :]
    return ["".join(make() for _ in range(rng.randrange(4))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_chunked_ids_equal_the_library(spark, library, monkeypatch, seed):
    monkeypatch.setattr(reuse, "REMEMBERED", 3)
    rows = [(None, None), (1, ""), (1, ""), (2, " "), (3, "x" * 20000), (4, "ab " * 9000), (5, "日" * 5000), (5, "日" * 5000)]
    rows += list(enumerate(odd_texts(seed, 150), 10))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "row": F.lit(2)}).repartition(5)
    assert ordered(reuse.word_token_digests(df, VOCABULARY).collect()) == ordered(plain_digests(library, *r) for r in rows)
    for r in reuse.encode_words(df, VOCABULARY).where("doc_id >= 10").collect():
        ids = library.encode(rows[r.doc_id - 2][1], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_chunked_tables_and_nothing(spark, library, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert ordered(queries.op13_chunk_bpe(spark, small).collect()) == ordered(plain_digests(library, *r) for r in rows)
    assert reuse.word_token_digests(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).collect() == []


def test_repeated_passages_are_cut_alike():
    import pyarrow as pa

    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(6000))
    texts = ["".join(rng.choice("xyz ") for _ in range(n)) + passage for n in (0, 77, 501)]
    data, offsets = chunks.bytes_of(pa.array(texts))
    found = []
    for start, ends in zip(offsets[:-1].tolist(), chunks.chunk_ends(data, offsets), strict=True):
        assert ends[-1] == offsets[len(found) + 1] and all(chunks.LEAST <= b - a <= chunks.MOST + 3 for a, b in zip([start, *ends], ends[:-1], strict=False))
        found.append({data[a:b].tobytes() for a, b in zip([start, *ends], ends, strict=False)})
    assert len(found[0] & found[1] & found[2]) > len(found[0]) / 2


def test_each_repeated_chunk_is_encoded_once(spark):
    rng = random.Random(4)
    passage = " ".join(str(rng.random()) for _ in range(300))
    df = spark.createDataFrame([(i, f"{rng.random()} " * 9 + passage) for i in range(60)], "doc_id long, text string").repartition(6)
    parted, _ = reuse._pieced(df, VOCABULARY)
    texts = parted.where("row IS NULL")
    assert texts.select("k1", "k2").distinct().count() * 40 < parted.where("row IS NOT NULL AND k1 IS NOT NULL").count()
    assert texts.count() <= 6 * texts.select("k1", "k2").distinct().count()
