"""URL filters, vector searches, the Jaccard join and the pipeline against brute force."""

import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomfield.llm import ann, components, jaccard, queries, topk, url_filter


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 3000), max_size=200), st.sets(st.integers(0, 3000), max_size=600))
def test_cascade_is_exact_over_its_universe(listed, others):
    a, b = sorted(map(str, listed)), sorted(map(str, others - listed))
    levels = url_filter.build_levels(a, b)
    assert url_filter.is_listed(a, levels).all() and not url_filter.is_listed(b, levels).any()


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_url_verdicts(spark, limit):
    urls = [None, "no scheme", "https://A.Spam.example.org:80/x", "http://example.org?u://en/", "https://x.example.com/en/1", "https://www.example.com/en/1#a", "https://shop.net/es/?q", "https://shop.net", "http://com/", "x://spam.example.org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame([("spam.example.org",), ("other.org",)], "key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, queries.URL_RULES, listed, limit).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.spam.example.org:80", "/x", None, "allow") and got[9] == ("spam.example.org", "", None, "block")
    assert got[3] == ("example.org", "", None, "allow") and got[4][2:] == ("example.com/en/", "block") and got[5][2:] == ("www.example.com/en/", "allow")
    assert got[6] == ("shop.net", "/es/", "net/es/", "block") and got[7][2:] == (None, "allow") and got[8][2:] == ("com/", "allow")
    long = pages.limit(1).withColumn("url", F.concat(F.lit("x://"), F.repeat(F.lit("a."), 50_000), F.lit("spam.example.org/p")))
    assert url_filter.filter_urls(long, queries.URL_RULES, listed, limit).first().verdict == "block"
    assert url_filter.filter_urls(pages.limit(0), queries.URL_RULES, listed.limit(0), limit).count() == 0


def vectors(spark, n=400, d=12, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, list(map(float, rng.normal(size=d) * (1 + i % 7)))) for i in range(n)]
    rows += [(n, None), (n + 1, [1.0, None]), (n + 2, [float("nan")] * d), (n + 3, [float("inf")] * d), (None, [1.0] * d), (n + 4, [0.0] * d), (n + 5, rows[3][1]), (n + 6, rows[3][1]), (n + 6, rows[3][1])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))


def usable(rows, zero):
    return {i: np.array(v) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and (zero or any(v))}


def test_exact_top_k(spark):
    rows, df = vectors(spark)
    good = {i: np.floor(1024 * v).astype(np.int64) for i, v in usable(rows, True).items()}
    want = []
    for q in (i for i in good if i % 20 == 0):
        best = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for partitions in (1, 5):
        assert sorted(map(tuple, topk.exact_top_k(df.repartition(partitions), every=20).collect())) == sorted(want)
    assert topk.exact_top_k(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="beyond a long"):
        topk.exact_top_k(spark.createDataFrame([(0, [1e17]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()
    few = df.where("vec_id IN (0, 1, 2)")
    assert sorted((r.query_id, r.vec_id) for r in topk.exact_top_k(few, every=2).collect()) == [(0, 1), (0, 2), (2, 0), (2, 1)]


def test_exact_top_k_of_large_components_and_many_dimensions(spark):
    rng = np.random.default_rng(8)
    for dim, scale in ((3, 2.0**18), (600, 1.0)):
        rows = [(i, [float(x) for x in rng.normal(size=dim) * scale]) for i in range(200)]
        ints = np.floor(1024 * np.array([v for _, v in rows])).astype(np.int64).astype(object)
        want = []
        for q in range(0, 200, 20):
            best = sorted((-int(ints[q] @ ints[i]), i) for i in range(200) if i != q)[:10]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        assert sorted(map(tuple, topk.exact_top_k(df, every=20).collect())) == sorted(want)


def test_exact_top_k_beside_a_huge_vector(spark):
    """Only scores that are asked for must fit a long, and those of wide vectors are exact."""
    rows = [(0, [0.0, 1.0]), (1, [1e17, 0.0]), (2, [2.0**31, 3.0]), (20, [2.0**21 + 1, 2.0]), (3, [2.0**20, 2.0**20])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.vec_id, r.score) for r in topk.exact_top_k(df.where("vec_id <> 20"), every=20).collect())
    assert got == [(0, 1, 0), (0, 2, 3 << 20), (0, 3, 1 << 40)]
    ints = {i: [int(1024 * x) for x in v] for i, v in rows}
    want = sorted(((sum(a * b for a, b in zip(ints[20], ints[i], strict=True)), i) for i in (0, 2, 3)), reverse=True)
    few = topk.exact_top_k(df.where("vec_id <> 1"), k=3, every=20).where("query_id = 20").orderBy("rank")
    if want[0][0] < 2**63:
        assert [(r.score, r.vec_id) for r in few.collect()] == want
    else:
        with pytest.raises(Exception, match="beyond a long"):
            few.collect()


def test_neighbours_recall_and_scores(spark):
    rows, df = vectors(spark, 1500, 16)
    good = usable(rows, False)
    found = {}
    for r in ann.nearest_neighbours(df.repartition(3), every=50, rerank=64).collect():
        assert abs(r.score - np.linalg.norm(good[r.query_id] - good[r.vec_id])) < 1e-9
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in (i for i in good if i % 50 == 0):
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 11)) and [(g[2], g[1]) for g in got] == sorted((g[2], g[1]) for g in got) and q not in [g[1] for g in got]
        best = sorted((np.linalg.norm(good[q] - v), i) for i, v in good.items() if i != q)[:10]
        hits += len({g[1] for g in got} & {i for _, i in best})
        total += 10
    assert hits >= 0.9 * total and ann.nearest_neighbours(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["narrow clusters", "far from the origin", "outliers", "many scales"])
def test_neighbours_are_the_nearest_where_codes_tell_little(spark, kind):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2400, 12))
    if kind == "narrow clusters":  # 3 clusters of 800: more rows than leaders share the codes of a cluster
        x = rng.normal(size=(3, 12))[np.arange(2400) % 3] + 1e-4 * x
    elif kind == "far from the origin":
        x += 1e5
    elif kind == "outliers":
        x[::40] *= 1e6
    else:
        x *= 10.0 ** rng.integers(-6, 3, (2400, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = {}
    for r in ann.nearest_neighbours(df, every=60, rerank=20).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(0, 2400, 60):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(2400), far)) if i != q][:10]
        assert sorted(found[q]) == list(enumerate(want, 1))


def test_neighbours_of_a_very_common_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(3000)]
    rows = [(i, [1.0, 2.0] if i % 3 == 0 else v) for i, v in rows] + [(7, [1.0, 2.0]), (2999, [1.0, 2.0])]
    close = {3001 + i: [1.0, 2.0, 0.001 * (i + 1)] for i in range(4)}
    df = spark.createDataFrame(rows + list(close.items()), "vec_id long, embedding array<double>").repartition(4)
    found = {}
    for r in ann.nearest_neighbours(df, every=60, rerank=16).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    copies = sorted({i for i, v in rows if v == [1.0, 2.0]})
    for q in range(0, 3000, 60):
        assert sorted(found[q]) == [(n + 1, i, 0.0) for n, i in enumerate([i for i in copies if i != q][:10])]
    got = sorted((r.rank, r.vec_id) for r in ann.nearest_neighbours(df, every=3001, rerank=16).where("query_id = 3001").collect())
    points = {i: np.array([*v, *[0.0] * (8 - len(v))]) for i, v in [*((i, [1.0, 2.0]) for i in copies), *close.items()]}
    want = sorted((float(np.sqrt(((points[3001] - p) ** 2).sum())), i) for i, p in points.items() if i != 3001)[:10]
    assert [i for _, i in got] == [i for _, i in want]
    assert ann.distinct_vectors(df, 8, 11).where("vec_id = 0").first().vec_ids == copies[:11]


def test_leaders_keep_ties_with_the_last_one():
    x = np.array([[3.0, 4.0], [4.0, 3.0], [-3.0, 4.0], [3.0, -4.0], [5.0, 0.0], [0.0, -5.0]])
    columns = [pa.array(range(10, 16)), pa.array(x.tolist()), pa.array([b"\0"] * 6, pa.binary()), pa.array((x * x).sum(1) / 2)]
    batch = pa.RecordBatch.from_arrays(columns, ["key", "embedding", "codes", "half"])
    block = SimpleNamespace(value=(np.array([1]), np.array([[3.5, 3.5]])))
    for parts in ([batch], [batch.slice(0, 2), batch.slice(2, 4)]):
        got = next(ann._searcher(block, np.zeros((2, 16, 1)), 2, 1)(iter(parts)))
        want = sorted((float(np.linalg.norm(v - 3.5)), i + 10) for i, v in enumerate(x))
        assert sorted((r["score"], r["key"]) for r in got.to_pylist()) == want
    query, near = np.array([1, 0, 0, 0, 1, 0]), np.array([2.0, 5, 3, 3, 1, 1])
    assert sorted(ann.leading(query, near, 2).tolist()) == [0, 1, 2, 3, 4]


def test_neighbours_do_not_depend_on_how_rows_are_dealt(spark):
    _, df = vectors(spark, 1500, 16)
    found = [sorted(map(tuple, ann.nearest_neighbours(df.repartition(n), every=50, rerank=24).collect())) for n in (1, 7)]
    assert found[0] == found[1]


def test_anisotropic_codes_weigh_parallel_error():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    loss = {}
    for eta in (1.0, 4.0):
        books = ann.fit_codebooks(x, eta)
        p = ann._padded(x, ann.WIDTH)
        codes = ann.encode(p, books, eta)
        r = p - books[np.arange(p.shape[1]), codes]
        loss[eta] = ((r * ann._unit(p)).sum((1, 2)) ** 2).mean()
    assert codes.max() < 16 and loss[4.0] < loss[1.0]


@pytest.mark.parametrize("most", [jaccard.FILTER_MOST, 0])
def test_texts_hashed_again_take_one_worker_of_a_task(spark, monkeypatch, most):
    """Each Python function of a chain has a worker of its own in every task, which lives on."""
    docs = spark.createDataFrame([(i, f"a b c d e f {i}") for i in range(50)], "doc_id long, text string")
    ids = docs.where("doc_id < 3").select(F.col("doc_id").alias("id"))
    monkeypatch.setattr(jaccard, "FILTER_MOST", most)
    monkeypatch.setattr(jaccard, "materialise", lambda df, *_: df)
    found = jaccard._sets_of(docs, ids)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert {jaccard.identity(s)[0] for _, own in jaccard._sets(ids.join(docs, ids.id == docs.doc_id).select("text").toArrow().to_batches()) for s in own} <= {r.v for r in found.collect()}
    assert 3 <= found.count() < 10


def sets_of(texts):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(texts):
    sets, root = sets_of(texts), {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 0.8 <= len(a) / len(b) <= 1.25 and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n):
    """Copies, near copies around the threshold, chains of them, a passage that half of the documents share, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = " ".join(word() for _ in range(40))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.45:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                if w:
                    w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        elif kind < 0.55:
            texts.append(" ".join(rng.choice("ab") for _ in range(rng.randint(0, 9))))
        else:
            own = " ".join(word() for _ in range(rng.randint(8, 160)))
            texts.append(f"{own} {passage}" if rng.random() < 0.5 else own)
    return [*enumerate(texts), (10**6, None), (10**6 + 1, "  "), (10**6 + 2, "A b C"), (10**6 + 3, "a B\tc")]


@pytest.mark.parametrize(("seed", "expanded"), [(1, 12), (2, 2)])
def test_join_equals_brute_force(spark, monkeypatch, seed, expanded):
    monkeypatch.setattr(jaccard, "EXPANDED", expanded)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    texts = corpus(seed, 350)
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(df).collect()}
    assert got == brute(texts)


def test_join_cases(spark):
    odd = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B C D E F"), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(odd).collect()), key=repr)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (None, 2, None)]
    assert jaccard.similar_documents(odd.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=4, max_size=200), st.data())
def test_linked_sets_share_a_key(a, data):
    """The pigeonhole: sets of similarity 0.8 or more join by at least one segment, and sketches bound their difference."""
    items = sorted(a)
    drop = data.draw(st.integers(0, len(items) // 8))
    b = set(items[drop:]) | set(data.draw(st.lists(st.integers(0, 2**64 - 1), max_size=len(items) // 9)))
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert jaccard.sketch_distance(jaccard.dense_sketch(x), jaccard.dense_sketch(y)) <= len(a ^ b)
    if 100 * len(a & b) >= 80 * len(a | b) and a != b:
        wide = frozenset(range(60))
        for common in (np.zeros(0, np.uint64), x[::3]):
            keys = [set(np.concatenate([np.zeros(0, np.uint64), *jaccard.band_keys(s, jaccard.Common(common), wide)]).tolist()) for s in (x, y)]
            assert keys[0] & keys[1]


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 10), (5, 5)] + [(i, i + 1) for i in range(100, 140)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8} | {i: 100 for i in range(100, 141)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, small):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "1234 5678", "en", "s", 9), (10**6 + 1, None, None, None, None), (10**6 + 2, "password=abcdef123456 and the of", "en", "s", 3)], docs.schema)
    docs, steps = docs.unionByName(junk).unionByName(docs.where("doc_id = 3")), {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, small)
        steps[name] = docs.collect()
    assert {r.doc_id for r in steps["language_id"]} >= {3, 10**6 + 2} and not {10**6, 10**6 + 1} & {r.doc_id for r in steps["language_id"]}
    kept = [r.doc_id for r in steps["ngram_jaccard"]]
    assert len(kept) == len(set(kept)) < len(steps["toxicity"]) <= len(steps["language_id"])
    assert len(steps["secret_scans"]) == len(kept) and any("[SECRET]" in r.text for r in steps["secret_scans"])
    assert {r.doc_id for r in steps["packing"]} == set(kept)
