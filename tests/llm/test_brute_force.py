"""Languages, toxicity, learned secrets and the pipeline against plain versions of their definitions, and edge cases of each."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomfield.llm import bpe, jaccard, langid, packing, secrets, tables, toxicity, url_filter

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# languages


def plain_grams(text):
    """The n-grams of each word with a space before and after it, but for the space alone."""
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        points = [0, *map(ord, word), 0]
        out.update((p,) for p in points[1:-1])
        out.update(tuple(points[i : i + 2]) for i in range(len(points) - 1))
        out.update(tuple(points[i : i + 3]) for i in range(len(points) - 2))
    return out


def most_frequent(counts, size):
    padded = lambda g: (*g, *[(1 << 21) - 1] * (3 - len(g)))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], padded(x[0])))[:size]]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def plain_languages(rows, size=langid.PROFILE):
    """(lang, score) of each row (doc_id, text, lang)."""
    counts = {}
    for doc_id, text, lang in rows:
        if lang is not None and doc_id is not None and not held_out(doc_id):
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    profiles = {lang: {g: n for n, g in enumerate(most_frequent(c, size))} for lang, c in counts.items() if c}
    out = []
    for _, text, _ in rows:
        own = most_frequent(plain_grams(text), size)
        if not own or not profiles:
            out.append(("und", 0.0))
            continue
        far = {lang: sum(abs(n - p[g]) if g in p else size for n, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        out.append((best, 1 - far[best] / (size * len(own))))
    return out


def test_languages_equal_the_plain_version(spark, small, monkeypatch):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += [(10**6, None, "en"), (10**6 + 1, "", None), (10**6 + 2, "12 !?", "de"), (None, "wort ohne nummer", "xx"), rows[0], rows[0], (10**6 + 3, "zwilling zwilling", "t1"), (10**6 + 4, "zwilling zwilling", "t2")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string").repartition(3)
    want = sorted(((i, *w) for (i, _, _), w in zip(rows, plain_languages(rows), strict=True)), key=repr)
    for group in (langid.GROUP, 2):
        monkeypatch.setattr(langid, "GROUP", group)
        got = sorted(((r.doc_id, r.lang_pred, r.score) for r in langid.with_languages(df).collect()), key=repr)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(g[2] - w[2]) < 1e-12 for g, w in zip(got, want, strict=True))
    assert langid.predict_languages(df.limit(0)).count() == 0


def test_many_languages_and_window_borders(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12)), f"l{i % 300}") for i in range(900)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i] for i in range(900)] == [(w, pytest.approx(s)) for w, s in plain_languages(rows)]
    text = "Über alle Maßen, año y año. " * 300
    whole = [x.tolist() for x in langid.ngram_counts(text)]
    for window in (7, 64, 1000):
        monkeypatch.setattr(langid, "WINDOW", window)
        assert [x.tolist() for x in langid.ngram_counts(text)] == whole


# toxicity


def plain_features(text):
    """Buckets of the words of a text, and of their first 4, 5 and 6 bytes, without ASCII punctuation and digits."""
    bare = re.sub(r"[!-@\[-`{-~]+", " ", text or "")
    return set(toxicity.word_buckets(pa.array([bare]))[0].tolist())


def plain_fit(x, dense, y):
    """Accelerated gradient descent on whole matrices."""
    n = len(y)
    scale = 1 / (x.mean(0) * 0.25 + toxicity.RIDGE + 0.002)
    spread = 1 / (0.25 * (dense**2).mean(0) + toxicity.RIDGE + 1e-3)
    step = 1 / (x.sum(1).mean() ** 0.5 + dense.shape[1] + 1)
    w, v = np.zeros(x.shape[1]), np.zeros(dense.shape[1])
    old = w, v
    for k in range(toxicity.ROUNDS):
        a, b = w + k / (k + 3) * (w - old[0]), v + k / (k + 3) * (v - old[1])
        error = 1 / (1 + np.exp(-np.clip(x @ a + dense @ b, -30, 30))) - y
        old = w, v
        w, v = a - step * scale * (x.T @ error / n + toxicity.RIDGE * a), b - step * spread * (dense.T @ error / n)
    return w, v


def plain_chain(train, labels, known, docs):
    """Probabilities of each category for docs, from a chain fitted on the feature sets of train."""
    matrix = lambda sets: np.array([[float(k in s) for k in known] for s in sets])
    p = lambda model, x, dense: 1 / (1 + np.exp(-np.clip(x @ model[0] + dense @ model[1], -30, 30)))
    x, new = matrix(train), matrix(docs)
    dense, dense_new, fold = np.ones((len(x), 1)), np.ones((len(new), 1)), np.arange(len(x)) % toxicity.FOLDS
    for y in labels.T:
        ahead = np.zeros(len(y))
        for f in range(toxicity.FOLDS):
            model = plain_fit(x[fold != f], dense[fold != f], y[fold != f])
            ahead[fold == f] = p(model, x[fold == f], dense[fold == f])
        model = plain_fit(x, dense, y)
        dense_new = np.c_[dense_new, p(model, new, dense_new)]
        dense = np.c_[dense, ahead]
    return dense_new[:, 1:]


def plain_toxicity(docs, labels):
    """Probabilities of the rows (doc_id, text) from labels (doc_id, quality, toxic)."""
    marks = {}
    for i, quality, toxic in labels:
        if i is not None:
            low, bad = marks.get(i, (0, 0))
            marks[i] = (max(low, int((1 if quality is None else quality) == 0)), max(bad, int((toxic or 0) == 1)))
    texts = {}
    for i, text in docs:
        if i in marks and text is not None:
            texts[i] = min(text, texts.get(i, text))
    ids = sorted({i for i, _ in docs if i in marks})
    train, y = [plain_features(texts.get(i)) for i in ids], np.array([marks[i] for i in ids], float)
    n, counts = len(ids), Counter(b for s in train for b in s)
    gains = {}
    for b, docs_with in counts.items():
        if docs_with >= toxicity.LEAST_DOCS:
            share, best = docs_with / n, 0.0
            for c in range(2):
                p = y[:, c].sum() / n
                both = sum(y[k, c] for k, s in enumerate(train) if b in s) / n
                best = max(best, abs(both - share * p) / np.sqrt(share * (1 - share) * p * (1 - p) / n + 1e-12))
            gains[b] = best
    known = sorted(sorted(gains, key=lambda b: (-round(gains[b], 9), b))[: toxicity.FEATURES])
    return plain_chain(train, y, known, [plain_features(t) for _, t in docs])


def test_toxicity_equals_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 40)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["good", "plain", "words", "here", "vile" if i % 4 == 0 else "kind", "junk" if i % 5 == 0 else "fine", f"w{rng.randint(0, 9)}x"]) for _ in range(12)) + ("." if i % 2 else "!")) for i in range(90)]
    docs += [(90, None), (None, "vile vile"), (91, ""), (1, docs[1][1]), (2, "another text of two")]
    labels = [(i, int(i % 5 != 0), int(i % 4 == 0)) for i in range(60)] + [(3, None, None), (4, 1, 0), (4, 0, None), (None, 0, 1), (500, 0, 1)]
    df = spark.createDataFrame([(*d, 7.0) for d in docs], "doc_id long, text string, p_toxic double").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = {d: tuple(p) for d, p in zip(docs, plain_toxicity(docs, labels).tolist(), strict=True)}
    got = toxicity.with_toxicity(df, marks).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.p_low_quality, r.p_toxic) == pytest.approx(want[r.doc_id, r.text], abs=1e-6) and r.is_toxic == (r.p_toxic >= toxicity.THRESHOLD)
    assert {r.p_toxic for r in toxicity.with_toxicity(df, marks.limit(0)).collect()} == {0.0}
    assert toxicity.with_toxicity(df.limit(0), marks).count() == 0


# secrets


def test_labelled_sample_is_the_smallest_hashes(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40]))) for _ in range(300)]
    docs = spark.createDataFrame([(f"x {v} y {'a' * 300} {v}",) for v in values] + [(None,)], "text string")
    want = sorted(values, key=lambda v: (zlib.crc32(v.encode()), v))[:40]
    for parts in (1, 6):
        got = secrets.labelled_sample(docs.repartition(parts), 40).collect()
        assert sorted(r.value for r in got if r.kind == "hex") == sorted(want)
    assert secrets.labelled_sample(docs.limit(0), 40).count() == 0


def test_automata_keep_their_counts_and_separate_formats():
    """Every state's moves and ends add up to its visits; measured on credentials that no base pattern finds."""
    rng = random.Random(6)
    take = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    upper, digits, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "abcdefghijklmnopqrstuvwxyz"
    words = [take("etaoinsrhl", rng.randint(16, 22)) for _ in range(400)]
    labelled = {"access": ["AKIA" + take(upper + digits, 16) for _ in range(200)], "hex": [take(digits + "abcdef", 32) for _ in range(200)], "assign": [take(lower + upper + digits, 24) for _ in range(200)]}
    formats = {k: secrets.Automaton([secrets.classes(v) for v in values]) for k, values in (labelled | {"learned": words}).items()}
    for model in formats.values():
        reached, todo = {0}, [0]
        while todo:
            for t in model.next[todo.pop()].values():
                if t not in reached:
                    reached.add(t)
                    todo.append(t)
        assert all(sum(model.moves[s].values()) + model.ends[s] == model.seen[s] for s in reached)
        assert all(set(model.moves[s]) == set(model.next[s]) for s in reached)
    found = lambda made: sum(any(k == 3 for _, k, _ in secrets.all_spans(f"see {made()} there", secrets.Scorer(formats))) for _ in range(50))
    assert found(lambda: "ASIA" + take(upper + digits, 16)) >= 45
    assert found(lambda: take(digits + "abcdef", 24)) >= 45
    assert found(lambda: take(digits + "ABCDEF", 32)) >= 40
    assert found(lambda: take(lower + upper + digits, 32)) >= 40
    assert found(lambda: take("etaoinsrhl", 18)) <= 2


def test_candidates_are_what_base_spans_leave():
    text = "AKIA" + "B" * 16 + "abcdefghijklmnopqrst x " + "y" * 15 + " " + "z" * 16
    base = secrets.base_spans(text)
    assert [t for _, _, t in secrets.candidates(text, base)] == ["abcdefghijklmnopqrst", "y" * 15, "z" * 16]
    assert [t for _, _, t in secrets.candidates(text, base, least=16)] == ["abcdefghijklmnopqrst", "z" * 16]
    assert [t for _, _, t in secrets.candidates(text, base, least=15)] == ["abcdefghijklmnopqrst", "y" * 15, "z" * 16]
    assert all(text[s:e] == t for s, e, t in secrets.candidates(text, base))


def test_redaction_cases(spark):
    long = "word " * 60000 + "password=abcdefgh123"
    rows = [(1, None, 5), (2, "", 0), (3, "token: abcd1234 and token: abcd1234", 1), (3, "token: abcd1234 and token: abcd1234", 1), (4, long, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted(map(tuple, secrets.redact_secrets(df).collect()), key=repr)
    masked = "[SECRET] and [SECRET]"
    assert got == sorted([(1, None, None), (2, "", 0), (3, masked, len(masked)), (3, masked, len(masked)), (4, "word " * 60000 + "[SECRET]", 300008)], key=repr)
    assert secrets.redact_secrets(df.limit(0)).count() == 0


# repeated rows, clashing columns and long texts of the other operators


def test_repeated_rows_are_kept(spark):
    rows = [(1, "one two three", "en", "s", 3)] * 3 + [(None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("start", "length", "sequence_id", "n_tokens", "component_id")})
    assert sorted(r.doc_id is None for r in bpe.token_digests(docs, RANKS, public_tokenizers.PATTERN).collect()) == [False] * 3 + [True] * 2
    assert sum(r.length for r in packing.pack_documents(docs, VOCABULARY).collect()) == 3 * 4 + 2
    assert sorted(r.spans for r in secrets.scan_secrets(docs).collect()) == [""] * 5
    assert sorted((r.component_id for r in jaccard.similar_documents(docs).collect()), key=repr) == [1, 1, 1, None, None]
    assert langid.predict_languages(docs).count() == 5
    listed = spark.createDataFrame([("a.com",)], "key string")
    pages = spark.createDataFrame([(1, "https://a.com/x", "h")] * 2 + [(2, None, "h")] * 2, "page_id long, url string, verdict string")
    assert sorted(r.verdict for r in url_filter.filter_urls(pages, [], listed).collect()) == ["allow", "allow", "block", "block"]


def test_texts_are_sliced_by_bytes():
    texts = ["a" * 10, None, "b" * (tables.SLICE_BYTES + 5), "c", "d" * (tables.SLICE_BYTES - 1), "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["i", "text"])
    parts = list(tables.slices(batch, 1))
    assert list(itertools.chain(*[p.column(0).to_pylist() for p in parts])) == list(range(6))
    assert [p.num_rows for p in parts] == [2, 1, 2, 1] and [p.num_rows for p in tables.slices(batch.slice(3), 1, rows=1)] == [1, 1, 1]


def test_long_texts_are_encoded_in_windows(monkeypatch):
    own, library = packing.WordTokenizer(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    texts = ["It's a word, isn't it? 12.5%  " * 400, "unbroken" * 900, "ï" * 50 + " 日本 " + "they'll " * 300, ""]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for window in (40, 1000, 1 << 20):
        monkeypatch.setattr(packing, "WINDOW", window)
        assert [np.frombuffer(i, "<u4").tolist() for i in own.encode(texts)] == want


def test_a_few_remembered_words_change_nothing():
    texts = [" ".join(random.Random(n).choice("abcdefghij") * 2 + str(n) for n in range(k, k + 50)) for k in range(0, 400, 20)]
    few = packing.WordTokenizer(VOCABULARY, remembered=7)
    assert [few.encode([t])[0] for t in texts] == packing.WordTokenizer(VOCABULARY).encode(texts)


# the pipeline


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_without_near_duplicates(docs):
    """Rows (doc_id, text) that stay, by comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and docs[i][0] is not None and docs[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
            root[find(i)] = find(j)
    kept = {}
    for i, (doc_id, text) in enumerate(docs):
        if doc_id is None:
            kept[i] = i
        elif not sets[i]:
            kept.setdefault((doc_id, text), i)
        elif find(i) not in kept or doc_id < docs[kept[find(i)]][0]:
            kept[find(i)] = i
    return sorted((docs[i] for i in kept.values()), key=repr)


def test_near_duplicates_of_one_id(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six"
    rows = [(5, a), (5, b), (5, b), (9, a), (9, "unlike any other text of this table"), (None, a), (None, a), (7, None), (7, None), (8, "")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, t_ string, root string").repartition(3)
    got = jaccard.without_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(5, a), (5, b), (9, "unlike any other text of this table"), (None, a), (None, a), (7, None), (8, "")], key=repr)


def test_pipeline_equals_the_plain_version(spark, small, tmp_path):
    extra = [(10**6, None, "en", "s", None), (10**6 + 1, "", None, "s", 0), (10**6 + 2, "1234 5678 !!!", None, "s", 13)]
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(spark.createDataFrame(extra, SCHEMA).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("int").alias("n_chars")), allowMissingColumns=True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs, rows = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for r in docs.collect():
        rows.append((r.doc_id, r.text, r.lang))
    judged = plain_languages(rows)
    stay = [(i, t) for (i, t, _), (lang, score) in zip(rows, judged, strict=True) if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(str(tmp_path / "labels.parquet")).collect()]
    p = plain_toxicity(stay, labels)
    assert np.abs(p[:, 1] - toxicity.THRESHOLD).min() > 1e-6
    clean = [d for d, q in zip(stay, p[:, 1], strict=True) if q < toxicity.THRESHOLD]
    single = plain_without_near_duplicates(clean)
    held = {k: {} for k in secrets.KINDS}
    for _, text in single:
        base = secrets.base_spans(text)
        for kind, value in [(secrets.KINDS[k], v) for _, k, _, v in base] + [("learned", v) for _, _, v in secrets.candidates(text, base)]:
            held[kind][value] = zlib.crc32(value.encode())
    formats = {k: secrets.Automaton([secrets.classes(v) for v in sorted(sorted((v for v in vs if len(v) <= secrets.LONGEST_FITTED), key=lambda v: (vs[v], v))[: secrets.SAMPLE])]) for k, vs in held.items() if vs}
    library, want = Tokenizer.from_file(VOCABULARY), {}
    for doc_id, text in single:
        out, at = "", 0
        for start, _, end in secrets.all_spans(text, secrets.Scorer(formats)):
            if start >= at:
                out += text[at:start] + "[SECRET]"
            at = max(at, end)
        want[doc_id] = [*library.encode(out + text[at:], add_special_tokens=False).ids, packing.END_ID]
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        part = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
        pieces.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    assert {i: sorted(x) for i, x in pieces.items()} == {i: list(range(len(ids))) for i, ids in want.items()}


def test_pipeline_of_an_empty_table(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0).withColumns({"is_toxic": F.lit("x"), "score": F.lit("y")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
