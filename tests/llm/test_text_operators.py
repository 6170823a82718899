"""BPE, packing, language ID, toxicity, secrets and chats against brute force, libraries and edge cases."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomfield.llm import bpe, chat, langid, packing, secrets, toxicity, words

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
POOL = "abc theing ÀéßñöI'sll'tre  \t\n\x1c\x1f\x85\xa0 　日本語한국어😀é̂Ⅷ²½0123...,,--==__İΣς<|endoftext|>"
DOCS = "doc_id long, text string, lang string, text_old string, score string"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", "clash") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.codec(RANKS, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(POOL, max_size=60), st.text("aeinst ", max_size=400)))
def test_bpe_equals_the_library(text):
    library_ = test_bpe_equals_the_library.library
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids = library_.encode_ordinary(text)
    assert codec.encode(text) == ids and codec.decode(ids) == text.encode()
    n, a, b = codec.digest(text)
    assert (n, a, b) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


test_bpe_equals_the_library.library = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})


def test_long_pieces_and_empty_texts(spark, own, library):
    for text in ("a" * 4000, " " * 500 + "x", "ab" * 3000, "".join(random.Random(1).choice("etaoinshrdlu") for _ in range(5000)), "word " * 70000):
        assert own.digest(text)[0] == len(library.encode_ordinary(text))
    got = {r.doc_id: r.n_tokens for r in bpe.token_digests(documents(spark, [None, "", "hi there"]), RANKS, public_tokenizers.PATTERN).collect()}
    assert got == {0: 0, 1: 0, 2: len(library.encode_ordinary("hi there"))}
    r = bpe.encode_documents(documents(spark, ["hi there"]), RANKS, public_tokenizers.PATTERN).first()
    assert r.ids == library.encode_ordinary("hi there") and bytes(r.decoded) == b"hi there"
    assert bpe.token_digests(documents(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_word_ids_equal_the_library():
    library_, own = Tokenizer.from_file(VOCABULARY), packing.WordTokenizer(VOCABULARY)
    rng = random.Random(2)
    texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["hi <|endoftext|> there", "it''s they'll A.B.C. don't...", "É À ß ÿ µ", ""]
    got = own.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library_.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_sentence_end_is_offered():
    own = packing.WordTokenizer(VOCABULARY)
    texts = ["Yes. No! Why? " * 50, "no end", "", "- one.\n- two.\n- three", 'she said "go.") .]}> then left?!.;', "tail ?"]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        held = [own.library.id_to_token(i) for i in np.frombuffer(ids, "<u4").tolist()]
        want, marked = [], False
        for place, token in enumerate(held, 1):
            marked |= any(c in ".!?" for c in token)
            if marked and token.endswith("</w>"):
                want.append(place)
                marked = False
        assert own.sentence_places(ids).tolist() == want
    sizes = [len(i) // 4 + 1 for i in own.encode(texts)]
    inner = [own.sentence_places(i) for i in own.encode(texts)]
    places, penalty = packing.cut_places(sizes, inner)
    offered = dict(zip(places.tolist(), penalty.tolist(), strict=True))
    starts = np.cumsum([0, *sizes[:-1]])
    assert all(offered[int(a + s)] <= packing.SENTENCE_CUT for a, own_places in zip(starts, inner, strict=True) for s in own_places)


def cost(places, penalty, cuts, size):
    fee = dict(zip(places.tolist(), penalty.tolist(), strict=True))
    pad = lambda n: 0 if n & (n - 1) == 0 else size - n
    return sum(pad(b - a) + fee[b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.floats(0, 9)), min_size=1, max_size=30), st.sampled_from([16, 24]))
def test_cuts_are_optimal(steps, size):
    places = np.cumsum([0, *[s for s, _ in steps]])
    penalty = np.array([0.0, *[p for _, p in steps]])
    best = [0.0] + [np.inf] * len(steps)
    for i in range(1, len(places)):
        for j in range(i):
            n = int(places[i] - places[j])
            if n <= size:
                best[i] = min(best[i], best[j] + (0 if n & (n - 1) == 0 else size - n) + penalty[i])
    assert abs(cost(places, penalty, packing.best_cuts(places, penalty, size), size) - best[-1]) < 1e-6


def test_packing_covers_every_id_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "word. " * 9000)], "doc_id long, text string"))
    library_ = Tokenizer.from_file(VOCABULARY)
    ids = {r.doc_id: [*library_.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = packing.pack_documents(docs, VOCABULARY).collect()
    held, sequences = {}, {}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert len(part) == 4 * r.length and r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[r.doc_id])
        held.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, parts in held.items():
        assert [s for s, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1].tolist() and sum(n for _, n in parts) == len(ids[doc_id])
    sizes = []
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1].tolist()
        sizes.append(sum(n for _, n in parts))
    assert set(held) == set(ids) and max(sizes) <= 2048
    assert sum(2048 - n for n in sizes if n & (n - 1)) < 0.02 * sum(sizes)


def brute_grams(text):
    line = " " + re.sub(r"\W+", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
    out = {}
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if g.strip() and not (n == 3 and g[1] == " "):
                out[g] = out.get(g, 0) + 1
    return out


@settings(max_examples=100, deadline=None)
@given(st.text("abé ñ-1ß", max_size=40))
def test_ngram_counts(text):
    codes, counts = langid.ngram_counts(text)
    assert sorted(counts.tolist()) == sorted(brute_grams(text).values()) and len(set(codes.tolist())) == len(codes)


def test_languages_on_held_out_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = langid.with_languages(docs).where("held_out").select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(10**6, None, None), (10**6 + 1, "123 !", "en"), (None, "the and", "en")], "doc_id long, text string, lang string")).withColumn("score", F.lit("clash"))
    out = {r.doc_id: r for r in langid.predict_languages(odd).where("doc_id >= 1000000 OR doc_id IS NULL").collect()}
    assert out[10**6].lang_pred == out[10**6 + 1].lang_pred == "und" and out[10**6].score == 0 and out[None].held_out is False
    assert langid.predict_languages(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_labels_are_no_input_of_a_prediction(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    changed = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in langid.predict_languages(d).collect()) for d in (docs, changed))
    assert a == b


def test_toxic_documents_are_found(spark):
    small = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    fit, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    got = toxicity.with_toxicity(docs.withColumn("is_toxic", F.lit("clash")), fit).join(test, "doc_id").collect()
    tp, fp, fn = (sum(f(r) for r in got) for f in (lambda r: r.is_toxic and r.toxic, lambda r: r.is_toxic and not r.toxic, lambda r: not r.is_toxic and r.toxic))
    assert fp <= 0.02 * len(got) and tp >= fn
    assert {r.is_toxic for r in toxicity.with_toxicity(docs, labels.limit(0)).limit(5).collect()} == {False}
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "you idiot")], "doc_id long, text string")
    rough = spark.createDataFrame([(1, None, None), (1, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.with_toxicity(odd, rough).count() == 3 and toxicity.with_toxicity(odd.limit(0), rough).count() == 0


def test_few_labels_and_one_class(spark):
    docs = spark.createDataFrame([(n, f"word{n % 3} some text") for n in range(9)], "doc_id long, text string")
    for known in ([(0, 1, 1)], [(0, 1, 0)], [(0, 1, 1), (1, 0, 0)], [(0, 1, 1), (1, 0, 0), (2, 1, 0)], [(n, 1, 0) for n in range(9)]):
        got = toxicity.with_toxicity(docs, spark.createDataFrame(known, "doc_id long, quality int, toxic int")).collect()
        assert len(got) == 9 and all(0 <= p <= 1 for r in got for p in (r.p_low_quality, r.p_toxic)) and all(r.is_toxic == (r.p_toxic >= 0.5) for r in got)
        if not any(t for *_, t in known):
            assert not any(r.is_toxic for r in got)


def test_chain_feeds_probabilities_forward():
    rng = np.random.default_rng(3)
    y1 = rng.integers(0, 2, 300)
    buckets = [np.unique(np.r_[rng.integers(10, 40, 8), 1 if y else 2]) for y in y1]
    chain = toxicity.Chain(np.unique(np.concatenate(buckets)), buckets, np.stack([y1, y1], 1))
    p = chain.predict(buckets)
    assert ((p[:, 1] > 0.5) == y1).mean() > 0.98 and len(chain.models[1][1]) == 2 and chain.models[1][1][1] > 0


def brute_spans(text):
    out = []
    for kind, pattern, group, least in (
        (0, r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
        (1, r"AKIA[A-Z0-9]+", 0, 16), (2, r"[0-9a-f]+", 0, 32)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "api_key", "apikey", "ſecret", "token", "=", ": ", '"', " ", "AKIA", "ABCDEF012345", "0123456789abcdef", "zz", "é", "\n"]), max_size=20).map("".join))
def test_base_spans(text):
    assert [(s, k, e) for s, k, e, _ in secrets.base_spans(text)] == brute_spans(text)


def test_automata_and_scans(spark):
    rng = random.Random(5)
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)) for _ in range(200)]
    prose = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(16, 22))) for _ in range(300)]
    formats = {"access": secrets.Automaton([secrets.classes(k) for k in keys]), "learned": secrets.Automaton([secrets.classes(p) for p in prose])}
    other = "ASIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    text = f"a {prose[0]} b {other} c {keys[0]}"
    got = [(secrets.KINDS[k], text[s:e]) for s, k, e in secrets.all_spans(text, secrets.Scorer(formats))]
    assert got == [("learned", other), ("access", keys[0])]
    total = sum(2 ** ((len(w) + 1) * formats["access"].bits(w, 1e-9)) for w in ("", "U", "0"))
    assert 0 <= total <= 1.01
    texts = [None, "", f"x password={'Ab1' * 4} y", f"{keys[1]} and {keys[1]}", "plain words"]
    rows = {r.doc_id: r for r in secrets.scan_secrets(documents(spark, texts)).collect()}
    assert rows[0].spans == "" and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[2].n_assign == 1 and rows[3].n_access == 2
    assert rows[3].spans.startswith("access:0:20,access:25:45")
    red = {r.doc_id: r.text for r in secrets.redact_secrets(documents(spark, texts)).collect()}
    assert red[0] is None and red[2] == "x [SECRET] y" and red[3] == "[SECRET] and [SECRET]" and red[4] == "plain words"
    assert secrets.scan_secrets(documents(spark, [])).count() == 0


def test_word_hashes_are_word_identities():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB c\n\tdé  ") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, "", " ", "x" * 3_000_000 + " y"]
    hashes, begins = words.word_hashes(pa.array(texts))
    split = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert np.diff(begins).tolist() == [len(w) for w in split]
    known = {}
    for w, a, b in zip(split, begins[:-1], begins[1:], strict=True):
        for x, y in zip(w, hashes[a:b].tolist(), strict=True):
            assert known.setdefault(x, y) == y
    assert len(set(known.values())) == len(known)


def test_chats(spark):
    log = [(1, 0, "u", "a"), (1, 1, "b", "b"), (2, 0, "u", "a"), (3, 0, "u", "a"), (3, 1, "b", "b"), (3, 1, "b", "b"), (4, 0, None, None), (None, 0, "u", "a"), (5, 0, "u", "a"), (5, None, "b", "z")]
    df = spark.createDataFrame(log, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("clash"))
    got = sorted((r.conv_id, r.n_turns, r.n_copies, r.rendered) for r in chat.render_conversations(df).groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "rendered"))), lambda x: x["rendered"]), "").alias("rendered")).collect())
    assert got == [(1, 2, 2, "<|u|>\na\n<|end|>\n<|b|>\nb\n<|end|>\n"), (4, 1, 1, "<|unknown|>\n\n<|end|>\n"), (5, 2, 1, "<|u|>\na\n<|end|>\n<|b|>\nz\n<|end|>\n")]
    assert chat.render_conversations(df.limit(0)).count() == 0
    long = spark.range(1000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    both = long.union(long.where("turn < 700").withColumn("conv_id", F.lit(2).cast("long")))
    assert [r.conv_id for r in chat.maximal_conversations(both).collect()] == [1]
