"""Frames: bit signatures, distances, candidate sampling, selection and coverage."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations, groupby, tee

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from loomfield.operators.ranks import written

#: Frames, about, of a block; a task compares two blocks of a job at a time.
BLOCK = 1024


def bit_signature(vec: Column) -> Column:
    """Array of 64-bit words with a bit per component: whether it reaches the mean."""
    mean = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x) / F.size(vec)
    bits = F.transform(vec, lambda x: (x >= mean).cast("long"))
    words = F.sequence(F.lit(0), F.floor((F.size(vec) - 1) / 64).cast("int"))
    return F.transform(words, lambda w: F.aggregate(F.slice(bits, w * 64 + 1, 64), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b)))


def with_signatures(frames: DataFrame, col: str = "vec") -> DataFrame:
    """Adds signature and bits."""
    return frames.withColumns({"signature": bit_signature(F.col(col)), "bits": F.size(col)})


def hamming_ratio(a: Column, b: Column, bits: Column) -> Column:
    """Share of differing bits of two signatures of equal length."""
    words = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(words, F.lit(0), lambda s, x: s + x) / bits


def scene_scores(frames: DataFrame, scale: float = 255.0) -> DataFrame:
    """Adds scene_score: mean absolute difference to the previous frame's vector, 1 for the first."""
    before = F.lag("vec").over(Window.partitionBy("job_id").orderBy("t", "frame_id"))
    diff = F.aggregate(F.zip_with("vec", "before", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x)
    score = F.when(F.col("before").isNull(), 1.0).otherwise(diff / F.size("vec") / scale)
    return frames.withColumn("before", before).withColumn("scene_score", F.round(score, 6)).drop("before")


def candidates(rows: Iterable[tuple[float, float, bool]], interval: float, threshold: float = 0.12) -> Iterator[tuple[int, str, bool]]:
    """(index, reason, replaces) of observations (time, scene score, whether it is the last) that become candidates, in order of time.

    The first and the last are kept, scenes, and those that are due: an interval
    after the last one that was due, whatever it was kept for. A candidate at the
    time of the one before takes its place.
    """
    covered, before = -interval, None
    for i, (t, score, last) in enumerate(rows):
        due, scene = t - covered >= interval, score >= threshold
        if i == 0 or last or scene or due:
            yield i, "first" if i == 0 else "tail" if last else "scene_change" if scene else "coverage", before is not None and abs(before - t) < 1e-6
            before = t
            covered = t if due else covered


def frame_candidates(frames: DataFrame, durations: DataFrame, threshold: float = 0.12, longest: float = 15.0, step: float = 0.2) -> DataFrame:
    """job_id, frame_id, t, scene_score, reason of sampled frames (job_id, frame_id, t, scene_score).

    The coverage interval is a quarter of the video (durations: job_id, duration_s;
    unknown: up to the last frame), between the sampling step and ``longest``. Jobs
    stream through their task in order of time.
    """
    ends = frames.groupBy("job_id").agg(F.max(F.struct("t", "frame_id")).alias("end")).join(durations, "job_id", "left")
    quarter = F.coalesce("duration_s", "end.t") / 4
    rows = frames.join(ends, "job_id").select(
        "job_id", "frame_id", "t", "scene_score", F.least(F.lit(longest), F.greatest(F.lit(step), quarter)).alias("interval"),
        (F.struct("t", "frame_id") == F.col("end")).alias("last"))
    names = ["job_id", "frame_id", "t", "scene_score", "reason"]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the candidate that a later one at its time may replace
        for (_, interval), own in groupby((r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)), key=lambda r: (r[0], r[4])):
            first, second = tee(own)
            at = -1
            for i, reason, replaces in candidates(((r[2], r[3], r[5]) for r in first), interval, threshold):
                while at < i:
                    row, at = next(second), at + 1
                if replaces:
                    held.pop()
                held.append((*row[:4], reason))
                if len(held) > 4096:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held[:-1]], schema)
                    del held[:-1]
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in held], schema)

    kinds = {f.name: f.dataType for f in rows.schema}
    fields = StructType([StructField(n, kinds.get(n, StringType())) for n in names])
    schema = to_arrow_schema(fields)
    return rows.repartition("job_id").sortWithinPartitions("job_id", "t", "frame_id").mapInArrow(sample, fields)


def _blocks(frames: DataFrame) -> DataFrame:
    """job_id, words, blocks, own, frame_id, t (if there), signature, bits: each frame with its block of those of its job and length."""
    rows = frames.where("job_id IS NOT NULL AND signature IS NOT NULL").withColumn("words", F.coalesce("bits", 64 * F.size("signature")))
    sizes = rows.groupBy("job_id", "words").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    at = [c for c in ("frame_id", "t") if c in frames.columns]
    own = F.pmod(F.xxhash64(*at), F.col("blocks"))
    return rows.join(sizes, ["job_id", "words"]).select("job_id", "words", "blocks", own.alias("own"), *at, "signature", "bits")


def _differing(x: pa.Table, y: pa.Table) -> np.ndarray:
    """(frames of x, frames of y) numbers of differing bits."""
    a, b = (np.asarray(z["signature"].combine_chunks().flatten()).view(np.uint64).reshape(z.num_rows, -1) for z in (x, y))
    out = np.zeros((len(a), len(b)), np.int64)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[:, w])
    return out


def _in_pairs(x: DataFrame, y: DataFrame, function, schema: str) -> DataFrame:
    """The function of the two Arrow tables of each pair of blocks (i, j)."""
    keys = ["job_id", "words", "i", "j"]
    y = y.select(*[F.col(c).alias(c) for c in y.columns])  # columns of its own, as both come from the same rows
    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(function, schema)


def nearest_distance(frames: DataFrame) -> DataFrame:
    """job_id, frame_id, nearest: smallest Hamming ratio to an earlier frame of the job, 1 for the first.

    Only the first frame of each signature is compared, with the first ones of the
    other signatures: a later frame has a copy before it, and the nearest of a first
    frame is as near as the first frame with that signature. Each pair of blocks of
    a job gives a minimum for each frame of the first.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    schema = f"job_id {kinds['job_id']}, frame_id {kinds['frame_id']}, ratio double"
    least, largest = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def minima(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table([x["job_id"][:0], x["frame_id"][:0], pa.array([], pa.float64())], ["job_id", "frame_id", "ratio"])
        ta, tb = (z["t"].to_numpy().astype(float) for z in (x, y))
        ia, ib = (z["frame_id"].fill_null(fill).to_numpy() for z, fill in ((x, least), (y, largest)))
        earlier = (tb < ta[:, None]) | ((tb == ta[:, None]) & (ib < ia[:, None]))
        bits = x["bits"].to_numpy()
        found = np.where(earlier, _differing(x, y), largest).min(1)
        hit = np.flatnonzero(found < largest)
        return pa.table([x["job_id"].take(hit), x["frame_id"].take(hit), pa.array(found[hit] / bits[hit])], ["job_id", "frame_id", "ratio"])

    at = F.struct(F.col("t"), F.col("frame_id"))
    firsts = frames.where("job_id IS NOT NULL AND signature IS NOT NULL").groupBy("job_id", "bits", "signature").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    copies = frames.join(firsts.where("n > 1"), ["job_id", "bits", "signature"]).where(at > F.col("first")).select("job_id", "frame_id", F.lit(0.0).alias("ratio"))
    rows = _blocks(firsts.select("job_id", "bits", "signature", "first.frame_id", "first.t"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    x = rows.select("job_id", "words", F.col("own").alias("i"), every.alias("j"), "frame_id", "t", "signature", "bits")
    y = rows.select("job_id", "words", every.alias("i"), F.col("own").alias("j"), "frame_id", "t", "signature")
    found = frames.select("job_id", "frame_id", F.lit(None).cast("double").alias("ratio")).unionByName(_in_pairs(x, y, minima, schema)).unionByName(copies)
    return found.groupBy("job_id", "frame_id").agg(F.coalesce(F.round(F.min("ratio"), 6), F.lit(1.0)).alias("nearest"))


def pick_k(frames: DataFrame, k: int, least: int = 1) -> DataFrame:
    """job_id, frame_id, t of k frames of each job that has at least ``least``; all of them if there are no more than k.

    The ends are taken, and for each evenly spaced time between them the frame of
    the least distance, as a share of the span, less 0.05 of its scene score, that
    was not taken before. As others take at most k - 3 frames, the k - 2 best of
    each time are enough to choose from; only they are gathered.
    """
    at = F.struct("t", "frame_id")
    ends = frames.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last")).where(F.col("n") >= least)
    rows = frames.join(ends, "job_id")
    edge = (at == F.col("first")) | ((at == F.col("last")) & F.lit(k > 1))
    sure = rows.where((F.col("n") <= k) | edge).select("job_id", "frame_id", "t")
    if k < 3:
        return sure
    span = F.greatest(F.col("last.t") - F.col("first.t"), F.lit(1.0))
    inner = rows.where((F.col("n") > k) & ~edge).select("job_id", "frame_id", "t", "scene_score", F.col("first.t").alias("begin"), span.alias("span"), F.explode(F.sequence(F.lit(1), F.lit(k - 2))).alias("slot"))
    scene = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("scene_score", F.lit(0.0))))
    cost = F.abs(F.col("t") - (F.col("begin") + F.col("span") * F.col("slot") / (k - 1))) / F.col("span") - 0.05 * scene
    place = F.row_number().over(Window.partitionBy("job_id", "slot").orderBy("cost", "t", "frame_id"))
    best = inner.withColumn("cost", cost).withColumn("place", place).where(F.col("place") <= k - 2).select("job_id", "slot", "place", "frame_id", "t")

    def choose_each(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: dict = {}
        for _, own in pdf.sort_values(["slot", "place"]).groupby("slot", sort=True):
            free = own[[x not in taken for x in zip(own["t"], own["frame_id"], strict=True)]]
            taken[free["t"].iloc[0], free["frame_id"].iloc[0]] = None
        return pd.DataFrame([(pdf["job_id"].iloc[0], f, t) for t, f in taken], columns=["job_id", "frame_id", "t"])

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("job_id", "frame_id", "t"))
    return sure.union(best.groupBy("job_id").applyInPandas(choose_each, schema))


def frame_coverage(selected: DataFrame, meta: DataFrame) -> DataFrame:
    """job_id, frames, max_gap, tail_gap, span_ratio, reached_end, omitted.

    meta: job_id, duration_s, sampled, and of the scan expected_tail_s,
    last_decodable_s, tolerance_s: the end was reached if the last frame that could be
    read lies within the tolerance of the expected one. The span is between 0 and 1,
    and 1 where there is no duration; a job without frames is one gap.
    """
    gap = F.col("t") - F.lag("t", 1, 0.0).over(Window.partitionBy("job_id").orderBy("t"))
    per = selected.withColumn("gap", gap).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("frames"), F.max("gap").alias("gap"), F.min("t").alias("first"), F.max("t").alias("last"))
    tail = F.greatest(F.lit(0.0), F.col("duration_s") - F.coalesce("last", F.lit(0.0)))
    span = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("last") - F.col("first")) / F.col("duration_s")))
    return meta.join(per, "job_id", "left").select(
        "job_id", F.coalesce("frames", F.lit(0)).alias("frames"), F.round(F.greatest(F.col("gap"), tail), 3).alias("max_gap"), F.round(tail, 3).alias("tail_gap"),
        F.round(F.when(F.coalesce("duration_s", F.lit(0.0)) == 0, 1.0).when(F.col("last").isNull(), 0.0).otherwise(span), 6).alias("span_ratio"),
        F.coalesce(F.col("expected_tail_s") - F.col("last_decodable_s") <= F.col("tolerance_s"), F.lit(False)).alias("reached_end"),
        F.greatest(F.lit(0), F.col("sampled") - F.coalesce("frames", F.lit(0))).alias("omitted"),
    )


def near_duplicate_frames(frames: DataFrame, ratio: float) -> DataFrame:
    """job_id, a, b (a < b), ratio of frames of a job whose signatures differ in at most that share of bits.

    With d the most bits that may differ, one of d + 1 strips of the signature
    must be the same in both, so strips are join keys where they have at least 8
    bits; a pair is reported once. Otherwise blocks of a job are compared two at
    a time, and only hits leave the task: every frame still meets every other.
    """
    frames = frames.where("frame_id IS NOT NULL")
    shape = frames.agg(F.max("bits"), F.max(F.size("signature"))).first()
    bits, words = shape[0] or 0, shape[1] or 0
    strips = int(bits * (ratio + 1e-6)) + 1  # the ratio is compared when rounded to six places
    if bits // strips >= 8:
        a = frames.select("job_id", F.col("frame_id").alias("a"), F.col("signature").alias("sa"), "bits")
        b = frames.select("job_id", F.col("frame_id").alias("b"), F.col("signature").alias("sb"), "bits")

        def strip(s: Column) -> Column:
            """Strips of equal or nearly equal numbers of bits of all words; one over two words has both parts."""
            edges, parts = [64 * words * n // strips for n in range(strips + 1)], []
            for n, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                values = []
                for w in range(low // 64, (high - 1) // 64 + 1):
                    start, stop = max(low - 64 * w, 0), min(high - 64 * w, 64)
                    word = F.shiftrightunsigned(F.coalesce(F.get(s, F.lit(w)), F.lit(0).cast("long")), start)
                    values.append(word if stop - start == 64 else word.bitwiseAND(F.lit((1 << stop - start) - 1)))
                parts.append(F.struct(F.lit(n).alias("i"), F.array(*values).alias("v")))
            return F.explode(F.array(*parts))

        a, b = a.withColumn("strip", strip(F.col("sa"))), b.withColumn("strip", strip(F.col("sb")))
        pairs = a.join(b, ["job_id", "bits", "strip"]).where("a < b").dropDuplicates(["job_id", "a", "b"])
        found = hamming_ratio(F.col("sa"), F.col("sb"), F.col("bits"))
        return pairs.select("job_id", "a", "b", F.round(found, 6).alias("ratio")).where(F.col("ratio") <= ratio)
    return _near_in_blocks(frames, ratio)


def _near_in_blocks(frames: DataFrame, ratio: float) -> DataFrame:
    """``near_duplicate_frames`` by comparing all frames of a job, two blocks at a time."""
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}
    schema = f"job_id {kinds['job_id']}, a {kinds['frame_id']}, b {kinds['frame_id']}, ratio double"

    def hits(x: pa.Table, y: pa.Table) -> pa.Table:
        names = ["job_id", "a", "b", "ratio"]
        if not x.num_rows or not y.num_rows:
            return pa.table([x["job_id"][:0], x["frame_id"][:0], x["frame_id"][:0], pa.array([], pa.float64())], names)
        ia, ib = (z["frame_id"].to_numpy() for z in (x, y))
        ascending = ia[:, None] < ib
        own = x["i"][0].as_py() == x["j"][0].as_py()
        share = _differing(x, y) / np.where(ascending, x["bits"].to_numpy()[:, None], y["bits"].to_numpy())
        m, n = np.nonzero((share <= ratio + 1e-6) & (ascending if own else ia[:, None] != ib))
        up = ascending[m, n]
        return pa.table([x["job_id"].take(m), pa.array(np.where(up, ia[m], ib[n])), pa.array(np.where(up, ib[n], ia[m])), pa.array(share[m, n])], names)

    rows = _blocks(frames)
    x = rows.select("job_id", "words", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), "frame_id", "signature", "bits")
    y = rows.select("job_id", "words", F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("i"), F.col("own").alias("j"), "frame_id", "signature", "bits")
    return _in_pairs(x, y, hits, schema).withColumn("ratio", F.round("ratio", 6)).where(F.col("ratio") <= ratio)


#: Flips of a strip, at most, that a signature is looked up under, and strips that a word is cut into.
MOST_FLIPS, CUTS = 4096, (1, 2, 4, 8)
#: Share of the classes that a look-up may meet before comparing all of them in blocks costs less.
WORTH = 0.25
#: Comparisons in blocks that cost as much as a row of the join by strips.
ROW_COST = 130


def flips(width: int, radius: int) -> list[int]:
    """All masks of ``width`` bits of which at most ``radius`` are set."""
    return [sum(1 << b for b in at) for n in range(radius + 1) for at in combinations(range(width), n)]


def strip_plan(words: int, most: int) -> tuple[int, int] | None:
    """(strips of a word, flips of a strip) by which signatures that differ in at most ``most`` bits meet at the least cost; None if comparing all costs less.

    Of ``words`` times the strips one differs in at most its share of the bits.
    """
    best = None
    for cuts in CUTS:
        width, radius = 64 // cuts, most // (words * cuts)
        n = sum(math.comb(width, i) for i in range(radius + 1))
        met = words * cuts * n / 2**width
        if n <= MOST_FLIPS and met <= WORTH and (best is None or words * cuts * n < best[0]):
            best = words * cuts * n, cuts, radius
    return best and best[1:]


def strips_pay(words: int, plan: tuple[int, int], classes: float, squares: float) -> bool:
    """Whether meeting by a ``strip_plan`` costs less than comparing all in blocks; squares: of the numbers of classes of each job, summed."""
    cuts, radius = plan
    looked_up = words * cuts * sum(math.comb(64 // cuts, i) for i in range(radius + 1))
    return ROW_COST * (looked_up * classes + looked_up / 2 ** (64 // cuts) * squares) < squares / 2


def _strips(signature: Column, words: int, cuts: int) -> Column:
    """Rows i, v: the strips of a signature."""
    width = 64 // cuts
    word = lambda w: F.coalesce(F.get(signature, F.lit(w)), F.lit(0).cast("long"))
    part = lambda w, c: word(w) if cuts == 1 else F.shiftrightunsigned(word(w), c * width).bitwiseAND(F.lit((1 << width) - 1))
    return F.explode(F.array(*[F.struct(F.lit(w * cuts + c).alias("i"), part(w, c).alias("v")) for w in range(words) for c in range(cuts)]))


def near_duplicate_classes(frames: DataFrame, ratio: float) -> tuple[DataFrame, DataFrame]:
    """Frames (job_id, frame_id, signature, bits) as classes, and the links between classes of a job.

    members: job_id, frame_id, class_id (the smallest frame with that signature);
    links: job_id, a, b (classes, a < b), ratio of those whose signatures differ in at
    most that share of the bits. Copies are one class, so what is compared and
    returned does not grow with them. Signatures meet where a strip of theirs is the
    same but for a few bits (``strip_plan``); where the ratio is too large or the jobs
    are too small for that to pay, all classes of a job are compared in blocks. Frames without job, id or
    signature are left out; signatures of different lengths are never linked.
    """
    good = written(frames.where("job_id IS NOT NULL AND frame_id IS NOT NULL AND signature IS NOT NULL").select("job_id", "frame_id", "signature", "bits"))
    classes = good.groupBy("job_id", "bits", "signature").agg(F.min("frame_id").alias("class_id"))
    members = good.join(classes, ["job_id", "bits", "signature"]).select("job_id", "frame_id", "class_id")
    jobs = classes.groupBy("job_id", "bits").agg(F.max(F.size("signature")).alias("words"), F.count(F.lit(1)).cast("double").alias("n"))
    shape = jobs.agg(F.max("bits"), F.max("words"), F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    bits, words = shape[0] or 0, shape[1] or 1
    plan = strip_plan(words, int(bits * (ratio + 1e-6)))
    if plan is None or not strips_pay(words, plan, shape[2] or 0, shape[3] or 0):
        return members, _near_in_blocks(classes.select("job_id", F.col("class_id").alias("frame_id"), "signature", "bits"), ratio)
    cuts, radius = plan
    side = lambda n: classes.select("job_id", "bits", F.col("class_id").alias(n), F.col("signature").alias(f"s{n}"), _strips(F.col("signature"), words, cuts).alias("strip"))
    a, b = side("a").select("*", "strip.i", "strip.v"), side("b").select("*", "strip.i", F.col("strip.v").alias("own"))
    b = b.withColumn("v", F.explode(F.array(*[F.col("own").bitwiseXOR(F.lit(m)) for m in _signed(flips(64 // cuts, radius))])))
    found = F.round(hamming_ratio(F.col("sa"), F.col("sb"), F.col("bits")), 6)
    # Spark's estimate leaves out what the flips multiply, so it would broadcast them
    pairs = a.drop("strip").join(b.drop("strip", "own").hint("merge"), ["job_id", "bits", "i", "v"]).where("a < b").withColumn("ratio", found).where(F.col("ratio") <= ratio)
    return members, pairs.select("job_id", "a", "b", "ratio").dropDuplicates(["job_id", "a", "b"])


def _signed(masks: list[int]) -> list[int]:
    """Masks as longs."""
    return [m - (1 << 64) if m >> 63 else m for m in masks]
