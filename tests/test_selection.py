"""Frames chosen in rounds equal those of a plain choice, one after the other."""

import math
import random

import pytest

from loomfield.operators import selection

SCHEMA = "job_id long, frame_id long, t double, scene_score double, signature array<long>, bits int, reason string"


def spread(n, end):
    return [end / 2] if n == 1 else [k * end / (n - 1) for k in range(n)]


def plain_choice(frames, duration, most, apart):
    """[(frame_id, t, reason)] of one job's frames (t, frame_id, score, signature, bits, reason)."""
    frames = sorted(frames)
    end = frames[-1][0]
    video = end if duration is None else duration
    interval = min(15.0, max(0.2, video / 4))

    def ratio(a, b):
        return 1.0 if a[4] != b[4] else sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a[3], b[3], strict=True)) / a[4]

    chosen = {}
    fresh = lambda i: i not in chosen and all(ratio(frames[i], frames[j]) > apart for j in chosen)
    slots = min(most, max(min(most, 3 if most >= 3 else 2), min(max(1, math.ceil(video / interval) + 1), math.ceil(most * 0.6))))
    for k, target in enumerate([0.0] if slots == 1 else spread(slots, end)):
        near = sorted(range(len(frames)), key=lambda i: (abs(frames[i][0] - target), -frames[i][2], i))
        if k == 0:
            chosen[near[0]] = "first"
        elif k == slots - 1:
            if chosen.get(near[0]) != "first":
                chosen[near[0]] = "tail"
        else:
            i = next((i for i in near if fresh(i)), None)
            if i is not None:
                chosen[i] = "coverage"
    for i in sorted(range(len(frames)), key=lambda i: (-frames[i][2], frames[i][0], i)):
        if len(chosen) < most and fresh(i):
            chosen[i] = None
    fewest = min(most, len(frames), 3)
    for target in spread(fewest, end):
        if len(chosen) < fewest and not any(abs(frames[i][0] - target) < 1e-6 for i in chosen):
            chosen[min((i for i in range(len(frames)) if i not in chosen), key=lambda i: (abs(frames[i][0] - target), i))] = "minimum_coverage"
    return [(frames[i][1], frames[i][0], reason or frames[i][5]) for i, reason in chosen.items()]


@pytest.mark.parametrize(("most", "apart", "offered"), [(8, 0.2, 2), (5, 0.35, 3), (2, 0.1, 32), (1, 0.1, 1), (40, 0.08, 32)])
def test_rounds_equal_the_plain_choice(spark, most, apart, offered):
    rng = random.Random(most)
    data, lengths = [], {}
    for job in range(14):
        bits = rng.choice([20, 64, 100])
        shots = [[rng.getrandbits(62) for _ in range(-(-bits // 64))] for _ in range(rng.choice([1, 3, 30]))]
        for n in range(rng.choice([1, 2, 3, 40])):
            t = rng.choice([n * 2.0, rng.random() * 50, float(rng.randint(0, 5))])
            mark = [w & (2 ** min(62, bits) - 1) ^ rng.choice([0, 1, 2, 5]) for w in rng.choice(shots)]
            data.append((job, n, t, rng.choice([0.0, 0.5, round(rng.random(), 2)]), mark, bits, rng.choice(["scene_change", "coverage"])))
        if job % 2:
            lengths[job] = rng.choice([0.3, 5.0, 400.0])
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    durations = spark.createDataFrame(list(lengths.items()), "job_id long, duration_s double")
    want = [(job, *kept) for job in range(14) for kept in plain_choice([(t, f, *rest) for j, f, t, *rest in data if j == job], lengths.get(job), most, apart)]
    assert sorted(map(tuple, selection.select_frames(df, durations, most, apart, offered=offered).collect())) == sorted(want)


def test_no_candidates(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert selection.select_frames(none, spark.createDataFrame([], "job_id long, duration_s double")).collect() == []
