"""Selection of frames for coverage and scenes without near-duplicates, in rounds over all jobs.

A selection is greedy: each choice depends on those before. A round brings
together, of each job, what was chosen so far and the few best candidates for each
choice that is still open, and makes as many choices as these allow; where near-duplicates use them
up, the next round brings the best of what is left. No task holds the candidates of a job.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.operators.frames import hamming_ratio
from loomfield.operators.ranks import written

#: Candidates of a job that a round brings for each choice.
OFFERED = 32
#: Share of the frames that coverage may take, and frames at least.
COVERAGE_SHARE, FEWEST = 0.6, 3
CHOSEN = ["frame_id", "t", "scene_score", "signature", "bits", "own", "reason"]
SAME_TIME = 1e-6


def _ratio(a: pd.Series, b: pd.Series) -> float:
    """Share of differing bits; signatures of different lengths have nothing in common."""
    if a.bits != b.bits:
        return 1.0
    return sum(((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(a.signature, b.signature, strict=True)) / a.bits


class Taken:
    """What was chosen of a job, by frame."""

    def __init__(self, rows: pd.DataFrame, apart: float):
        self.rows, self.apart = {(r.t, r.frame_id): r for r in rows.itertuples()}, apart
        self.reasons = {k: r.reason for k, r in self.rows.items()}

    def free(self, row) -> bool:
        return (row.t, row.frame_id) not in self.rows and all(_ratio(row, r) > self.apart for r in self.rows.values())

    def take(self, row, reason: str | None) -> None:
        key = row.t, row.frame_id
        self.rows.setdefault(key, row)
        self.reasons[key] = reason

    def table(self, job: object, at: int) -> pd.DataFrame:
        """What is chosen of a job, and how far it got in a row of its own."""
        rows = [(job, *[None] * len(CHOSEN), at), *[(job, *[getattr(r, c) for c in CHOSEN[:-1]], self.reasons[k], None) for k, r in self.rows.items()]]
        table = pd.DataFrame(rows, columns=["job_id", *CHOSEN, "at"], dtype=object)
        return table.astype({"at": "Int64", "frame_id": "Int64", "bits": "Int64", "t": float, "scene_score": float})


def _cover(taken: Taken, offered: pd.DataFrame, job: dict, full: int) -> int:
    """Choices for the slots from ``at`` on; the slot that needs more candidates, or the number of slots."""
    by_slot = dict(tuple(offered.groupby("slot")))
    for slot in range(int(job["at"]), int(job["slots"])):
        own = by_slot.get(slot, offered[:0])
        if slot in (0, job["slots"] - 1):
            row = next(own.itertuples())
            if slot == 0:
                taken.take(row, "first")
            elif taken.reasons.get((row.t, row.frame_id)) != "first":
                taken.take(row, "tail")
            continue
        row = next((r for r in own.itertuples() if taken.free(r)), None)
        if row is not None:
            taken.take(row, "coverage")
        elif len(own) == full:
            return slot
    return int(job["slots"])


def _fill(taken: Taken, offered: pd.DataFrame, job: dict, full: int) -> int:
    """The best scenes; 1 if more candidates may fit, else 0."""
    for row in offered.itertuples():
        if len(taken.rows) < job["most"] and taken.free(row):
            taken.take(row, None)
    return int(len(taken.rows) < job["most"] and len(offered) == full)


def _complete(taken: Taken, offered: pd.DataFrame, job: dict, full: int) -> int:
    """Those nearest to even times, near-duplicates or not, up to the fewest."""
    for slot, own in offered.groupby("slot"):
        target = _even(int(slot), int(job["fewest"]), job["end"])
        if len(taken.rows) < job["fewest"] and not any(abs(t - target) < SAME_TIME for t, _ in taken.rows):
            row = next((r for r in own.itertuples() if (r.t, r.frame_id) not in taken.rows), None)
            if row is not None:
                taken.take(row, "minimum_coverage")
    return 0


def _even(slot: int, n: int, end: float) -> float:
    return end / 2 if n == 1 else slot * end / (n - 1)


def _round(jobs: DataFrame, chosen: DataFrame, offered: DataFrame, step: Callable, apart: float, full: int) -> tuple[DataFrame, DataFrame]:
    """What is chosen of ``jobs`` after a round, and how far each job got (at)."""
    facts = [c for c in jobs.columns if c != "job_id"]
    left = jobs.join(chosen, "job_id", "left").select("job_id", *facts, *CHOSEN)
    offered = offered.select(*[F.col(c).alias(c) for c in offered.columns])  # columns of its own, as both come from the same rows

    def walk(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        job = a.iloc[0].to_dict()
        taken = Taken(a[a["frame_id"].notna()], apart)
        at = step(taken, b.sort_values(["slot", "place"]), job, full)
        return taken.table(job["job_id"], at)

    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("job_id", *CHOSEN)) + ", at long"
    out = written(left.groupBy("job_id").cogroup(offered.groupBy("job_id")).applyInPandas(walk, schema))
    return out.where("at IS NULL").drop("at"), out.where("at IS NOT NULL").select("job_id", "at")


def _offer(rows: DataFrame, order: list, slot: Column, full: int) -> DataFrame:
    """The ``full`` best rows of each job and slot."""
    slotted = rows.withColumn("slot", slot)
    place = F.row_number().over(Window.partitionBy("job_id", "slot").orderBy(*order))
    return slotted.withColumn("place", place).where(F.col("place") <= full).select("job_id", "slot", "place", *CHOSEN[:-1])


def _apart_from(rows: DataFrame, chosen: DataFrame, apart: float) -> DataFrame:
    """Adds near: whether a row is a near-duplicate of one that its job has chosen, or that one."""
    held = chosen.groupBy("job_id").agg(F.collect_list(F.struct("frame_id", "t", "signature", "bits")).alias("held"))
    same = lambda h: (h["frame_id"] == F.col("frame_id")) & (h["t"] == F.col("t"))
    alike = lambda h: (h["bits"] == F.col("bits")) & (hamming_ratio(h["signature"], F.col("signature"), F.col("bits")) <= apart)
    return rows.join(held, "job_id", "left").withColumn("near", F.coalesce(F.exists("held", lambda h: same(h) | alike(h)), F.lit(False))).drop("held")


def select_frames(candidates: DataFrame, durations: DataFrame, most: int = 40, apart: float = 0.08, longest: float = 15.0, step: float = 0.2, offered: int = OFFERED) -> DataFrame:
    """job_id, frame_id, t, reason of the candidates kept (job_id, frame_id, t, scene_score, signature, bits, reason), at most ``most`` of a job.

    Slots for coverage, three at least, are as many as intervals (a quarter of the
    video, between ``step`` and ``longest``) cover the video, up to 60 % of ``most``.
    At each slot's time the nearest candidate (better scenes first) is taken that is
    no near-duplicate of one taken; the ends are taken as they are. Then the best
    scenes that are no near-duplicates fill up. If fewer than three were taken, those
    nearest to even times are added. durations: job_id, duration_s; unknown: up to
    the last candidate. Candidates without job, frame or time are left out; equal
    ones go by time and frame. ``offered`` candidates are brought for each choice of a round;
    the number changes no result.
    """
    rows = candidates.where("job_id IS NOT NULL AND frame_id IS NOT NULL AND t IS NOT NULL").select(
        "job_id", F.col("frame_id").cast("long").alias("frame_id"), F.col("t").cast("double").alias("t"), F.coalesce(F.col("scene_score").cast("double"), F.lit(0.0)).alias("scene_score"),
        "signature", F.col("bits").cast("long").alias("bits"), F.col("reason").alias("own"))
    rows = written(rows)
    jobs = rows.groupBy("job_id").agg(F.max("t").alias("end"), F.count(F.lit(1)).alias("n")).join(durations.select("job_id", "duration_s"), "job_id", "left")
    video = F.coalesce("duration_s", "end")
    interval = F.least(F.lit(longest), F.greatest(F.lit(step), video / 4))
    least = min(most, FEWEST if most >= FEWEST else 2)
    wanted = F.greatest(F.lit(1), F.ceil(video / interval) + 1)
    slots = F.least(F.lit(most), F.greatest(F.lit(least), F.least(wanted, F.lit(-(-most * 6 // 10)))))
    fewest = F.least(F.lit(min(most, FEWEST)), F.col("n"))
    jobs = written(jobs.select("job_id", "end", slots.cast("long").alias("slots"), fewest.cast("long").alias("fewest"), F.lit(most).cast("long").alias("most")))
    chosen = written(rows.withColumn("reason", F.lit(None).cast("string")).limit(0))
    nearest = [F.abs(F.col("t") - F.col("target")), F.desc("scene_score"), "t", "frame_id"]

    at = jobs.select("job_id", F.lit(0).cast("long").alias("at"))
    while True:
        open_ = jobs.join(at, "job_id").where("at < slots")
        if open_.isEmpty():
            break
        each = _apart_from(rows.join(open_, "job_id"), chosen, apart).withColumn("slot", F.explode(F.sequence("at", F.col("slots") - 1)))
        edge = (F.col("slot") == 0) | (F.col("slot") == F.col("slots") - 1)
        target = F.when(F.col("slots") == 1, 0.0).otherwise(F.col("slot") * F.col("end") / (F.col("slots") - 1))
        best = _offer(each.where(edge | ~F.col("near")).withColumn("target", target), nearest, F.col("slot"), offered)
        after, at_ = _round(open_, chosen, best, _cover, apart, offered)
        chosen, at = _replaced(chosen, after, at_), at_
    open_ = jobs.withColumn("at", F.lit(1).cast("long"))
    while not open_.isEmpty():
        fitting = _apart_from(rows.join(open_.select("job_id"), "job_id"), chosen, apart).where(~F.col("near"))
        after, at_ = _round(open_, chosen, _offer(fitting, [F.desc("scene_score"), "t", "frame_id"], F.lit(0).cast("long"), offered), _fill, apart, offered)
        chosen = _replaced(chosen, after, at_)
        open_ = written(jobs.join(at_.where("at = 1"), "job_id"))
    few = jobs.join(chosen.groupBy("job_id").agg(F.count(F.lit(1)).alias("taken")), "job_id").where("taken < fewest").drop("taken").withColumn("at", F.lit(0).cast("long"))
    if not few.isEmpty():
        each = rows.join(few, "job_id").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fewest") - 1)))
        target = F.when(F.col("fewest") == 1, F.col("end") / 2).otherwise(F.col("slot") * F.col("end") / (F.col("fewest") - 1))
        best = _offer(each.withColumn("target", target), [F.abs(F.col("t") - F.col("target")), "t", "frame_id"], F.col("slot"), max(offered, FEWEST))
        after, at_ = _round(few, chosen, best, _complete, apart, offered)
        chosen = _replaced(chosen, after, at_)
    return chosen.select("job_id", "frame_id", "t", F.coalesce("reason", "own").alias("reason"))


def _replaced(chosen: DataFrame, after: DataFrame, walked: DataFrame) -> DataFrame:
    """What was chosen of jobs that a round did not touch, and what it chose of the others."""
    return written(chosen.join(walked.select("job_id"), "job_id", "left_anti").select("job_id", *CHOSEN).unionByName(after.select("job_id", *CHOSEN)))
