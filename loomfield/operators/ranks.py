"""Places of rows within keys, without a window that holds a whole key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.sources.files import shared_folder

#: Rows of counts (one for each key and range) up to which they are broadcast; beyond, they are joined.
BROADCAST_ROWS = 200_000


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table of the shared folder, so that what follows reads the same rows each time and after the loss of any executor."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "i", total: str | None = None) -> DataFrame:
    """Adds ``name``: each row's place, from 1, among the rows of its keys in the given order; with ``total`` also their number.

    Rows are dealt by ranges of keys and order, sorted within each range and
    written once. A row's place is its distance from the first row of its key in
    the range, plus what earlier ranges hold of the key; those counts have a row for
    each range and key. A key of any size is thus spread over ranges, unless
    all its rows are equal in the order. Null keys are a key of their own; rows that are equal in
    the order are numbered as they come; an empty table stays empty.
    """
    by = [F.col(k) for k in keys]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    held = written(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    own = [F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)]
    counts = held.groupBy("_range", *own).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    key = Window.partitionBy(*[f"_key{n}" for n in range(len(keys))] or [F.lit(0)])
    before = F.sum("_n").over(key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = written(counts.withColumns({"_before": F.coalesce(before, F.lit(0)), "_total": F.sum("_n").over(key)}).withColumnRenamed("_range", "_own"))
    if counts.count() <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(keys)], F.col("_range") == F.col("_own"))
    placed = held.join(counts, same).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1)
    return placed.select(*rows.columns, name, *([F.col("_total").alias(total)] if total else []))
