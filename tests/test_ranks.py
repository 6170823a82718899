"""Places within keys, whatever the keys' sizes."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomfield.operators.ranks import numbered


@pytest.fixture
def fifty(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_one_key_holds_all_rows(fifty):
    rows = fifty.range(5000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 10007).alias("x"))
    got = numbered(rows, ["k"], ["x"], "i", "n").collect()
    assert [r.i for r in sorted(got, key=lambda r: r.x)] == list(range(1, 5001)) and {r.n for r in got} == {5000}


def test_keys_with_null_descending_and_empty(fifty):
    rows = fifty.range(600).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("k"), F.col("id") % 3)).alias("k"), F.col("id").alias("x"))
    places = defaultdict(list)
    for r in numbered(rows, ["k"], [F.desc("x")]).collect():
        places[r.k].append((-r.x, r.i))
    assert len(places) == 3
    for own in places.values():
        assert [i for _, i in sorted(own)] == list(range(1, 201))
    assert numbered(rows.limit(0), ["k"], ["x"]).collect() == []
    assert sorted(r.i for r in numbered(rows, [], ["x"]).collect()) == list(range(1, 601))
