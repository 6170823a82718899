"""Streaming ingest gives one result however the stream is split, and chain state equals a plain fold."""

import itertools
import json

import pytest
from pyspark.sql import Row

from loomfield.streaming.ingest import FirstDelivery, FirstSight, ingest_pages_stream
from loomfield.streaming.pages import chain_outcome, chain_state_stream

SCHEMA = "snapshot_id string, page_seq long, page_cursor string, next_cursor string, has_more boolean, items array<string>"
COLUMNS = ["snapshot_id", "page_seq", "page_cursor", "next_cursor", "has_more", "items"]
DELIVERIES = [
    ("s", 1, "0", "1", True, ["a", " b ", "a"]), ("s", 2, "0", "1", True, ["z"]), ("t", 3, "0", None, False, ["a", None, ""]), ("s", 4, "0", "9", True, ["y"]),
    ("s", 5, "1", None, False, ["b", "c"]), ("s", 6, "1", None, False, None), (None, 7, "0", "1", True, ["x"]),
]
PAGES = [("s", "0", "1", True, 1), ("s", "1", None, False, 5), ("t", "0", None, False, 3)]
CONFLICTS = [("s", "0", "9", True, 4)]
ITEMS = [("s", "a", 1), ("s", "b", 2), ("s", "c", 3), ("t", "a", 1)]


def put(folder, name, pages):
    (folder / name).write_text("\n".join(json.dumps(dict(zip(COLUMNS, p, strict=False))) for p in pages))


class Held:
    """The state of one key, and a handle to it."""

    def __init__(self):
        self.value = None

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def by_key(rows, key, processor, states):
    """What a processor yields for the rows of a batch, group by group, with the states of its keys."""
    groups = {}
    for r in rows:
        groups.setdefault(key(r), []).append(r)
    for k, own in groups.items():
        p = processor()
        p.init(states.setdefault(k, Held()))
        yield from p.handleInputRows(k, iter(own), None)


@pytest.mark.parametrize("order", [1, -1])
def test_processors_give_one_result_for_every_split(order):
    """All 64 ways to deal the deliveries to batches; within a batch they may come in any order."""
    given = [Row(**dict(zip([*COLUMNS[:-1], "items_"], d, strict=True))) for d in DELIVERIES if d[0]]
    for cuts in itertools.product([False, True], repeat=len(given) - 1):
        batches, first, seen, out, items = [[given[0]]], {}, {}, [], []
        for cut, r in zip(cuts, given[1:], strict=True):
            batches += [[]] if cut else []
            batches[-1].append(r)
        for batch in batches:
            log = list(by_key(batch[::order], lambda r: (r.snapshot_id, r.page_cursor), FirstDelivery, first))
            fresh = list(by_key(log, lambda r: (r.snapshot_id, r.item_id or r.page_cursor, r.kind == "item"), FirstSight, seen))
            out += [(r.kind, r.snapshot_id, r.page_cursor, r.next_cursor, r.has_more, r.page_seq) for r in fresh if r.kind != "item"]
            items += sorted((r.snapshot_id, r.page_seq, r.place, r.item_id) for r in fresh if r.kind == "item")
        assert sorted(r[1:] for r in out if r[0] == "page") == PAGES and [r[1:] for r in out if r[0] == "conflict"] == CONFLICTS
        places = [(s, x, n) for s in "st" for n, x in enumerate([x for t, _, _, x in items if t == s], 1)]
        assert places == ITEMS


@pytest.mark.parametrize("cuts", [[], [3, 5]])
def test_one_result_for_every_split(spark, tmp_path, cuts):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(DELIVERIES)], strict=True)):
        put(source, f"{n}.json", DELIVERIES[a:b])
        ingest_pages_stream(spark.readStream.schema(SCHEMA).json(str(source)), out, str(tmp_path / "check")).awaitTermination()
    log = spark.read.parquet(out + "/log").select("kind", "snapshot_id", "page_cursor", "next_cursor", "has_more", "page_seq").collect()
    assert sorted(tuple(r)[1:] for r in log if r.kind == "page") == PAGES
    assert [tuple(r)[1:] for r in log if r.kind == "conflict"] == CONFLICTS
    assert sorted(map(tuple, spark.read.parquet(out + "/items").select("snapshot_id", "item_id", "position").collect())) == ITEMS


def test_chain_state(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    pages = [("s", 1, "0", "1", True), ("s", 2, "2", "3", True), ("s", 3, "1", None, False), ("s", 4, "4", None, False), ("t", 1, "7", None, False)]
    put(source, "1.json", pages)
    stream = chain_state_stream(spark.readStream.schema(SCHEMA).json(str(source)))
    query = stream.writeStream.format("memory").queryName("chain").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.sql("SELECT * FROM chain").collect()))
    state, want = {}, []
    for s, i, cursor, following, more in pages:
        outcome, state[s] = chain_outcome(state.get(s), cursor, following, more)
        want.append((s, i, outcome))
    assert got == sorted(want) and [w[2] for w in want] == ["accepted", "discontinuity", "accepted", "after_last_page", "bad_start"]
