"""Idempotent ingest of collection pages as a stream, with keyed state in place of stored pages."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomfield.operators.ranks import numbered

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Kinds of rows: stored pages, deliveries that differ from the stored page, and items.
PAGE, CONFLICT, ITEM = "page", "conflict", "item"
LOG = "kind string, snapshot_id {0}, page_cursor string, page_seq long, next_cursor string, has_more boolean, place int, item_id string"


FIELDS = [f.split()[0] for f in LOG.split(", ")]


def _logged(row: Row) -> Row:
    return Row(**{c: row[c] for c in FIELDS})


class FirstDelivery(StatefulProcessor):
    """Of each (snapshot, cursor): the first delivery is the page, with its items; equal ones add nothing, others are conflicts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "next_cursor string, has_more boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.first.get()
        for r in sorted(rows, key=lambda r: r.page_seq):
            body = (r.next_cursor, r.has_more)
            if held is None:
                held = body
                self.first.update(body)
                yield Row(kind=PAGE, snapshot_id=key[0], page_cursor=key[1], page_seq=r.page_seq, next_cursor=body[0], has_more=body[1], place=None, item_id=None)
                for place, item in enumerate(r.items_ or []):
                    if item is not None and item.strip():
                        yield Row(kind=ITEM, snapshot_id=key[0], page_cursor=key[1], page_seq=r.page_seq, next_cursor=None, has_more=None, place=place, item_id=item.strip())
            elif tuple(held) != body:
                yield Row(kind=CONFLICT, snapshot_id=key[0], page_cursor=key[1], page_seq=r.page_seq, next_cursor=body[0], has_more=body[1], place=None, item_id=None)

    def close(self) -> None:
        pass


class FirstSight(StatefulProcessor):
    """Of each (snapshot, item) the first row; pages and conflicts pass."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "page_seq long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if not key[2]:
            for r in rows:
                yield _logged(r)
        elif self.seen.get() is None:
            first = min(rows, key=lambda r: (r.page_seq, r.place))
            self.seen.update((first.page_seq,))
            yield _logged(first)

    def close(self) -> None:
        pass


def ingest_pages_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Pages (snapshot_id, page_cursor, page_seq, next_cursor, has_more, items) into tables under ``path``.

    The first delivery of a cursor is stored, whatever the batches: an equal one adds
    nothing, a different one goes to conflicts. Items are kept on first sight in
    their snapshot and get the next positions there. State is kept for each cursor
    and each item, so no batch reads what others stored; positions go on from one
    count for each snapshot. A batch writes folders of its own, which a second run of it
    replaces. Deliveries of a batch count in the order of page_seq; rows without
    a snapshot or a cursor, and items without an id, are left out.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = stream.schema["snapshot_id"].dataType.simpleString()
    rows = stream.where("snapshot_id IS NOT NULL AND page_cursor IS NOT NULL").withColumnRenamed("items", "items_")
    pages = rows.groupBy("snapshot_id", "page_cursor").transformWithState(FirstDelivery(), LOG.format(kind), "append", "none")
    named = pages.withColumns({"name": F.coalesce("item_id", "page_cursor"), "is_item": F.col("kind") == ITEM})
    log = named.groupBy("snapshot_id", "name", "is_item").transformWithState(FirstSight(), LOG.format(kind), "append", "none")

    def store(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        log_of = f"{path}/log/batch={number}"
        batch.write.mode("overwrite").partitionBy("kind").parquet(log_of)
        fresh = own.read.schema(LOG.format(kind)).parquet(log_of).where(F.col("kind") == ITEM)
        counts = f"{path}/counts/batch="
        known = own.read.parquet(f"{counts}{number - 1}") if number else own.createDataFrame([], f"snapshot_id {kind}, items long")
        placed = numbered(fresh.select("snapshot_id", "item_id", "page_seq", "place"), ["snapshot_id"], ["page_seq", "place", "item_id"], "n")
        placed = placed.join(known, "snapshot_id", "left").withColumn("position", F.col("n") + F.coalesce("items", F.lit(0)))
        placed.select("snapshot_id", "item_id", "position", "page_seq").write.mode("overwrite").parquet(f"{path}/items/batch={number}")
        added = fresh.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("items"))
        known.union(added).groupBy("snapshot_id").agg(F.sum("items").alias("items")).write.mode("overwrite").parquet(f"{counts}{number}")

    return log.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
