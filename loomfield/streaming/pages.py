"""The state of each chain of collection pages, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHAIN = "snapshot_id string, page_seq long, outcome string"


def chain_outcome(state: tuple | None, cursor: str, next_cursor: str | None, has_more: bool) -> tuple[str, tuple | None]:
    """The outcome of a page after the state (expected cursor, more pages), and the state after it."""
    if state is None:
        return ("accepted", (next_cursor, has_more)) if cursor == "0" else ("bad_start", None)
    expected, more = state
    if not more:
        return "after_last_page", state
    return ("accepted", (next_cursor, has_more)) if cursor == expected else ("discontinuity", state)


def chain_state_stream(stream: DataFrame) -> DataFrame:
    """snapshot_id, page_seq, outcome of each page: accepted, bad_start, discontinuity or after_last_page."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else None
        pages = pd.concat(list(batches)).sort_values("page_seq")
        out = []
        for p in pages.itertuples():
            outcome, state = chain_outcome(state, p.page_cursor, p.next_cursor, bool(p.has_more))
            out.append((key[0], p.page_seq, outcome))
        if state is not None:
            held.update(state)
        yield pd.DataFrame(out, columns=["snapshot_id", "page_seq", "outcome"])

    return stream.groupBy("snapshot_id").applyInPandasWithState(follow, CHAIN, "expected string, more boolean", "append", GroupStateTimeout.NoTimeout)
