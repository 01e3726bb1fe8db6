"""Event-time order for state that depends on it.

Events of a key wait in state until the watermark has passed them, and are then handed on in order. What comes
late by less than the watermark's delay changes nothing; what comes later is dropped by Spark, which
counts it in the progress of the query (``run.Drained.late``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming.state import GroupState

#: First column of the state: the waiting events, as an Arrow stream.
HELD = "held binary"


def _packed(rows: pd.DataFrame) -> bytes | None:
    if rows.empty:
        return None
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    rows = pa.ipc.open_stream(held).read_all().to_pandas()
    # Arrays come back as numpy arrays either way; lists compare and sort more simply.
    return rows


def in_order(
    fold: Callable[[tuple, pd.DataFrame, tuple | None, int], tuple[pd.DataFrame | None, tuple | None, int | None]], ts: str, order: list[str],
) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """A function for ``applyInPandasWithState`` that gives ``fold`` the events of a key in order.

    Args:
        fold: gets the key, the events that are due (sorted; none if only a timer went off), what it returned as its state the last
            time (None at first) and the watermark in milliseconds. Returns rows or None, the new state (a tuple
            of the state columns after ``HELD``, or None to forget), and the time in milliseconds at which it wants to be
            called without events, or None.
        ts: column of the event time.
        order: columns that order events.

    The state of the query is ``HELD`` followed by the columns that ``fold`` keeps; their values may be null.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, *rest = state.get if state.exists else (None,)
        kept = tuple(rest) if rest and rest[0] is not None else None
        frames = [_unpacked(held)] if held is not None else []
        if not state.hasTimedOut:
            frames += list(batches)
        watermark = state.getCurrentWatermarkMs()
        rows = pd.concat(frames, ignore_index=True) if frames else None
        due = rest_rows = None
        if rows is not None:
            passed = rows[ts] <= pd.Timestamp(max(watermark, 0), unit="ms")
            due, rest_rows = rows[passed].sort_values(order, kind="stable"), rows[~passed]
        out, kept, wake = fold(key, due if due is not None else pd.DataFrame(), kept, watermark)
        waiting = rest_rows is not None and not rest_rows.empty
        if kept is None and not waiting:
            if state.exists:
                state.remove()
        else:
            state.update((_packed(rest_rows) if waiting else None, *(kept if kept is not None else (None,) * width)))
            calls = [wake] if wake is not None else []
            if waiting:
                calls.append(-(-rest_rows[ts].min().value // 1_000_000))
            if calls:
                state.setTimeoutTimestamp(max(min(calls), watermark + 1))
        if out is not None and len(out):
            yield out

    width = fold.width
    return run


def keeps(width: int):
    """Says how many state columns a fold keeps; the first of them is never null while there is a state."""

    def mark(fold):
        fold.width = width
        return fold

    return mark
