"""Streaming forms: first row per key with a watermark, and the merge applied batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merge import apply_actions, sync_actions


def first_within(stream: DataFrame, keys: list[str], at: str, delay: str = "7 days") -> DataFrame:
    """Rows whose key was not seen within the watermark; later ones are dropped, and state with them."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def weekly_counts(stream: DataFrame, by: str, at: str, delay: str = "7 days") -> DataFrame:
    """Rows per key and Monday-to-Sunday week."""
    from pyspark.sql import functions as F

    week = F.window(at, "7 days", "7 days", "4 days")
    return stream.withWatermark(at, delay).groupBy(week.alias("week"), by).count()


def breaker(stream: DataFrame, by: str, order: str, failed: str, limit: int) -> DataFrame:
    """Keys whose last `limit` rows failed in a row, once each."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, stopped = state.get if state.exists else (0, False)
        rows = pd.concat(batches).sort_values(order)
        for at, bad in zip(rows[order], rows[failed], strict=True):
            streak = streak + 1 if bad else 0
            if streak == limit and not stopped:
                stopped = True
                yield pd.DataFrame({by: [key[0]], "stopped_at": [at]})
        state.update((streak, stopped))

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    return stream.groupBy(by).applyInPandasWithState(step, f"{by} {kinds[by]}, stopped_at {kinds[order]}", "streak int, stopped boolean", "append", GroupStateTimeout.NoTimeout)


def merge_batches(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: list[str], fields: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merge each batch into the table that `read` gives and `write` replaces."""

    def apply(batch: DataFrame, epoch: int) -> None:
        existing = read()
        decided = sync_actions(existing, batch, key, fields, order)
        guard = existing.select(*key, "is_human", "is_invalid")
        merged = apply_actions(existing, decided, key, fields, order).join(guard, key, "left").na.fill({"is_human": False, "is_invalid": False})
        write(merged)

    return apply
