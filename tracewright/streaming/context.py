"""The same questions asked of streams: flags per window, mode switches, nesting depth."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _ordered(batches: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    """A key's rows of one micro-batch in order; the source's limit on a micro-batch bounds them (such as `maxFilesPerTrigger`)."""
    return pd.concat(list(batches)).sort_values(order, kind="stable")


def windowed_flags(events: DataFrame, time: str, by: str, flag: Column, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, by, n, flags): how many rows and which flags each key has in each window; rows later than `late` are left out."""
    rows = events.withWatermark(time, late).withColumn("_flag", flag)
    return rows.groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n"), F.bit_or("_flag").alias("flags")).select(F.col("w.start").alias("start"), by, "n", "flags")


def mode_switches(events: DataFrame, by: str, order: str, mode: str) -> DataFrame:
    """Rows whose mode differs from the key's row before, also across batches.  Each key keeps one mode as state."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for at, now in _ordered(batches, order)[[order, mode]].itertuples(index=False):
            if last is not None and now != last:
                rows.append((key[0], at, now, last))
            last = now
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=[by, order, "mode", "previous_mode"])

    return events.select(by, order, mode).groupBy(by).applyInPandasWithState(run, f"{by} {kinds[by]}, {order} {kinds[order]}, mode string, previous_mode string", "last string", "append", GroupStateTimeout.NoTimeout)


def depths(events: DataFrame, by: str, order: str, opens: str, closes: str) -> DataFrame:
    """(by, order, depth): the nesting depth after each opening or closing row, never below 0; one number per key is kept."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        depth = state.get[0] if state.exists else 0
        rows = []
        for at, up, down in _ordered(batches, order)[[order, opens, closes]].itertuples(index=False):
            depth = depth + 1 if up else max(0, depth - 1) if down else depth
            rows.append((key[0], at, depth))
        state.update((depth,))
        yield pd.DataFrame(rows, columns=[by, order, "depth"])

    return events.select(by, order, opens, closes).where(F.col(opens) | F.col(closes)).groupBy(by).applyInPandasWithState(run, f"{by} {kinds[by]}, {order} {kinds[order]}, depth int", "depth int", "append", GroupStateTimeout.NoTimeout)
