"""Rows around matches, and marks where a mode changes, in ordered streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running
from .storage import written


def with_context(df: DataFrame, hit: Column, by: list[str], order: list[str], before: int = 0, after: int = 0) -> DataFrame:
    """Rows that match, with `before` earlier and `after` later rows; windows may overlap.  Adds `hit`."""
    numbered = running(df.withColumn("hit", F.coalesce(hit, F.lit(False))), by, order, _n=("sum", F.lit(1)))
    placed = running(numbered, by, ["_n"], _last=("last", F.when(F.col("hit"), F.col("_n"))), _next=("next", F.when(F.col("hit"), F.col("_n")), True))
    return placed.where((F.col("_n") <= F.col("_last") + after) | (F.col("_next") <= F.col("_n") + before)).drop("_n", "_last", "_next")


def with_greedy_context(df: DataFrame, hit: Column, by: list[str], order: list[str], before: int = 0, after: int = 0, width: int = 100_000) -> DataFrame:
    """The same for a reader that tests no row inside an after-window, and forgets its history at a match.

    Adds `kind`: history, anchor or after.  Rows are numbered by ranges.  Which
    matches are anchors is decided within chunks of `width` rows: a chunk tells, for
    each match near its beginning, which anchor is its last if that match is its
    first one.  Only these tables are read in order, to find where each chunk is
    entered; then each chunk marks its anchors.
    """
    numbered = running(df.withColumn("hit", F.coalesce(hit, F.lit(False))), by, order, _n=("sum", F.lit(1)))
    matches = numbered.where("hit").select(*by, "_n")
    found = (_anchors(matches, by, after, max(width, after + 1)) if after else matches).withColumn("_anchor", F.col("_n"))
    joined = numbered.join(found.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_n").alias("_at"), "_anchor"), _same(by) & (F.col("_n") == F.col("_at")), "left").drop("_at", *[f"_b{i}" for i in range(len(by))])
    placed = running(joined, by, ["_n"], _last=("last", F.col("_anchor")), _next=("next", F.col("_anchor")))
    kind = F.when(F.col("_anchor").isNotNull(), "anchor").when(F.col("_n") <= F.col("_last") + after, "after").when(F.col("_next") <= F.col("_n") + before, "history")
    return placed.withColumn("kind", kind).where("kind is not null").drop("_n", "_anchor", "_last", "_next")


def _same(by: list[str]) -> Column:
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    return same


def _anchors(matches: DataFrame, by: list[str], after: int, width: int) -> DataFrame:
    """Of the matches (by..., _n) those that a reader takes that skips `after` rows behind each."""
    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in matches.schema if f.name != "_n"], "_n long"])
    dealt = matches.withColumn("_chunk", F.floor(F.col("_n") / width).cast("long")).repartition(*by, "_chunk").sortWithinPartitions(*by, "_chunk", "_n")
    names = [*by, "_chunk"]

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, np.ndarray, pd.DataFrame]]:
        """The positions of each chunk, at most `width`, in order."""
        held, key = [], None
        for pdf in batches:
            for own, part in pdf.groupby(names, sort=False, dropna=False):
                if key is not None and str(own) != str(key):
                    yield key, np.concatenate([x["_n"].to_numpy() for x in held]), pd.concat(held)
                    held = []
                key = own
                held.append(part)
        if held:
            yield key, np.concatenate([x["_n"].to_numpy() for x in held]), pd.concat(held)

    def last_of(n: np.ndarray, first: int) -> int:
        at = first
        while True:
            ahead = int(np.searchsorted(n, n[at] + after, "right"))
            if ahead == len(n):
                return int(n[at])
            at = ahead

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, n, rows in chunks(batches):
            # a window that was opened before the chunk ends within its first rows
            some = 1 + int(np.searchsorted(n, n[0] // width * width + after, "left"))
            yield rows.iloc[: min(some, len(n))].assign(_last=[last_of(n, i) for i in range(min(some, len(n)))])

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chunk, last, done = None, None, None, True
        for pdf in batches:
            keep = []
            for row in pdf.itertuples(index=False, name=None):
                own = str(row[: len(by)])
                if own != key:
                    key, chunk, last = own, None, None
                if row[len(by)] != chunk:
                    chunk, done = row[len(by)], False
                good = not done and (last is None or row[len(by) + 1] > last + after)
                keep.append(good)
                if good:
                    last, done = row[len(by) + 2], True
            yield pdf[keep]

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, n, rows in chunks(batches):
            first = rows["_first"].iloc[0]
            if first != first or first is None:
                continue
            at, taken = int(np.searchsorted(n, int(first))), []
            while at < len(n):
                taken.append(at)
                at = int(np.searchsorted(n, n[at] + after, "right"))
            yield rows.iloc[taken][[*by, "_n"]]

    told = written(dealt.mapInPandas(tell, f"{kinds}, _chunk long, _last long").select(*names, "_n", "_last"))
    in_order = told.repartition(*by).sortWithinPartitions(*names, "_n") if by else told.coalesce(1).sortWithinPartitions("_chunk", "_n")
    entered = written(in_order.mapInPandas(enter, told.schema))
    first = entered.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_chunk").alias("_c"), F.col("_n").alias("_first"))
    rows = dealt.join(first, _same(by) & (F.col("_chunk") == F.col("_c"))).select(*by, "_n", "_chunk", "_first").repartition(*by, "_chunk").sortWithinPartitions(*by, "_chunk", "_n")
    return rows.mapInPandas(mark, kinds)


def mode_switches(df: DataFrame, mode: Column, by: list[str], order: list[str], initial=None, among: Column | None = None) -> DataFrame:
    """Rows whose mode differs from that of the row before; adds `mode` and `previous_mode`.  With `among`, only such rows count, as those of a dump that aren't history."""
    rows = (df if among is None else df.where(among)).withColumn("mode", mode)
    marked = running(rows, by, order, _before=("last", F.struct("mode"), False)).withColumn("previous_mode", F.col("_before.mode")).drop("_before")
    if initial is not None:
        marked = marked.withColumn("previous_mode", F.coalesce("previous_mode", F.lit(initial)))
    return marked.where(F.col("mode") != F.col("previous_mode"))


def jumps(df: DataFrame, pc: str, by: list[str], order: list[str], step: int = 4) -> DataFrame:
    """Rows further than `step` from the row before."""
    held = running(df, by, order, _before=("last", F.struct(F.col(pc).alias("pc")), False)).withColumn("previous_pc", F.col("_before.pc")).drop("_before")
    return held.where(F.abs(F.col(pc).cast("decimal(21,0)") - F.col("previous_pc").cast("decimal(21,0)")) > step)
