"""Own functions over the rows of a trace, with state, beside the built-in operators.

A callback is a start state, a step that takes a state and a row and gives the next
state and rows of output, and a merge of the states of two stretches that follow
each other.  The trace is dealt to chunks.  Every chunk first steps from the start
state; merged in order, these states say how each chunk begins; then each chunk
steps again, from there, for its output.  With a merge that fits the step, results
don't depend on the chunks, and one task reads no more than a state a chunk in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written


class Callback(NamedTuple):
    start: Callable[[], Any]
    step: Callable[[Any, dict], tuple[Any, list[tuple]]]
    merge: Callable[[Any, Any], Any]
    #: The columns of the output, as in a schema.
    kinds: str
    #: Which rows it sees; all, if none is given.
    rows: Column | None = None


class Callbacks:
    """Callbacks by name."""

    def __init__(self):
        self.held: dict[str, Callback] = {}

    def add(self, name: str, callback: Callback) -> None:
        if name in self.held:
            raise ValueError(f"there is a callback {name!r} already")
        self.held[name] = callback

    def run(self, name: str, trace: DataFrame, order: str = "idx", width: int = 1_000_000) -> DataFrame:
        """The output of a callback over the rows of a trace, in chunks of `width` places of a number `order` that no two rows share."""
        f = self.held[name]
        start, step, merge = f.start, f.step, f.merge
        names = [x.strip().split()[0] for x in f.kinds.split(",")]
        rows = trace if f.rows is None else trace.where(f.rows)
        kinds = dict(rows.dtypes)[order]
        dealt = rows.withColumn("_chunk", F.floor(F.col(order) / width).cast("long")).repartition("_chunk").sortWithinPartitions("_chunk", order)

        def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            chunk, state = None, None
            for pdf in batches:
                for row in pdf.astype(object).to_dict("records"):
                    if (at := row.pop("_chunk")) != chunk:
                        if chunk is not None:
                            yield pd.DataFrame({"_chunk": [chunk], "_state": [cloudpickle.dumps(state)]})
                        chunk, state = at, start()
                    state, _ = step(state, row)
            if chunk is not None:
                yield pd.DataFrame({"_chunk": [chunk], "_state": [cloudpickle.dumps(state)]})

        def carried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state = start()
            for pdf in batches:
                before = []
                for own in pdf["_state"]:
                    before.append(cloudpickle.dumps(state))
                    state = merge(state, cloudpickle.loads(bytes(own)))
                yield pdf.assign(_state=before)

        def replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            chunk, state = None, None
            for pdf in batches:
                out = []
                for row in pdf.astype(object).to_dict("records"):
                    at, begin = row.pop("_chunk"), row.pop("_state")
                    if at != chunk:
                        chunk, state = at, cloudpickle.loads(bytes(begin))
                    state, made = step(state, row)
                    out += made
                yield pd.DataFrame(out, columns=names, dtype=object)

        if kinds not in ("bigint", "int", "smallint", "tinyint"):
            raise ValueError(f"{order} has to be a whole number")
        summaries = written(dealt.mapInPandas(told, "_chunk long, _state binary"))
        begins = written(summaries.coalesce(1).sortWithinPartitions("_chunk").mapInPandas(carried, "_chunk long, _state binary"))
        entered = dealt.join(begins, "_chunk").repartition("_chunk").sortWithinPartitions("_chunk", order)
        return entered.mapInPandas(replayed, f.kinds)
