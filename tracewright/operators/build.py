"""From a trace to the graph of its pointers and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trace as T
from .closure import _written
from .graph import RETURN, VISIBLE, Graph
from .lookup import as_of_chunked
from .provenance import Provenance, provenance

#: The ids of calls lie below those of all pointers.
CALLS = -(1 << 62)


def _seen(frames: DataFrame, at: str, time: str, op: int, pointers: Provenance, values: DataFrame, chunk: float) -> DataFrame:
    """Edges to each call from the pointers in valid registers at a moment: one for each pointer and offset, with its registers."""
    moments = frames.where(F.col(at).isNotNull()).select("call", F.col(at).alias("idx"), F.col(time).alias("time"))
    spans = pointers.registers.withColumn("offset", F.lit(None).cast("long"))
    held = T.visible_pointers(moments, spans, chunk=chunk).select("call", "vid", F.explode("regs").alias("reg"))
    asked = held.join(moments, "call").withColumn("on", F.col("idx").cast("double"))
    known = as_of_chunked(asked, values, ["reg"], "on", ["offset", "valid"], chunk).where("valid")
    grouped = known.groupBy("call", "vid", "offset", "time").agg(F.sort_array(F.collect_set("reg")).alias("regs"))  # at most a row per register
    return grouped.select(F.col("vid").alias("src"), "call", F.lit(op).alias("op"), "time", F.col("offset").alias("addr"), "regs")


def trace_to_graph(trace: DataFrame, exact_bounds: bool = False, chunk_rows: int = 1_000_000) -> Graph:
    """The graph of a trace (rows of `trace.TRACE`): pointers, their events, calls, and edges of all kinds.

    Calls have ids from `CALLS` on.  Empty tables give an empty graph with one root call.
    """
    pointers = provenance(T.micro_ops(trace, exact_bounds), chunk_rows)
    frames = _written(T.call_graph(T.call_events(trace)))
    chunk = float(chunk_rows)
    number = lambda c: F.lit(CALLS) + F.col(c)
    values = trace.where("reg_num >= 64").select((F.col("reg_num") - 64).cast("int").alias("reg"), F.col("idx").cast("double").alias("on"), F.col("cap.offset").alias("offset"), F.coalesce("cap.valid", F.lit(False)).alias("valid"))
    # a call is named by the row that makes it
    seen = _seen(frames.where("op <> 0").withColumn("opened", F.col("call")), "opened", "t_call", VISIBLE, pointers, values, chunk)
    back = _seen(frames.where("closed is not null"), "closed", "t_return", RETURN, pointers, values, chunk)
    sizes = T.frame_sizes(trace).withColumnRenamed("pc", "address")
    base = _frame_bases(trace, frames, chunk)
    calls = frames.join(sizes, "address", "left").join(base, "call", "left").select(number("call").alias("vid"), "address", F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("symbol_file"), "t_return", "addr_return", F.coalesce("frame_base", F.lit(0)).alias("frame_base"), F.coalesce("frame_size", F.lit(0)).alias("frame_size"))
    none = F.lit(None)
    no_regs = none.cast("array<int>")
    made = frames.where("parent is not null").select(number("parent").alias("src"), number("call").alias("dst"), F.when(F.col("op") == 0, 1).otherwise(F.col("op")).alias("op"), F.coalesce("t_call", F.lit(0)).alias("time"), F.coalesce("addr_call", F.lit(0)).alias("addr"), no_regs.alias("regs"))
    derived = pointers.edges.where("src is not null").select("src", "dst", F.lit(0).alias("op"), none.cast("long").alias("time"), none.cast("long").alias("addr"), no_regs.alias("regs"))
    linked = seen.unionByName(back).select("src", number("call").alias("dst"), "op", "time", "addr", "regs")
    edges = derived.unionByName(made).unionByName(linked).withColumn("eid", F.monotonically_increasing_id())
    return Graph(pointers.vertices, pointers.events.select("vid", "time", "addr", "type"), calls, edges.select("eid", "src", "dst", "op", "time", "addr", "regs"))


def _frame_bases(trace: DataFrame, frames: DataFrame, chunk: float) -> DataFrame:
    """(call, frame_base): the stack capability's address plus the stack pointer at each call, where both are known."""
    at = frames.where("op <> 0").select("call", F.col("call").cast("double").alias("on"))
    stack = trace.where(F.col("reg_num") == 64 + T.STACK_CAP).select(F.col("idx").cast("double").alias("on"), (F.col("cap.base") + F.col("cap.offset")).alias("_cap"))
    pointer = trace.where("reg_num = 29").select(F.col("idx").cast("double").alias("on"), F.col("gpr_val").alias("_sp"))
    both = as_of_chunked(as_of_chunked(at, stack, [], "on", ["_cap"], chunk), pointer, [], "on", ["_sp"], chunk)
    return both.select("call", (F.col("_cap") + F.col("_sp")).alias("frame_base")).where("frame_base is not null")
