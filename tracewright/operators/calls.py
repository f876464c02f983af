"""The calls of a trace, without reading it in one sequence.

Whether an eret ends the last exception, and whether a system call is open, are
running aggregates.  After that an event pushes a call, is a return that closes the
call on top if that fits, or unwinds to the latest system call.

A chunk of events is folded on a stack of its own.  Calls that end within the chunk
are done.  What is left, the returns and unwindings that meet an empty stack and
the calls still open, in order, does to the stack outside what the whole chunk does.
So the chunks' remainders are a shorter trace, which is folded in wider chunks, and
so on; the rounds grow with the logarithm of the number of chunks, and one task sees
only what no chunk could settle.

A call whose caller lies outside its chunk names a place on the stack outside, one
for all calls between two returns that reach out; the place goes along with the
remainder until a wider chunk, or the last fold, knows what is there.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import CALL, SYSCALL
from .scan import running
from .storage import BROADCAST_ROWS, dropped, written

FRAMES = "call long, parent long, op int, address long, t_call long, addr_call long, t_return long, addr_return long, closed long, depth int"
#: One row of a fold: a finished frame (`base`: the place that its depth counts from), a place found, or an event that is left.
_ROW = f"what string, {FRAMES}, base long, idx long, kind string, time long, pc long, target long, expected long, within boolean"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def steps(events: DataFrame, width: int) -> DataFrame:
    """(idx, time, kind, pc, target, expected, within, chunk) of `call_events`: what acts on the stack, dealt to chunks; an eret is `unwind` if it ends a system call's exception.

    Running aggregates see exceptions and erets only.  Whether a system call is open
    is told in each chunk, and by a row a chunk of what was before it.
    """
    is_eret = F.col("kind") == "eret"
    names = ["idx", "time", "kind", "pc", "target", "expected"]
    # exceptions open: up with one that is raised, down with an eret, never below zero
    some = running(events.where(is_eret | F.col("raised")), [], ["idx"], _sum=("sum", F.col("raised").cast("long") - is_eret.cast("long"), False))
    some = some.withColumn("_sum", F.coalesce("_sum", F.lit(0)))
    some = running(some, [], ["idx"], _least=("min", F.when(is_eret, F.col("_sum") - 1), False))
    ends = is_eret & (F.col("_sum") - F.least(F.lit(0), F.coalesce("_least", F.lit(0))) == 1) & ~F.col("raised")
    rows = events.where(F.col("kind").isin("call", "syscall", "return")).unionByName(some.where(ends).select(*events.columns))
    flag = F.when(F.col("kind") == "syscall", True).when(is_eret, False)
    rows = rows.select(*names, flag.alias("_flag"), F.floor(F.col("idx") / width).cast("long").alias("chunk"))
    before = running(rows.groupBy("chunk").agg(F.max_by("_flag", F.when(F.col("_flag").isNotNull(), F.col("idx"))).alias("_flag")), [], ["chunk"], _before=("last", F.col("_flag"), False))
    before = written(before.select("chunk", "_before"))
    before = F.broadcast(before) if before.count() <= BROADCAST_ROWS else before
    own = F.last("_flag", ignorenulls=True).over(W.partitionBy("chunk").orderBy("idx").rowsBetween(W.unboundedPreceding, -1))
    told = rows.join(before, "chunk").repartition("chunk").withColumn("within", F.coalesce(own, "_before", F.lit(False)))
    kind = F.when(~is_eret, F.col("kind")).when(F.col("within"), "unwind")
    return told.withColumn("kind", kind).where("kind is not null").select(*names, "within", "chunk")


def _number(x):
    return None if x is None or x != x else int(x)


class _Place:
    """Where the calls of a chunk stand that have no caller in it."""

    def __init__(self, idx: int):
        self.idx, self.used = idx, False


#: Rows of output that a fold gathers.
_BATCH = 10_000
_TIME, _PC, _TARGET, _EXPECTED, _IS_SYSCALL, _WITHIN = 1, 2, 4, 8, 16, 32


class _Fold:
    """A stack of calls as columns of numbers (about 41 bytes a call); all of them have one place, and a call's caller is the one below it.  The last fold has a root below all."""

    def __init__(self, last: bool, out: list):
        self.last, self.out, self.place, self.roots = last, out, None, 1
        self.call, self.time, self.pc, self.target, self.expected = (array("q") for _ in range(5))
        self.flags = array("B")

    def _emit(self, what: str, **x) -> None:
        self.out.append([what, *(x.get(c) for c in _NAMES[1:])])

    def _left(self, r) -> None:
        self._emit("event", idx=r[0], kind=r[2], time=_number(r[1]), pc=_number(r[3]), target=_number(r[4]), expected=_number(r[5]), within=r[6])

    def _held(self, i: int) -> tuple:
        """(call, kind, time, pc, target, expected, within) of a call on the stack."""
        f = self.flags[i]
        return self.call[i], "syscall" if f & _IS_SYSCALL else "call", *(x[i] if f & bit else None for x, bit in ((self.time, _TIME), (self.pc, _PC), (self.target, _TARGET), (self.expected, _EXPECTED))), bool(f & _WITHIN)

    def _caller(self, i: int):
        return self.call[i - 1] if i else -self.roots if self.last else None

    def _frame(self, i: int, **end) -> None:
        call, kind, time, pc, target, _, _ = self._held(i)
        if self.place:
            self.place.used = True
        self._emit("frame", call=call, parent=self._caller(i), base=self.place.idx if self.place else None, depth=i + self.last, op=SYSCALL if kind == "syscall" else CALL, address=target, t_call=time, addr_call=pc, **end)

    def _close(self, r) -> int:
        end = dict(t_return=_number(r[1]), addr_return=_number(r[3]), closed=int(r[0]))
        if not self.call:  # what closes the root makes a new one above it
            self.roots += 1
            self._emit("frame", call=1 - self.roots, parent=-self.roots, depth=0, op=0, **end)
            return 0
        i = len(self.call) - 1
        self._frame(i, **end)
        op = SYSCALL if self.flags[i] & _IS_SYSCALL else CALL
        for x in (self.call, self.time, self.pc, self.target, self.expected, self.flags):
            x.pop()
        return op

    def _reached(self) -> None:
        """Something outside has changed, so that what follows stands elsewhere."""
        if self.place and self.place.used:
            self._emit("event", idx=self.place.idx, kind="place", within=False)
        self.place = None

    def _here(self, idx: int) -> _Place:
        self.place = self.place or _Place(idx)
        return self.place

    def step(self, r) -> None:
        """What a row other than an unwinding does."""
        idx, kind = int(r[0]), r[2]
        if kind == "place":
            here = None if self.last else self._here(idx) if not self.call else self.place
            if here:
                here.used = True
            self._emit("place", idx=idx, parent=self._caller(len(self.call)), base=here.idx if here else None, depth=len(self.call) + self.last)
        elif kind in ("call", "syscall"):
            if not self.call and not self.last:
                self._here(idx)
            flags = (kind == "syscall") * _IS_SYSCALL | bool(r[6]) * _WITHIN
            for x, bit, y in ((self.time, _TIME, r[1]), (self.pc, _PC, r[3]), (self.target, _TARGET, r[4]), (self.expected, _EXPECTED, r[5])):
                y = _number(y)
                x.append(0 if y is None else y)
                flags |= bit * (y is not None)
            self.call.append(idx)
            self.flags.append(flags)
        elif not self.call and not self.last:
            self._reached()
            self._left(r)
        else:
            expected = self.expected[-1] if self.call and self.flags[-1] & _EXPECTED else None
            if (not r[6]) if expected is None else expected == _number(r[4]):
                self._close(r)

    def unwind(self, r) -> Iterator[None]:
        """Closes all up to the latest system call; stops where the output is a batch."""
        ended = False
        while self.call and not ended:
            ended = self._close(r) == SYSCALL
            if len(self.out) >= _BATCH:
                yield
        if not ended and self.last:
            self._close(r)
        elif not ended:
            self._reached()
            self._left(r)

    def end(self) -> Iterator[None]:
        """What is still on the stack; stops where the output is a batch."""
        self._reached()
        if self.last:
            self._emit("frame", call=-self.roots, depth=0, op=0)
        for i in range(len(self.call)):
            if self.last:
                self._frame(i)
            else:
                call, kind, *rest = self._held(i)
                self._left((call, rest[0], kind, *rest[1:]))
            if len(self.out) >= _BATCH:
                yield


def _folded(rows: DataFrame, width: int | None, dealt: bool = False) -> DataFrame:
    """Rows of _ROW: the events folded in chunks of `width` places, or all of them to the end.  dealt: they have their chunks, each in one task."""
    chunk = F.lit(0) if width is None else F.col("chunk") if dealt else F.floor(F.col("idx") / width).cast("long")
    events = rows.select("idx", "time", "kind", "pc", "target", "expected", "within", chunk.alias("chunk"))
    order = ["chunk", "idx", F.col("kind") != "place"]
    events = events.coalesce(1) if width is None else events if dealt else events.repartition("chunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list = []
        chunk, fold = None, _Fold(True, out) if width is None else None

        def made() -> pd.DataFrame:
            df = pd.DataFrame(out, columns=_NAMES, dtype=object)
            out.clear()
            return df

        for pdf in batches:
            for r in pdf.astype(object).itertuples(index=False, name=None):
                if width is not None and r[7] != chunk:
                    for _ in fold.end() if fold else ():
                        yield made()
                    chunk, fold = r[7], _Fold(False, out)
                if r[2] == "unwind":
                    for _ in fold.unwind(r):
                        yield made()
                else:
                    fold.step(r)
            yield made()
        for _ in fold.end() if fold else ():
            yield made()
        yield made()

    return events.sortWithinPartitions(*order).mapInPandas(run, _ROW)


def call_graph(events: DataFrame, width: int = 1_000_000, fan: int = 64) -> DataFrame:
    """Rows of FRAMES: every call (named by its row) with its caller and its return; op 0 marks roots, which are below 0.

    A return closes the latest call if it goes where that expects, and no open
    system call is on top.  An eret that ends the last exception closes all up to
    the latest system call.  What closes the root makes a new root above it.  depth
    counts the calls below on the stack; a root has 0.
    """
    names = ["idx", "time", "kind", "pc", "target", "expected"]
    events = written(events.select(*names, F.coalesce("raised", F.lit(False)).alias("raised")))
    left, span = steps(events, width), events.agg(F.min("idx").alias("a"), F.max("idx").alias("b")).first()
    rounds: list[DataFrame] = []
    while span["a"] is not None and span["a"] // width != span["b"] // width:
        folded = written(_folded(left, width, not rounds))
        if not rounds:
            dropped(events)
        rounds.append(folded)
        left = folded.where("what = 'event'")
        width *= fan
    last = written(_folded(left if rounds else written(left), None))
    names, place = [x.split()[0] for x in FRAMES.split(", ")], [F.col("parent").alias("_parent"), F.col("depth").alias("_depth")]
    found, places = last.where("what = 'frame'").select(*names), last.where("what = 'place'").select(F.col("idx").alias("base"), *place)
    for folded in reversed(rounds):
        # a place for each stretch of calls between returns that reach out of their chunk: mostly few
        places = written(places)
        places = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
        known = folded.where("what <> 'event'").join(places, "base", "left").withColumn("parent", F.coalesce("parent", "_parent")).withColumn("depth", (F.col("depth") + F.coalesce("_depth", F.lit(0))).cast("int"))
        found = found.unionByName(known.where("what = 'frame'").select(*names))
        places = known.where("what = 'place'").select(F.col("idx").alias("base"), *place)
    return found
