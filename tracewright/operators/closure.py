"""Closures over edges, chains of ancestors, trees, and matched brackets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import running
from .storage import dropped, to_join
from .storage import written as _written


def descendants(edges: DataFrame, seeds: DataFrame, carry: list[str] | None = None, src: str = "src", dst: str = "dst", key: str = "id", forest: bool = False) -> DataFrame:
    """(id, carry..., depth): everything reachable from the seeds, once for each carried value, at its least depth.

    Set-based breadth first: each round meets the edges with the new ids only.  In a
    forest, where no two edges have one target, rounds grow with the logarithm of the
    depth: see `descendants_in_forest`.
    """
    carry = carry or []
    if forest:
        return descendants_in_forest(edges.select(F.col(dst).alias(key), F.col(src).alias("parent")), seeds, carry, key)
    links = edges.select(F.col(src).alias(key), F.col(dst).alias("_next"))
    front = _written(seeds.select(key, *carry).distinct().withColumn("depth", F.lit(0)))
    found, depth = front, 0
    while True:
        depth += 1
        step = front.join(links, key).select(F.col("_next").alias(key), *carry).distinct().join(found.select(key, *carry), [key, *carry], "left_anti")
        front = _written(step.withColumn("depth", F.lit(depth)))
        if not front.take(1):
            dropped(front)
            return found
        found = found.unionByName(front)


def descendants_in_forest(parents: DataFrame, seeds: DataFrame, carry: list[str], key: str = "id") -> DataFrame:
    """`descendants` by the nearest seed at or above each vertex, and the seeds above that one, both by doubling.

    parents: (id, parent), a row per vertex that has a parent.
    """
    own = seeds.select(key, *carry).distinct()
    marks = own.select(key, F.col(key).alias("_seed")).distinct()
    near = _written(nearest_marked(parents, marks, key, "_seed", "_far"))
    # from each seed to the next one above it, then to all above it
    up = parents.join(marks.select(key), key, "left_semi").join(near.select(F.col(key).alias("parent"), F.col("_seed").alias("_above"), "_far"), "parent")
    reach = _written(up.select(F.col(key).alias("_seed"), "_above", (F.col("_far") + 1).alias("_up"), F.lit(1).cast("long").alias("_hops")))
    hops = 1
    while reach.where(F.col("_hops") == hops).take(1):
        on = reach.select(F.col("_seed").alias("_above"), F.col("_above").alias("_next"), F.col("_up").alias("_u"), F.col("_hops").alias("_h"))
        more = reach.where(F.col("_hops") == hops).join(on, "_above").select("_seed", F.col("_next").alias("_above"), (F.col("_up") + F.col("_u")).alias("_up"), (F.col("_hops") + F.col("_h")).alias("_hops"))
        following = _written(reach.unionByName(more))
        dropped(reach)
        reach, hops = following, hops * 2
    each = reach.select("_seed", "_above", "_up").unionByName(marks.select("_seed", F.col("_seed").alias("_above"), F.lit(0).cast("long").alias("_up")))
    met = near.join(each, "_seed").select(key, "_above", (F.col("_far") + F.col("_up")).alias("_depth"))
    carried = own.select(F.col(key).alias("_above"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    out = met.join(carried, "_above").groupBy(key, *[f"_c{i}" for i in range(len(carry))]).agg(F.min("_depth").cast("int").alias("depth"))
    return out.select(key, *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "depth")


def _outer(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join on `key`; the many rows of `left` where that is null are spread over tasks."""
    spread = F.when(F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(4096))).otherwise(0)
    # 0 as well, but nothing that the optimizer would take out of the join
    return left.withColumn("_turn", spread).join(right.withColumn("_turn", F.pmod(F.xxhash64(key), F.lit(1).cast("long"))), [key, "_turn"], "left").drop("_turn")


#: So many times as far a vertex of `preorder` looks up after each round.
_LOOK = 4


def _ahead(state: DataFrame, parts: list[str]) -> DataFrame:
    """A row of `state` (v, jump, parts...) with the places `jump1`, `jump2`, ... and their parts, and `jump{_LOOK}`, how far the next round begins."""
    out = state.withColumnRenamed("jump", "jump1")
    up = to_join(state).select("v", "jump", *parts)
    for i in range(1, _LOOK):
        out = _outer(out, up.select(F.col("v").alias(f"jump{i}"), F.col("jump").alias(f"jump{i + 1}"), *[F.col(c).alias(f"{c}{i}") for c in parts]), f"jump{i}")
    return out


def preorder(parents: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """(id, depth, enter, leave) of each vertex of a forest: its place in pre-order, and that of the last vertex below it.

    parents: a row per vertex; a root's parent is null.  Roots and children follow
    in the order of their ids.  Below a vertex is what has a place from its own to
    its `leave`, so descendants are a range.  First every vertex is counted for all
    above it, then its place is the sum of what precedes it and each vertex above it
    among their siblings.  Both go up by doubling: rounds grow with the logarithm of
    the depth.  A cycle is an error.
    """
    state = _written(parents.select(F.col(key).alias("v"), F.col(parent).alias("p"), F.col(parent).alias("jump"), F.lit(1).cast("long").alias("n")))
    total, rounds, far = state.count(), 0, 1
    while state.where("jump is not null").take(1):
        if far > total:  # no path has more vertices than there are
            raise ValueError("the parents form a cycle")
        seen = _ahead(state.select("v", "jump", "n"), [])
        # n are the vertices less than `far` below; those of the next stretches follow
        more = seen.select(F.explode(F.array(*[f"jump{i}" for i in range(1, _LOOK)])).alias("v"), "n").where("v is not null").groupBy("v").agg(F.sum("n").alias("_more"))
        following = _written(seen.select("v", F.col(f"jump{_LOOK}").alias("jump"), "n").join(more, "v", "left").join(state.select("v", "p"), "v").select("v", "p", "jump", (F.col("n") + F.coalesce("_more", F.lit(0))).alias("n")))
        dropped(state)
        state, rounds, far = following, rounds + 1, far * _LOOK
    if (state.where("p is null").agg(F.sum("n")).first()[0] or 0) != total:
        raise ValueError("a parent is no vertex")
    own = running(state.select("v", "p", "n"), ["p"], ["v"], before=("sum", F.col("n"), False))
    deep = F.col("p").isNotNull().cast("long")
    sums = own.select("v", F.col("p").alias("jump"), "n", (F.coalesce("before", F.lit(0)) + deep).alias("enter"), deep.alias("depth"))
    for _ in range(rounds):
        sums = _written(sums)
        seen = _ahead(sums, ["enter", "depth"])
        along = lambda c: F.col(c) + sum((F.coalesce(f"{c}{i}", F.lit(0)) for i in range(1, _LOOK)), F.lit(0))
        sums = seen.select("v", F.col(f"jump{_LOOK}").alias("jump"), "n", along("enter").alias("enter"), along("depth").alias("depth"))
    return sums.select(F.col("v").alias(key), F.col("depth").cast("int").alias("depth"), "enter", (F.col("enter") + F.col("n") - 1).alias("leave"))


def roots_by_doubling(parents: DataFrame, key: str = "id", parent: str = "parent") -> DataFrame:
    """(id, root, depth) of each vertex of a forest; a root's parent is null.  Rounds grow with the logarithm of the depth; a cycle is an error."""
    state = _written(parents.select(key, F.coalesce(parent, key).alias("root"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth"), F.lit(True).alias("moved")))
    for _ in range(state.count().bit_length() + 1):  # no path has more vertices than there are
        up = state.select(F.col(key).alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        step = state.join(up, "root", "left").select(key, F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce(F.col("_depth") > 0, F.lit(False)).alias("moved"))
        following = _written(step)
        dropped(state)
        state = following
        if not state.where("moved").take(1):
            return state.drop("moved")
    raise ValueError("the parents form a cycle")


def nearest_marked(parents: DataFrame, marks: DataFrame, key: str = "vid", mark: str = "mark", distance: str | None = None) -> DataFrame:
    """(vid, mark) of all vertices of a forest at or below a marked one: the mark of the nearest; with `distance`, how far up it is.

    parents: (vid, parent), a row per vertex that has a parent.  Each round doubles how far up
    a vertex has looked, so rounds grow with the logarithm of the depth; a cycle is an error.
    """
    every = parents.select(key, F.col("parent").alias("jump")).unionByName(parents.select(F.col("parent").alias(key)).unionByName(marks.select(key)).distinct().withColumn("jump", F.lit(None).cast(parents.schema["parent"].dataType)))
    state = every.groupBy(key).agg(F.max("jump").alias("jump")).join(marks.groupBy(key).agg(F.min(mark).alias(mark)), key, "left")
    # a vertex that has its mark looks no further
    found = F.col(mark).isNotNull()
    state = _written(state.select(key, mark, F.when(~found, F.col("jump")).alias("jump"), F.when(found, 0).otherwise(1).cast("long").alias("_steps")))
    rounds = state.count().bit_length() + 1  # no path has more vertices than there are
    while state.where("jump is not null").take(1):
        rounds -= 1
        if rounds < 0:
            raise ValueError("the parents form a cycle")
        up = to_join(state).select(F.col(key).alias("jump"), F.col("jump").alias("_jump"), F.col(mark).alias("_mark"), F.col("_steps").alias("_more"))
        before = state
        # every jump leads to a row, and what looks no further stays out of the join, where a null would be one key
        looked = state.where("jump is not null").join(up, "jump").select(key, F.col("_mark").alias(mark), F.when(F.col("_mark").isNull(), F.col("_jump")).alias("jump"), (F.col("_steps") + F.col("_more")).alias("_steps"))
        state = _written(state.where("jump is null").unionByName(looked))
        dropped(before)
    return state.where(F.col(mark).isNotNull()).select(key, mark, *([F.col("_steps").alias(distance)] if distance else []))


def ancestors(edges: DataFrame, start: DataFrame, src: str = "src", dst: str = "dst", key: str = "id") -> DataFrame:
    """(start, id, depth): the chain above each start, nearest first at depth 1."""
    return descendants(edges.select(F.col(dst).alias("src"), F.col(src).alias("dst")), start.withColumn("start", F.col(key)), ["start"], "src", "dst", key)


def roots(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Vertices that no edge enters."""
    return edges.select(F.col(src).alias("id")).distinct().join(edges.select(F.col(dst).alias("id")), "id", "left_anti")


def tree(edges: DataFrame, seeds: DataFrame, key: str = "id") -> DataFrame:
    """(id, depth, path): the vertices below the seeds; ordered by path they are in pre-order."""
    links = edges.select(F.col("src").alias(key), F.col("dst").alias("_next"))
    front = _written(seeds.select(key).distinct().withColumn("depth", F.lit(0)).withColumn("path", F.array(key)))
    found = front
    while True:
        front = _written(front.join(links, key).where(~F.array_contains("path", F.col("_next"))).select(F.col("_next").alias(key), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("_next")).alias("path")))
        if not front.take(1):
            return found
        found = found.unionByName(front)


def neighbours(vertices: DataFrame, edges: DataFrame, direction: str = "out", key: str = "vid") -> DataFrame:
    """(vid, other, op): what edges lead to, or where they come from."""
    own, other = ("src", "dst") if direction == "out" else ("dst", "src")
    return vertices.select(key).join(edges.select(F.col(own).alias(key), F.col(other).alias("other"), "op"), key)


def first_parent(edges: DataFrame, order: str = "eid") -> DataFrame:
    """(vid, parent): the source of the first edge into each vertex."""
    return edges.groupBy(F.col("dst").alias("vid")).agg(F.min_by("src", order).alias("parent"))


def match_brackets(df: DataFrame, by: list[str], order: list[str], opens: str, closes: str, expected: str | None = None, actual: str | None = None) -> DataFrame:
    """(by..., opened, closed, depth): each opening row with the row that closes it, or null.

    With `expected` and `actual`, a closing row takes the top only if its actual
    value is what that opening row expects; else it closes nothing.  Only the
    opening and closing rows of a stream are read, in order, one batch at a time.
    """
    picks = [*by, *order[-1:], opens, closes] + ([expected, actual] if expected else [])
    rows = df.where(F.col(opens) | F.col(closes)).select(*dict.fromkeys([*by, *order, *picks]))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    k = kinds[order[-1]]
    dealt = rows.repartition(*by).sortWithinPartitions(*by, *order) if by else rows.coalesce(1).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, stack, out = None, [], []

        def flush() -> list[tuple]:
            nonlocal stack
            left = [(*key, at, None, depth) for depth, (at, _) in enumerate(stack)] if key is not None else []
            stack = []
            return left

        for pdf in batches:
            for row in pdf.to_dict("records"):
                own = tuple(row[c] for c in by)
                if own != key:
                    out += flush()
                    key = own
                if row[closes] and stack and (not expected or stack[-1][1] == row[actual]):
                    at, _ = stack.pop()
                    out.append((*key, at, row[order[-1]], len(stack)))
                if row[opens]:
                    stack.append((row[order[-1]], row[expected] if expected else None))
            yield pd.DataFrame(out, columns=[*by, "opened", "closed", "depth"]).astype({"closed": "object"})
            out = []
        yield pd.DataFrame(flush(), columns=[*by, "opened", "closed", "depth"]).astype({"closed": "object"})

    return dealt.mapInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], f"opened {k}, closed {k}, depth int"]))
