"""Trie of the conversations' common beginnings, merged family by family.

A conversation c is rebuilt from the first h turns of its base (c - c % 5) and its
own turns after its first h; the five conversations of a base are a family.

1. Texts become two 64-bit hashes of role and text and a length.  From here on no
   text travels.
2. Base conversations and the others are cogrouped by cells of whole families; a
   task rebuilds its families and builds their small tries: a row for each node of
   a family, with its members.  A node's key is its depth and the exclusive or, in
   two lanes of 64 bits, of all its turns' hashes mixed with their depths.
3. Only these combined nodes are shuffled.  Merged by key they give members,
   children and parents.
4. Every node is owned by its least member.  What a conversation owns is the end of
   its path, so its owned nodes' savings and leaves are one row, which a family's
   nodes above take in.  So sums over subtrees take one more merge of the family
   nodes, however deep the trie is.
5. Ids of a node's ends are joined in ranges, and the ranges hashed in order.

A conversation of more than 4,096 turns goes in parts of so many turns, numbered by
ranges: since the keys are exclusive ors, what lies before a part is one row.  A
SHA-256 goes through its bytes in order, so the last step of one node's digest is a
stream in one task, of strings of 1,024 ids.

Turns of one number follow by the hash of role and text; repeated rows are turns of
their own.  Null conv_ids are no conversation.  An empty table gives an empty one.
Ids below zero take the base that the sign of % gives in Spark.  Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.operators.lookup import with_running_sum

from .common import Scratch, read, smaller_side
from .op12_sharding import with_slot

FAMILY, HEADS = 5, 9
#: Turns of one part of a conversation, and about as many turns in a cell of families.
PART, CELL = 4096, 20_000
#: Ids in one string of a node's ends.
JOINED = 1024
KEY = ["depth", "p1", "p2"]
NODES = "base long, depth long, p1 long, p2 long, q1 long, q2 long, bytes long, convs array<long>, ends array<long>"
EMPTY = hashlib.sha256(b"").hexdigest()


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """(conv, base, h, turn, a, b, bytes): turns without their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    conv = F.col("conv_id").cast("long")
    out = conversations.where(conv.isNotNull()).select(
        conv.alias("conv"), (conv - conv % FAMILY).alias("base"), (F.crc32(conv.cast("string").cast("binary")) % HEADS).alias("h"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"), F.octet_length(text).cast("long").alias("bytes"),
    )
    return out


def _mixed(x: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """64-bit hashes mixed with depths (a finaliser in multiplications and shifts)."""
    z = x.astype(np.uint64) + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))).astype(np.int64)


def _mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        depth = batch.column("depth").to_numpy()
        lanes = [pa.array(_mixed(batch.column(c).to_numpy(), depth)) for c in ("a", "b")]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), *lanes], ["conv", "part", "x1", "x2"])


def in_parts(turns: DataFrame, scratch: Scratch, size: int = PART) -> DataFrame:
    """Adds part, last (the conversation has no later part), shift (from place to rebuilt depth) and c1, c2 (what the key is before the part); the last three for later parts alone."""
    plain = {"part": F.lit(0).cast("long"), "last": F.lit(True), "shift": F.lit(None).cast("long"), "c1": F.lit(0).cast("long"), "c2": F.lit(0).cast("long")}
    long = scratch.table(turns.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > size).select("conv", F.floor((F.col("n") - 1) / size).alias("parts")), "long")
    if not long.take(1):
        return turns.withColumns(plain)
    few = smaller_side(long)
    far = scratch.table(with_slot(turns.join(few, "conv"), scratch, ["turn", "a", "b"], "conv").withColumn("part", F.floor(F.col("slot") / size)), "far")
    near = turns.join(few, "conv", "left_anti")
    # the first turns of the long conversations' bases, which may be short or long themselves
    bases = far.select("base").distinct()
    first = F.row_number().over(W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "a", "b"))
    heads = near.where("conv = base").join(bases, "base", "left_semi").withColumn("depth", first).where(F.col("depth") < HEADS).select("base", F.col("depth").cast("long").alias("depth"), "a", "b")
    heads = scratch.table(heads.unionByName(far.where((F.col("conv") == F.col("base")) & (F.col("slot") < HEADS - 1)).select("base", (F.col("slot") + 1).alias("depth"), "a", "b")), "heads")
    known = smaller_side(scratch.table(heads.groupBy("base").agg(F.count("*").alias("n_heads")), "n_heads"))
    far = far.join(known, "base", "left").withColumn("shift", F.least("h", F.coalesce("n_heads", F.lit(0))) - F.col("h")).drop("n_heads")
    own = far.where("slot >= h").select("conv", "part", (F.col("slot") + 1 + F.col("shift")).alias("depth"), "a", "b")
    lent = far.where("slot = 0").select("conv", "base", "h").join(heads, "base").where("depth <= h").select("conv", F.lit(-1).cast("long").alias("part"), "depth", "a", "b")
    sums = own.unionByName(lent).mapInArrow(_mix, "conv long, part long, x1 long, x2 long").groupBy("conv", "part").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select("conv", "part", F.bit_xor("x1").over(before).alias("c1"), F.bit_xor("x2").over(before).alias("c2")).where("part > 0")
    later = far.where("part > 0").join(smaller_side(scratch.table(carry, "carry")), ["conv", "part"])
    names = [*turns.columns, *plain]
    start = far.where("part = 0").withColumns({**plain, "last": F.col("parts") == 0})
    later = later.withColumn("last", F.col("part") == F.col("parts"))
    return scratch.table(near.withColumns(plain).select(*names).unionByName(start.select(*names)).unionByName(later.select(*names)), "parts")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    n = len(columns[0])
    new = np.ones(n, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0) if n > 1 else False
    return np.flatnonzero(new)


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] numbers, then those of the next."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _families(size: int):
    def run(bases: pa.Table, others: pa.Table) -> pa.Table:
        both = pa.concat_tables([bases, others])
        get = lambda c: both.column(c).cast(pa.int64()).combine_chunks().fill_null(0).to_numpy()
        conv, part, turn, a, b = map(get, ("conv", "part", "turn", "a", "b"))
        some = both.column("turn").is_valid().combine_chunks().to_numpy(zero_copy_only=False)
        order = np.lexsort((b, a, turn, some, part, conv))
        conv, part, a, b = conv[order], part[order], a[order], b[order]
        base, h, octets, last, shift, c1, c2 = (get(c)[order] for c in ("base", "h", "bytes", "last", "shift", "c1", "c2"))
        first = _starts(conv, part)
        length = np.diff(np.append(first, len(conv)))
        run_of = np.repeat(np.arange(len(first)), length)
        place = part * size + np.arange(len(conv)) - first[run_of] + 1
        # what each first part takes from its family's base
        opens = part[first] == 0
        lends = opens & (conv[first] == base[first])
        lender, at = base[first][lends], np.searchsorted(base[first][lends], base[first])
        found = opens & (at < len(lender))
        found[found] = lender[at[found]] == base[first][found]
        lent = np.zeros(len(first), np.int64)
        lent[found] = np.minimum(h[first][found], np.minimum(length[lends][at[found]], HEADS - 1))
        moved = np.where(opens, lent - h[first], shift[first])
        own = np.flatnonzero(place > h)
        taken = _spans(first[lends][at[found]], lent[found])
        roots = np.flatnonzero(opens)
        zero = np.zeros(len(roots), np.int64)
        runs = np.concatenate([run_of[own], np.repeat(np.flatnonzero(found), lent[found]), roots])
        depth = np.concatenate([place[own] + moved[run_of[own]], _spans(np.ones(int(found.sum()), np.int64), lent[found]), zero])
        lanes = [np.concatenate([_mixed(x[own], depth[: len(own)]), _mixed(x[taken], depth[len(own) : len(own) + len(taken)]), zero]) for x in (a, b)]
        octets = np.concatenate([octets[own], octets[taken], zero])
        order = np.lexsort((depth, runs))
        runs, depth, octets = runs[order], depth[order], octets[order]
        begin = _starts(runs)
        n = np.diff(np.append(begin, len(runs)))
        keys, above = [], []
        for lane, carried in zip(lanes, (c1, c2), strict=True):
            lane = lane[order]
            until = np.bitwise_xor.accumulate(lane)
            p = until ^ np.repeat(np.where(begin > 0, until[begin - 1], 0) ^ carried[first][runs[begin]], n)
            keys.append(p)
            above.append(p ^ lane)
        ends = np.zeros(len(runs), bool)
        ends[begin + n - 1] = last[first][runs[begin]] > 0
        member, family = conv[first][runs], base[first][runs]
        order = np.lexsort((member, keys[1], keys[0], depth, family))
        node = _starts(family[order], depth[order], keys[0][order], keys[1][order])
        ending = np.append(0, np.cumsum(ends[order]))
        columns = [family, depth, *keys, *above, octets]
        lists = [
            pa.ListArray.from_arrays(pa.array(np.append(node, len(order)).astype(np.int32)), pa.array(member[order])),
            pa.ListArray.from_arrays(pa.array(ending[np.append(node, len(order))].astype(np.int32)), pa.array(member[order][ends[order]])),
        ]
        return pa.Table.from_arrays([*[pa.array(x[order][node].astype(np.int64)) for x in columns], *lists], [c.split()[0] for c in NODES.split(", ")])

    return run


def family_nodes(turns: DataFrame, scratch: Scratch, size: int = PART, cell: int = CELL) -> DataFrame:
    """A row for each node of each family's trie, with the members and those that end there; NODES."""
    cells = 1 + turns.count() // cell
    dealt = in_parts(turns, scratch, size).withColumn("cell", F.pmod(F.xxhash64("base", "part"), F.lit(cells)))
    bases, others = dealt.where("conv = base"), dealt.where("conv <> base")
    return bases.groupBy("cell").cogroup(others.groupBy("cell")).applyInArrow(_families(size), NODES)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, conv) to strings of ids (key, at, ids)."""
    for batch in batches:
        depth, p1, p2, conv = (batch.column(c).to_numpy() for c in (*KEY, "conv"))
        if not len(conv):
            continue
        first = _starts(depth, p1, p2)
        last = np.append(first[1:], len(conv))
        cut = [range(x, y, JOINED) for x, y in zip(first, last, strict=True)]
        at = np.fromiter((x for r in cut for x in r), np.int64)
        ids = conv.tolist()
        until = np.minimum(at + JOINED, np.repeat(last, [len(r) for r in cut]))
        text = pa.array([",".join(map(str, ids[x:y])) for x, y in zip(at.tolist(), until.tolist(), strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([*[pa.array(x[at]) for x in (depth, p1, p2, conv)], text], [*KEY, "at", "ids"])


def _sha256(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of ids in order to (key, digest)."""
    key, state, out = None, None, []

    def made() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*KEY, "digest"])

    for batch in batches:
        for *own, text in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if own == key:
                state.update(b",")
            else:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256()
            state.update(text.encode())
        yield made()
        out.clear()
    if key:
        out.append((*key, state.hexdigest()))
        yield made()


def end_digests(nodes: DataFrame) -> DataFrame:
    """(key, digest) of the nodes at which conversations end."""
    ends = nodes.select(*KEY, F.explode("ends").alias("conv"))
    joined = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(_joined, "depth long, p1 long, p2 long, at long, ids string")
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "at").mapInArrow(_sha256, "depth long, p1 long, p2 long, digest string")


def prefix_trie(conversations: DataFrame, size: int = PART, cell: int = CELL) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = scratch.table(hashed_turns(conversations), "turns")
    family = scratch.table(family_nodes(turns, scratch, size, cell), "families")
    merged = family.groupBy(*KEY).agg(F.sum(F.size("convs")).alias("n"), F.min(F.col("convs")[0]).alias("conv"), F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.first("bytes").alias("bytes"))
    merged = scratch.table(merged.withColumn("worth", (F.col("n") - 1) * F.col("bytes")), "merged")
    up = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    children = merged.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    parents = merged.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent"))
    nodes = scratch.table(merged.join(children, KEY, "left").join(parents, ["depth", "q1", "q2"], "left"), "nodes")
    owned = nodes.groupBy("conv").agg(F.sum("worth").alias("worth"), F.max(F.col("n_children").isNull().cast("long")).alias("leaf"))
    owned = owned.groupBy((F.col("conv") - F.col("conv") % FAMILY).alias("base")).agg(F.collect_list(F.struct("conv", "worth", "leaf")).alias("owned"))
    within = F.filter("owned", lambda x: F.array_contains("convs", x["conv"]))
    total = lambda c: F.aggregate(within, F.lit(0).cast("long"), lambda s, x: s + x[c])
    below = family.join(owned, "base").select(*KEY, total("worth").alias("worth"), total("leaf").alias("leaf")).groupBy(*KEY).agg(F.sum("worth").alias("below"), F.sum("leaf").alias("n_leaves"))
    placed = with_running_sum(nodes, ["conv"], "depth", "worth", "until", float(PART))
    # members other than the owner own nothing above; of the owner's own nodes those above the node don't count
    out = placed.join(below, KEY).join(end_digests(family), KEY, "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", (F.col("below") - F.col("until") + F.col("worth")).alias("saved_tokens"), F.coalesce("digest", F.lit(EMPTY)).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


ORACLE_SQL = """
with turns as (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from conversations where conv_id is not null),
convs as (select c, c - c % 5 as b, count(*) as n,
          xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(8 * length(c::varchar)), lambda i: (ascii(substr(c::varchar, 1 + i // 8, 1)) >> (i % 8)) & 1)),
          lambda s, y: case when xor(s, y) & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end)) % 9 as h from turns group by c),
rebuilt as (select k.c, t.pos as d, t.r, t.x from convs k join turns t on t.c = k.b and t.pos <= k.h
            union all select k.c, t.pos - k.h + least(k.h, coalesce(base.n, 0)), t.r, t.x from convs k join turns t on t.c = k.c and t.pos > k.h left join convs base on base.c = k.b),
paths as (select c, d, octet_length(encode(x)) as bytes, sha256(string_agg(sha256(r) || sha256(x), '') over (partition by c order by d)) as p from rebuilt union all select c, 0, 0, '' from convs),
steps as (select *, lag(p) over (partition by c order by d) as up, max(d) over (partition by c) as len from paths),
nodes as (select d, p, any_value(up) as up, min(c) as c, count(*) as n, any_value(bytes) as bytes, string_agg(c::varchar, ',' order by c) filter (where d = len) as ends from steps group by d, p),
kids as (select d - 1 as d, up as p, count(*) as n from nodes where d > 0 group by all),
full_nodes as (select n.*, coalesce(k.n, 0) as n_children from nodes n left join kids k using (d, p)),
sums as (select a.d, a.p, sum((u.n - 1) * u.bytes) as saved, count(*) filter (where u.n_children = 0) as leaves from full_nodes u join steps a on a.c = u.c and a.d <= u.d group by a.d, a.p)
select n.c as conv_id, n.d as depth, parent.c as parent_conv_id, n.n as n_convs, n.n_children, s.leaves as n_leaves, s.saved::bigint as saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from full_nodes n join sums s using (d, p) left join nodes parent on parent.d = n.d - 1 and parent.p = n.up
"""
