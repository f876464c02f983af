"""Sharding by a hierarchical weighted hash tree: a key descends region, rack and shard by weighted draws.

At each level every child draws for the key: an exponential variate of a hash of
the key and the child's path, at the rate of the child's weight, the sum of the
weights below it.  The least draw wins, so a child is chosen in proportion to its
weight, and a child whose weight didn't change keeps its draw.  So

- a key moves only into children whose weight grew, or out of such whose weight
  fell, and in a subtree without a change nothing moves;
- a shard that comes as a region of its own (`grown`) changes no other weight:
  rows move into it alone.

A row's shard needs nothing but its key and the tree, a small setting that goes
along with the plan.  Places within a shard (`slot`) are numbered by partition:
each partition numbers its own rows, and a table with a row per partition and
shard says where they start; so no shard is one task.

Null keys are one key, unlike any other; null texts have size 16 and the checksum
of nothing.  Rows that repeat a key lie in one shard, each with a slot of its own;
equal texts are dealt by their keys as all others.  Children of weight 0 are never
chosen.  An empty table gives an empty one.  Columns of the table that bear the
names of new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, read, smaller_side

SHARDS, SHARDS_PER_RACK, RACKS_PER_REGION = 40, 4, 2
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


class Shard(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def balanced(n: int) -> list[Shard]:
    """n shards of equal weight, by fours in racks, by two racks in regions."""
    return [Shard(s // (SHARDS_PER_RACK * RACKS_PER_REGION), s // SHARDS_PER_RACK, s) for s in range(n)]


def grown(tree: Iterable[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region and rack of its own."""
    tree = list(tree)
    following = [1 + max((x[level] for x in tree), default=-1) for level in range(3)]
    return [*tree, Shard(*following, weight)]


def _children(tree: list[Shard], level: int) -> dict[str, list[tuple[str, int, float]]]:
    """For each inner vertex's path its children of some weight: (path, number, weight)."""
    weights: dict[tuple[int, ...], float] = {}
    for x in tree:
        weights[x[: level + 1]] = weights.get(x[: level + 1], 0.0) + x.weight
    out: dict[str, list[tuple[str, int, float]]] = {}
    for path, w in sorted(weights.items()):
        if w > 0:
            out.setdefault("/".join(map(str, path[:-1])), []).append(("/".join(map(str, path)), path[-1], w))
    return out


def _draw(key: Column, path: Column, weight: Column) -> Column:
    """An exponential variate at the rate of the weight, from 52 bits of a hash of key and path."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/"), path)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(2**52)) / weight


def _descend(key: Column, tree: list[Shard]) -> Column:
    """struct(region, rack, shard) of the key."""
    if not any(x.weight > 0 for x in tree):
        raise ValueError("the tree has no shard of any weight")
    at, numbers = F.lit(""), []
    for level in range(3):
        table = _children(tree, level)
        entries = [y for parent, kids in table.items() for y in (F.lit(parent), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(n).alias("number"), F.lit(w).alias("weight")) for p, n, w in kids]))]
        won = F.array_min(F.transform(F.create_map(*entries)[at], lambda c: F.struct(_draw(key, c["path"], c["weight"]).alias("draw"), c["number"].alias("number"), c["path"].alias("path"))))
        numbers.append(won["number"].cast("int"))
        at = won["path"]
    return F.struct(*[n.alias(c) for n, c in zip(numbers, Shard._fields, strict=False)])


def with_shard(df: DataFrame, tree: Iterable[Shard], key: str = "doc_id", prefix: str = "") -> DataFrame:
    """Adds the region, rack and shard of each row's key in the tree; `prefix` goes before these names."""
    names = [f"{prefix}{c}" for c in Shard._fields[:3]]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    place = _descend(F.coalesce(F.col(key).cast("string"), F.lit("null")), list(tree))
    return df.select(*kept, place.alias("__place")).select(*kept, *[F.col(f"__place.{c}").alias(n) for c, n in zip(Shard._fields, names, strict=False)])


def with_slot(df: DataFrame, scratch: Scratch, order: list[str], shard: str = "shard") -> DataFrame:
    """Adds `slot`, the rows' places in their shards in the given order, nulls first, without gaps from 0.

    The rows are dealt by range, so that a shard is spread over tasks and even rows
    that are equal in all of `order` are; df should have only what the result needs.
    """
    by = [F.col(shard), *[F.col(c).asc_nulls_first() for c in order], F.col("__tie")]
    rows = scratch.table(df.withColumn("__tie", F.monotonically_increasing_id()), "dealt")
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie")
    placed = scratch.table(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()), "placed")
    before = F.sum("__n").over(W.partitionBy(shard).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = placed.groupBy("__part", shard).agg(F.count("*").alias("__n"), F.min("__seq").alias("__first"))
    starts = smaller_side(scratch.table(starts.select("__part", shard, (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift")), "starts"))
    scratch.drop(rows)
    return placed.join(starts, ["__part", shard]).withColumn("slot", (F.col("__seq") + F.col("__shift")).cast("long")).drop("__part", "__seq", "__shift")


def write_shards(df: DataFrame, tree: Iterable[Shard], path: str, key: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Write whole rows as Parquet, a folder for each region, rack and shard below `path`."""
    names = [*Shard._fields[:3]]
    with_shard(df, tree, key).write.partitionBy(*names).option("maxRecordsPerFile", rows_per_file).parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = balanced(SHARDS)
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = with_shard(with_shard(docs, tree), grown(tree), prefix="grown_").drop("grown_region", "grown_rack")
    slots = with_slot(placed, Scratch(spark, "sharding"), ["doc_id", "size", "text_crc32"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


def _sql() -> str:
    """The winner of every level by the least draw; the checksum byte by byte with a table of remainders."""

    def level(source: str, up: str, new: str, children: str, tree: str) -> str:
        draw = "-ln((('0x' || substr(md5(concat(k, '/', c.path)), 1, 13))::bigint + 0.5) / 4503599627370496.0) / c.weight"
        return f"select s.* exclude ({up}), arg_min(struct_pack(path := c.path, number := c.number), {draw}) as {new} from {source} s join {children} c on c.up = s.{up} and c.tree = '{tree}' group by all"

    vertices = ", ".join(f"('{name}', '{up}', '{path}', {number}, {weight})" for name, tree in (("now", balanced(SHARDS)), ("grown", grown(balanced(SHARDS)))) for depth in range(3) for up, kids in _children(tree, depth).items() for path, number, weight in kids)
    steps = []
    for name in ("now", "grown"):
        steps.append(f"{name}0 as (select distinct k, '' as p from docs)")
        for depth, column in enumerate(("region", "rack", "shard")):
            steps.append(f"{name}{depth + 1} as (select * exclude (won), won.path as p, won.number as {column} from ({level(f'{name}{depth}', 'p', 'won', 'vertices', name)}))")
    return f"""
with vertices(tree, up, path, number, weight) as (values {vertices}),
docs as (select doc_id, coalesce(doc_id::varchar, 'null') as k, hex(encode(coalesce(text, ''))) as h from documents),
remainders as (select list(list_reduce(list_prepend(i, range(8)), lambda s, b: case when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end) order by i) as v from range(256) r(i)),
sums as (select doc_id, k, length(h) // 2 + {ROW_BYTES} as size, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)), lambda s, x: xor(s >> 8, v[1 + (xor(s, x) & 255)]))) as text_crc32 from docs, remainders),
{", ".join(steps)}
select d.doc_id, d.size::bigint as size, d.text_crc32::bigint as text_crc32, 'key' as law, n.shard::int as shard,
       row_number() over (partition by n.shard order by d.doc_id nulls first, d.size, d.text_crc32) - 1 as slot,
       g.shard::int as grown_shard, n.region::int as region, n.rack::int as rack
from sums d join now3 n using (k) join grown3 g using (k)"""


ORACLE_SQL = _sql()
