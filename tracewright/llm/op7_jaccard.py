"""Join of texts with similar word n-grams, by a forest of MinHash tries.

1. A text is its set of 5-word shingles.  Texts with equal sets are one set.
2. Each of `TREES` trees holds every set's path: its minima under `DEEP` own
   permutations.  The paths of all trees are sorted together by ranges, so a node
   of a trie is a run of rows with a common prefix, and one pass over the sorted
   rows finds, for every set, the longest prefix that it shares and the first set
   of its node at each shorter one.
3. Matched prefixes are shortened step by step, from the whole path to the
   longest prefix by which a pair of the wanted similarity meets with at least
   the probability `RECALL`.  At each step a set is compared with the first set
   of its node unless they are in one component already; exact Jaccard
   similarities make links.
4. Nodes that then still hold several components are compared set by set, in
   blocks, so no link that the forest shows is missed.
5. Within each component all sets are compared in blocks, exactly, for the number
   of links of each; pairs are counted, never listed.

A permutation is an exclusive or with a random word, then an odd factor, modulo 2^32.

Texts without words (nulls and empty ones too) are each alone.  Repeated rows of a
document are documents of their own, with one id.  The class is named by its least
id, whatever the order of rows; an empty table gives an empty one; columns beyond
the id and the text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read, small_batches, smaller_side
from .components import connected_components
from .shingles import shingle_sets, similar

WORDS, SIMILARITY, TREES, DEEP, RECALL = 5, 0.8, 16, 8, 0.999
#: Matched prefixes are shortened by so many minima at a time.
SHORTER = 2
#: Two blocks are compared in one task; a block has about so many sets, and about so many shingles.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000


def shortest_prefix(similarity: float = SIMILARITY, trees: int = TREES, deep: int = DEEP, recall: float = RECALL) -> int:
    """The longest prefix that still reaches the recall at that similarity."""
    return max((d for d in range(1, deep + 1) if 1 - (1 - similarity**d) ** trees >= recall), default=1)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, told, sid, n, paths): a hash of the text, its set, the set's size, and its path in each tree: a byte for the tree, four for each minimum."""
    rng = np.random.default_rng(7)
    words, odd = (rng.integers(0, 1 << 32, TREES * DEEP, np.uint32) for _ in range(2))
    odd |= np.uint32(1)
    trees = [bytes([t]) for t in range(TREES)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s in shingle_sets(pdf["text"].tolist(), WORDS):
                if not len(s):
                    rows.append((None, 0, []))
                    continue
                h = (s >> np.uint64(32)).astype(np.uint32)
                least = np.full(len(words), 0xFFFFFFFF, np.uint32)
                for a in range(0, len(h), 4096):
                    np.minimum(least, ((h[a : a + 4096, None] ^ words) * odd).min(0), out=least)
                flat = least.astype(">u4").tobytes()
                rows.append((_digest(s), len(s), [t + flat[4 * DEEP * i : 4 * DEEP * (i + 1)] for i, t in enumerate(trees)]))
            out = pd.DataFrame(rows, columns=["sid", "n", "paths"])
            out.insert(0, "told", pdf["told"].to_numpy())
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    small_batches(docs.sparkSession)
    return _keyed(docs, id_col, text_col).mapInPandas(run, "doc_id long, told long, sid binary, n long, paths array<binary>")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, told, text): by id and hash a row, or rows that are equal to it, can be met again without its text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("told"), F.col(text_col).alias("text"))


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima from the first on are equal in each pair of paths (rows of bytes); none in different trees."""
    x, y = (np.ascontiguousarray(v[:, 1:]).view(np.uint32) for v in (a, b))
    return np.cumprod(x == y, axis=1).sum(1) * (a[:, 0] == b[:, 0])


def _matched(sets: DataFrame, flat: int) -> DataFrame:
    """(part, depth, node, a, b, path): set `b` is the first of the node at that depth in which the set `a` is; node: at the least depth.

    Depth -1 and -2 mark the first and the last row of a part of the sorted rows;
    the last one's `b` holds the first sets of its nodes.
    """
    depths = list(range(flat, DEEP + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before, firsts = TaskContext.get().partitionId(), None, []
        for pdf in batches:
            if not len(pdf):
                continue
            sids = [bytes(x) for x in pdf["sid"]]
            path = np.frombuffer(b"".join(map(bytes, pdf["path"])), np.uint8).reshape(len(sids), -1)
            if before is None:
                firsts = [sids[0]] * len(depths)
                yield pd.DataFrame([(part, -1, 0, sids[0], None, path[0].tobytes())], columns=_MATCHED)
            lcp = common_prefix(path, np.concatenate([path[:1] if before is None else before, path[:-1]]))
            if before is None:
                lcp[0] = 0
            node = path[:, : 1 + 4 * flat]
            rows, held = [], [None] * len(sids)
            for k in range(len(depths) - 1, -1, -1):  # from the deepest node, so that a first set is met once
                at = np.maximum.accumulate(np.where(lcp < depths[k], np.arange(len(sids)), -1))
                for i in np.flatnonzero(lcp >= depths[k]).tolist():
                    first = firsts[k] if at[i] < 0 else sids[at[i]]
                    if first != held[i]:
                        held[i] = first
                        rows.append((part, depths[k], int.from_bytes(hashlib.blake2b(node[i].tobytes(), digest_size=8).digest(), "big", signed=True), sids[i], first, None))
                if at[-1] >= 0:
                    firsts[k] = sids[at[-1]]
            before = path[-1:]
            yield pd.DataFrame(rows, columns=_MATCHED)
        if before is not None:
            yield pd.DataFrame([(part, -2, 0, sids[-1], b"".join(firsts), before.tobytes())], columns=_MATCHED)

    rows = sets.select("sid", F.explode_outer("paths").alias("path"))
    return rows.repartitionByRange("path", "sid").sortWithinPartitions("path", "sid").mapInPandas(run, "part int, depth int, node long, a binary, b binary, path binary")


_MATCHED = ["part", "depth", "node", "a", "b", "path"]


def across_parts(ends: list, flat: int) -> list[tuple]:
    """(depth, node, a, b) for nodes that go on in the next part: its first set and the node's first one.  Two rows a part, in order."""
    out, before, carried = [], None, {}
    for head, tail in zip(ends[::2], ends[1::2], strict=True):
        width = len(tail["b"]) // (DEEP + 1 - flat)
        own = {d: bytes(tail["b"][i * width : (i + 1) * width]) for i, d in enumerate(range(flat, DEEP + 1))}
        paths = [np.frombuffer(bytes(x["path"]), np.uint8)[None, :] for x in (head, tail)]
        shared = int(common_prefix(before, paths[0])[0]) if before is not None else 0
        met = None
        for d in range(min(shared, DEEP), flat - 1, -1):
            if carried[d] != met:
                met = carried[d]
                node = int.from_bytes(hashlib.blake2b(paths[0][0, : 1 + 4 * flat].tobytes(), digest_size=8).digest(), "big", signed=True)
                out.append((d, node, bytes(head["a"]), met))
        # a node that fills the part from its first row on keeps the first set of the part before
        whole = int(common_prefix(paths[0], paths[1])[0])
        carried = {d: carried[d] if d <= min(shared, whole) else own[d] for d in own}
        before = paths[1]
    return out


def _sets(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in rows["shingles"]]


def _grouped(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of star pairs (a, b) those that are similar; the sets around one b are dealt to groups of about a block."""
    weight = pairs.join(sets.select(F.col("sid").alias("a"), "n"), "a")
    size = weight.groupBy("b").agg(_blocks().alias("parts"))
    dealt = pairs.join(size, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).select("b", "part", F.col("a").alias("sid"))
    centres = dealt.select("b", "part").distinct().withColumn("sid", F.col("b"))
    rows = dealt.union(centres).join(sets, "sid")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, sids = _sets(pdf), [bytes(x) for x in pdf["sid"]]
        centre = sids.index(bytes(key[0]))
        near = similar(own, [own[centre]], similarity)[:, 0]
        found = [s for i, s in enumerate(sids) if near[i] and i != centre]
        return pd.DataFrame({"a": found, "b": [bytes(key[0])] * len(found)}, columns=["a", "b"])

    return rows.groupBy("b", "part").applyInPandas(run, "a binary, b binary")


def _blocks() -> Column:
    """How many blocks the sets of a group make, by their number and their shingles."""
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")


def _in_blocks(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(group, low, high, block, ...) rows: each member of a group in each pair of blocks that holds it, with its shingles."""
    members = groups.join(sets.select("sid", "n"), "sid")
    dealt = members.join(members.groupBy("group").agg(_blocks().alias("blocks")), "group").withColumn("block", F.pmod(F.xxhash64("sid", "group"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks", "n").join(sets.select("sid", "shingles"), "sid")


def _halves(key: tuple, pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return (pdf, pdf) if key[1] == key[2] else (pdf[pdf["block"] == key[1]], pdf[pdf["block"] == key[2]])


def _cross_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between different components, as many as join them: at most one a member for each block pair."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.reset_index(drop=True)
        left, right = _halves(key, pdf)
        sets = _sets(pdf)
        comps = pd.factorize(pdf["comp"].map(bytes))[0]
        i, j = left.index.to_numpy(), right.index.to_numpy()
        near = similar([sets[x] for x in i], [sets[x] for x in j], similarity) if len(i) and len(j) else np.zeros((len(i), len(j)), bool)
        near &= comps[i][:, None] != comps[j][None, :]
        parent = list(range(int(comps.max()) + 1))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        a, b = [], []
        for x, y in zip(*np.nonzero(near), strict=True):
            p, q = root(comps[i[x]]), root(comps[j[y]])
            if p != q:
                parent[p] = q
                a.append(bytes(pdf["sid"][i[x]]))
                b.append(bytes(pdf["sid"][j[y]]))
        return pd.DataFrame({"a": a, "b": b}, columns=["a", "b"])

    return rows.groupBy("group", "low", "high").applyInPandas(run, "a binary, b binary")


def _link_counts(rows: DataFrame, similarity: float) -> DataFrame:
    """(sid, links): how many documents of other sets each set is linked with."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _halves(key, pdf)
        x, y = _sets(left), _sets(right)
        near = similar(x, y, similarity) if x and y else np.zeros((len(x), len(y)), bool)
        if key[1] == key[2]:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"sid": left["sid"], "links": near @ right["copies"].to_numpy(np.int64)})
        return pd.DataFrame({"sid": pd.concat([left["sid"], right["sid"]]), "links": np.concatenate([near @ right["copies"].to_numpy(np.int64), near.T @ left["copies"].to_numpy(np.int64)])})

    return rows.groupBy("group", "low", "high").applyInPandas(run, "sid binary, links long").groupBy("sid").agg(F.sum("links").alias("links"))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, count_links: bool = True) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), n_links (documents at least so similar)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    signed = scratch.table(_signed(docs, id_col, text_col), "signed")
    sets = signed.where("sid is not null").groupBy("sid").agg(F.first("paths").alias("paths"), F.first("n").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("own"), F.min(F.struct("doc_id", "told")).alias("row"))
    sets = scratch.table(sets, "sets")
    flat = shortest_prefix(similarity)
    matched = scratch.table(_matched(sets, flat), "matched")
    ends = matched.where("depth < 0").orderBy("part", F.desc("depth")).collect()  # two rows a part
    more = spark.createDataFrame(across_parts(ends, flat), "depth int, node long, a binary, b binary")
    matched = scratch.table(matched.where("depth > 0").select("depth", "node", "a", "b").union(more), "pairs")
    # the shingles of each set that shares a node
    wanted = matched.select(F.col("a").alias("sid")).union(matched.select(F.col("b").alias("sid"))).distinct()
    wanted = scratch.table(sets.select("sid", "n", "row").join(wanted, "sid", "left_semi"), "wanted")
    one = F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("told") == F.col("row.told"))
    # each set by one of its rows; rows that are equal to that one are one from here on
    texts = _keyed(docs, id_col, text_col).join(smaller_side(wanted), one).groupBy("sid").agg(F.first("n").alias("n"), F.min("text").alias("text"))
    held = scratch.table(_own_sets(texts), "shingles")
    comps = None
    for depth in range(DEEP, flat - 1, -SHORTER):
        least = max(flat, depth) if depth - SHORTER >= flat else flat
        pairs = matched.where(F.col("depth").between(least, DEEP) & (F.col("depth") < depth + SHORTER)).select("a", "b").distinct()
        if comps is not None:
            pairs = pairs.join(comps.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comps.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left")
            pairs = pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        pairs = scratch.table(pairs, "star")
        if comps is not None and not pairs.take(1):
            continue
        found = scratch.table(_grouped(pairs, held, similarity), "links")
        comps = _joined(comps, found, scratch)
    # nodes that hold several components; equal nodes of different trees once
    members = matched.select("node", F.col("a").alias("sid")).union(matched.select("node", F.col("b").alias("sid"))).distinct()
    labelled = members.join(comps.withColumnRenamed("id", "sid"), "sid", "left").select("node", "sid", F.coalesce("comp", "sid").alias("comp"))
    mixed = labelled.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("y"), F.count("*").alias("n")).where("lo <> hi")
    once = mixed.groupBy("x", "y", "n").agg(F.min("node").alias("node")).select("node")
    groups = scratch.table(labelled.join(once, "node", "left_semi").withColumnRenamed("node", "group"), "mixed")
    more = scratch.table(_cross_links(_in_blocks(groups, held), similarity), "links")
    if more.take(1):
        comps = _joined(comps, more, scratch)
    scratch.drop(matched, groups)
    member = comps.select("id", "comp").union(comps.select(F.col("comp").alias("id"), "comp").distinct())
    least = sets.select("sid", "own").join(member, F.col("sid") == F.col("id")).groupBy("comp").agg(F.min("own").alias("class"))
    of = member.join(least, "comp").select(F.col("id").alias("sid"), "class")
    if count_links:
        groups = member.join(sets.select(F.col("sid").alias("id"), "copies"), "id").select(F.col("comp").alias("group"), F.col("id").alias("sid"), "copies")
        of = of.join(_link_counts(_in_blocks(groups, held), similarity), "sid", "left")
    else:
        of = of.withColumn("links", F.lit(None).cast("long"))
    each = sets.select("sid", "own", "copies").join(of, "sid", "left").select("sid", F.coalesce("class", "own").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "sid").join(each, "sid", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _joined(comps: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components after more links."""
    if comps is not None:
        if not links.take(1):
            return comps
        links = comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(links)
    return connected_components(links, scratch)


def _own_sets(texts: DataFrame) -> DataFrame:
    """(sid, n, shingles) of (sid, n, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"sid": pdf["sid"], "n": pdf["n"], "shingles": [x.tobytes() for x in shingle_sets(pdf["text"].tolist(), WORDS)]})

    return texts.mapInPandas(run, "sid binary, n long, shingles binary")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(read(spark, sf_dir, "documents"))
