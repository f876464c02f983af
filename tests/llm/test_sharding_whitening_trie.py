"""Sharding, whitening and the conversations' trie against brute force on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import digits, op11_whitening, op12_sharding, op13_prefix_trie
from tracewright.llm.common import Scratch
from tracewright.llm.op12_sharding import Shard


# --- 11
def test_products_are_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63 - 1, (5000, 5))
    gram = digits.Gram(5)
    gram.add(x[:4500])
    gram.add(x[4500:])
    ones = np.concatenate([np.ones((5000, 1), object), x.astype(object)], axis=1)
    assert (ones.T @ ones == gram.settle()).all()
    a, b = rng.integers(-(2**62), 2**62, (3, 9000)).astype(object) ** 3, rng.integers(-9, 9, (9000, 2))
    assert (digits.product(a, b) == a @ b.astype(object)).all()


def whitened_by_brute_force(rows):
    """n, sums, and the moments in rational numbers, of the vectors that take part."""
    used = [(i, [max(min(math.floor(256 * c), 2**63 - 1), -(2**63)) if abs(c) < 1e300 else (2**63 - 1 if c > 0 else -(2**63)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in used})
    return used, fit, len(fit), [sum(c) for c in zip(*fit, strict=True)]


def random_vectors(outlier):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.1 * (j + 1)) for j in range(6)]) for i in range(300)]
    rows += [(i, rows[i][1]) for i in range(20)] + [(400 + i, rows[7][1]) for i in range(100)]
    rows += [(None, rows[3][1]), (500, None), (501, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [float("-inf")] + [0.0] * 5), (504, [])]
    return rows + ([(505, [outlier, 0.5, 0.25, 1.0, 0.0, 0.0]), (506, [0.0, outlier / 1e5, 0.0, 0.0, 0.0, 1.0])] if outlier else [])


@pytest.mark.parametrize("outlier", [0, 1e6, 1e13, 3e16])
def test_whitening_against_brute_force(spark, outlier):
    rows = random_vectors(outlier)
    used, fit, n, sums = whitened_by_brute_force(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit("clash"), "w": F.lit(1)}).repartition(4)
    got = op11_whitening.whiten(table).collect()
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, c) for i, _ in used for c in range(1, 5))
    assert {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for i, x in used}
    for r in got:
        whole = deviation[r.vec_id]
        assert (r.deviation, r.deviation_digits) == ((whole, None) if whole < 2**63 else (None, str(whole)))
    # the covariance of the fit list's rows, centred in integers, is diagonal with the eigenvalues
    m = np.array([[sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit) for j in range(6)] for i in range(6)], object)
    trace = sum(m.diagonal())
    values, vectors, bits = digits.leading(m, 4)
    by_id = {(r.vec_id, r.component): r for r in got}
    for c in range(4):
        w, v = values[c], vectors[:, c]
        assert max(abs(x) for x in (m @ v << bits) - w * v) < 1e-9 * abs(w) * (1 << bits)
        assert abs(sum(int(x) ** 2 for x in v) / (1 << 2 * bits) - 1) < 1e-14
        for i, x in used:
            r = by_id[i, c + 1]
            assert abs(r.explained / (w / (trace << bits)) - 1) < 1e-9
            flat = sum((n * a - s) * int(y) for a, s, y in zip(x, sums, v, strict=True)) / (n << bits)
            assert abs(r.whitened - flat / math.sqrt(w / (n**3 << bits))) < 1e-7


def test_whitening_without_variance_and_of_several_lengths(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0]), (4, [6.0]), (5, [1.001, 2.001])]
    got = {(r.vec_id, r.component): r for r in op11_whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert {k: (r.n, r.deviation, r.whitened, r.explained) for k, r in got.items() if k[0] in (1, 2, 5)} == {(i, c): (1, 0, None, 0.0) for i in (1, 2, 5) for c in (1, 2)}
    assert sorted((k, r.n, r.deviation, abs(r.whitened)) for k, r in got.items() if k[0] in (3, 4)) == [((3, 1), 2, 65536, 1.0), ((4, 1), 2, 65536, 1.0)]
    assert op11_whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# --- 12
def drawn(key, tree):
    """The shard of a key by the definition: at each level the child of the least draw."""
    below = [x for x in tree if x.weight > 0]
    for level in range(3):
        weights = defaultdict(float)
        for x in below:
            weights[x[: level + 1]] += x.weight
        draws = {p: -math.log((int(hashlib.md5(f"{key}/{'/'.join(map(str, p))}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w for p, w in weights.items()}
        won = min(draws, key=lambda p: (draws[p], p[-1]))
        below = [x for x in below if x[: level + 1] == won]
    return below[0][:3]


def shards(spark, tree, n=4000):
    rows = op12_sharding.with_shard(spark.range(n).withColumnRenamed("id", "doc_id"), tree).collect()
    return {r.doc_id: (r.region, r.rack, r.shard) for r in rows}


def test_shards_against_brute_force(spark):
    rng = random.Random(2)
    tree = [Shard(r, k, 10 * r + 3 * k + s, rng.choice([0.0, 0.5, 1.0, 3.0])) for r in range(3) for k in range(2) for s in range(3)]
    assert shards(spark, tree, 1500) == {i: drawn(i, tree) for i in range(1500)}
    with pytest.raises(ValueError):
        op12_sharding.with_shard(spark.range(1), [Shard(0, 0, 0, 0.0)], "id")


def test_a_changed_weight_moves_rows_of_its_subtree_alone(spark):
    tree = op12_sharding.balanced(16)
    before = shards(spark, tree)
    heavier = shards(spark, [x._replace(weight=3.0) if x.shard == 5 else x for x in tree])
    region, rack = tree[5].region, tree[5].rack
    for i, (was, now) in enumerate(zip(before.values(), heavier.values(), strict=True)):
        if was != now:  # into the region, within it into the rack, within the rack into the shard
            assert now[0] == region, i
            assert was[0] != region or now[1] == rack
            assert was[:2] != (region, rack) or now[2] == 5
    # by their shares: 10 of 18 in the region, 6 of 10 of these in the rack, 3 of 6 of these in the shard
    assert abs(sum(x[0] == region for x in heavier.values()) / 4000 - 10 / 18) < 0.03
    assert abs(sum(x[2] == 5 for x in heavier.values()) / 4000 - 3 / 18) < 0.02
    more = shards(spark, op12_sharding.grown(tree))
    moved = [more[i][2] for i in before if more[i] != before[i]]
    assert set(moved) == {16} and abs(len(moved) / 4000 - 1 / 17) < 0.015


def test_slots_of_hot_and_odd_rows(spark, tmp_path, monkeypatch):
    docs = [(i, f"text {i % 7}") for i in range(300)] + [(5, "same")] * 400 + [(None, None)] * 50 + [(7, ""), (8, "é"), (9, "x" * 50_000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"shard": F.lit("clash"), "slot": F.lit(0), "__n": F.lit(1)}).repartition(6)
    placed = op12_sharding.with_shard(table, op12_sharding.balanced(8))
    rows = op12_sharding.with_slot(placed.select("doc_id", "text", "shard"), Scratch(spark, "t"), ["doc_id", "text"]).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(docs)
    for shard, own in {s: sorted((r for r in rows if r.shard == s), key=lambda r: r.slot) for s in {r.shard for r in rows}}.items():
        assert [r.slot for r in own] == list(range(len(own)))
        keys = [(r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in own]
        assert keys == sorted(keys), shard
    op12_sharding.write_shards(table.drop("shard", "slot"), op12_sharding.balanced(8), f"{tmp_path}/shards")
    read = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter((r.doc_id, r.text, r.shard) for r in read.collect()) == Counter((r.doc_id, r.text, r.shard) for r in rows)
    none = op12_sharding.with_shard(table.limit(0), op12_sharding.balanced(8)).select("doc_id", "shard")
    assert op12_sharding.with_slot(none, Scratch(spark, "t"), ["doc_id"]).collect() == []


# --- 13
def trie(rows):
    """The nodes by their definition."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = set()
    for p, m in members.items():
        todo, leaves, saved = [p], 0, 0
        while todo:
            q = todo.pop()
            leaves += not children[q]
            saved += (len(members[q]) - 1) * len(q[-1][1].encode()) if q else 0
            todo += children[q]
        ends = ",".join(str(c) for c in sorted(m) if rebuilt[c] == p)
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(members)


def conversations(seed, n=160, longest=9):
    rng = random.Random(seed)
    texts = ["", "a", "b", "é c", "common"]
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "user", "assistant", None]) if t % 3 else "user", rng.choice(texts) if t % 2 else "common"))
    copied = [(r[1], r[2], r[3]) for r in rows if r[0] == rows[0][0]]
    rows += [(10_000 + i, *x) for i in range(60) for x in copied]
    rows += [(20_001, None, "user", None), (20_001, 3, None, "a"), (20_002, 5, "user", "b"), (None, 0, "user", "a"), (20_005, 2**40, "user", "x" * 3000), (20_007, -4, "user", "common"), (20_007, -4, "user", "common")]
    return rows


KIND = "conv_id long, turn long, role string, text string"


def trie_of(spark, rows, **sizes):
    table = spark.createDataFrame(rows, KIND).withColumns({"depth": F.lit("clash"), "base": F.lit(1), "cell": F.lit(None)}).repartition(3)
    got = [tuple(r) for r in op13_prefix_trie.prefix_trie(table, **sizes).collect()]
    assert len(got) == len(set(got))
    return set(got), len(got)


@pytest.mark.parametrize("sizes", [{}, {"cell": 40}])
def test_trie_against_brute_force(spark, sizes):
    rows = conversations(3)
    assert trie_of(spark, rows, **sizes) == trie(rows)


def test_trie_of_long_conversations_in_parts(spark):
    # parts of 8 turns: long bases with short relatives, long relatives of short and of absent bases, equal long ones
    rng = random.Random(4)
    rows = conversations(5, 60)
    long = {30_000: 70, 30_001: 45, 30_002: 4, 30_006: 50, 30_007: 50, 30_010: 3, 30_011: 33, 30_012: 40, 30_015: 17, 30_016: 16, 30_017: 24, 30_020: 8, 30_021: 9}
    for c, n in long.items():
        own = random.Random(c // 10 if c % 2 else 1)
        rows += [(c, t, "user", own.choice("pq") if t > 5 else "common") for t in range(n)]
    rng.shuffle(rows)
    assert trie_of(spark, rows, size=8, cell=100) == trie(rows)


def test_trie_of_nothing(spark):
    assert trie_of(spark, []) == (set(), 0)
    assert trie_of(spark, [(None, 1, "user", "a")]) == (set(), 0)
