"""What is read in chunks and by ranges, against a fold in sequence or a comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import calls, closure, context, intervals, lookup, provenance, scan, verify
from tracewright.operators.graph import CALL, SYSCALL

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: User memory, the kernel's segments, and the ends of signed and unsigned numbers.
SPOTS = [0, -4611686018427387904, -2147483648, MOST - 5000, LEAST]


def unsigned(x):
    return x & ((1 << 64) - 1)


def address(rng, spread=5000):
    return max(min(rng.choice(SPOTS) + rng.randint(-100, spread), MOST), LEAST)


@pytest.mark.parametrize("wide", [False, True])
def test_lookups_of_addresses(spark, wide):
    rng, of = random.Random(1), unsigned if wide else int
    keys = sorted({address(rng) for _ in range(60)})
    values = [address(rng, 5100) for _ in range(300)] + keys + [-1, 0, MOST, LEAST, None] + [keys[7] + 1] * 500
    table = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int")
    left = spark.createDataFrame(list(enumerate(values)), "j int, v long")
    got = {r.j: r.i for r in lookup.floor_lookup(left, table, "v", "k", ["i"], 64, wide).collect()}
    assert got == {j: None if v is None else max(((of(k), i) for i, k in enumerate(keys) if of(k) <= of(v)), default=(0, None))[1] for j, v in enumerate(values)}
    spans = [(i, s, max(min(s + rng.choice([0, 1, 5, 300, 10**6, 2**62, -3]), MOST), LEAST)) for i, s in enumerate(rng.choices(values[:300], k=120))]
    table = spark.createDataFrame([*spans, (900, None, 5), (901, 5, None)], "o int, s long, e long")
    got = {r.j: r.o for r in lookup.first_covering(left, table, "v", "s", "e", "o", ["o"], wide).collect()}
    assert got == {j: None if v is None else min((i for i, s, e in spans if of(s) <= of(v) <= of(e)), default=None) for j, v in enumerate(values)}
    if wide:
        got = {r.j: r.hit for r in verify.in_some_range(left, table.select(F.col("s").alias("start"), F.col("e").alias("end")), "v", "hit").collect()}
        assert got == {j: v is not None and any(of(s) <= of(v) <= of(e) for _, s, e in spans) for j, v in enumerate(values)}


def test_a_hot_value_is_split(spark):
    # one value in most rows: the join by cells is one that adaptive execution can split, and no window holds the rows
    left = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-4611686018427387904 + 7).alias("v"))
    table = spark.range(-20, 20).select((F.col("id") - 4611686018427387904).alias("k"), F.col("id").alias("i"))
    found = lookup.floor_lookup(left, table, "v", "k", ["i"], 64, True)
    assert found.where("v < 0 and i <> 7").count() == 0 and found.count() == 20_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join Inner" in plan


def test_nothing_to_look_up(spark):
    left, none = spark.createDataFrame([(1, 5), (2, None)], "j int, v long"), spark.createDataFrame([], "k long, e long, i int")
    assert lookup.floor_lookup(left, none, "v", "k", ["i"], 64).where("i is null").count() == 2
    assert lookup.first_covering(left, none, "v", "k", "e", "i", ["i"]).where("i is null").count() == 2
    numbers = spark.createDataFrame([(1, 1.5), (2, -3.0), (3, None), (4, float("nan")), (5, float("inf")), (6, float("-inf")), (7, 0.1)], "j int, v double")
    table = spark.createDataFrame([(0.1, 1), (1.0, 2), (1.0, 3), (-2.0, 4)], "k double, i int")
    assert {r.j: r.i for r in lookup.floor_lookup(numbers, table, "v", "k", ["i"], 1).collect()} == {1: 3, 2: None, 3: None, 4: None, 5: 3, 6: None, 7: 1}


def test_running_aggregates(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "b", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, *range(-9, 9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, k string, o int, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = scan.running(df, ["k"], ["o", "i"], s=("sum", F.col("v")), m=("max", F.col("v"), False), n=("min", F.col("v")), p=("last", F.col("v"), False), q=("next", F.col("v")), r=("next", F.col("v"), True)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == 400
    for key in ("a", "b", None):
        own = sorted((r for r in out if r.k == key), key=lambda r: (r.o is not None, r.o or 0, r.i))
        values = [r.v for r in own]
        known = lambda x: [v for v in x if v is not None]
        for at, r in enumerate(own):
            to, before, after = known(values[: at + 1]), known(values[:at]), known(values[at + 1 :])
            assert (r.s, r.n) == (sum(to) if to else None, min(to, default=None))
            assert (r.m, r.p) == (max(before, default=None), before[-1] if before else None)
            assert (r.q, r.r) == (after[0] if after else None, next(iter(known(values[at:])), None))


def test_intervals_without_a_key(spark):
    rng = random.Random(6)
    spans = [(s, s + rng.choice([1, 2, 5, 60])) for s in rng.choices(range(3000), k=300)]
    df = spark.createDataFrame(spans, "s int, e int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        united = sorted(tuple(r) for r in intervals.union(df, "s", "e").collect())
        counted = sorted(tuple(r) for r in intervals.sweep(df, "s", "e").collect())
        apart = sorted(tuple(r) for r in intervals.gaps(spark.createDataFrame(united, "s int, e int"), "s", "e").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for s, e in sorted(spans):
        if want and s <= want[-1][1]:
            want[-1] = (want[-1][0], max(want[-1][1], e))
        else:
            want.append((s, e))
    assert united == want
    assert apart == [(a[1], b[0]) for a, b in zip(want, want[1:], strict=False)]
    edges = sorted({x for span in spans for x in span})
    assert counted == [(a, b, n) for a, b in zip(edges, edges[1:], strict=False) if (n := sum(s <= a < e for s, e in spans))]


def test_cycles_are_errors(spark):
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "vid long, parent long")
    with pytest.raises(ValueError, match="cycle"):
        closure.nearest_marked(loop, spark.createDataFrame([(9, 1)], "vid long, mark int"))
    with pytest.raises(ValueError, match="cycle"):
        provenance._follow(loop.withColumnRenamed("parent", "to"))


def folded(events):
    """The calls of a trace by one stack, in sequence."""
    stack, roots, depth, within, out = [[-1, None, 0, None, None, None, None, 0]], 1, 0, False, []

    def close(r):
        nonlocal roots
        f = stack.pop()
        if not stack:
            roots += 1
            f[1] = -roots
            stack.append([-roots, None, 0, None, None, None, None, 0])
        out.append((*f[:6], r["time"], r["pc"], r["idx"], f[7]))
        return f[2]

    for r in events:
        if r["kind"] in ("call", "syscall"):
            within |= r["kind"] == "syscall"
            stack.append([r["idx"], stack[-1][0], SYSCALL if r["kind"] == "syscall" else CALL, r["target"], r["time"], r["pc"], r["expected"], stack[-1][7] + 1])
        elif r["kind"] == "return":
            expected = stack[-1][6]
            if (not within) if expected is None else expected == r["target"]:
                close(r)
        elif r["kind"] == "eret":
            depth -= 1
            if within and depth == 0 and not r["raised"]:
                within, ended = False, False
                while len(stack) > 1 and not ended:
                    ended = close(r) == SYSCALL
                if not ended:
                    close(r)
            depth = max(depth, 0)
        depth += r["raised"]
    return sorted(out + [(*f[:6], None, None, None, f[7]) for f in stack], key=lambda x: x[0])


def random_events(seed, n, shape):
    rng, open_, events = random.Random(seed), [], []
    for i in range(n):
        kind = rng.choices(["call", "return", "syscall", "eret", "exception"], shape)[0]
        target = expected = None
        if kind == "call":
            target, expected = rng.randint(1, 5) * 16, rng.choice([None, *[rng.randint(1, 6)] * 9])
            open_.append(expected)
        elif kind == "return":
            wanted = open_.pop() if open_ and rng.random() < 0.8 else rng.randint(1, 6)
            target = wanted if wanted is not None else rng.randint(1, 6)
        elif kind == "syscall":
            target = rng.randint(1, 500)
        raised = kind == "exception" or (kind == "syscall" and rng.random() < 0.9) or rng.random() < 0.03
        events.append({"idx": i * 3 + 1, "time": i * 5, "kind": kind, "pc": 4096 + i * 4, "target": target, "expected": expected, "raised": raised})
    return events


@pytest.mark.parametrize(("width", "shape"), [(40, (4, 4, 1, 1, 0.3)), (1_000_000, (6, 3, 0, 0, 0)), (150, (2, 6, 1, 2, 0.2))])
def test_calls_against_one_stack(spark, width, shape):
    events = random_events(sum(shape), 400, shape)
    df = spark.createDataFrame([tuple(r.values()) for r in events], "idx long, time long, kind string, pc long, target long, expected long, raised boolean").repartition(4)
    got = sorted((tuple(r) for r in calls.call_graph(df, width, 4).collect()), key=lambda x: x[0])
    assert got == folded(events)


def test_open_calls_are_held_as_numbers():
    """A fold's memory, which at many open calls is its task's: under 100 bytes a call, and output in batches."""
    import tracemalloc

    for last in (True, False):
        out = []
        tracemalloc.start()
        fold = calls._Fold(last, out)
        for i in range(30_000):
            fold.step((i, i * 2, "call", i * 4, i * 8, None, False))
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.stop()
        n, most = 0, 0
        for _ in fold.end():
            n, most = n + len(out), max(most, len(out))
            out.clear()
        assert held < 30_000 * 100 and n + len(out) == 30_000 + (1 if last else 0) and most <= 10_000


def test_calls_of_nothing(spark):
    none = spark.createDataFrame([], "idx long, time long, kind string, pc long, target long, expected long, raised boolean")
    assert [(r.call, r.op, r.depth) for r in calls.call_graph(none).collect()] == [(-1, 0, 0)]


def test_forests_by_doubling(spark, monkeypatch):
    rng = random.Random(8)
    parents = {i: rng.randrange(i) if i % 29 and rng.random() < 0.97 else None for i in range(1, 300)} | {0: None, 500: 499, 499: 498, 498: None}
    df = spark.createDataFrame(list(parents.items()), "id long, parent long").repartition(3)
    children = {i: sorted(k for k, p in parents.items() if p == i) for i in [None, *parents]}
    want, todo, at = {}, [(i, 0, 0) for i in reversed(children[None])], 0
    order = []
    while todo:
        i, depth, _ = todo.pop()
        order.append(i)
        want[i] = (depth, at)
        at += 1
        todo += [(c, depth + 1, 0) for c in reversed(children[i])]
    size = dict.fromkeys(parents, 1)
    for i in reversed(order):
        if parents[i] is not None:
            size[parents[i]] += size[i]
    got = {r.id: (r.depth, r.enter, r.leave) for r in closure.preorder(df).collect()}
    assert got == {i: (d, e, e + size[i] - 1) for i, (d, e) in want.items()}
    seeds = [(3, "a"), (3, "b"), (50, "a"), (120, "c"), (0, "a"), (499, "d"), (777, "e")]
    out = {(r.id, r.tag): r.depth for r in closure.descendants(df.where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst")), spark.createDataFrame(seeds, "id long, tag string"), ["tag"], forest=True).collect()}
    reached = {}
    for i in [*parents, 777]:
        above, far = i, 0
        while above is not None:
            for s, tag in seeds:
                if s == above:
                    reached[i, tag] = min(far, reached.get((i, tag), far))
            above, far = parents.get(above), far + 1
    assert out == reached


def test_a_large_table_of_nodes_is_not_broadcast(spark, monkeypatch):
    points = spark.range(100).select("id", (F.col("id") * 7).alias("v"))
    spans = spark.range(40).select(F.col("id").alias("o"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 500).alias("e"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for rows, sent in ((1_000_000, True), (10, False)):
        monkeypatch.setattr("tracewright.operators.storage.BROADCAST_ROWS", rows, raising=False)
        found = lookup.first_covering(points, spans, "v", "s", "e", "o", ["o"])
        assert ("SortMergeJoin" not in plan(found)) == sent
        assert {r.id: r.o for r in found.collect()} == {i: next((o for o in range(40) if o * 10 <= i * 7 <= o * 10 + 500), None) for i in range(100)}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 20_000, []
    monkeypatch.setattr(closure, "_written", lambda df, f=closure._written: (rounds.append(1), f(df))[1])
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    seeds = spark.createDataFrame([(0,), (7,), (n - 3,)], "id long")
    found = closure.descendants_in_forest(chain.where("parent is not null"), seeds, [])
    assert found.agg(F.count("*"), F.max("depth")).first()[:] == (n, n - 4 - 7) and len(rounds) <= 20
    del rounds[:]
    last = closure.preorder(chain).where(f"id = {n - 1}").first()
    assert last[1:] == (n - 1, n - 1, n - 1) and len(rounds) <= 18
    with pytest.raises(ValueError, match="cycle"):
        closure.preorder(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "id long, parent long"))


def test_preorder_of_a_shallow_forest_takes_rounds_by_its_depth(spark, monkeypatch):
    n, rounds = 3000, []
    monkeypatch.setattr(closure, "_written", lambda df, f=closure._written: (rounds.append(1), f(df))[1])
    up = {i: None if i < 3 else f"k{i % 3}" if i < 40 else f"k{3 + i % 37}" for i in range(n)}
    got = {r.id: (r.depth, r.enter, r.leave) for r in closure.preorder(spark.createDataFrame([(f"k{i}", p) for i, p in up.items()], "id string, parent string")).collect()}
    below, want = {}, {}
    for i, p in up.items():
        below.setdefault(p, []).append(f"k{i}")

    def visit(v, depth):
        at, end = len(want), len(want)
        want[v] = None
        for c in sorted(below.get(v, [])):
            end = visit(c, depth + 1)
        want[v] = (depth, at, end)
        return end

    for r in sorted(below[None]):
        visit(r, 0)
    assert got == want and len(rounds) <= 3
    with pytest.raises(ValueError, match="no vertex"):
        closure.preorder(spark.createDataFrame([(1, None), (2, 9)], "id long, parent long"))


def _plans(monkeypatch, module):
    """The plans of the tables that a module writes from now on."""
    plans = []
    monkeypatch.setattr(module, "_written", lambda df, f=module._written: (plans.append(df._jdf.queryExecution().executedPlan().toString()), f(df))[1])
    return plans


def test_vertices_that_look_no_further_stay_out_of_the_join(spark, monkeypatch):
    plans = _plans(monkeypatch, closure)
    parents = spark.range(1, 200).select(F.col("id").alias("vid"), (F.col("id") - F.when(F.col("id") % 2 == 0, 2).otherwise(1)).alias("parent"))
    marks = spark.createDataFrame([(4, "a"), (90, "b"), (33, "c"), (500, "d")], "vid long, mark string")
    up, held, want = {i: i - (2 if i % 2 == 0 else 1) for i in range(1, 200)}, {4: "a", 90: "b", 33: "c", 500: "d"}, {}
    for v in [*range(200), 500]:
        x, far = v, 0
        while x is not None and x not in held:
            x, far = up.get(x), far + 1
        if x is not None:
            want[v] = (held[x], far)
    assert {r.vid: (r.mark, r.far) for r in closure.nearest_marked(parents, marks, distance="far").collect()} == want
    assert len(plans) > 3 and all("LeftOuter" not in p for p in plans[1:])


def test_versions_that_follow_nothing_stay_out_of_the_join(spark, monkeypatch):
    plans = _plans(monkeypatch, provenance)
    cap = dict(valid=True, origin="SETBOUNDS", pc=0, is_kernel=False, base=0, offset=0, length=64, perms=7, otype=0, sealed=False, flags=0)
    acts = [("root", "r1", None), ("copy", "r2", "r1"), ("clear", "r1", None), ("derive", "r3", "r2"), ("copy", "r4", "r1"), ("derive", "r5", "r9")]
    names = [x.split()[0] for x in provenance.UOP.split(", ")]
    rows = [tuple((cap | dict(idx=i, sub=0, act=act, dst=dst, src=src, addr=None, time=i, valid=i != 4)).get(c) for c in names) for i, (act, dst, src) in enumerate(acts)]
    found = provenance.provenance(spark.createDataFrame(rows, provenance.UOP)).vertices
    assert sorted((r.origin, r.t_alloc) for r in found.collect()) == [("INITIAL_ROOT", -1), ("ROOT", 0), ("SETBOUNDS", 3), ("SETBOUNDS", 5)]
    assert any("isnull(to" in p for p in plans if "_real" in p)


@pytest.mark.parametrize("kind", ["long", "double"])
def test_a_floor_lookup_does_not_copy_its_rows(spark, kind):
    rng = random.Random(5)
    keys = sorted({rng.choice([0, 1 << 20, 1 << 45, -(1 << 50)]) + rng.randint(0, 900) for _ in range(80)})
    values = [rng.choice(keys) + rng.randint(-400, 400) for _ in range(400)] + [keys[0] - 1, *keys]
    of = int if kind == "long" else float
    left = spark.createDataFrame([(j, of(v)) for j, v in enumerate(values)], f"j int, v {kind}")
    found = lookup.floor_lookup(left, spark.createDataFrame([(of(k), i) for i, k in enumerate(keys)], f"k {kind}, i int"), "v", "k", ["i"], 64)
    assert {r.j: r.i for r in found.collect()} == {j: max((i for i, k in enumerate(keys) if k <= v), default=None) for j, v in enumerate(values)}
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def pending_by_fold(steps, locations):
    """The sessions of one activation after another, register by register."""
    out = {}
    for who in sorted({s["u"] for s in steps}):
        holds, session, whole = {}, {}, {}

        def done(v, outcome, at):
            session[v][-2:] = [outcome, at]

        def live(v):
            return v in session and session[v][-2] is None

        for r in (s for s in steps if s["u"] == who):
            at, act, dst, src = r["at"], r["act"], r["dst"], r["src"]
            if act == "return":
                for v in session:
                    if live(v):
                        done(v, "returned", at)
            sources = [x for x in dict.fromkeys([*(r["reads"] or []), src]) if x is not None]
            values = {holds[x] for x in sources if x in holds}
            if act != "move":
                for v in values:
                    if live(v):
                        kind, size = session[v][0], session[v][4]
                        if kind == "andperm":
                            done(v, "matched" if act == "perms" and dst == 13 else "used", at)
                        elif act == "bounds" and dst == src:
                            right = r["length"] == size if kind == "stack" else r["amount"] == size
                            done(v, "bounded" if right else "wrong_bound", at)
                            if right and kind == "stack" and session[v][5]:
                                whole[at] = (session[v][1], session[v][5])
                        else:
                            done(v, "used", at)
            made = at
            if act == "move" and src in holds:
                made = holds[src]
            if dst is not None:
                old = holds.get(dst)
                holds[dst] = made
                if old is not None and live(old) and old not in holds.values():
                    done(old, "overwritten", at)
            if act == "offset":
                match = sorted((x for x in locations if x[1] <= r["pc"] < x[2] - 4 and x[3] == r["amount"]), key=lambda x: (x[0], x[4]))
                if src in (11, 24) and dst not in (11, 24) and match:
                    session[at] = ["stack", match[0][0], None, dst, match[0][4], match[0][5], None, None]
                for v in values:
                    if v in whole:
                        parts = sorted((n, z) for n, o, z in whole[v][1] if o == r["amount"])
                        if parts:
                            session[at] = ["subobject", whole[v][0], parts[0][0], dst, parts[0][1], None, None, None]
            if act == "bounds" and src == 11 and dst != src:
                session[at] = ["andperm", None, None, dst, None, None, None, None]
        for at, (kind, variable, member, reg, size, _, outcome, ended) in session.items():
            out[who, at] = (kind, variable, member, reg, size, outcome or "open", ended)
    return out


def test_pending_sets_against_a_fold(spark):
    rng = random.Random(12)
    locations = [("x", 1000, 5000, 16, 8, None), ("y", 1000, 2000, 32, 24, [("a", 0, 8), ("b", 8, 16)]), ("z", 2000, 5000, 32, 24, [("b", 8, 16), ("bb", 8, 4)])]
    steps = []
    for u in range(20):
        for i in range(150):
            act = rng.choices(["offset", "bounds", "perms", "move", "load", "return"], [6, 5, 2, 4, 2, 0.05])[0]
            dst, src = rng.choice([1, 2, 3, 4, 13, 24]), rng.choice([1, 2, 3, 4, 11, 11, 24])
            if act == "bounds" and rng.random() < 0.8:
                dst = src = rng.choice([1, 2, 3, 4])
            if act == "perms" and rng.random() < 0.7:
                dst = 13
            amount = rng.choice([16, 32, 0, 8]) if act == "offset" else rng.choice([8, 24, 16])
            row = dict(u=u, at=i * 10 + u, pc=1000 + 4 * rng.randint(0, 900), act=act, dst=dst, src=src, amount=amount, base=0, length=amount, reads=rng.choice([None, None, [5, rng.choice([1, 2, 3])]]) if act == "load" else None)
            steps.append(row | ({"dst": None, "src": None} if act == "return" else {}) | ({"dst": None} if act == "load" and rng.random() < 0.5 else {}))
    scripts = [("offset", 1, 11, 32, None), ("bounds", 1, 1, 24, None), ("move", 3, 1, 0, None), ("offset", 2, 3, 8, None), ("offset", 4, 1, 0, None), ("bounds", 2, 2, 16, None), ("load", 5, None, 0, [4])]
    for u in (100, 101):
        steps += [dict(u=u, at=i * 10, pc=1004, act=act, dst=dst, src=src, amount=amount + (u == 101 and i == 5), base=0, length=amount, reads=reads) for i, (act, dst, src, amount, reads) in enumerate(scripts)]
    df = spark.createDataFrame([tuple(r.values()) for r in steps], "u int, at long, pc long, act string, dst int, src int, amount long, base long, length long, reads array<int>").repartition(3)
    places = spark.createDataFrame(locations, "variable string, lowpc long, highpc long, offset long, size long, members array<struct<name:string,offset:bigint,size:bigint>>")
    want = pending_by_fold(steps, locations)
    got = {(r.u, r.at): tuple(r)[2:] for r in verify.pending_sets(df, places, ["u"], 170.0).collect()}
    assert got == want
    assert {(x[0], x[5]) for x in want.values()} >= {("stack", "bounded"), ("stack", "wrong_bound"), ("stack", "used"), ("stack", "overwritten"), ("subobject", "bounded"), ("subobject", "used"), ("subobject", "wrong_bound"), ("andperm", "matched"), ("andperm", "used")}


@pytest.mark.parametrize("by", [[], ["k"]])
def test_greedy_windows_in_chunks(spark, by):
    rng = random.Random(15)
    rows = [(i, rng.choice("aab"), rng.random() < (0.02 if 300 < i < 420 else 0.3)) for i in range(700)]
    df = spark.createDataFrame(rows, "i int, k string, m boolean").repartition(4)
    for before, after, width in ((2, 3, 16), (1, 20, 4), (3, 0, 16)):
        got = {r.i: r.kind for r in context.with_greedy_context(df, F.col("m"), by, ["i"], before, after, width).collect()}
        want = {}
        for key in ("a", "b") if by else (None,):
            history, left = [], 0
            for i, k, m in rows:
                if by and k != key:
                    continue
                if left:
                    want[i], left = "after", left - 1
                elif m:
                    want |= dict.fromkeys(history[-before:], "history") | {i: "anchor"}
                    history, left = [], after
                    continue
                else:
                    history.append(i)
        assert got == want
    near = {r.i for r in context.with_context(df, F.col("m"), by, ["i"], 2, 1).collect()}
    lists = [[r for r in rows if not by or r[1] == key] for key in (("a", "b") if by else (None,))]
    assert near == {own[j][0] for own in lists for j in range(len(own)) if any(x[2] for x in own[max(j - 1, 0) : j + 3])}
