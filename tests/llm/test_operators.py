"""Every operator on small tables, against brute force, an exact round trip, or the library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import hnsw, op1_line_dedup, op2_quality, op3_ann, op4_bpe, op5_packing, op6_rules, op7_jaccard, op8_tokens, op9_langid, op10_warc, packing, rans, transducer, warc
from tracewright.llm.common import Scratch
from tracewright.llm.components import connected_components
from tracewright.llm.encoding import Encoder, Lexicon


def components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {x: root(x) for x in parent}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(45)] + [(200, i) for i in range(201, 240)] + [(7, 7), (300, 301), (301, 300)]
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long")
    got = {r.id: r.comp for r in connected_components(df, Scratch(spark, "t")).collect()}
    assert got == {x: c for x, c in components([e for e in edges if e[0] != e[1]]).items() if x != c}
    assert connected_components(df.limit(0), Scratch(spark, "t")).collect() == []


# --- 1
def all_windows(line):
    return {line[i : i + 12] for i in range(max(len(line) - 11, 1))}


def brute_lines(rows):
    """Each line and the one that stays, from the sets of all windows of 12 characters."""
    lines = {(i, n): x for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if x.strip()}
    sets = {x: all_windows(x) for x in set(lines.values())}
    names = sorted(sets)
    near = [(a, b) for k, a in enumerate(names) for b in names[:k] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    root = components(near)
    first = {}
    for at in sorted(lines, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        first.setdefault(root.get(lines[at], lines[at]), at)
    return {(at, first[root.get(x, x)]) for at, x in lines.items()}


def test_lines_against_brute_force(docs, texts):
    got = {((r.doc_id, r.line_no), (r.keep_doc_id, r.keep_line_no)) for r in op1_line_dedup.dedup_lines(docs).collect()}
    assert got == brute_lines(texts)


def test_lines_near_and_far(spark):
    rng = random.Random(3)
    base = " ".join(f"word{rng.randint(0, 999)}" for _ in range(60))
    other = base.replace("word", "term")
    near = base.rsplit(" ", 1)[0] + " changed"
    out = op1_line_dedup.without_repeated_lines(spark.createDataFrame([(1, f"{base}\n\nshort"), (2, f"{near}\n{other}"), (3, near), (4, ""), (5, None)], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: f"{base}\n\nshort", 2: other, 4: "", 5: None}


def missed_pairs(spark, n, edited):
    """How many of 3,000 pairs of lines of n characters share no bucket where the first characters differ."""
    rng = random.Random(12)
    rows = []
    for i in range(3000):
        line = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n))
        rows += [(2 * i, line), (2 * i + 1, "".join(chr(ord(x) ^ 1) for x in line[:edited]) + line[edited:])]
    seen = defaultdict(set)
    for r in op1_line_dedup.signed(spark.createDataFrame(rows, "lid long, line string")).collect():
        seen[r.lid] = set(r.bands)
    return sum(not seen[2 * i] & seen[2 * i + 1] for i in range(3000))


def test_short_lines_share_a_bucket(spark):
    # 8 of 10 shingles in common, a similarity of 0.8: 0.08 % miss, so about 2
    assert missed_pairs(spark, 20, 1) <= 9


def test_lines_against_all_windows(spark):
    rng, abc = random.Random(8), "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(abc) for _ in range(rng.randint(2, 11))) for _ in range(400)]
    thai = "".join(chr(rng.randint(0xE01, 0xE2E)) for _ in range(130))
    lines = [thai, thai[1:], "a" + "\U0001F600\U0001F601" * 3, "x" * 300, "".join(rng.choice(abc) for _ in range(700)), "short one"]
    for i in range(200):
        line = "".join(x + " " for x in rng.choices(words, k=rng.randint(12, 40))).strip()
        at = rng.randrange(len(line))
        lines += [line, line[:at] + "#" + line[at + 1 :]]
    lines += [lines[4][:400] + "?" + lines[4][401:], "a" + "\U0001F600\U0001F601" * 3]
    sets = [all_windows(x) for x in lines]
    near = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    root = components(near)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.keep_doc_id for r in op1_line_dedup.dedup_lines(docs).collect()}
    assert got == {i: root.get(i, i) for i in range(len(lines))}
    table = docs.select(F.col("doc_id").alias("lid"), F.col("text").alias("line"))
    arrays = {r.lid: set(r.h) for r in table.select("lid", op1_line_dedup.shingles(F.col("line")).alias("h")).collect()}
    assert {i: len(h) for i, h in arrays.items()} == {i: len(x) for i, x in enumerate(sets)}
    each = op1_line_dedup._hashed(table)
    each = each.select("lid", F.explode(F.array(*[c for c in each.columns if c != "lid"])).alias("h"))
    assert arrays == {r.lid: set(r.h) for r in each.groupBy("lid").agg(F.collect_set("h").alias("h")).collect()}


def test_lines_that_share_a_passage_and_a_large_near_group(spark, monkeypatch):
    rng, abc = random.Random(14), "abcdefghijklmnopqrstuvwxyz"
    text = lambda n: "".join(rng.choice(abc) for _ in range(n))
    passage, base = text(400), text(240)
    lines = [text(rng.randint(60, 500)) + passage + text(rng.randint(60, 500)) for _ in range(60)]
    for _ in range(140):
        edited = list(base)
        for _ in range(rng.randint(1, 3)):
            edited[rng.randrange(240)] = "#"
        lines.append("".join(edited))
    monkeypatch.setattr(op1_line_dedup, "CROWD", 8)
    want = {(at[0], first[0]) for at, first in brute_lines(list(enumerate(lines)))}
    got = {(r.doc_id, r.keep_doc_id) for r in op1_line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == want


def test_lines_of_a_largest_component_meet_only_those_that_seek(spark):
    rows = [(1, i, 1) for i in (1, 2, 3, 4)] + [(1, 9, 9), (2, 9, 9), (2, 10, 9), (2, 2, 1)]
    seeks = op1_line_dedup._seeking(spark.createDataFrame(rows, "band long, id long, comp long"))
    assert {(r.id, r.comp, r.seeks) for r in seeks.collect()} == {(1, 1, False), (2, 1, True), (3, 1, False), (4, 1, False), (9, 9, True), (10, 9, False)}
    lines = [(1, "a" * 12 + "0123456789bc"), (3, "a" * 12 + "0123456789bc"), (9, "z" * 12 + "0123456789bd"), (2, "z" * 12 + "0123456789be")]
    table = spark.createDataFrame(lines, "id long, line string").join(seeks, "id")
    ranked = op1_line_dedup._rare_prefixes(table, 0.01)
    assert {r.id for r in ranked.collect()} == {2, 9}  # what 1 and 3 share, no line that seeks has
    plan = op1_line_dedup._rare_prefixes(spark.createDataFrame([], "id long, comp long, seeks boolean, line string"), 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # counts are not joined to every shingle of every line


def test_lines_of_smaller_buckets_need_no_rare_shingles(spark, monkeypatch):
    rng, abc = random.Random(15), "abcdefghijklmnopqrstuvwxyz"
    text = lambda n: "".join(rng.choice(abc) for _ in range(n))
    lines, base = [], text(300)
    for _ in range(12):  # groups of a few near copies, each unlike the others but for their first 200 characters
        own = base[:200] + text(100)
        lines += [own, own[:250] + "#" + own[251:], own[:-20]]
    monkeypatch.setattr(op1_line_dedup, "_rare_prefixes", lambda *_: pytest.fail("shingles of all lines of a small bucket were ranked"))
    want = {(at[0], first[0]) for at, first in brute_lines(list(enumerate(lines)))}
    got = {(r.doc_id, r.keep_doc_id) for r in op1_line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == want and 1 < len({x[1] for x in want}) < len(lines)


def test_sketches_agree(spark):
    rng, n = random.Random(16), 30
    byte = lambda: rng.choice([0, 1, 127, 128, 255, rng.randrange(256)])
    pairs = [[(x := byte(), x if rng.random() < 0.5 else byte()) for _ in range(n)] for _ in range(400)]
    words = lambda p, side: [int.from_bytes(bytes([z[side] for z in p[8 * k : 8 * k + 8]]), "little") for k in range(4)]
    rows = [[i, *[w - (w >> 63 << 64) for side in (0, 1) for w in words(p, side)]] for i, p in enumerate(pairs)]
    got = spark.createDataFrame(rows, "i int, " + ", ".join(f"{side}s{k} long" for side in "ab" for k in range(4))).where(op1_line_dedup._agree())
    want = {i for i, p in enumerate(pairs) if sum(x == y for x, y in p) > 13}
    assert {r.i for r in got.collect()} == want and 0 < len(want) < 400


def test_lines_runs_without_python(docs):
    plan = op1_line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_lines_of_nothing(no_docs):
    assert op1_line_dedup.dedup_lines(no_docs).collect() == []
    assert op1_line_dedup.without_repeated_lines(no_docs).columns == no_docs.columns


# --- 2
def test_quality(spark, docs, no_docs):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["ABC!!", "DEF!!"]) if i % 3 == 0 else rng.choice(["quiet", "words", "stand", "here."]) for _ in range(50)), int(i % 3 != 0)) for i in range(300)]
    d, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = op2_quality.train(d.where("doc_id < 200"), labels.where("doc_id < 200 or doc_id is null"))
    got = {r.doc_id: r.score for r in op2_quality.score(d, model).collect()}
    assert all((got[i] >= 0.5) == bool(q) for i, _, q in rows if i >= 200)
    assert all(0 <= r.score <= 1 for r in op2_quality.score(docs, model).collect())
    empty = op2_quality.train(no_docs, labels.limit(0))
    assert {r.score for r in op2_quality.score(docs, empty).collect()} == {0.5}


def test_additive_model_learns_an_interaction():
    x = np.random.default_rng(2).random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = op2_quality.AdditiveModel().fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9
    assert (0, 1) in {(f, g) for f, g, _ in model.pairs}


def test_additive_model_against_brute_force():
    rng = np.random.default_rng(4)
    gain = lambda g, h: g**2 / (h + 1)
    for _ in range(30):
        g, h = rng.normal(size=9), rng.random(9)
        cuts = [gain(g[:i].sum(), h[:i].sum()) + gain(g[i:].sum(), h[i:].sum()) for i in range(1, 9)]
        at = int(np.argmax(cuts)) + 1
        step = op2_quality._best_cuts(g, h, leaves=2)
        if max(cuts) > gain(g.sum(), h.sum()) + 1e-9:
            want = np.where(np.arange(9) < at, g[:at].sum() / (h[:at].sum() + 1), g[at:].sum() / (h[at:].sum() + 1))
            assert np.allclose(step, want)
        g, h = rng.normal(size=(4, 5)), rng.random((4, 5))
        four = lambda i, j: [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 5)), (slice(i, 4), slice(0, j)), (slice(i, 4), slice(j, 5))]
        best = max(((sum(gain(g[p].sum(), h[p].sum()) for p in four(i, j)), i, j) for i in range(1, 4) for j in range(1, 5)))
        found, step = op2_quality._quadrants(g, h)
        assert np.isclose(found, best[0] - gain(g.sum(), h.sum()))
        for p in four(*best[1:]):
            assert np.allclose(step[p], g[p].sum() / (h[p].sum() + 1))
    x = np.round(rng.random((800, 4)), 1)  # ties
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.2 * rng.random(800) > 0.8).astype(float)
    model = op2_quality.AdditiveModel().fit(x, y)
    for row, score in zip(x[:60].tolist(), model.score(x[:60]).tolist(), strict=True):
        bin_of = lambda edges, v: sum(v >= e for e in edges)
        total = model.base + sum(t[bin_of(e, v)] for e, t, v in zip(model.edges, model.tables, row, strict=True))
        total += sum(t[bin_of(model.coarse[f], row[f]), bin_of(model.coarse[g], row[g])] for f, g, t in model.pairs)
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9


def test_quality_learns_with_one_row_of_an_id(spark):
    rows = [(1, "many words of one kind " * 5)] * 30 + [(2, "OTHER!! WORDS!!")] * 30 + [(3, None), (4, "long " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    assert op2_quality.train(docs, labels, rows=4).base == 0.0  # two labels of each kind, whatever the rows
    scores = op2_quality.score(docs, op2_quality.train(docs, labels)).groupBy("doc_id").agg(F.count_distinct("score").alias("n")).collect()
    assert {r.n for r in scores} == {1}


# --- 3
def test_nearest_with_a_repeated_id(spark):
    rows = [(1, [1.0, 2.0])] * 40 + [(2, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [2.0, -1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    reps = {tuple(r.v): r.ids for r in op3_ann.representatives(df, 5, Scratch(spark, "t")).collect()}
    assert reps == {(1.0, 2.0): [1, 2, 3], (2.0, -1.0): [4]}


def test_an_id_with_several_vectors_answers_by_each(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    vectors += [(7, [x + 0.01 * rng.gauss(0, 1) for x in vectors[50][1]]) for _ in range(3)] + [(7, vectors[7][1])] * 2
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"width": F.lit("clash"), "block": F.lit(1), "ids": F.lit(None)}).repartition(3)
    got = {(r.query_id, r["rank"]): r.vec_id for r in op3_ann.nearest(df, df.where("vec_id = 50")).collect()}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    different = {(i, tuple(v)) for i, v in vectors}
    order = sorted((-float(unit(v) @ unit(vectors[50][1])), i) for i, v in different if i != 50)
    assert [got[50, k] for k in range(1, 6)] == [i for _, i in order[:5]] and [got[50, k] for k in (1, 2, 3)] == [7, 7, 7]


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:140] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [float("inf")] + [0.0] * 15), (1004, [None] + [1.0] * 15), (None, x[1].tolist()), (1050, [1.0, 2.0]), (50, x[50].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in op3_ann.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=128).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 700, 50):
        s = y @ y[q]
        best = [i for i in np.lexsort((np.arange(700), -np.round(s, 12))) if i != q][:5]
        hit += len({v for v, _ in got[q]} & set(best))
        assert [v for v, _ in got[q]] == [v for v, _ in sorted(got[q], key=lambda p: (-p[1], p[0]))]
        assert all(abs(score - s[v]) < 1e-9 for v, score in got[q])
    assert hit >= 0.95 * 70
    assert [v for v, _ in got[100]] == [0, 101, 102, 103, 104]
    assert set(got) == set(range(0, 700, 50))
    assert op3_ann.nearest(df.limit(0), df.limit(0)).collect() == []


def test_blocks_of_queries_are_not_broadcast(spark, monkeypatch):
    plans = []

    def table(self, df, name, *rest, f=Scratch.table):
        if name == "found":
            df.collect()  # the plan is the one that ran then
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return f(self, df, name, *rest)

    monkeypatch.setattr(Scratch, "table", table)
    x = np.random.default_rng(6).normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): r.vec_id for r in op3_ann.nearest(df, df.where("vec_id % 5 = 0"), shard_rows=32).collect()}
    assert len(plans) == 1 and "isFinalPlan=true" in plans[0] and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
    repeated = [x for x in plans[0].splitlines() if "Generate explode" in x]
    assert repeated and not any("asked" in x or "queries" in x for x in repeated)  # keys alone
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -2)
    assert got == {(q, k + 1): v for q in range(0, 600, 5) for k, v in enumerate(np.argsort(-s[q])[:5].tolist())}


def test_graph_by_insertion_finds_the_nearest():
    x = np.random.default_rng(7).normal(size=(2500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph.build(x)
    assert [len(a) for a in g.levels] == sorted((len(a) for a in g.levels), reverse=True) and all((b < 2500).all() for b in g.links)
    found = g.search(x[:100], 6, 96)[0]
    best = np.argsort(-(x[:100] @ x.T), axis=1, kind="stable")[:, :6]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(found, best, strict=True)]) >= 0.95 * 6
    for level, links in zip(g.levels, g.links, strict=True):
        assert all(n not in row for n, row in zip(level.tolist(), links.tolist(), strict=True))
        assert all(len({v for v in row if v >= 0}) == sum(v >= 0 for v in row) for row in links.tolist())


def test_graph_round_trip():
    x = np.random.default_rng(1).normal(size=(300, 8))
    g = hnsw.Graph.build(x / np.linalg.norm(x, axis=1, keepdims=True))
    again = hnsw.Graph.from_bytes(g.to_bytes())
    assert (g.search(x[:5], 3)[0] == again.search(x[:5], 3)[0]).all()
    assert hnsw.Graph.build(x[:1]).search(x[:2], 3)[0][:, 0].tolist() == [0, 0]


# --- 4, 5, 8
@pytest.mark.parametrize("path", [op4_bpe.WORD_BPE, op8_tokens.BYTE_BPE])
def test_encoder_against_the_library(path, texts):
    library = Tokenizer.from_file(path)
    rng = random.Random(9)
    alphabet = ["a", "b", "'", "s", "re", "ll", " ", "  ", "\n", "\t", "1", "23", "!", "..", "É", "ß", "<|endoftext|>", "日本", "é", "İ", "Σ", "\xa0", "\x1c", "²", "½", "_", "'S", "😀", "\x85"]
    held = [t for _, t in texts] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    ids, counts = Encoder(Lexicon(["river", "stone12", " stone", "x" * 30], path)).encode(held)
    at = 0
    for text, n in zip(held, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == library.encode(text or "", add_special_tokens=False).ids, text
        at += n


def test_transducer_numbers_words_in_order():
    words = ["a", "ab", "abc", "b", "bc", "xbc"]
    t = transducer.Transducer(transducer.build(words, 256))
    asked = [*words, "x", "abcd", "c", "bcd"]
    codes = np.array([ord(c) for w in asked for c in w])
    ends = np.cumsum([len(w) for w in asked])
    assert t.numbers(codes, ends - [len(w) for w in asked], ends).tolist() == [0, 1, 2, 3, 4, 5, -1, -1, -1, -1]
    assert len(t.accept) < sum(map(len, words))  # suffixes are shared


def test_bpe_query(docs, texts, no_docs):
    library = Tokenizer.from_file(op4_bpe.WORD_BPE)
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in op4_bpe.round_trip(docs).collect()) == want
    assert op4_bpe.round_trip(no_docs).collect() == []


def brute_bins(items, capacity):
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for b in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[b] -= items[i]
            go(i + 1, rooms)
            rooms[b] += items[i]
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 20, 50])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 9))), reverse=True)
        counts = Counter(items)
        fixed, left = packing.reduce(counts, capacity)
        best = brute_bins(items, capacity)
        assert sum(n for _, n in fixed) + brute_bins(sorted(Counter(left).elements(), reverse=True), capacity) == best
        packed = packing.pack(counts, capacity)
        assert packing.lower_bound(counts, capacity) <= best <= sum(n for _, n in packed) <= best + 1
        assert Counter({s: sum(k * n for sizes, n in packed for t, k in sizes if t == s) for s in counts}) == counts


def test_packing_of_one_id_on_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(op5_packing, "RANKED", 40)
    rows = [(7, "the same words again")] * 600 + [(7, f"other words {i}") for i in range(100)] + [(None, "the same words again")] * 50 + [(i, "x y z " * (i % 40)) for i in range(200)]
    out = op5_packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    ends = defaultdict(list)
    for r in out:
        ends[r.sequence_id].append((r.offset, r.length))
    for places in ends.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(places[-1]) <= 2048
    assert len(ends) == -(-sum(r.length for r in out) // 2048)


def test_packing(docs, texts, no_docs):
    library = Tokenizer.from_file(op4_bpe.WORD_BPE)
    rows = op5_packing.pack_documents(docs).collect()
    want = Counter()
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) == packing.lower_bound(Counter(r.length for r in rows), 2048)
    assert op5_packing.pack_documents(no_docs).collect() == []


def test_rans():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.4, 600_000), 9000).astype(np.uint16)
    table = rans.Table.of_counts(dict(enumerate(np.bincount(ids).tolist())))
    again = rans.Table.from_bytes(table.to_bytes())
    for n in (0, 1, 64, 1025, 4097, 600_000):
        data = rans.encode_block(np.array([4]), np.array([1]), np.array([n]), ids[:n], table)
        block = rans.Block(data, again)
        assert (block.ids() == ids[:n]).all()
        if n > 500_000:
            part = rans.STEPS * block.lanes
            assert len(block.marks) > 1 and (block.part(1) == ids[part : 2 * part]).all()
    with pytest.raises(ValueError, match="damaged"):
        rans.Block(data[:-1] + bytes([data[-1] ^ 1]), table)


def test_token_files(docs, texts, no_docs):
    library = Tokenizer.from_file(op8_tokens.BYTE_BPE)
    manifest, folder = op8_tokens.write_tokens(docs)
    rows = sorted(op8_tokens.read_blocks(manifest, folder, read_ids=True).collect(), key=lambda r: r.start)
    encoded = sorted(((-1 if i is None else i), tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in texts)
    assert sorted(((-1 if r.doc_id is None else r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == encoded
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert order == sorted(order)
    assert op8_tokens.read_blocks(*op8_tokens.write_tokens(no_docs)).collect() == []


def test_token_files_with_an_id_of_many_rows(spark, monkeypatch):
    library = Tokenizer.from_file(op8_tokens.BYTE_BPE)
    rows = [(7, f"text {i % 5}") for i in range(60)] + [(None, "none")] * 20 + [(3, "first"), (9, "last")]
    monkeypatch.setattr(op8_tokens, "RANGE_ROWS", 10)
    manifest, folder = op8_tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"))
    assert manifest.select("range").distinct().count() > 3
    got = sorted(op8_tokens.read_blocks(manifest, folder).collect(), key=lambda r: r.start)
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order) and len(order) == len(rows)
    sizes = Counter((i, len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == sizes
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]


# --- 6
def brute_rules(text):
    words = text.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    n = len(words)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    inside = {i + k for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    longest = [max((next((k for k in range(n) if max(i, j) + k >= n or words[i + k] != words[j + k]), n) for j in range(n) if j != i), default=0) for i in range(n)]
    covered = {i + k for i in range(n) if longest[i] >= op6_rules.LEAST for k in range(longest[i])}
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), longest, len(covered)


def test_rules_against_brute_force(docs, texts, no_docs):
    rng = random.Random(2)
    cases = [t or "" for _, t in texts if len(t or "") < 3000] + [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["a # b\vc|d\n\na # b\vc|d\n x"]
    for text in cases:
        n, chars, symbols, lines, repeated, longest, covered = brute_rules(text)
        got = op6_rules.measures(text)
        assert got[:5] == (n, chars, symbols, lines, repeated)
        assert got[5] == (n < 50 or 100 * repeated > 50 * n)
        assert got[6] == max(longest, default=0) and got[7] == (covered / n if n else 0.0)
    out = {r.doc_id: r.rules for r in op6_rules.judge(docs).collect()}
    assert out[57].base_failed and not out[57].kept and out[46].n_words == 0
    assert op6_rules.judge(no_docs).collect() == []


def test_long_repeats_with_few_ranks_held(monkeypatch):
    rng = np.random.default_rng(6)
    cases = [rng.integers(0, 3, 500), np.zeros(700, np.int64), np.tile(rng.integers(0, 50, 90), 9), rng.permutation(400)]
    want = [op6_rules.longest_repeats(x) for x in cases]
    monkeypatch.setattr(op6_rules, "LARGE", 10)
    assert all((op6_rules.longest_repeats(x) == y).all() for x, y in zip(cases, want, strict=True))
    assert want[1].tolist() == [699, *range(699, 0, -1)]


# --- 7
def brute_classes(rows):
    def shingles(text):
        w = (text or "").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    links = [{j for j, (_, y) in enumerate(sets) if j != k and x and len(x & y) >= 0.8 * len(x | y)} for k, (_, x) in enumerate(sets)]
    root = components([(a, b) for a, x in enumerate(links) for b in x])
    groups = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        groups[root.get(k, k)].append(i)
    return Counter((i, min((x for x in groups[root.get(k, k)] if x is not None), default=None), len(links[k])) for k, (i, _) in enumerate(sets))


def test_similar_texts_against_brute_force(docs, texts, no_docs):
    assert Counter(tuple(r) for r in op7_jaccard.similar_texts(docs).collect()) == brute_classes(texts)
    assert op7_jaccard.similar_texts(no_docs).collect() == []


def test_similar_texts_in_a_large_group(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"v{rng.randint(0, 9999)}" for _ in range(80))) for i in range(20)]
    monkeypatch.setattr(op7_jaccard, "BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in op7_jaccard.similar_texts(df).collect()) == brute_classes(rows)
    assert op7_jaccard.shortest_prefix() == 4


def test_one_id_on_many_different_texts(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for g in range(40):
        base = [f"g{g}w{rng.randint(0, 999)}" for _ in range(60)]
        for i in range(10):
            words = list(base)
            words[rng.randrange(5, 55)] = f"new{i}"
            rows.append((7 if g % 2 else None, " ".join(words)))
    rows += rows[:30] * 3
    seen = []
    monkeypatch.setattr(op7_jaccard, "_own_sets", lambda texts, f=op7_jaccard._own_sets: (seen.append(texts.count()), f(texts))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in op7_jaccard.similar_texts(df).collect()) == brute_classes(rows)
    assert seen == [400]  # a row for each different set, none for each pair of rows of the id


def test_prefixes_across_parts(spark):
    rng = np.random.default_rng(3)
    flat, deep = 4, op7_jaccard.DEEP
    paths = [bytes([int(t)]) + rng.integers(0, 2, deep).astype(">u4").tobytes() for t in rng.integers(0, 3, 400)]
    sets = spark.createDataFrame([(i.to_bytes(2, "big"), [p]) for i, p in enumerate(paths)], "sid binary, paths array<binary>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = op7_jaccard._matched(sets, flat).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ends = sorted((r for r in rows if r.depth < 0), key=lambda r: (r.part, -r.depth))
    assert len({r.part for r in ends}) > 1
    pairs = {(r.depth, bytes(r.a), bytes(r.b)) for r in rows if r.depth > 0} | {(d, a, b) for d, _, a, b in op7_jaccard.across_parts(ends, flat)}
    lcp = lambda x, y: next((k for k in range(deep) if x[: 5 + 4 * k] != y[: 5 + 4 * k]), deep)
    own = {i.to_bytes(2, "big"): p for i, p in enumerate(paths)}
    assert all(lcp(own[a], own[b]) >= d for d, a, b in pairs)
    for depth in range(flat, deep + 1):
        linked = components([(a, b) for d, a, b in pairs if d >= depth])
        nodes = defaultdict(set)
        for i, p in own.items():
            nodes[p[: 1 + 4 * depth]].add(linked.get(i, i))
        assert all(len(x) == 1 for x in nodes.values())


def test_recall_of_short_texts(spark):
    rng = random.Random(31)
    rows = []
    for i in range(1500):
        words = [f"w{rng.randint(0, 10**9)}" for _ in range(13)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]  # 8 of 10 shingles in common
    got = {r.doc_id: r.class_id for r in op7_jaccard.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), count_links=False).collect()}
    assert sum(got[2 * i + 1] != 2 * i for i in range(1500)) <= 5


# --- 9
def test_language_id(spark, docs, no_docs):
    rng = random.Random(6)
    sounds = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["eau", "que", "oi"]}
    rows = [(i, lang, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(40))) for i in range(90) for lang in [sorted(sounds)[i % 3]]]
    df = spark.createDataFrame([*rows, (900, None, "x"), (901, "aa", None)], "doc_id long, lang string, text string")
    profiles = op9_langid.learn(df.where("doc_id < 60 or doc_id >= 900"))
    got = op9_langid.identify(df.where("doc_id between 60 and 89"), profiles).collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in op9_langid.identify(docs, profiles).collect()}
    assert odd[46] == odd[47] == odd[48] == odd[52] == ("und", 0.0)
    assert {r.lang_pred for r in op9_langid.identify(docs, op9_langid.learn(no_docs)).collect()} == {"und"}
    none = spark.createDataFrame([(i, t) for i, t in enumerate(["\u00b2\u00b3\u00bd", "\u2460\u2461", "\u2167 _ 12", "\u0301"])], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in op9_langid.identify(none, profiles).collect()} == {("und", 0.0)}


def test_language_id_against_brute_force(spark):
    rng = random.Random(16)
    sounds = {"aa": "kato", "bb": "mire", "cc": "sulo"}
    rows = [(i, lang, " ".join("".join(rng.choice(sounds[lang] + "xe") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 300)))) for i in range(60) for lang in [sorted(sounds)[i % 3]]]
    rows += [(100, "aa", rows[0][2]), (100, "aa", rows[0][2]), (101, "bb", "zz zz"), (102, "cc", "ka" * 20_000)]

    def grams(text):
        words = f" {' '.join(text.split())} "
        return [words[i : i + n] for n in (1, 2, 3) for i in range(len(words) - n + 1) if words[i : i + n] != " " and (n < 3 or words[i + 1] != " ")]

    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    mixed = lambda c: c * 0x9E3779B97F4A7C15 % (1 << 64)
    profiles = {}
    for lang in sounds:
        n = Counter(code(g) for _, own, t in rows if own == lang for g in grams(t))
        profiles[lang] = {c: k for k, c in enumerate(sorted(n, key=lambda c: (-n[c], c))[:300])}

    def predict(text):
        n = Counter(map(code, grams(text)))
        own = sorted(n, key=lambda c: (-n[c], mixed(c)))[:300]
        far = {lang: sum(abs(p[c] - k) if c in p else 300 for k, c in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        return best, round(1 - far[best] / (300 * len(own)), 9)

    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in op9_langid.identify(df, op9_langid.learn(df)).collect())
    assert got == Counter((i, *predict(t)) for i, _, t in rows)


# --- 10
def test_archives_of_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    assert op10_warc.op10_warc(spark, f"file://{tmp_path}").collect() == []


def test_archives(spark):
    rows = [(1, "http://a/ b\r\n", "<p>é"), (2, None, "<p>é"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "z" * 200_000), (9, "http://f", "<p>é"), (9, "http://f", "<p>é"), (None, "http://g", "<p>é"), (None, "http://h", "alone")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, _original string, _first string").repartition(3)
    scratch = Scratch(spark, "t")
    files = scratch.table(op10_warc.write_archives(op10_warc.with_originals(pages, scratch), scratch.path("a")), "m")
    back = op10_warc.read_archives(spark, manifest=files._scratch_path)
    got = Counter((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in back.collect())
    first = {"<p>é": 9, "": 4}
    want = Counter()
    for i, _, html in rows:
        data, of = (html or "").encode(), first.get(html or "")
        revisit = of is not None and of != i
        want[f"urn:page:{'' if i is None else i}", "revisit" if revisit else "response", f"urn:page:{of}" if revisit else None, len(data), warc.digest(data)] += 1
    assert got == want
    assert {r.payload for r in back.where("record_type = 'response'").select("payload").collect()} == {b"", "<p>é".encode(), b"z" * 200_000, b"alone"}
    plan = back.where("record_type = 'revisit' and target_uri like 'http://a%'")
    assert [r.target_uri for r in plan.collect()] == ["http://a/%20b%0D%0A"]
    assert plan.where("payload is not null").count() == 0
    empty = scratch.table(op10_warc.write_archives(op10_warc.with_originals(pages.limit(0), scratch), scratch.path("a")), "m")
    assert op10_warc.read_archives(spark, manifest=empty._scratch_path).collect() == []


def test_reader_stops_after_the_headers():
    import io

    class Counted(io.BytesIO):
        got = 0

        def read(self, n=-1):
            data = super().read(n)
            Counted.got += len(data)
            return data

    rng = random.Random(4)
    data = b"".join(warc.member(warc.record(f"urn:page:{i}", None, rng.randbytes(6_000_000))) for i in range(3))
    assert [int(warc._parsed(b)["content-length"]) for _, b in warc.records(Counted(data), whole=False)] == [6_000_000] * 3
    assert Counted.got < len(data) / 3


def test_reader_skips_what_is_not_wanted(tmp_path):
    import io

    data = [warc.record(f"urn:page:{i}", None, b"q" * 10_000 * i, "urn:page:0" if i == 2 else None) for i in range(4)]
    for packed in (b"".join(map(warc.member, data)), b"".join(data)):
        assert [h["warc-record-id"] for h, _ in warc.records(io.BytesIO(packed))] == [f"<urn:page:{i}>" for i in range(4)]
        assert [len(b.partition(b"\r\n\r\n")[2]) for _, b in warc.records(io.BytesIO(packed), lambda h: h["warc-type"] == "response")] == [0, 10_000, 30_000]
    for packed in (b"".join(map(warc.member, data)), b"".join(data)):
        tops = [b for _, b in warc.records(io.BytesIO(packed), whole=False)]
        assert [int(warc._parsed(b)["content-length"]) for b in tops] == [0, 10_000, 20_000, 30_000] and all(b.endswith(b"\r\n\r\n") for b in tops)
    with pytest.raises(ValueError, match="Content-Length"):
        list(warc.records(io.BytesIO(data[1].replace(b"\r\nContent-Length: 10069", b"\r\nContent-Length: many").replace(b"\r\nContent-Length: 100", b"\r\nContent-Length: x100"))))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(io.BytesIO(warc.member(data[1])[:-20])))
