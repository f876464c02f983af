"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline
import pytest


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    english, german = ["".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(3)) for _ in range(300)], ["".join(rng.choice(["sch", "ung", "ein", "ver", "ich"]) for _ in range(3)) for _ in range(300)]
    rows = [(i, prose(rng, 150, english if i % 2 else german), "en" if i % 2 else "de") for i in range(40)]
    near = rows[3][1].split()
    near[70] = "changed"
    rows += [(50, rows[2][1], "de"), (51, " ".join(near), "en"), (52, "again and again " * 60, "en"), (53, None, "en"), (54, "12345 ... " * 60, "en"), (55, "too short", "en")]
    passage = prose(rng, 60, english)
    rows += [(60 + i, f"{prose(rng, 90, english)}\n{passage}", "en") for i in range(4)]
    path = tmp_path_factory.mktemp("corpus")
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"file://{path}/documents.parquet")
    return str(path), rows, passage


def test_stages(spark, corpus):
    path, rows, passage = corpus
    docs = spark.read.parquet(f"file://{path}/documents.parquet")
    kept, last = {}, None
    for name, stage in corpus_pipeline.STAGES:
        last = stage(spark, docs, f"file://{path}").cache()
        if name != "best_fit_packing":
            assert last.columns == docs.columns
            kept[name] = {r.doc_id: r for r in last.collect()}
            docs = last
    clean = {i for i, *_ in rows if i < 40} | {60, 61, 62, 63}
    assert set(kept["language_id"]) == {i for i, *_ in rows} - {53, 54}
    assert set(kept["quality_rules"]) == clean | {50, 51}
    assert set(kept["line_dedup"]) == clean
    assert sum(passage in r.text for r in kept["line_dedup"].values()) == 1
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"].values())
    assert set(kept["ngram_jaccard"]) == clean
    pieces = last.collect()
    assert {r.doc_id for r in pieces} == clean and all(r.offset + r.length <= 2048 for r in pieces)


def test_near_copies_leave_one(spark, corpus):
    path, _, _ = corpus
    docs = spark.read.parquet(f"file://{path}/documents.parquet")
    out = {r.doc_id for r in corpus_pipeline.ngram_jaccard(spark, docs, path).collect()}
    assert {2, 3} <= out and not {50, 51} & out


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(400)]
    shared, texts = prose(rng, 20, words), [prose(rng, 60, words) for _ in range(6)]
    rows = [(None, f"{shared}\n{texts[0]}"), (None, f"{texts[1]}\n{shared}"), (None, f"{shared}\n{texts[2]}"), (7, f"{texts[3]}\n{shared}"), (7, f"{shared}\n{texts[4]}"), (None, texts[5]), (None, texts[5]), (7, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()]
    assert sorted(line for text in out for line in text.split("\n")) == sorted([shared, *texts])
    copies = spark.createDataFrame([(None, texts[0]), (None, texts[0]), (7, texts[1]), (7, texts[2]), (3, texts[2]), (9, texts[0]), (5, texts[3]), (5, texts[3])], "doc_id long, text string")
    out = sorted((r.doc_id, r.text) for r in corpus_pipeline.ngram_jaccard(spark, copies, "").collect())
    assert out == sorted([(9, texts[0]), (7, texts[1]), (3, texts[2]), (5, texts[3])])


def test_run_equals_its_stages(spark, corpus):
    path, _, _ = corpus
    docs = spark.read.parquet(f"file://{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, f"file://{path}").cache()
    piece = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(piece, corpus_pipeline.run(spark, f"file://{path}").collect())) == sorted(map(piece, docs.collect()))


def test_near_copies_that_share_no_line(spark):
    """Copies cut into other lines, with a word changed in each: no two lines are alike, so line dedup keeps all and the join finds them."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    rows, cut = [], lambda text, n: "\n".join(" ".join(text[i : i + n]) for i in range(0, len(text), n))
    for k in range(5):
        text = [rng.choice(words) for _ in range(240)]
        near = list(text)
        near[100] = "changed"
        rows += [(2 * k, cut(text, 40)), (2 * k + 1, cut(near, 23))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lines = corpus_pipeline.line_dedup(spark, docs, "")
    assert lines.count() == 10
    assert sorted(r.doc_id for r in corpus_pipeline.ngram_jaccard(spark, lines, "").collect()) == [0, 2, 4, 6, 8]


def test_stages_on_nothing_and_on_clashing_names(spark, tmp_path):
    names = "__row long, __gone string, _id long, sid string, lang_pred string, kept boolean, rules string, score double, class_id long, lid string, line string, band long"
    empty = spark.createDataFrame([], f"doc_id long, text string, lang string, source string, n_chars long, {names.removeprefix('__row long, __gone string, ')}")
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.count() == 0
    rng = random.Random(3)
    text = prose(rng, 120, ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)])
    columns = [c.split()[0] for c in names.split(", ")][2:]
    rows = [(1, text, "en", "s", len(text), *[None] * len(columns)), (None, None, None, None, None, *[None] * len(columns)), (2, "", "en", "s", 0, *[None] * len(columns))]
    docs = spark.createDataFrame(rows, empty.schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, f"file://{tmp_path}")
        if name != "best_fit_packing":
            assert docs.columns == empty.columns
    assert {r.doc_id for r in docs.collect()} == {1}
