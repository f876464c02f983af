import random

import pytest

WORDS = ["river", "stone", "light", "garden", "window", "under", "market", "yellow", "silent", "harbor", "winter", "copper", "meadow", "signal", "thread", "candle", "orbit", "velvet", "timber", "lantern"]
CLASHING = "score double, lang_pred string, rules string, held_out string, _id string, _gone string, _key string, _guess string, piece int, sid string, class_id string, lid string, line string, ids string"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) with nulls, blanks, copies, near copies, repeats, odd characters and a long text."""
    rng = random.Random(11)
    rows = [(i, "\n".join(sentence(rng, rng.randint(8, 60)) for _ in range(rng.randint(1, 4)))) for i in range(40)]
    rows += [(40, rows[0][1]), (41, rows[1][1]), (42, rows[2][1].replace("stone", "stones", 1)), (43, rows[3][1] + " extra"), (44, rows[0][1])]
    words = rows[5][1].split()
    words[len(words) // 2] = "changed"
    rows += [(45, " ".join(words)), (46, None), (47, ""), (48, " \n\t "), (49, "one two"), (50, "one two"), (51, "日本語のテキスト 日本語のテキスト"), (52, "!!! ??? ..."), (53, "x" * 5000), (54, sentence(rng, 6000)), (55, "<|endoftext|> it's é É 12 ½\n\n  end ")]
    rows += [(56, rows[7][1]), (56, rows[7][1]), (None, rows[8][1]), (None, None), (57, "same line here again today\n" * 30)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    names = [c.split()[0] for c in CLASHING.split(", ")]
    rows = [(i, t, "en", "s", len(t or ""), *(None for _ in names)) for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
