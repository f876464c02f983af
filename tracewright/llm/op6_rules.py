"""Quality rules on the repetition inside a text, by a suffix array of its words.

The suffix array comes from prefix doubling; the ranks of each doubling give the
longest common prefix of neighbouring suffixes, and so for each word the longest
repeat that begins there (the deepest common-prefix interval that holds it).
Repeats of `LEAST` words or more are united; a text fails if they cover more than
`MOST_COVERED` of its words, or if one repeat has more than `MOST_LONG` words and
more than `LONG_SHARE` of the text.

Null and empty texts have no words, and fail by the base rule.  Words are split at
the six ASCII blanks.  Equal words are one symbol; a repeat counts wherever it
occurs, overlapping itself too, so there are no ties to break.  Repeated rows are
each judged, alike; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

LEAST, MOST_COVERED, MOST_LONG, LONG_SHARE = 6, 0.4, 50, 0.2
LARGE = 1 << 20
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, longest_repeat long, covered double, kept boolean"
)


def _doubled(rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ranks by 2 k symbols, suffixes in that order) from ranks by k symbols."""
    n = len(rank)
    key = np.zeros(n, np.int64)
    if k < n:
        key[: n - k] = rank[k:] + np.int64(1)
    key += rank * np.int64(n + 1)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.empty(n, np.int32)
    new[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
    return new, order


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest substring from there that occurs elsewhere too.

    The ranks of a text of more than `LARGE` symbols are held for every fourth
    doubling alone, and made again from those, so memory stays in proportion.
    """
    n = len(symbols)
    if n < 2:
        return np.zeros(n, np.int64)
    held, every = {}, 4 if n > LARGE else 1
    rank, level = symbols.astype(np.int32), 0
    while True:
        if level % every == 0:
            held[level] = rank
        rank, order = _doubled(rank, 1 << level)
        level += 1
        if rank[order[-1]] == n - 1:
            break
    i, j = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for base in sorted(held, reverse=True):
        run = [held.pop(base)]
        while base + len(run) < min(base + every, level):
            run.append(_doubled(run[-1], 1 << (base + len(run) - 1))[0])
        while run:
            ranks = np.append(run.pop(), -1)
            same = (ranks[i] == ranks[j]).astype(np.int64) << (base + len(run))
            common += same
            i += same
            j += same
    out = np.zeros(n, np.int64)
    out[order[:-1]] = common
    out[order[1:]] = np.maximum(out[order[1:]], common)
    return out


def united(longest: np.ndarray, least: int) -> int:
    """How many places lie in a repeat of at least `least` symbols."""
    starts = np.flatnonzero(longest >= least)
    if not len(starts):
        return 0
    edges = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.subtract.at(edges, starts + longest[starts], 1)
    return int((np.cumsum(edges) > 0).sum())


def measures(text: str | None, least: int = LEAST) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII blanks alone
    n = len(words)
    number: dict[bytes, int] = {}
    repeats = longest_repeats(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n))
    windows = np.minimum(repeats, 3)
    repeated = united(windows, 3)
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    covered = united(repeats, least) / n if n else 0.0
    longest = int(repeats.max()) if n else 0
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    failed = n < 50 or 100 * repeated > 50 * n
    good = covered <= MOST_COVERED and not (longest > MOST_LONG and longest > LONG_SHARE * n)
    return n, chars, sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeated, failed, longest, covered, good and not failed


def rules_of(text: Column) -> Column:
    """The struct n_words ... kept of each text."""

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measures(x) for x in texts], columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return run(text)


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and the struct `rules` (n_words ... kept); a column of that name is replaced."""
    small_batches(docs.sparkSession)
    return docs.withColumn("rules", rules_of(F.col(text_col)))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "rules.*").drop("longest_repeat", "covered")


#: The same by windows of words: repeats of at least k words cover what the repeated windows of k words cover.
ORACLE_SQL = f"""
with w as (select doc_id, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
n as (select *, len(ws) as n, greatest({MOST_LONG + 1}, cast(floor({LONG_SHARE} * len(ws)) as bigint) + 1) as m from w),
g as (select doc_id, k, i, hash(ws[i : i + k - 1]) as g from (select doc_id, ws, n, unnest([3, {LEAST}, m]) as k from n), unnest(range(1, n - k + 2)) as t(i)),
r as (select doc_id, k, i from (select *, count(*) over (partition by doc_id, k, g) as c from g) where c > 1),
c as (select doc_id, k, count(distinct i + j) as covered from r, unnest(range(0, k)) as u(j) where k in (3, {LEAST}) group by doc_id, k),
l as (select doc_id, count(*) - count(distinct x) as dup from (select doc_id, unnest(string_split(text, chr(10))) as x from w) where regexp_matches(x, '[^\\x20\\x09-\\x0D]') group by doc_id),
o as (select n.doc_id, n.n as n_words, length(text) - length(regexp_replace(text, '[^\\x20\\x09-\\x0D]', '', 'g')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(l.dup, 0) as n_dup_lines, coalesce(a.covered, 0) as n_repeat_words, coalesce(b.covered, 0) as often, exists (select 1 from r where r.doc_id = n.doc_id and r.k = n.m) as long_one
  from n left join l using (doc_id) left join c a on a.doc_id = n.doc_id and a.k = 3 left join c b on b.doc_id = n.doc_id and b.k = {LEAST})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and often <= {MOST_COVERED} * n_words and not long_one as kept from o"""
