"""Line dedup by MinHash, with DataFrame operations only.

A line's shingles are all its windows of `WINDOW` characters, one from every
character that has so many from it on.  A line shorter than a window is one
shingle.  Twelve characters are about two words: unlike lines of one language
share less than a thousandth of such windows (measured), so that buckets hold
hardly any chance pairs however many lines there are.

1. Lines are told apart by a 128-bit digest; exact copies are one class.
2. A signature has `BANDS * ROWS` minima of the shingles' 64-bit hashes, each
   under an own rotation of the bits and an exclusive or with a random word.
3. Lines that agree in a whole band form a bucket.  Each is compared with the
   least line of its bucket; links join components (union-find).  In buckets of
   more than `CROWD` lines, every line outside the bucket's largest component is
   compared with `CENTRES` more of its lines.
4. Where buckets still hold several components, their other lines have met only
   the centre.  Those of buckets with at most `CROWD` lines all meet those of other
   components, first by their minima; those of larger ones meet lines of other
   components that share one of their rarest shingles, which similar lines must
   (prefix filter).  So a large group of near copies costs a few comparisons a
   line, and lines that share a frequent passage never meet for that.
5. One line of each component stays: the first by document and line number.

At a similarity of 0.8 a pair shares a bucket with probability
1 - (1 - 0.8^3)^10 = 0.9992; simulated with these rotations, 0.9990 to 0.9995 for
unions of 5 to 200 shingles.  Pairs that agree in at most `UNLIKE` of the 30 minima
aren't compared: at 0.8 that loses a pair with a probability below 0.00002.

Nulls and empty texts: lines of null texts don't exist; blank lines belong to no
class and are kept.  Ties: among lines of one place the least row key stays.
Repeated rows: see `dedup_lines`.  An empty table gives an empty one; only the id
and the text column are read, so other columns may have any names.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, read, smaller_side
from .components import connected_components

WINDOW, BANDS, ROWS, SIMILARITY = 12, 10, 3, 0.8
#: Sequences of places are made for pieces of a line with this many windows; so many windows are hashed in one row.
PIECE, STEP = 4096, 8
#: Buckets with more lines than this get so many more centres; in smaller ones the minima of all lines are compared.
CROWD, CENTRES = 128, 4
#: Pairs with so few minima in common aren't similar.
UNLIKE = 13
#: The columns of a sketch: a byte of each minimum, eight to a number.
SKETCH = [f"s{k}" for k in range((BANDS * ROWS + 7) // 8)]
#: Of a line's rarest shingles so many go along, to tell which is the first that two lines share.
FIRST = 32
#: Numbers of lines that go and keys of their documents are broadcast up to this many, else joined by a shuffle.
GONE = 2_000_000


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, row, line_no, line, lid): the non-blank lines; lid is the digest of the line, row the key of the document's row (0 without one)."""
    cut = docs.select(F.col(id_col).alias("doc_id"), (F.col(row_col) if row_col else F.lit(0)).cast("long").alias("row"), F.posexplode_outer(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    return cut.where(r"line rlike '\\S'").withColumn("lid", F.unhex(F.md5("line")))


def _windows(code: Column) -> Column:
    """How many windows there are in a line encoded with four bytes a character."""
    return F.greatest(F.shiftright(F.octet_length(code), 2) - (WINDOW - 1), F.lit(1))


def _hash_at(code: Column, place: Column) -> Column:
    """The hash of the window from a place (from 0) of an encoded line."""
    return F.xxhash64(F.substring(code, place * 4 + 1, F.lit(4 * WINDOW)))


def _hashes(line: Column) -> Column:
    """The hashes of all windows of a line."""
    coded = F.array(F.encode(line, "UTF-32"))  # a lambda's variable is evaluated once
    places = lambda c: F.sequence(F.lit(1), F.greatest(F.octet_length(c) - (4 * WINDOW - 1), F.lit(1)), F.lit(4))
    return F.transform(coded, lambda c: F.transform(places(c), lambda i: F.xxhash64(F.substring(c, i, F.lit(4 * WINDOW)))))[0]


def shingles(line: Column) -> Column:
    """The hashes of a line's different shingles."""
    return F.array_distinct(_hashes(line))


def _hashed(lines: DataFrame) -> DataFrame:
    """(lid, h0, h1, ...): the hashes of a line's windows, `STEP` in a row; the last row repeats the last window."""
    # an exploded struct is made once; plain columns beside an exploded one would be evaluated for every row of it
    # explode_outer: explode would make the optimizer evaluate the array once more, as a filter
    coded = lines.select(F.explode_outer(F.array(F.struct("lid", F.encode("line", "UTF-32").alias("code")))).alias("x")).select("x.lid", "x.code")
    at = F.sequence(F.lit(0), _windows(F.col("code")) - 1, F.lit(PIECE))
    piece = lambda i: F.struct("lid", F.substring("code", i * 4 + 1, F.lit(4 * (PIECE + WINDOW - 1))).alias("piece"))
    pieces = coded.select(F.explode_outer(F.transform(at, piece)).alias("x")).select("x.lid", "x.piece")
    places = pieces.select("lid", "piece", F.explode_outer(F.sequence(F.lit(0), F.least(F.lit(PIECE), _windows(F.col("piece"))) - 1, F.lit(STEP))).alias("at"))
    last = F.least(F.lit(PIECE), _windows(F.col("piece"))) - 1
    return places.select("lid", *[_hash_at(F.col("piece"), F.least(F.col("at") + j, last)).alias(f"h{j}") for j in range(STEP)])


def _signatures(lines: DataFrame) -> DataFrame:
    """(lid, m0, m1, ...): the minima of each different line."""
    rng = random.Random(20)

    def least(i: int) -> Column:
        turn, word = 1 + 2 * i, rng.getrandbits(64) - (1 << 63)
        turned = [F.shiftleft(h, turn).bitwiseOR(F.shiftrightunsigned(h, 64 - turn)).bitwiseXOR(F.lit(word)) for h in (F.col(f"h{j}") for j in range(STEP))]
        return F.min(F.shiftright(F.least(*turned), 32)).alias(f"m{i}")

    return _hashed(lines).groupBy("lid").agg(*[least(i) for i in range(BANDS * ROWS)])


def signed(lines: DataFrame) -> DataFrame:
    """(lid, bands, s0, s1, ...): of each different line the keys of its bands, and its sketch."""
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)])
    byte = lambda i: F.shiftleft(F.col(f"m{i}").bitwiseAND(0xFF), i % 8 * 8)
    words = [reduce(Column.bitwiseOR, [byte(i) for i in range(8 * k, min(8 * k + 8, BANDS * ROWS))]).alias(c) for k, c in enumerate(SKETCH)]
    return _signatures(lines).select("lid", bands.alias("bands"), *words)


def _sketch(known: DataFrame, side: str) -> DataFrame:
    """(a, as0, as1, ...): the sketches by id, with a letter before each name."""
    return known.select(F.col("id").alias(side), *[F.col(c).alias(side + c) for c in SKETCH])


def _agree() -> Column:
    """Whether the sketches of a and b have more than `UNLIKE` minima in common: bytes that differ are gathered to a bit each and counted."""

    def unlike(word: Column) -> Column:
        for n in (4, 2, 1):
            word = word.bitwiseOR(F.shiftrightunsigned(word, n))
        return F.bit_count(word.bitwiseAND(0x0101010101010101))

    return reduce(Column.__add__, [unlike(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in SKETCH]) < BANDS * ROWS - UNLIKE


def _likely(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches agree."""
    return pairs.join(_sketch(known, "a"), "a").join(_sketch(known, "b"), "b").where(_agree()).select("a", "b")


def _rare_prefixes(lines: DataFrame, similarity: float) -> DataFrame:
    """(id, comp, seeks, h, place, size, first): of each line, the rarest shingles among `lines`, so many that a similar line has one of its own rarest among them.

    Two sets with Jaccard similarity s have s of each in common; so if either's
    shingles are put in one order, the first n - ceil(s n) + 1 of both meet.
    A shingle that one line alone has, or none that seeks, meets nothing: such are
    counted, not ranked.
    first holds the `FIRST` rarest of these, in order.
    """
    held = lines.withColumn("hs", shingles(F.col("line"))).select("id", "comp", "seeks", F.size("hs").alias("size"), "hs")
    each = held.select("id", "comp", "seeks", "size", F.explode_outer("hs").alias("h"))
    # counted where it lies, by shingle: a join with the counts would make every row once more
    here = W.partitionBy("h")
    shared = each.withColumn("df", F.count("*").over(here)).withColumn("met", F.max("seeks").over(here)).where("df > 1 and met")
    ranked = shared.withColumn("turn", F.row_number().over(W.partitionBy("id").orderBy("df", "h"))).withColumn("place", F.col("turn") + F.col("size") - F.count("*").over(W.partitionBy("id")))
    prefix = ranked.where(F.col("place") <= F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9) + 1)
    first = F.collect_list(F.when(F.col("turn") <= FIRST, F.struct("turn", "h"))).over(W.partitionBy("id"))
    return prefix.select("id", "comp", "seeks", "h", "place", "size", F.transform(F.array_sort(first), lambda x: x["h"]).alias("first"))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose lines have at least that Jaccard similarity of shingles."""
    x, y = (texts.select(F.col("id").alias(k), F.col("line").alias(f"{k}line"), F.col("size").alias(f"{k}size")) for k in "ab")
    near = pairs.join(x, "a").join(y, "b").where(F.least("asize", "bsize") >= F.lit(similarity) * F.greatest("asize", "bsize") - 1e-9)
    # texts are shuffled and the hashes made here: they are many times larger than their text.  What is exploded is made once, and sets meet in generated code
    made = near.select("a", "b", (F.col("asize") + F.col("bsize")).alias("all"), F.explode_outer(F.array(F.struct(_hashes(F.col("aline")).alias("x"), _hashes(F.col("bline")).alias("y")))).alias("p"))
    return made.where(F.size(F.array_intersect("p.x", "p.y")) * F.lit(1 + similarity) >= F.lit(similarity) * F.col("all") - 1e-9).select("a", "b")


def _labelled(banded: DataFrame, comps: DataFrame) -> DataFrame:
    """(band, id, comp) of the lines of buckets."""
    return banded.select("band", "id").join(comps, "id", "left").select("band", "id", F.coalesce("comp", "id").alias("comp"))


def _crowd_links(crowds: DataFrame, comps: DataFrame, known: DataFrame, texts: DataFrame, similarity: float, turn: int, scratch: Scratch) -> DataFrame:
    """Links of the lines outside their bucket's largest component with another line of that, another one each turn."""
    labelled = scratch.table(_labelled(crowds, comps), "crowds")
    parts = labelled.groupBy("band", "comp").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("order"), "id"))["id"].alias("centre"))
    centres = parts.groupBy("band").agg(F.max(F.struct("n", "comp", "centre")).alias("most"), F.count("*").alias("comps")).where("comps > 1").select("band", F.col("most.comp").alias("main"), F.col("most.centre").alias("b"))
    centres = scratch.table(centres, "centres")
    pairs = labelled.join(smaller_side(centres), "band").where("comp <> main").select(F.col("id").alias("a"), "b").distinct()
    found = scratch.table(_verified(_likely(pairs, known), texts, similarity), "links")
    scratch.drop(labelled, centres)
    return found


def _mixed(banded: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, id, comp) of the buckets that without their centre, which has met every line of them, hold several components."""
    met = scratch.table(_labelled(banded.where("id <> first"), comps), "met")
    mixed = scratch.table(met.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band"), "mixed")
    out = scratch.table(met.join(smaller_side(mixed), "band"), "mixed")
    scratch.drop(met, mixed)
    return out


def _few_links(mixed: DataFrame, known: DataFrame, texts: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """The links among lines of different components of buckets with at most `CROWD` lines: each meets fewer than `CROWD` others, and only pairs whose sketches agree are made."""
    held = scratch.table(mixed.join(known.select("id", *SKETCH), "id"), "few")
    x, y = (held.select("band", F.col("id").alias(k), *[F.col(c).alias(k + c) for c in ("comp", *SKETCH)]) for k in "ab")
    pairs = x.join(y, (x["band"] == y["band"]) & (F.col("a") > F.col("b")) & (F.col("acomp") != F.col("bcomp")) & _agree()).select("a", "b").distinct()
    found = scratch.table(_verified(pairs, texts, similarity), "links")
    scratch.drop(held)
    return found


def _seeking(mixed: DataFrame) -> DataFrame:
    """(id, comp, seeks) of the lines of buckets: whether a line is outside the largest component of one of its buckets."""
    most = mixed.groupBy("band", "comp").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"))
    return mixed.join(most, "band").groupBy("id", "comp").agg(F.max(F.col("comp") != F.col("main")).alias("seeks"))


def _rest_links(mixed: DataFrame, known: DataFrame, texts: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """The links that no comparison with a centre shows in larger buckets, as pairs of lines that share a rare shingle.

    Of two lines of a bucket that are of different components one at least seeks;
    so the many lines of a largest component never meet each other.
    """
    left = scratch.table(_seeking(mixed), "rest")
    prefixes = scratch.table(_rare_prefixes(texts.drop("size").join(left, "id"), similarity).join(known.select("id", *SKETCH), "id"), "prefixes")
    x, y = (prefixes.select("h", *[F.col(c).alias(k + c) for c in ("id", "comp", "seeks", "place", "size", "first", *SKETCH)]) for k in "ab")
    # the conditions are met inside the join: pairs of one component, of too different sizes, with unlike sketches, or with too few shingles from this place on, are never made
    after = 1 + F.least(F.col("asize") - F.col("aplace"), F.col("bsize") - F.col("bplace"))
    apart = (after >= F.lit(similarity / (1 + similarity)) * (F.col("asize") + F.col("bsize")) - 1e-9) & (F.col("acomp") != F.col("bcomp")) & (F.least("asize", "bsize") >= F.lit(similarity) * F.greatest("asize", "bsize") - 1e-9) & _agree()
    # two that seek meet once
    apart = apart & (~F.col("bseeks") | (F.col("aid") > F.col("bid")))
    # and of the rarest shingles that two lines share only the first makes the pair
    once = F.coalesce(F.get(F.array_intersect("afirst", "bfirst"), F.lit(0)) == F.col("x.h"), F.lit(True))
    pairs = x.where("aseeks").alias("x").join(y.alias("y"), (F.col("x.h") == F.col("y.h")) & apart & once).select(F.col("aid").alias("a"), F.col("bid").alias("b")).distinct()
    found = scratch.table(_verified(pairs, texts, similarity), "links")
    scratch.drop(left, prefixes)
    return found


def _joined(comps: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The components after more links."""
    return connected_components(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")).union(links), scratch)


def line_classes(lines: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> DataFrame:
    """(lid, class) of the different lines that have a near copy; class is the digest of one line of the component."""
    own = scratch.table(signed(lines).withColumn("id", F.monotonically_increasing_id()), "signed")
    each = own.select("id", F.explode_outer("bands").alias("band"))
    shared = scratch.table(each.groupBy("band").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "shared")
    banded = scratch.table(each.join(smaller_side(shared), "band"), "buckets")
    wanted = scratch.table(own.select("id", "lid", *SKETCH).join(smaller_side(banded.select("id").distinct()), "id", "left_semi"), "wanted")
    # one more pass over the texts, for those of the candidates, with their numbers of different shingles
    texts = scratch.table(lines.select("lid", "line").join(smaller_side(wanted.select("id", "lid")), "lid").select("id", "line").dropDuplicates(["id"]).withColumn("size", F.size(shingles(F.col("line")))), "texts")
    star = banded.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    links = scratch.table(_verified(_likely(star, wanted), texts, similarity), "links")
    comps = connected_components(links, scratch)
    crowds = scratch.table(banded.where(F.col("n") > CROWD).select("band", "id"), "crowded")
    for turn in range(CENTRES if crowds.take(1) else 0):
        more = _crowd_links(crowds, comps, wanted, texts, similarity, turn, scratch)
        if not more.take(1):
            break
        comps = _joined(comps, more, scratch)
    for links_of, some in ((_few_links, F.col("n") <= CROWD), (_rest_links, F.col("n") > CROWD)):
        mixed = _mixed(banded.where(some), comps, scratch)
        more = links_of(mixed, wanted, texts, similarity, scratch) if mixed.take(1) else mixed
        if more.take(1):
            comps = _joined(comps, more, scratch)
        scratch.drop(mixed)
    known = wanted.select("id", "lid")
    out = comps.join(known, "id").select("lid", "comp").join(known.select(F.col("id").alias("comp"), F.col("lid").alias("class")), "comp").select("lid", "class")
    out = scratch.table(out, "classes")
    scratch.drop(own, shared, banded, wanted, texts, crowds)
    return out


def _decided(docs: DataFrame, id_col: str, text_col: str, similarity: float, row_col: str | None = None) -> DataFrame:
    """(doc_id, row, line_no, keep): each line and the one (doc_id, row, line_no) that stays for its component."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = lines_of(docs, id_col, text_col, row_col)
    classes = line_classes(lines, scratch, similarity)
    at = lines.select("doc_id", "row", "line_no", "lid").join(smaller_side(classes), "lid", "left").select("doc_id", "row", "line_no", F.coalesce("class", "lid").alias("class"))
    at = scratch.table(at, "places")
    # most lines are alone in their class; of the others, a row a class.  Counts are hashed, while the least places are sorted: so they are taken of those lines alone
    counts = scratch.table(at.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class"), "counts")
    several = at.join(smaller_side(counts), "class", "left_semi").groupBy("class").agg(F.min(F.struct("doc_id", "row", "line_no")).alias("keep"))
    several = scratch.table(several, "several")
    return at.join(smaller_side(several), "class", "left").select("doc_id", "row", "line_no", F.coalesce("keep", F.struct("doc_id", "row", "line_no")).alias("keep"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per non-blank line: doc_id, line_no (from 0), keep_doc_id, keep_line_no, kept.

    The keep columns name the line that stays for the component.  Repeated rows of
    one document id are told apart by nothing, so their lines of one number are
    all kept or all dropped.  Null ids come before all others.
    """
    out = _decided(docs, id_col, text_col, similarity).select("doc_id", "line_no", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").alias("keep_line_no"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("line_no") == F.col("keep_line_no")))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the lines that `dedup_lines` doesn't keep; all columns stay.

    A document all of whose lines repeat lines of others goes; one that had no
    non-blank line stays as it is.  Every row has a key of its own, so rows that
    repeat an id, or have none, are different documents; the least key breaks ties.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = scratch.table(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    other = (F.col("row") != F.col("keep.row")) | (F.col("line_no") != F.col("keep.line_no"))
    gone = _decided(rows, id_col, text_col, SIMILARITY, "__row").where(other).groupBy("row").agg(F.collect_list("line_no").alias("__gone"))
    gone = scratch.table(gone, "gone")
    # a number for each line that goes, a key for each document: broadcast below a bound, else joined by a shuffle
    if (gone.agg(F.sum(F.size("__gone") + 8).alias("n")).first()["n"] or 0) <= GONE:
        gone = F.broadcast(gone)
    held = rows.join(gone.withColumnRenamed("row", "__row"), "__row", "left")
    cut = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    held = held.withColumn("__cut", F.when(F.col("__gone").isNotNull(), cut))
    return held.where(r"__cut is null or __cut rlike '\\S'").withColumn(text_col, F.coalesce("__cut", text_col)).select(*docs.columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents"))
