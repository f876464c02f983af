"""Encode texts with a compiled lexicon: known words by the transducer, the rest by exact merges."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import splitting, transducer
from .bpe import Merges
from .common import small_batches

#: Characters that are taken together; a longer text is cut where no token can span.
CHARS = 1 << 20
_CUT = {True: re.compile(r"\s"), False: re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")}


class Splitter:
    """Words of texts as a tokenizer file's normalizer and pre-tokenizer give them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merges = Merges(path)
        self.lower = self.merges.lower
        self.special = re.compile("|".join(map(re.escape, self.merges.special))) if self.merges.special else None
        self.bytes_of = {c: b for b, c in enumerate(self._letters())}

    @staticmethod
    def _letters() -> list[str]:
        from .bpe import byte_letters

        return byte_letters()

    def batches(self, texts: list[str | None]) -> Iterator[tuple]:
        """The pieces, numbered in order from 0: ("simple", number of each word's piece, code points, starts, ends, text),
        ("words", number, words) and ("id", number, id), and last ("owners", the text of each piece)."""
        part: list[str] = []
        owners: list[int] = []
        size, of = 0, []
        for at, text in enumerate(texts):
            for piece in self._pieces(text or ""):
                i = len(of)
                of.append(at)
                if isinstance(piece, str) and piece and splitting.simple(piece):
                    part.append(piece)
                    owners.append(i)
                    size += len(piece)
                    if size >= CHARS:
                        yield self._simple(part, owners)
                        part, owners, size = [], [], 0
                elif not isinstance(piece, str):
                    yield ("id", i, piece)
                elif piece:
                    yield ("words", i, self._split_by_library(piece))
        if part:
            yield self._simple(part, owners)
        yield ("owners", np.array(of, np.int64))

    def _pieces(self, text: str) -> Iterator[str | int]:
        if self.special and "<|" in text:
            at = 0
            for m in self.special.finditer(text):
                yield from self._cut(text[at : m.start()])
                yield self.merges.special[m[0]]
                at = m.end()
            text = text[at:]
        yield from self._cut(text)

    def _cut(self, text: str) -> Iterator[str]:
        while len(text) > CHARS:
            m = _CUT[self.lower].search(text, CHARS)
            if not m:
                break
            yield text[: m.start()]
            text = text[m.start() :]
        yield text

    def _simple(self, part: list[str], owners: list[int]) -> tuple:
        own = np.array(owners)
        if self.lower:
            text = " ".join(part).lower()
            gap = 1
        else:
            text, gap = "".join(part), 0
        sizes = np.fromiter(map(len, part), np.int64, len(part)) + gap
        begins = np.cumsum(sizes) - sizes
        codes = splitting.code_points(text)
        start, end = splitting.word_split(codes) if self.lower else splitting.byte_split(codes, begins)
        return ("simple", own[np.searchsorted(begins, start, "right") - 1], codes, start, end, text)

    def _split_by_library(self, text: str) -> list[bytes]:
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        of = self.bytes_of
        return [bytes(of[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]


def _hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, for counting; equal words have equal hashes."""
    size = end - start
    order = np.argsort(size.astype(np.uint16) if len(size) and size.max() < 65536 else size, kind="stable")[::-1]
    at, left = start[order], size[order]
    h = np.full(len(order), 1469598103934665603, np.uint64)
    k, m = 0, len(order)
    while m:
        while m and left[m - 1] <= k:
            m = int(np.searchsorted(-left[:m], -k, "left"))
        if not m:
            break
        h[:m] = (h[:m] ^ codes[at[:m] + k]) * np.uint64(1099511628211)
        k += 1
    out = np.empty_like(h)
    out[order] = h ^ (h >> np.uint64(29))
    return out


def _counted(texts: list[str | None], splitter: Splitter) -> Counter:
    counts: Counter = Counter()
    for kind, *x in splitter.batches(texts):
        if kind == "simple":
            _, codes, start, end, text = x
            short = (end - start) <= 32
            start, end = start[short], end[short]
            _, first, n = np.unique(_hashes(codes, start, end), return_index=True, return_counts=True)
            often = n > 1
            for s, e, c in zip(start[first[often]].tolist(), end[first[often]].tolist(), n[often].tolist(), strict=True):
                counts[text[s:e]] += c
    return counts


def frequent_words(docs: DataFrame, text_col: str, path: str, words: int = 50_000, summary: int = 20_000) -> list[str]:
    """The `words` most frequent simple words of all texts (ties: by the word).

    Each partition counts all its texts into a bounded summary, from which the
    rarest words go when it is full; the partitions' summaries are summed.  Which
    words get into the lexicon decides speed alone, never an id.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter, held = Splitter(path), Counter()
        for pdf in batches:
            held.update(_counted(pdf[text_col].tolist(), splitter))
            if len(held) > 8 * summary:
                held = Counter(dict(held.most_common(4 * summary)))
        top = held.most_common(summary)
        yield pd.DataFrame({"word": pd.Series([w for w, _ in top], dtype=object), "n": pd.Series([c for _, c in top], dtype="int64")})

    small_batches(docs.sparkSession)
    counts = docs.select(text_col).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(words).collect()]


class Lexicon:
    """The file of the transducer with the ids of its words; small enough to broadcast."""

    def __init__(self, words: list[str], path: str):
        splitter = Splitter(path)
        words = sorted(w for w in set(words) if w and splitting.simple(w))
        self.path, self.data = path, transducer.build(words, splitting.LIMIT)
        self.ids, self.counts = splitter.merges.encode([w.encode() for w in words])


class Encoder:
    """Encodes texts as the tokenizers library does with the file at `path` and no special tokens added.

    The ids of words that the lexicon lacks are merged once and held; when those
    words have more than `HELD` characters, all are let go.
    """

    HELD = 4 << 20

    def __init__(self, lexicon: Lexicon):
        self.splitter = Splitter(lexicon.path)
        self.automaton = transducer.Transducer(lexicon.data)
        self.known = len(lexicon.counts)
        self._lexicon = lexicon
        self._forget()

    def _forget(self) -> None:
        """Ids, and for each word its first id and their count: the lexicon's words, then the held ones."""
        self.ids, self.counts = self._lexicon.ids.astype(np.int32), self._lexicon.counts.astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.held: dict[str | bytes, int] = {}
        self.size = 0

    def _places(self, words: list) -> np.ndarray:
        """The number of each word among all that are known, after merging those that are new."""
        held = self.held
        before = len(held)
        base = self.known
        places = np.fromiter((held.setdefault(w, base + len(held)) for w in words), np.int64, len(words))
        if len(held) > before:
            fresh = list(islice(reversed(held), len(held) - before))[::-1]
            ids, n = self.splitter.merges.encode([w.encode() if isinstance(w, str) else w for w in fresh])
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(n) - n])
            self.counts = np.concatenate([self.counts, n])
            self.ids = np.concatenate([self.ids, ids])
            self.size += sum(map(len, fresh))
        return places

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, count of ids of each text); a null text is empty."""
        parts, owners = [], []
        for kind, *x in self.splitter.batches(texts):
            if kind == "owners":
                of = x[0]
                continue
            if kind == "id":
                parts.append(np.array([x[1]], np.int32))
                owners.append(np.array([x[0]]))
                continue
            if self.size > self.HELD:
                self._forget()
            if kind == "words":
                owner = np.full(len(x[1]), x[0])
                place = self._places(x[1])
            else:
                owner, codes, start, end, text = x
                place = self.automaton.numbers(codes, start, end).astype(np.int64)
                new = np.flatnonzero(place < 0)
                place[new] = self._places([text[s:e] for s, e in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            first, n = self.first[place], self.counts[place]
            total = int(n.sum())
            parts.append(self.ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)])
            owners.append(np.repeat(owner, n))
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        ids, owner = np.concatenate(parts).astype(np.uint32), np.concatenate(owners)
        if len(owner) and (owner[1:] < owner[:-1]).any():
            ids = ids[np.argsort(owner, kind="stable")]
        return ids, np.bincount(of[owner], minlength=len(texts))


def compiled(docs: DataFrame, text_col: str, path: str, words: int = 50_000) -> Broadcast:
    """The broadcast lexicon of a corpus: at most `words` words of at most 32 characters."""
    return docs.sparkSession.sparkContext.broadcast(Lexicon(frequent_words(docs, text_col, path, words), path))
