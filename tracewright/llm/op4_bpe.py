"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The frequent words of the corpus are compiled with their ids into a shared-suffix
automaton that every worker maps into memory; all other words are merged exactly.
The ids are those of the tokenizers library; decoding joins the tokens' texts as
the library's decode does for a file without a decoder.

Null texts are empty: no ids, an empty decoded text.  Repeated rows are each
encoded, alike; words that are equally frequent enter the lexicon in sorted order,
and the lexicon changes no id.  An empty table gives an empty one; columns beyond
the id and the text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import read, small_batches
from .encoding import Encoder, compiled

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


class Decoder:
    """Texts of ids for a file without a decoder: the tokens' texts with blanks between."""

    def __init__(self, vocab: dict[str, int]):
        self.tokens = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = WORD_BPE, lexicon=None) -> DataFrame:
    """(doc_id, n_tokens, ids): the ids as little-endian unsigned 32-bit integers, one row per row."""
    lexicon = lexicon or compiled(docs, text_col, path)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(lexicon.value)
        for pdf in batches:
            ids, counts = encoder.encode(pdf["text"].tolist())
            ends = np.cumsum(counts).tolist()
            flat = memoryview(ids.astype("<u4").tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": counts, "ids": [bytes(flat[4 * (e - c) : 4 * e]) for e, c in zip(ends, counts.tolist(), strict=True)]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInPandas(run, f"doc_id {kind}, n_tokens long, ids binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = WORD_BPE) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again."""
    lexicon = compiled(docs, text_col, path)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(lexicon.value)
        decoder = Decoder(encoder.splitter.merges.vocab)
        for pdf in batches:
            ids, counts = encoder.encode(pdf["text"].tolist())
            each = np.split(ids.astype("<u4"), np.cumsum(counts)[:-1]) if len(pdf) else []
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"],
                "n_tokens": counts,
                "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in each],
                "decoded_sha256": [hashlib.sha256(decoder.decode(x).encode()).hexdigest() for x in each],
            })

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
