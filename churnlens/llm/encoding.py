"""BPE encoding and decoding of whole texts.

A text is normalised (canonical composition, lower case) and cut into
pieces by the tokenizer's pattern; every distinct piece of a task is merged
once, by a segment tree over the ranks of its adjacent pairs: the root is
the leftmost pair of the lowest rank, a merge updates three leaves and
their paths, and the piece is done when no pair is left.  Short pieces are
merged many at a time (a row of an array is one tree).
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from churnlens.llm.bpe import Merges, load_merges
from churnlens.llm.common import map_texts, table
from churnlens.llm.tokens import (BYTE_PATTERN, WORD_PATTERN, PieceTable, library_for_new, splitter,
                                  tokenizer_path, with_special)

TOKENIZER = "word_bpe_49k.json"


def normalise(text: str) -> str:
    """Canonical composition, then lower case letter by letter (the final
    sigma gets no form of its own)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Encoder:
    """Encode and decode with a byte-level BPE file of the ``tokenizers``
    library, with its results for add_special_tokens=False."""

    def __init__(self, path: str):
        self.merges: Merges = load_merges(path)
        words = bool(self.merges.suffix)  # the file with word ends folds case
        pieces = splitter(WORD_PATTERN if words else BYTE_PATTERN)
        split = library_for_new(path, (lambda t: pieces(normalise(t))) if words else pieces)
        self.table = PieceTable(with_special(split, list(self.merges.special)), self.merges.encode_pieces)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another and the number of ids of each text."""
        return self.table.values(texts)

    def decode(self, ids) -> str:
        """The library's decode(ids, skip_special_tokens=False)."""
        return self.merges.decode(ids)


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.lru_cache(4)
def _numerals(path: str) -> list[str]:
    return [str(i) for i in range(len(encoder(path).merges.tokens))]


def encode_documents(docs: DataFrame, keep: list[str], path: str | None = None,
                     with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256 (and ``ids``, ``decoded``)
    to the ``keep`` columns.  Null and empty texts have no tokens; repeated
    rows keep their own row; an empty table gives no rows; texts are read
    whole, however long; a kept column named like a new one is replaced."""
    path = path or tokenizer_path(TOKENIZER)

    def run(texts):
        enc, numeral = encoder(path), _numerals(path)
        flat, counts = enc.encode(texts)
        out = {"n_tokens": counts.tolist(), "ids_sha256": [], "decoded_sha256": []}
        ids_column, text_column = [], []
        end = 0
        for n in counts:
            ids = flat[end:end + n].tolist()
            end += n
            decoded = enc.decode(ids)
            out["ids_sha256"].append(hashlib.sha256(" ".join([numeral[i] for i in ids]).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            if with_ids:
                ids_column.append(ids)
            if with_text:
                text_column.append(decoded)
        return out | ({"ids": ids_column} if with_ids else {}) | ({"decoded": text_column} if with_text else {})

    return map_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string"
                     + ", ids array<long>" * with_ids + ", decoded string" * with_text, keep)


def op1_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of documents."""
    return encode_documents(table(spark, sf_dir, "documents"), ["doc_id"])
