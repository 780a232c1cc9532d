"""Token counts with a shortcut for whole tokens.

Byte-pair encoding first splits text into pre-tokens.  For every string of the
vocabulary that a pre-token can be, its merges are carried out once, offline, on
the driver: if they end in that one token, the shortcut is proven, and a
pre-token that equals the string counts as one.  Only other pre-tokens are
merged.  Vocabulary and proof are broadcast; their size is that of the
vocabulary, so workers need no file of it.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

#: The rank file of the vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text into pre-tokens for it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Counts of this many pieces of text are kept in a worker's memory.
REMEMBERED = 600_000
#: Letters below are letters to every version of Unicode, so a piece of them is one pre-token.
LATIN = "\u0250"
_FAR = 1 << 40


@lru_cache(2)
def ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, rank: dict[bytes, int]) -> list[bytes]:
    """Byte-pair encoding by definition: merge the adjacent pair of least rank, the leftmost first, till none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min((rank.get(parts[i] + parts[i + 1], _FAR), i) for i in range(len(parts) - 1))
        if best[0] == _FAR:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@lru_cache(2)
def proven(path: str = VOCABULARY) -> frozenset[str]:
    """The vocabulary's strings that are one pre-token and are shown to encode as one token."""
    rank, whole = ranks(path), regex.compile(PATTERN)
    out = set()
    for b in rank:
        try:
            s = b.decode()
        except UnicodeDecodeError:
            continue
        if whole.fullmatch(s) and len(merge(b, rank)) == 1:
            out.add(s)
    return frozenset(out)


class Counter:
    """Counts of a worker: sums of pieces between blanks, remembered, where the text allows that.

    Where no white space follows a blank, a pre-token never reaches over a blank
    that it doesn't begin with, so a text's count is that of its pieces, each
    with the blank before it.  Other texts are split as a whole.
    """

    def __init__(self, rank: dict[bytes, int], whole: frozenset[str]):
        self.whole, self.find = whole, regex.compile(PATTERN).findall
        self.core = tiktoken.Encoding("loomline", pat_str=PATTERN, mergeable_ranks=rank, special_tokens={})._core_bpe
        self.memory: dict[str, tuple[int, int]] = {}
        outer = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> int:
                if " " + piece in outer.whole:
                    n = 1
                elif piece.isalpha() and max(piece) < LATIN:
                    n = len(outer.core.encode_single_piece(b" " + piece.encode()))
                else:
                    n = outer.exact(" " + piece) if piece and not piece[0].isspace() else _FAR
                if len(self) >= REMEMBERED:
                    self.clear()
                self[piece] = n
                return n

        self.pieces = Pieces()

    def exact(self, text: str) -> int:
        """Tokens: one for a pre-token that is proven whole, and merges for the rest."""
        n = 0
        for t in self.find(text):
            n += 1 if t in self.whole else len(self.core.encode_single_piece(t.encode("utf-8", "replace")))
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        pieces = text.split(" ")
        first = pieces[0]
        pieces[0] = "x"
        n = sum(map(self.pieces.__getitem__, pieces)) - self.pieces["x"]
        return self.exact(text) if n >= _FAR else n + self.exact(first)


_counters: dict[str, Counter] = {}


def counter(path: str, load: Callable[[], tuple[dict[bytes, int], frozenset[str]]]) -> Counter:
    """The worker's counter, which lives as long as its process; load gives vocabulary and proof."""
    own = importlib.import_module(__name__)._counters
    if path not in own:
        own[path] = Counter(*load())
    return own[path]


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every row; a null text has null tokens, an empty one 0. Repeated rows stay."""
    spark = docs.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast((ranks(path), proven(path)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, lambda: known.value)
        for batch, texts in slices(batches, "text"):
            n = np.fromiter(map(c.count, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, mask=np.asarray(batch.column("text").is_null()))], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, n_tokens long")
