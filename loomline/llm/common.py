"""What the operators share: checkpoints, checked broadcasts, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..shipping import ship  # noqa: F401

#: A side is broadcast only below so many estimated bytes.
BROADCAST_BYTES = 8 << 20
#: Documents are worked on in slices of about so many characters.
SLICE_CHARS = 4 << 20
LAST_ID = np.iinfo(np.int64).max


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from what is written."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(name: str, columns: list[str]) -> str:
    """name, with as many underscores after it as it takes to be none of the columns, whose case doesn't count."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Texts to learn from: at most so many characters of them in all, and a text of more than the second number is none of them.
TRAIN_CHARS, TRAIN_TEXT = 48 << 20, 1 << 20


def training_rows(docs: DataFrame, chosen: DataFrame, label: str, seed: int, given: str | None = None, chars: int = TRAIN_CHARS, longest: int = TRAIN_TEXT) -> list[tuple[str, object]]:
    """(text, label) of the chosen documents (doc_id, label), which must be few, on the driver.

    A document counts once: of rows that repeat its id the least text.  With
    `given` only rows count whose column of that name is the label.  Whole texts
    are taken in order of a hash of the id for as long as they stay within so
    many characters; longer ones than `longest` are left out.  The result is in
    order of text.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col(given).cast("string").alias(label)] if given else [])]
    own = docs.where("text is not null and doc_id is not null").select(*columns).where(F.length("text") <= longest)
    own = own.join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), label)), ["doc_id", label] if given else "doc_id")
    rows = cut(own.groupBy("doc_id", label).agg(F.min("text").alias("text")))
    sizes = rows.select("doc_id", label, F.length("text").alias("n"), F.xxhash64("doc_id", F.lit(seed)).alias("h")).collect()  # as many as chosen
    taken, n = [], 0
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"], str(r[label]))):
        if n + r["n"] <= chars:
            taken.append((r["doc_id"], r[label]))
            n += r["n"]
    if len(taken) < len(sizes):
        few = docs.sparkSession.createDataFrame(taken, rows.select("doc_id", label).schema)
        rows = rows.join(F.broadcast(few), ["doc_id", label])
    return sorted(((r["text"], r[label]) for r in rows.collect()), key=lambda r: (r[0], str(r[1])))


def checked(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, which must be cheap to count, marked for broadcast if its size allows that.

    Beyond the limit the plain DataFrame comes back, and Spark joins by shuffle.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def strings(column: pa.Array | pa.ChunkedArray) -> list[str | None]:
    return column.to_pylist()


def int64s(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values as int64, with 0 for null, and the mask of nulls."""
    mask = np.asarray(column.is_null())
    return np.asarray(column.cast(pa.int64()).fill_null(0)), mask


def slices(batches: Iterable[pa.RecordBatch], text: str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches of about so many characters, with their texts; null reads as empty."""
    for batch in batches:
        texts = [t or "" for t in strings(batch.column(text))]
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t) + 1
            if size >= chars or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def unit_sql(*columns: str, seed: int) -> str:
    """A hash-seeded number in [0, 1) of the columns, in DuckDB."""
    key = " || '|' || ".join(f"coalesce({c}::VARCHAR, 'null')" for c in columns)
    return f"(('0x' || substr(md5({key} || '|{seed}'), 1, 13))::BIGINT::DOUBLE / {float(1 << 52)})"


def wrapped(df: DataFrame, name: str = "_row") -> DataFrame:
    """df with each row as one struct, so columns added beside it clash with none of its own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def unwrapped(df: DataFrame, columns: list[str], *more, name: str = "_row", **changed) -> DataFrame:
    """The columns of the struct again, some of them changed, and more after them."""
    return df.select(*[changed.get(c, F.col(name).getField(c)).alias(c) for c in columns], *more)


def ngrams(words: list[str], sizes: Iterable[int], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size (they go up), the buckets of the words' n-grams between marks for their ends, and which word each is of, in order.

    An empty word has none.  buckets is a power of two.
    """
    codes = np.frombuffer("".join([f"<{w}>" if w else "" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter([len(w) + 2 if w else 0 for w in words], np.int64, len(words))
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))
    h, done = np.zeros(len(codes), np.uint64), 0
    for n in sizes:
        for k in range(done + 1, n + 1):
            h = h[: max(0, len(codes) - k + 1)] * np.uint64(0x100000001B3) + codes[k - 1 :] + np.uint64(k)
        done = n
        whole = left[: len(h)] >= n
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield ((mixed >> np.uint64(40)) & np.uint64(buckets - 1)).astype(np.int64)[whole], word[: len(h)][whole]
