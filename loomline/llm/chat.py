"""Chat formatting by columnar byte assembly.

The turns of a conversation follow each other, each between a header with its
role and an end mark.  For a batch of turns, lengths of all segments and their
cumulative offsets are computed first; headers and contents are then scattered
into one preallocated buffer, over which an Arrow column of strings is laid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

HEAD, MIDDLE, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"
#: A column holds at most about so many bytes; a batch with more is assembled in parts.
BUFFER = 256 << 20


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, starts and sizes of a column of strings without nulls."""
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, at[:-1], np.diff(at)


def scatter(target: np.ndarray, at: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """Copy segment i of data, from start[i] on, to at[i]."""
    total = int(size.sum())
    if not total:
        return
    within = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    target[np.repeat(at, size) + within] = data[np.repeat(start, size) + within]


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All turns formatted, in one buffer, and where each begins (and the last ends)."""
    n = len(role)
    fixed = np.frombuffer((HEAD + MIDDLE + TAIL).encode(), np.uint8)
    h, m, t = len(HEAD), len(MIDDLE), len(TAIL)
    r_data, r_start, r_size = _bytes(role)
    c_data, c_start, c_size = _bytes(text)
    ends = np.cumsum(r_size + c_size + h + m + t)
    starts = np.concatenate([[0], ends]).astype(np.int64)
    buffer = np.empty(int(starts[-1]), np.uint8)
    at = starts[:-1]
    same = lambda x, w: (np.full(n, x), np.full(n, w))
    scatter(buffer, at, fixed, *same(0, h))
    scatter(buffer, at + h, r_data, r_start, r_size)
    scatter(buffer, at + h + r_size, fixed, *same(h, m))
    # contents are large: they go in slices, whose indices fit the cache
    for s in range(0, n, 4096):
        e = slice(s, s + 4096)
        scatter(buffer, (at + h + r_size + m)[e], c_data, c_start[e], c_size[e])
    scatter(buffer, starts[1:] - t, fixed, *same(h + m, t))
    return buffer, starts


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of turns, sorted by conversation, to conversations; one may reach over several batches."""
    open_key: object = None
    is_open = False
    head: list[bytes] = []  # what of the open conversation is assembled
    turns = 0

    def batch(keys: list, texts: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        size = np.asarray(pa.compute.binary_length(texts)).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), texts, pa.array(n, pa.int64()), pa.array(size)], ["conv_id", "text", "n_turns", "n_bytes"])

    for whole in batches:
        for part in _parts(whole):
            ids = part.column("conv_id").to_pylist()
            buffer, starts = assemble(part.column("role"), part.column("text"))
            new = [i for i in range(len(ids)) if i == 0 or ids[i] is None or ids[i] != ids[i - 1]]
            runs = list(zip(new, [*new[1:], len(ids)]))
            done: list[bytes] = []
            keys, sizes = [], []
            if is_open and (open_key is None or ids[0] != open_key):
                keys.append(open_key)
                done.append(b"".join(head))
                sizes.append(turns)
                is_open = False
            elif is_open and len(runs) > 1:  # the open one ends in this part
                keys.append(open_key)
                done.append(b"".join([*head, buffer[starts[0] : starts[runs[0][1]]].tobytes()]))
                sizes.append(turns + runs[0][1])
                runs, is_open = runs[1:], False
            if done:
                yield batch(keys, pa.array(done, pa.binary()).cast(pa.string()), np.array(sizes))
            if is_open:  # it goes on
                head.append(buffer.tobytes())
                turns += len(ids)
                continue
            *inner, last = runs
            if inner:
                # the finished ones lie in the buffer one after another: only offsets are needed
                edge = starts[[inner[0][0], *(e for _, e in inner)]]
                data = pa.py_buffer(buffer[edge[0] : edge[-1]])
                texts = pa.StringArray.from_buffers(len(inner), pa.py_buffer((edge - edge[0]).astype(np.int32)), data)
                yield batch([ids[s] for s, _ in inner], texts, np.array([e - s for s, e in inner]))
            open_key, is_open = ids[last[0]], True
            head, turns = [buffer[starts[last[0]] : starts[last[1]]].tobytes()], last[1] - last[0]
    if is_open:
        yield batch([open_key], pa.array([b"".join(head)], pa.binary()).cast(pa.string()), np.array([turns]))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in parts of at most about BUFFER bytes; at least a turn each."""
    if not batch.num_rows:
        return
    size = np.cumsum(sum(_bytes(batch.column(c))[2] for c in ("role", "text")) + len(HEAD + MIDDLE + TAIL))
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + BUFFER, side="right")))
        yield batch.slice(start, end - start)
        start = end


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, text, n_turns, n_bytes) of every conversation, its turns in order of turn.

    Turns with one number follow each other by role and then text; turns
    without a number come first.  A null role reads as 'unknown', a null text
    as empty.  A row without a conv_id is a conversation of its own, without id.
    Contents are copied as they are.  A conversation of over 2 GB, which no
    string of Spark holds, is an error.
    """
    ship(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.repartition(F.coalesce("conv_id", F.xxhash64("turn", "role", "text"))).sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_conversations, "conv_id long, text string, n_turns long, n_bytes long")


CHAT_SQL = f"""
with t as (select *, case when conv_id is null then row_number() over () end as own from conversations)
select conv_id, string_agg('{HEAD}' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by turn nulls first, coalesce(role, 'unknown'), coalesce(text, '')) as text,
count(*)::BIGINT as n_turns, sum(strlen('{HEAD}' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10)))::BIGINT as n_bytes
from t group by conv_id, own"""
