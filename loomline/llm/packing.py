"""Packing texts into windows of tokens by non-negative least squares.

Lengths are counted in a histogram of GRAIN tokens a bin.  All combinations of
up to DEPTH bins that fill a window are enumerated; non-negative least squares
finds how often to repeat each so that they use up the histogram; repeats are
rounded, and what the rounded ones leave over is packed greedily.  All this
works on counts, whose size depends on the window only.  Texts are then dealt
to the slots by their rank in their bin.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_BYTES, checked, cut
from .token_counts import VOCABULARY, token_counts

WINDOW = 2048
GRAIN = 16
DEPTH = 3
#: Texts of a bin are ranked in groups of about so many, so no task sorts a whole bin.
GROUP_ROWS = 1 << 17


@lru_cache(4)
def combinations(bins: int, depth: int) -> np.ndarray:
    """How often each bin (row; bin i is of i + 1 grains) occurs in each combination (column) that fills the window."""
    found: list[tuple[int, ...]] = []

    def grow(have: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.append(have)
        elif len(have) < depth:
            top = min(left, have[-1] if have else bins)
            for b in range(top, 0, -1):
                if b * (depth - len(have)) >= left:
                    grow((*have, b), left - b)

    grow((), bins)
    out = np.zeros((bins, len(found)))
    for j, c in enumerate(found):
        for b in c:
            out[b - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """min |a x - b| over x >= 0 by Lawson and Hanson's active sets."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, ab = a.T @ a, a.T @ b
    for _ in range(3 * n):
        grad = ab - gram @ x
        grad[passive] = -np.inf
        j = int(grad.argmax())
        if grad[j] <= tol * max(1.0, np.abs(ab).max()):
            break
        passive[j] = True
        while True:
            on = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[on] = s
                break
            bad = s <= 0
            step = (x[on][bad] / np.maximum(x[on][bad] - s[bad], 1e-300)).min()
            x[on] += step * (s - x[on])
            drop = on[bad & (x[on] <= 1e-12)]
            if not len(drop):
                drop = on[bad][:1]
            x[drop] = 0
            passive[drop] = False
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, bins of the window, longest first); together they use every text of the histogram exactly once."""
    left = np.asarray(histogram, np.int64).copy()
    bins = len(left)
    out: list[tuple[int, tuple[int, ...]]] = []
    if not left.any():
        return out
    a = combinations(bins, depth)
    scale = left.max()
    weight = np.sqrt(np.arange(1, bins + 1) / bins)  # a long text left over costs more
    x = nnls(a * weight[:, None], left / scale * weight) * scale
    for j in np.argsort(-x, kind="stable"):
        need = a[:, j].astype(np.int64)
        used = need > 0
        n = int(min(np.rint(x[j]), (left[used] // need[used]).min())) if x[j] > 0 else 0
        if n > 0:
            left -= n * need
            out.append((n, _listed(need)))
    while left.any():
        room, need = bins, np.zeros(bins, np.int64)
        while room > 0 and (fit := np.flatnonzero(left[:room] - need[:room] > 0)).size:
            b = int(fit[-1])
            k = int(min(room // (b + 1), left[b] - need[b]))
            need[b] += k
            room -= k * (b + 1)
        used = need > 0
        n = int((left[used] // need[used]).min())
        left -= n * need
        out.append((n, _listed(need)))
    return out


def _listed(need: np.ndarray) -> tuple[int, ...]:
    return tuple(int(b) + 1 for b in np.flatnonzero(need)[::-1] for _ in range(need[b]))


def deal(steps: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(bin, rank from, rank to, first pack, slot): the texts of a bin with these ranks go to consecutive packs."""
    rank: dict[int, int] = {}
    rows, first = [], 0
    for n, bins in steps:
        for slot, b in enumerate(bins):
            start = rank.get(b, 0)
            rows.append((b, start, start + n, first, slot))
            rank[b] = start + n
        first += n
    return rows


def pieces(counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, piece, start, n_tokens) of counts (doc_id, n_tokens): a text longer than a window is cut at its multiples."""
    many = F.ceil(F.col("n_tokens") / window).cast("int")
    cut_up = counts.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), many - 1)).alias("piece"))
    start = F.col("piece").cast("long") * window
    return cut_up.select("doc_id", "piece", start.alias("start"), F.least(F.lit(window).cast("long"), F.col("n_tokens") - start).alias("n_tokens"))


def pack(counts: DataFrame, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> DataFrame:
    """(pack_id, slot, offset, doc_id, piece, start, n_tokens) of counts (doc_id, n_tokens).

    Every token of every text lies in exactly one window: `n_tokens` tokens of
    the text from `start` on lie at `offset` of window `pack_id`, where texts
    follow each other in order of slot.  Texts of no or unknown length are in no
    window.  Repeated rows are packed as often as they occur.
    """
    spark = counts.sparkSession
    binned = pieces(counts, window).withColumn("bin", F.ceil(F.col("n_tokens") / grain).cast("int"))
    histogram = np.zeros(window // grain, np.int64)
    for r in binned.groupBy("bin").count().collect():  # at most window / grain rows
        histogram[r["bin"] - 1] = r["count"]
    groups = np.maximum(1, -(-histogram // GROUP_ROWS)).tolist()
    group = F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.get(F.lit(np.array(groups, np.int64)), F.col("bin") - 1)).cast("int")
    binned = binned.withColumn("grp", group)
    before = Window.partitionBy("bin").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)  # a row for each group
    offsets = binned.groupBy("bin", "grp").count().select("bin", "grp", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    offsets = F.broadcast(offsets) if 24 * sum(groups) <= BROADCAST_BYTES else offsets
    dealt = spark.createDataFrame(deal(plan(histogram, depth)), "bin int, rank_from long, rank_to long, first_pack long, slot int")
    ranked = binned.withColumn("_in", F.row_number().over(Window.partitionBy("bin", "grp").orderBy("doc_id", "piece", "n_tokens")) - 1)
    ranked = ranked.join(offsets, ["bin", "grp"]).withColumn("rank", F.col("before") + F.col("_in"))
    inside = (F.col("r.bin") == F.col("p.bin")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    placed = ranked.alias("r").join(checked(dealt, 40).alias("p"), inside)
    placed = placed.select((F.col("first_pack") + F.col("rank") - F.col("rank_from")).alias("pack_id"), "slot", "doc_id", "piece", "start", "n_tokens")
    by = Window.partitionBy("pack_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("pack_id", "slot", F.coalesce(F.sum("n_tokens").over(by), F.lit(0)).cast("long").alias("offset"), "doc_id", "piece", "start", "n_tokens")


def pack_documents(docs: DataFrame, path: str = VOCABULARY, window: int = WINDOW) -> DataFrame:
    """pack() by the counts of the tokens that each text has."""
    return pack(cut(token_counts(docs, path)), window)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: where each text's tokens lie in the training windows (see pack).

    Null and empty texts are in no window; repeated rows, as the copies that
    mixing makes, are packed as often as they occur; rows without an id keep
    none.  An empty table gives no window.
    """
    return pack_documents(docs)
