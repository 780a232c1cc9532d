"""Exact top-k search by inner product over norm buckets.

Vectors are grouped by length (norm) into buckets, which are gone through from
the longest on.  Every query is a row that carries its best k so far; their
least product is its bound.  A bucket is broadcast, and each task searches it
for its own queries, so no vector is shuffled for a search.  A query whose bound
the longest vector of a bucket can't reach is finished with all further ones.
In a bucket that can reach it, the bound divided by both lengths is the local
threshold of the cosine: if it is high, only vectors whose coordinates lie in
the ranges that such a cosine allows are looked at; else only those that are
long enough.  All that is left is verified by its product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked, cut, ship

K = 10
#: A bucket has at most about so many bytes of vectors: it is broadcast.
BUCKET_BYTES = 48 << 20
#: A task has at most about so many queries.
QUERIES = 16384
#: Of a bucket, so many vectors are gone through together, longest first.
LOCAL = 2048
#: From this cosine on, coordinates prune better than lengths.
COORDINATE = 0.9
#: So many of a query's largest coordinates are compared.
FOCUS = 4
DIGITS = 9
#: Slack of a comparison of products: so much, and so much of the product of both lengths, by which sums in another order differ.
_EPS, _REL = 1e-8, 1e-9


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding, norm) of the rows that can be searched, one for each id."""
    v = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.where("vec_id is not null and size(embedding) > 0").where(fine).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return v.withColumn("norm", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)))


def bucketed(v: DataFrame, size: int | None = None) -> tuple[DataFrame, list[tuple[int, float]], int, int]:
    """v with the number of its bucket, 0 being the longest; each bucket's largest norm; the largest width; the number of vectors.

    Buckets of about `size` vectors end at quantiles of the norm; one that equal
    norms make too large is split by hash.
    """
    spark = v.sparkSession
    n, width = v.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    parts = max(1, -(-n // (size or max(1, BUCKET_BYTES // (8 * width)))))
    cuts = v.select(F.percentile_approx("norm", [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] if parts > 1 and n else []
    cuts = sorted(set(cuts or []), reverse=True)
    coarse = F.size(F.filter(F.lit(np.array(cuts)), lambda c: F.col("norm") <= c)) if cuts else F.lit(0)
    v = v.withColumn("coarse", coarse)
    sizes = {r["coarse"]: r["count"] for r in v.groupBy("coarse").count().collect()}  # a row for each bucket
    first, split = {}, {}
    for c in sorted(sizes):
        first[c] = sum(split.values())
        split[c] = max(1, round(sizes[c] * parts / max(1, n)))
    table = spark.createDataFrame([(c, first[c], split[c]) for c in sorted(sizes)], "coarse int, first int, split int")
    v = v.join(checked(table, 16), "coarse").withColumn("bucket", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("split"))).cast("int"))
    v = cut(v.select("vec_id", "embedding", "norm", "bucket"))
    tops = [(r["bucket"], r["top"]) for r in v.groupBy("bucket").agg(F.max("norm").alias("top")).collect()]  # a row for each bucket
    return v, sorted(tops), width, n


def _matrix(table: pa.Table | pa.RecordBatch, dim: int) -> np.ndarray:
    column = table.column("embedding")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = np.asarray(column.values), np.asarray(column.offsets)
    out = np.zeros((len(column), dim))
    size = np.diff(offsets)
    if len(out) and (size == dim).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, dim)
    for i in range(len(out)):  # shorter vectors go on with zeros
        out[i, : size[i]] = flat[offsets[i] : offsets[i + 1]]
    return out


class Best:
    """The best k of each query so far, as pairs; bound is the k-th product, or what was known before."""

    def __init__(self, bound: np.ndarray, k: int):
        self.bound, self.k = bound.copy(), k
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        row, ids, score = np.append(self.row, row), np.append(self.id, ids), np.append(self.score, score)
        order = np.lexsort([ids, -score, row])
        row = row[order]
        start = np.flatnonzero(np.diff(row, prepend=-1))
        rank = np.arange(len(row)) - np.repeat(start, np.diff(start, append=len(row)))
        keep = order[rank < self.k]
        self.row, self.id, self.score = row[rank < self.k], ids[keep], score[keep]
        last = rank[rank < self.k] == self.k - 1
        np.maximum.at(self.bound, self.row[last], self.score[last])


def by_length(p: np.ndarray, p_id: np.ndarray, p_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of a bucket, the longest first."""
    order = np.lexsort([p_id, -p_norm])
    return p[order], p_id[order], p_norm[order]


def search_bucket(q: np.ndarray, q_id: np.ndarray, q_norm: np.ndarray, p: np.ndarray, p_id: np.ndarray, p_norm: np.ndarray, best: Best) -> Best:
    """best, with what of the vectors p, the longest of which come first, belongs to the best of each query q; both sides of equal width."""
    k = best.k
    unit_q = q / np.maximum(q_norm, 1e-300)[:, None]
    focus = np.argsort(-np.abs(unit_q), axis=1, kind="stable")[:, :FOCUS]
    for at in range(0, len(p), LOCAL):
        own, own_id, own_norm = p[at : at + LOCAL], p_id[at : at + LOCAL], p_norm[at : at + LOCAL]
        unit_p = None
        slack_of = _EPS + _REL * q_norm * own_norm[0]
        for lo in range(0, len(q), LOCAL):
            rows = np.arange(lo, min(lo + LOCAL, len(q)))
            need = best.bound[rows] - slack_of[rows]
            top = q_norm[rows] * own_norm[0]
            cosine = np.where(need > 0, need / np.maximum(top, 1e-300), -1.0)
            rows, need, cosine = rows[cosine <= 1], need[cosine <= 1], cosine[cosine <= 1]
            narrow = cosine >= COORDINATE
            found = []
            long_enough = rows[~narrow]
            if len(long_enough):
                # the longest of these vectors that any query needs; shorter ones can't reach its bound
                reach = np.where(need[~narrow] > 0, need[~narrow] / np.maximum(q_norm[long_enough], 1e-300), -1.0)
                end = int(np.searchsorted(-own_norm, -reach.min(), side="right"))
                product = q[long_enough] @ own[:end].T
                floor = need[~narrow]
                if end > k:
                    floor = np.maximum(floor, np.partition(product, end - k - 1, axis=1)[:, end - k - 1] - slack_of[long_enough])  # one more than k, as a query may meet itself
                found.append(np.nonzero(product >= floor[:, None]))
                found[-1] = (long_enough[found[-1][0]], found[-1][1])
            by_coordinate = rows[narrow]
            if len(by_coordinate):
                if unit_p is None:
                    unit_p = np.ascontiguousarray((own / np.maximum(own_norm, 1e-300)[:, None]).T)
                t = np.minimum(1.0, cosine[narrow])[:, None]
                ok = np.ones((len(by_coordinate), len(own)), bool)
                for j in range(focus.shape[1]):
                    f = focus[by_coordinate, j]
                    x = unit_q[by_coordinate, f][:, None]
                    slack = np.sqrt(np.maximum(0.0, (1 - t * t) * (1 - x * x))) + 1e-9
                    # a query within t of the axis has the axis itself in reach
                    low, high = np.where(x < -t, -1 - 1e-9, t * x - slack), np.where(x > t, 1 + 1e-9, t * x + slack)
                    values = unit_p[f]
                    ok &= (values >= low) & (values <= high)
                i, c = np.nonzero(ok)
                found.append((by_coordinate[i], c))
            if not found:
                continue
            i, c = (np.concatenate(x) for x in zip(*found))
            differs = q_id[i] != own_id[c]
            i, c = i[differs], c[differs]
            score = np.round(np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[i[s : s + 65536]], own[c[s : s + 65536]]) for s in range(0, len(i), 65536))]), DIGITS)
            reached = score >= best.bound[i] - slack_of[i]
            best.add(i[reached], own_id[c[reached]], score[reached])
    return best


STATE = "vec_id long, embedding array<double>, norm double, bound double, ids array<long>, scores array<double>"


def _search(bucket: Broadcast, width: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries (as of STATE) with the bucket's vectors (as by_length gives them) taken into their best."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, p_id, p_norm = bucket.value
        for batch in (b.slice(at, LOCAL) for b in batches for at in range(0, b.num_rows, LOCAL)):
            best = Best(batch.column("bound").to_numpy(), k)
            known = batch.column("ids")
            best.add(np.repeat(np.arange(len(known)), np.diff(np.asarray(known.offsets))), np.asarray(known.flatten()), np.asarray(batch.column("scores").flatten()))
            search_bucket(_matrix(batch, width), batch.column("vec_id").to_numpy(), batch.column("norm").to_numpy(), p, p_id, p_norm, best)
            at = pa.array(np.append(0, np.cumsum(np.bincount(best.row, minlength=batch.num_rows))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (best.id, best.score)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "embedding", "norm")), pa.array(best.bound), *lists], ["vec_id", "embedding", "norm", "bound", "ids", "scores"])

    return work


def top_k(rows: DataFrame, k: int = K, size: int | None = None) -> DataFrame:
    """(query_id, rank, neighbor_id, score): for every vector the k others of the largest inner product.

    Products are rounded to DIGITS places; among equal ones the smaller id comes
    first.  Rows with a null id or a null, empty or not wholly finite vector are
    neither queries nor found; of rows with one id the least vector counts; a
    shorter vector is compared as if it went on with zeros.
    """
    spark = rows.sparkSession
    ship(spark)
    v, tops, width, n = bucketed(vectors(rows), size)
    if not tops:
        return spark.createDataFrame([], "query_id long, rank int, neighbor_id long, score double")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // QUERIES))
    none = [F.lit(float("-inf")).alias("bound"), F.array().cast("array<long>").alias("ids"), F.array().cast("array<double>").alias("scores")]
    active = v.select("vec_id", "embedding", "norm", *none).repartition(tasks, "vec_id")
    finished = []
    for number, top in tops:
        if number:
            # the longest vector of the bucket, and so of all after it, could reach the bound
            reach = (F.col("bound") <= 0) | (F.col("bound") <= F.col("norm") * F.lit(top * (1 + _REL)) + _EPS)
            finished.append(active.where(~reach))
            active = active.where(reach)
            if not active.head(1):
                break
        table = v.where(F.col("bucket") == number).select("vec_id", "embedding", "norm").toArrow()  # about BUCKET_BYTES
        bucket = spark.sparkContext.broadcast(by_length(_matrix(table, width), table.column("vec_id").to_numpy(), table.column("norm").to_numpy()))
        del table
        active = cut(active.mapInArrow(_search(bucket, width, k), STATE))
        bucket.destroy()
    out = active
    for part in finished:
        out = out.unionByName(part)
    found = out.select(F.col("vec_id").alias("query_id"), F.posexplode(F.arrays_zip("ids", "scores")).alias("pos", "f"))
    return found.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("f.ids").alias("neighbor_id"), F.col("f.scores").alias("score"))


TOP_K_SQL = f"""
with v as (select vec_id, embedding::DOUBLE[] as e from embeddings),
s as (select a.vec_id as query_id, b.vec_id as neighbor_id, round(list_inner_product(a.e, b.e), {DIGITS}) as score from v a join v b on a.vec_id <> b.vec_id),
r as (select query_id, (row_number() over (partition by query_id order by score desc, neighbor_id))::INTEGER as rank, neighbor_id, score from s)
select query_id, rank, neighbor_id, score from r where rank <= {K}"""
