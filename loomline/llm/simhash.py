"""SimHash near-dedup by random bit sampling.

A text's fingerprint has 256 bits: each is the majority, over the text's
distinct lower-case words and pairs of neighbouring words, of a hash bit of
them.  The pairs tell apart long texts that use the same words, and texts of
the same words in another order.  Each of several tables samples some
coordinates of the fingerprint at random and groups fingerprints that agree on
them.  A bucket over the cap is split by further sampled bits, several times
over with other bits, so that a pair split apart once meets again; leaves are
compared pair by pair.  Candidates whose distance is at most MAX_DISTANCE are
near duplicates, and groups are what they connect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, int64s, ship, slices, unwrapped, wrapped

WORDS = 4
BITS = 64 * WORDS
#: Of the 256 bits, so many may differ.  Unrelated texts differ in about 120, near copies mostly in under 45.
MAX_DISTANCE = 56
#: So many that even a pair of MAX_DISTANCE that nothing else connects meets with a probability of 0.98, and of 0.88 where buckets are split three times over.
TABLES = 104
SAMPLED = 13
#: A bucket of more rows is split by EXTRA further bits, in SPLITS ways.
CAP = 4096
EXTRA, SPLITS = 4, 4
#: Buckets of at most so many rows are compared many at once.
SMALL = 512
#: Rows of a larger bucket that are compared at once with so many others, and pairs of small ones at once; what this takes stays in a core's cache.
BLOCK, TILE = 128, 1024
SLICE = 1 << 15
SEED = 7
#: Texts are read in slices of about so many characters.
CHARS = 1 << 20
#: Words whose hashes a worker remembers.
REMEMBERED = 1 << 17
#: Rows of the tables, (fingerprints x TABLES), for a task; and so many of them it compares together, or one bucket if that has more.
TASK_ROWS = 1 << 21
ROWS = 1 << 17

_LANES = np.zeros(256, np.uint64)
for _b in range(256):
    _LANES[_b] = sum(1 << (8 * j) for j in range(8) if _b >> j & 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _sums(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often each of the 256 bits is set among the hashes of each text, which has one at least."""
    step = 255  # eight counters of a byte lie in one word
    parts = -(-(ends - starts) // step)
    owner = np.repeat(np.arange(len(starts)), parts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = np.append(starts[owner] + within * step, len(h))
    sums = np.empty((len(owner), WORDS * 8), np.uint64)
    for p in range(0, len(owner), 2048):  # the tables of the bits are large
        q = min(p + 2048, len(owner))
        own = h[at[p] : at[q]]
        for w in range(WORDS):
            mixed = _mix(own + np.uint64((w * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            sums[p:q, w * 8 : w * 8 + 8] = np.add.reduceat(_LANES[mixed.view(np.uint8).reshape(-1, 8)], at[p:q] - at[p], axis=0)
    counts = sums.view(np.uint8).reshape(len(owner), BITS).astype(np.int32)
    return np.add.reduceat(counts, np.cumsum(parts) - parts, axis=0)


class _Hashes(dict):
    """Hashes of words, remembered by the worker."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()
_LOW = np.uint64((1 << 40) - 1)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (40 bits) of the distinct words and pairs of neighbours of each text, and how many each has."""
    split = [t.lower().split() for t in texts]
    size = np.fromiter(map(len, split), np.int64, len(split))
    h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(split)), np.uint64, int(size.sum()))
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), size) << np.uint64(40)
    pair = _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[owner[:-1] == owner[1:]]
    keys = np.concatenate([owner | h >> np.uint64(24), owner[:-1][owner[:-1] == owner[1:]] | pair >> np.uint64(24)])
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return keys & _LOW, np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=len(texts))


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints as rows of four words, and which texts have any word at all."""
    h, size = features(texts)
    some = size > 0
    out = np.zeros((len(texts), WORDS), np.uint64)
    if some.any():
        n = size[some]
        ends = np.cumsum(n)
        counts = _sums(h, ends - n, ends)
        # as many bits set as not: the parity of the place decides, alike in every text
        even = np.arange(BITS) % 2
        bits = 2 * counts + even > n[:, None]
        out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return out, some


def samples() -> np.ndarray:
    """The order of coordinates of each table: the first SAMPLED make the key, those after it the further bits."""
    rng = np.random.default_rng(SEED)
    return np.array([rng.permutation(BITS) for _ in range(TABLES)])


def _bits(f: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The bits of f at these places, as one number."""
    out = np.zeros(len(f), np.int64)
    for j, p in enumerate(places):
        out |= ((f[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)).astype(np.int64) << j
    return out


SIGNED = "doc_id long, f0 long, f1 long, f2 long, f3 long"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text", CHARS):
        f, some = fingerprints(texts)
        ids, null = int64s(batch.column("doc_id"))
        some &= ~null
        f = f[some].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), *(pa.array(np.ascontiguousarray(f[:, w])) for w in range(WORDS))], ["doc_id", "f0", "f1", "f2", "f3"])


def signed(docs: DataFrame) -> DataFrame:
    """The fingerprint of every document that has an id and a word."""
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_sign, SIGNED)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = samples()
    names = ["key", "doc_id", "f0", "f1", "f2", "f3"]
    for batch in batches:
        f = np.stack([np.asarray(batch.column(c)).view(np.uint64) for c in names[2:]], 1)
        for t in range(TABLES):
            key = _bits(f, order[t, :SAMPLED]) + (t << SAMPLED)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *(batch.column(c) for c in names[1:])], names)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each node's component, by repeated hooking."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while not (root == (up := root[root])).all():
            root = up


def _leaves(f: np.ndarray, rows: np.ndarray, places: np.ndarray) -> Iterator[np.ndarray]:
    """The bucket rows in leaves: of at most CAP rows, or of a crowd so much alike that further bits don't thin it out.

    A split must halve the pairs, its repetitions counted in, so the whole work
    never exceeds that of comparing all rows with each other.
    """
    if len(rows) <= CAP or len(places) < SPLITS * EXTRA:
        yield rows
        return
    parts = []
    for s in range(SPLITS):
        key = _bits(f[rows], places[s * EXTRA : (s + 1) * EXTRA])
        order = np.argsort(key, kind="stable")
        parts += [p for p in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(p) > 1]
    if 2 * sum(len(p) ** 2 for p in parts) > len(rows) ** 2:
        yield rows
        return
    for p in parts:
        yield from _leaves(f, rows[p], places[SPLITS * EXTRA :])


def _near(pairs: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Places of the near pairs, pairs(w) being words w of both sides, which broadcast; the last word is looked at only where the others are near."""
    d = np.bitwise_count(np.bitwise_xor(*pairs(0)))
    for w in range(1, WORDS - 1):
        d += np.bitwise_count(np.bitwise_xor(*pairs(w)))  # of three words 192 at most: a byte
    at = np.unravel_index(np.flatnonzero(d <= MAX_DISTANCE), d.shape)
    if not len(at[0]):
        return at
    x, y = (np.broadcast_to(side, d.shape)[at] for side in pairs(WORDS - 1))
    near = d[at] + np.bitwise_count(x ^ y) <= MAX_DISTANCE
    return tuple(i[near] for i in at)


def _crowd(f: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what near pairs among the rows connect.

    A block of rows that are connected already is compared only with rows that
    aren't connected to it, so a crowd of copies costs a block, not its square.
    """
    n = len(rows)
    words = np.ascontiguousarray(f[rows].T)
    root = np.arange(n)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, n, BLOCK):
        block = words[:, i : i + BLOCK, None]
        own = root[i : i + BLOCK]
        # rows before the block have met it, or were connected to what did
        target = i + np.flatnonzero(root[i:] != own[0]) if (own == own[0]).all() else np.arange(i, n)
        others = words[:, target]
        for j in range(0, len(target), TILE):
            x, y = _near(lambda w: (block[w], others[w, j : j + TILE]))
            x, y = i + x, target[j + y]
            apart = root[x] != root[y]
            x, y = x[apart], y[apart]
            if not len(x):
                continue
            joined = _forest(root[x], root[y], n)
            if len(x) > n:  # few are worth no sorting
                low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
                _, pick = np.unique(low * n + high, return_index=True)
                x, y = x[pick], y[pick]
            a.append(x)
            b.append(y)
            root = joined[root]
    return rows[np.concatenate(a)], rows[np.concatenate(b)]


def _rounds(f: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what near pairs connect within buckets that lie one after another, the longest first.

    Every row is compared with the next, the next but one and so on, while its
    bucket is that long: such rows come first, so whole slices are compared.
    """
    words = np.ascontiguousarray(f.T)
    of = np.repeat(np.arange(len(size)), size)
    ends = np.cumsum(size)
    root = np.arange(len(f))
    a, b, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for lag in range(1, int(size[0]) if len(size) else 0):
        n = int(ends[np.searchsorted(-size, -lag) - 1]) - lag  # rows of buckets longer than lag
        for s in range(0, n, SLICE):
            e = min(s + SLICE, n)
            (x,) = _near(lambda w: (words[w, s:e], words[w, s + lag : e + lag]))
            x = s + x
            y = x + lag
            new = (of[x] == of[y]) & (root[x] != root[y])
            a.append(x[new])
            b.append(y[new])
            more += int(new.sum())
        if more > len(f):  # from here on leave out what these connect
            root, more = _forest(np.concatenate(a), np.concatenate(b), len(f)), 0
    return np.concatenate(a), np.concatenate(b)


def bucket_edges(key: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, row) between rows of one bucket that are near; they connect what is connected by near pairs of a bucket or leaf."""
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] - 1))
    size = np.diff(np.append(starts, len(key)))
    longest = np.argsort(-size, kind="stable")
    starts, size = starts[longest], size[longest]
    first = np.cumsum(size) - size
    order = order[np.repeat(starts - first, size) + np.arange(len(key))]
    key, f = key[order], f[order]
    large = int((size > min(SMALL, CAP)).sum())
    rest = int(size[:large].sum())
    found = [tuple(x + rest for x in _rounds(f[rest:], size[large:]))]
    perms = samples()
    for s, n in zip(first[:large], size[:large]):
        rows = np.arange(s, s + n)
        for leaf in _leaves(f, rows, perms[int(key[s]) >> SAMPLED, SAMPLED:]) if n > CAP else (rows,):
            found.append(_crowd(f, leaf))
    a = np.concatenate([x for x, _ in found])
    b = np.concatenate([x for _, x in found])
    return order[a], order[b]


def _stars(key: np.ndarray, ids: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    """A star for each group of near rows of these whole buckets."""
    a, b = bucket_edges(key, f)
    # ids recur from table to table: number them, and keep a spanning star of what is connected
    distinct, place = np.unique(ids, return_inverse=True)
    root = _forest(place[a], place[b], len(distinct))
    member = np.flatnonzero(root != np.arange(len(distinct)))
    return pa.RecordBatch.from_arrays([pa.array(distinct[root[member]]), pa.array(distinct[member])], ["a", "b"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition sorted by key; only ROWS rows, or a bucket, are held at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    rows = 0
    for batch in batches:
        f = np.stack([np.asarray(batch.column(f"f{w}")).view(np.uint64) for w in range(WORDS)], 1)
        held.append((np.asarray(batch.column("key")), np.asarray(batch.column("doc_id")), f))
        rows += batch.num_rows
        if rows >= ROWS and held[0][0][0] != held[-1][0][-1]:
            key, ids, f = (np.concatenate(x) for x in zip(*held))
            end = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            yield _stars(key[:end], ids[:end], f[:end])
            held, rows = [(key[end:], ids[end:], f[end:])], len(key) - end
    if rows:
        yield _stars(*(np.concatenate(x) for x in zip(*held)))


def near_edges(one: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, between the ids of distinct fingerprints (first, f0, ...), whose components are the groups of near ones."""
    spark = one.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-one.count() * TABLES // TASK_ROWS))
    # each row becomes TABLES rows: in few tasks these would be spilled before they are shuffled
    keyed = one.select(F.col("first").alias("doc_id"), *(f"f{w}" for w in range(WORDS))).repartition(parts).mapInArrow(_keyed, "key int, " + SIGNED)
    return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_edges, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root) of every node that has an edge but for the roots, root being its component's least id.

    Alternates linking each node with the least of its neighbourhood (first the
    larger ones of it, then the smaller ones) till nothing changes.  A round
    shuffles twice and is written to the shared folder; the number of rounds
    goes with the logarithm of a component's size.
    """

    def sign(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def near(e: DataFrame) -> DataFrame:  # what goes by u after this needs no shuffle
        return e.repartition("u").dropDuplicates(["u", "v"])

    least = F.min("v").over(Window.partitionBy("u"))
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    before = sign(edges)
    while True:
        both = near(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.withColumn("m", F.least(least, "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = near(large).withColumn("m", least)
        edges = cut(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v"))
        if (now := sign(edges)) == before:
            return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))
        before = now


def _groups(fp: DataFrame) -> DataFrame:
    """(doc_id, root) of every document but the least of its group, of fingerprints as signed() gives them.

    Only distinct fingerprints are compared and connected; a document that
    shares one with a document of smaller id follows that, so a crowd of exact
    copies never makes a crowd of edges.
    """
    f = [f"f{w}" for w in range(WORDS)]
    one = cut(fp.groupBy(*f).agg(F.min("doc_id").alias("first")))
    same = fp.join(one, f).where("doc_id <> first").select("first", "doc_id").distinct()
    # ids under which there are several texts connect what these are near to
    several = fp.groupBy("doc_id").agg(F.min(F.struct(*f)).alias("a"), F.max(F.struct(*f)).alias("b")).where("a <> b").select("doc_id")
    links = same.join(several, "doc_id", "left_semi").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    roots = components(near_edges(one).unionByName(links))
    leaves = same.join(several, "doc_id", "left_anti").join(roots.withColumnRenamed("doc_id", "first"), "first", "left")
    return roots.unionByName(leaves.select("doc_id", F.coalesce("root", "first").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id): each document that goes, with the one of its group that stays, that of the least id.

    Rows without an id or without any word (null, empty or blank text) have no
    duplicates.  Rows with one id count as one document, or, if their texts
    differ, as one whose versions are all compared.  Two texts are near if their
    fingerprints differ in at most MAX_DISTANCE bits; groups are transitive.
    """
    return _groups(cut(signed(docs))).select("doc_id", F.col("root").alias("kept_doc_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of near duplicates, and all that have none.

    Of rows that repeat an id and, but for case and white space, a text, the
    one stays whose columns, read as strings, come first.  Rows without an id
    or without any word all stay.
    """
    fp = cut(signed(docs))
    gone = _groups(fp).select(F.col("doc_id").alias("_gone"))
    rows = wrapped(docs).withColumn("_id", F.col("_row.doc_id").cast("long")).join(gone.hint("shuffle_hash"), F.col("_id") == F.col("_gone"), "left_anti")
    again = fp.groupBy("doc_id", *(f"f{w}" for w in range(WORDS))).count().where("count > 1").select(F.col("doc_id").alias("_again")).distinct()
    if again.head(1):  # else nothing is to be done for them
        again = cut(again)
        text = F.col("_row.text").cast("string")
        of = F.col("_id") == F.col("_again")
        copies = rows.join(again, of, "left_semi").where(text.rlike(r"(?U)\S"))
        rest = rows.join(again, of, "left_anti").unionByName(rows.join(again, of, "left_semi").where(~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))))
        words = F.xxhash64(F.split(F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " "))), " "))
        whole = F.struct(*[F.col("_row").getField(c).cast("string") for c in docs.columns])
        rows = rest.unionByName(copies.groupBy("_id", words.alias("_words")).agg(F.min_by("_row", whole).alias("_row")).select("_row", "_id"))
    return unwrapped(rows, docs.columns)
