"""Line dedup: sharded cuckoo filters backed by exact reference counts.

Every line that isn't blank is known by 128 bits of hash of its trimmed text.
Lines are spread over shards.  A shard has a cuckoo filter, which says of most
new lines that they were never seen, and an exact table of reference counts,
which settles the rest.  Counts go up with inserted documents and down with
deleted ones; a line whose count falls to nothing leaves table and filter, so
state after an insertion and a deletion is the state from before.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..seq import estimated_bytes
from .common import LAST_ID, cut, free_name, int64s, ship, slices, unwrapped, wrapped

SLOTS = 4
#: Rows that a shard works through at a time.
CHUNK = 1 << 16
#: A shard is for about so many bytes of documents, as Catalyst estimates them without a job.
SHARD_BYTES = 16 << 20
MOST_SHARDS = 100_000
_M = np.uint64(0x9E3779B97F4A7C15)


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints in buckets of four, for arrays of 64-bit hashes.

    contains() never misses what was inserted and not removed.  A table that
    gets too full is doubled, for which the caller's exact hashes are needed,
    so insert() takes a function that gives them all.
    """

    def __init__(self, capacity: int = 1024, table: np.ndarray | None = None):
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / SLOTS / 0.8))))
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = (h ^ (h >> np.uint64(31))) * _M
        h ^= h >> np.uint64(29)
        finger = (h >> np.uint64(48)).astype(np.uint16)
        finger[finger == 0] = 1
        mask = np.uint64(len(self.table) - 1)
        first = h & mask
        return finger, first.astype(np.int64), self._other(first.astype(np.int64), finger)

    def _other(self, bucket: np.ndarray, finger: np.ndarray) -> np.ndarray:
        mixed = (finger.astype(np.uint64) * _M) >> np.uint64(20)
        return ((bucket.astype(np.uint64) ^ mixed) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        finger, a, b = self._places(h)
        return (self.table[a] == finger[:, None]).any(1) | (self.table[b] == finger[:, None]).any(1)

    def insert(self, h: np.ndarray, everything) -> None:
        """Insert a fingerprint for each of these hashes; everything() gives all hashes held after it, if the table must grow.

        Keys that share a hash each have a fingerprint of their own, so that one
        can be removed and the other stays.
        """
        finger, bucket, other = self._places(h)
        rng = np.random.default_rng(len(h))
        for turn in range(64):
            if not len(finger):
                return
            for slot in range(SLOTS):  # one newcomer for each bucket and slot at a time
                free = np.flatnonzero(self.table[bucket, slot] == 0)
                _, one = np.unique(bucket[free], return_index=True)
                at = free[one]
                self.table[bucket[at], slot] = finger[at]
                left = np.ones(len(finger), bool)
                left[at] = False
                finger, bucket, other = finger[left], bucket[left], other[left]
            if turn % 2:  # both places were full: evict one each
                _, one = np.unique(bucket, return_index=True)
                slot = rng.integers(0, SLOTS, len(one))
                out = self.table[bucket[one], slot]
                self.table[bucket[one], slot] = finger[one]
                home = bucket[one]
                finger[one], bucket[one] = out, self._other(home, out)
                other[one] = home
            else:
                bucket, other = other, bucket
        self.table = np.zeros((len(self.table) * 2, SLOTS), np.uint16)
        self.insert(everything(), everything)

    def remove(self, h: np.ndarray) -> None:
        """Take out one fingerprint for each of these hashes, which were all inserted."""
        finger, a, b = self._places(h)
        for place in (a, b):
            for slot in range(SLOTS):
                hit = np.flatnonzero((self.table[place, slot] == finger) & (finger != 0))
                _, one = np.unique(place[hit], return_index=True)
                self.table[place[hit[one]], slot] = 0
                finger[hit[one]] = 0
        if finger.any():  # some fell on one bucket and slot together
            again = finger != 0
            self.remove(h[again])

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Cuckoo":
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())


class Counts:
    """Exact counts of 128-bit keys with their first owner, as sorted runs that are merged when alike in size."""

    #: hi, lo: the key; refs; then the owner, least first.
    TYPE = np.dtype([("hi", "u8"), ("lo", "u8"), ("refs", "i8"), ("doc", "i8"), ("row", "i8"), ("pos", "i8")])

    def __init__(self, rows: np.ndarray | None = None):
        self.runs: list[np.ndarray] = [] if rows is None or not len(rows) else [self.merged(rows)]

    @staticmethod
    def grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row for each key, with its first owner and the sum of refs; and each row's place among them."""
        order = np.lexsort([rows[c] for c in ("pos", "row", "doc", "lo", "hi")])
        rows = rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["hi"][1:] != rows["hi"][:-1]) | (rows["lo"][1:] != rows["lo"][:-1])
        starts = np.flatnonzero(new)
        out = rows[starts]
        if len(starts):
            out["refs"] = np.add.reduceat(rows["refs"], starts)
        place = np.empty(len(rows), np.int64)
        place[order] = np.cumsum(new) - 1
        return out, place

    @classmethod
    def merged(cls, rows: np.ndarray) -> np.ndarray:
        return cls.grouped(rows)[0]

    def add(self, rows: np.ndarray) -> None:
        if len(rows):
            self.runs.append(self.merged(rows))
        while len(self.runs) > 1 and len(self.runs[-2]) < 2 * len(self.runs[-1]):
            b, a = self.runs.pop(), self.runs.pop()
            self.runs.append(self.merged(np.concatenate([a, b])))

    def all(self) -> np.ndarray:
        if len(self.runs) != 1:
            self.runs = [self.merged(np.concatenate([np.zeros(0, self.TYPE), *self.runs]))]
        return self.runs[0]

    def find(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Which of the keys are held."""
        found = np.zeros(len(hi), bool)
        for run in self.runs:
            todo = np.arange(len(hi))
            at = np.searchsorted(run["hi"], hi)
            while len(todo):  # keys that share their upper half follow each other
                inside = at < len(run)
                todo, at = todo[inside], at[inside]
                same = run["hi"][at] == hi[todo]
                hit = same & (run["lo"][at] == lo[todo])
                found[todo[hit]] = True
                todo, at = todo[same & ~hit], at[same & ~hit] + 1
        return found


def line_key(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def row_key(text: str) -> int:
    """What Spark's xxhash64 gives for the text."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=42)
    return h - (1 << 64) if h >> 63 else h


POSTINGS = "shard int, hi long, lo long, refs long, doc long, row long, pos long"


def _postings(shards: int, keep_all: bool):
    """Lines of a partition: the first of each with its count, and with shard -1 those after it.

    Because only one row for each line leaves a partition for the shuffle, a
    line that half the corpus has weighs no more than any other.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, rows, poss = [], [], [], []
        for batch, texts in slices(batches, "text"):
            ids, null = int64s(batch.column("doc"))
            ids = np.where(null, LAST_ID, ids)
            part, at, row = [], [], []
            for i, text in enumerate(texts):
                if not text:
                    continue
                r = None
                for pos, line in enumerate(text.split("\n")):
                    if line := line.strip(" \t\r"):
                        if r is None:
                            r = row_key("\0" + text if null[i] else text)
                        part.append(line_key(line))
                        at.append(i)
                        row.append(r)
                        poss.append(pos)
            keys.append(np.frombuffer(b"".join(part), ">u8").astype(np.uint64).reshape(-1, 2))
            docs.append(ids[np.array(at, np.int64)])
            rows.append(np.array(row, np.int64))
        if not poss:
            return
        key = np.concatenate(keys)
        table = np.zeros(len(poss), Counts.TYPE)
        for name, x in (("hi", key[:, 0]), ("lo", key[:, 1]), ("refs", 1), ("doc", np.concatenate(docs)), ("row", np.concatenate(rows)), ("pos", np.array(poss, np.int64))):
            table[name] = x
        del keys, docs, rows, key
        if keep_all:
            yield _batch(table, _shard(table["hi"], shards))
            return
        first, place = Counts.grouped(table)
        yield _batch(first, _shard(first["hi"], shards))
        owner = first[place]
        again = table[(table["doc"] != owner["doc"]) | (table["row"] != owner["row"]) | (table["pos"] != owner["pos"])]
        yield _batch(again, np.full(len(again), -1, np.int32))

    return work


def _shard(hi: np.ndarray, shards: int) -> np.ndarray:
    return ((hi >> np.uint64(8)) % np.uint64(shards)).astype(np.int32)


def _batch(rows: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    columns = [np.ascontiguousarray(rows[c]).view(np.int64) for c in ("hi", "lo", "refs", "doc", "row", "pos")]
    return pa.RecordBatch.from_arrays([pa.array(shard), *map(pa.array, columns)], ["shard", "hi", "lo", "refs", "doc", "row", "pos"])


def _rows(batches) -> tuple[np.ndarray, np.ndarray]:
    """Structured rows and shards of Arrow batches."""
    tables, shards = [np.zeros(0, Counts.TYPE)], [np.zeros(0, np.int32)]
    for b in batches:
        t = np.zeros(b.num_rows, Counts.TYPE)
        for c in Counts.TYPE.names:
            t[c] = np.asarray(b.column(c)).view(Counts.TYPE[c])
        tables.append(t)
        shards.append(np.asarray(b.column("shard")))
    return np.concatenate(tables), np.concatenate(shards)


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Sorted occurrences, with those that equal the one before them added to it."""
    new = np.ones(len(rows), bool)
    new[1:] = np.any([rows[c][1:] != rows[c][:-1] for c in ("hi", "lo", "doc", "row", "pos")], axis=0)
    if new.all():
        return rows
    starts = np.flatnonzero(new)
    out = rows[starts]
    out["refs"] = np.add.reduceat(rows["refs"], starts)
    return out


def insert_shard(rows: np.ndarray, counts: Counts, cuckoo: Cuckoo) -> np.ndarray:
    """Insert the occurrences, in order of documents; gives those that are not the first of their line.

    What the filter doesn't know is new.  Only the rest is looked up among the
    exact counts; a false alarm of the filter thus does no harm.  Occurrences
    that repeat each other, as rows repeated in several partitions have them,
    become one first, so none is taken for a later occurrence of itself.
    """
    rows = _distinct(rows[np.lexsort([rows["pos"], rows["row"], rows["doc"]])])
    repeated = []
    for start in range(0, len(rows), CHUNK):
        chunk = rows[start : start + CHUNK]
        maybe = cuckoo.contains(chunk["hi"])
        known = np.zeros(len(chunk), bool)
        known[maybe] = counts.find(chunk["hi"][maybe], chunk["lo"][maybe])
        own = chunk[~known]
        fresh, place = Counts.grouped(own)
        first = fresh[place]
        again = (own["doc"] != first["doc"]) | (own["row"] != first["row"]) | (own["pos"] != first["pos"])
        repeated += [chunk[known], own[again]]
        counts.add(chunk)
        cuckoo.insert(fresh["hi"], lambda: counts.all()["hi"])
    return np.concatenate([rows[:0], *repeated])


def _insert_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, shards = _rows(batches)
    for shard in np.unique(shards):
        own = rows[shards == shard]
        out = insert_shard(own, Counts(), Cuckoo()) if shard >= 0 else own
        yield _batch(out, np.full(len(out), shard, np.int32))


def shards_for(docs: DataFrame) -> int:
    """The number of shards for a table: by its estimated size, and at least the session's shuffle partitions.

    Where there is no estimate, as of rows that aren't from files, or one of
    over a petabyte, which is a join's, the lengths of the texts are added up.
    """
    size = estimated_bytes(docs)
    if size > 1 << 50:
        size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_SHARDS, size // SHARD_BYTES))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))


def repeated_lines(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The occurrences (doc, row, pos) of lines that are not the first of their line in all docs.

    doc is the id, or the largest of its type for null; row tells apart texts
    under the same id, and rows without an id from those of that largest id.
    """
    ship(docs.sparkSession)
    shards = shards or shards_for(docs)
    found = _source(docs).mapInArrow(_postings(shards, False), POSTINGS)
    # a local repeat (shard -1) goes on as it is, wherever its key lies
    spread = F.when(F.col("shard") < 0, F.pmod("hi", F.lit(shards))).otherwise(F.col("shard")).cast("int")
    return found.repartition(shards, spread).mapInArrow(_insert_partition, POSTINGS).select("doc", "row", "pos")


def dedup_lines(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """docs with every line but the first occurrence of each taken out of text.

    Occurrences are ordered by doc_id (null last, beside the largest id of the
    type), then by a hash of the text, and by place in the text.  Lines are
    compared without white space at their ends; blank lines are left as they
    are.  All columns stay; a last one, `lines_removed` (with underscores after
    it where docs has such a column), tells how many lines went.  A text that
    loses all its lines becomes empty or blank; null stays null.  Rows that
    repeat both doc_id and text are the same document and get the same result;
    so do rows without doc_id that repeat a text.
    """
    gone = F.col("_gone").alias(free_name("lines_removed", docs.columns))
    return unwrapped(_deduped(docs, shards), docs.columns, gone, text=F.col("_text"))


def _deduped(docs: DataFrame, shards: int | None) -> DataFrame:
    """(_row, _text, _gone): each row as it was, its new text, and how many lines went."""
    removed = repeated_lines(docs, shards).groupBy("doc", "row").agg(F.collect_list(F.col("pos").cast("int")).alias("_out"))
    text, i = F.col("_row.text").cast("string"), F.col("_row.doc_id").cast("long")
    # by text as well, so rows without an id don't meet in one task
    row = F.when(i.isNull(), F.xxhash64(F.concat(F.lit("\0"), text))).otherwise(F.xxhash64(text))
    joined = wrapped(docs).join(removed.hint("shuffle_hash"), (F.coalesce(i, F.lit(LAST_ID)) == F.col("doc")) & (row == F.col("row")), "left")
    split = joined.select("_row", F.when(F.col("_out").isNotNull(), F.struct(F.split(text, "\n", -1).alias("lines"), F.col("_out").alias("out"))).alias("_split"))
    # by index, so the work goes with the number of lines
    kept = F.when(F.col("_split").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_split.lines") - 1), F.col("_split.out")))
    split = split.withColumn("_kept", kept)
    new = F.when(F.col("_kept").isNull(), text).otherwise(F.array_join(F.transform("_kept", lambda i: F.get(F.col("_split.lines"), i)), "\n"))
    gone = F.coalesce(F.size("_split.lines") - F.size("_kept"), F.lit(0)).cast("long")
    return split.select("_row", new.alias("_text"), gone.alias("_gone"))


class LineDedup:
    """The state of incremental line dedup in a folder of the shared file system.

    counts: every line with its count and first owner; filters: the cuckoo
    filter of each shard; postings: which documents have each line.  All three
    lie by shard, and docs tells which shards a document's lines are in.

    insert() and delete() read and write the shards that they touch and no
    others.  They write them into a folder of their own, and then a manifest,
    MANIFEST.<version>, which names the folders in force of every shard.  It
    appears whole or not at all, so a run that breaks off leaves the last
    version in force.  vacuum() removes what is in force no longer.  One run
    may write at a time; a second one fails.

    Rows without a doc_id are kept under, and deleted with, the largest id of
    its type.
    """

    SCHEMAS = {"counts": POSTINGS, "postings": POSTINGS, "filters": "shard int, filter binary", "docs": "doc long, shard int, bucket int"}

    def __init__(self, spark: SparkSession, path: str, shards: int = 64):
        ship(spark)
        self.spark, self.path = spark, path.rstrip("/")
        found = self._versions("MANIFEST.")
        if found:
            read = json.loads(spark.read.text(f"{self.path}/MANIFEST.{max(found)}", wholetext=True).first()[0])
            self.state = read | {k: {int(s): v for s, v in read[k].items()} for k in ("counts", "postings")}
        else:
            self.state = {"version": 0, "shards": shards, "counts": {}, "postings": {}, "docs": []}

    @property
    def version(self) -> int:
        return self.state["version"]

    @property
    def shards(self) -> int:
        return self.state["shards"]

    # -- files

    def _hadoop(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self):
        return self._hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, prefix: str) -> list[int]:
        """The numbers of the files or folders with this name before them."""
        fs, at = self._fs(), self._hadoop(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit()]

    def _read(self, name: str, folders: dict[int, list[int]], by: str) -> DataFrame:
        """A table's rows: of each version the parts (of column `by`) that are given."""
        out = self.spark.createDataFrame([], self.SCHEMAS[name])
        for v, parts in sorted(folders.items()):
            rows = self.spark.read.schema(self.SCHEMAS[name]).parquet(f"{self.path}/v{v}/{name}")
            out = out.unionByName(rows.where(F.col(by).isin(parts)))
        return out

    def table(self, name: str, shards: Iterable[int] | None = None) -> DataFrame:
        """counts, filters or postings of these shards, or of all."""
        live = self.state["postings" if name == "postings" else "counts"]
        folders = defaultdict(list)
        for shard in live if shards is None else live.keys() & set(shards):
            for v in live[shard] if name == "postings" else [live[shard]]:
                folders[v].append(shard)
        return self._read(name, folders, "shard")

    def _write(self, df: DataFrame, name: str, part: str = "shard") -> None:
        df.repartition(part).sortWithinPartitions(part).write.mode("overwrite").partitionBy(part).parquet(f"{self.path}/v{self.version + 1}/{name}")

    def _commit(self, state: dict) -> None:
        """Put the next version in force: a manifest under another name, renamed when it is whole."""
        state["version"] = self.version + 1
        fs, part, whole = self._fs(), self._hadoop(f"{self.path}/.{uuid.uuid4().hex}"), self._hadoop(f"{self.path}/MANIFEST.{state['version']}")
        out = fs.create(part)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(whole) or not fs.rename(part, whole):
            raise RuntimeError(f"version {state['version']} of {self.path} was written by another run")
        self.state = state

    def vacuum(self) -> None:
        """Remove the folders and manifests that the newest manifest does without."""
        kept = {*self.state["counts"].values(), *self.state["docs"], *(v for vs in self.state["postings"].values() for v in vs)}
        for prefix, live in (("v", kept), ("MANIFEST.", {self.version})):
            for v in set(self._versions(prefix)) - live:
                self._fs().delete(self._hadoop(f"{self.path}/{prefix}{v}"), True)

    # -- operations

    def occurrences(self, docs: DataFrame) -> DataFrame:
        return _source(docs).mapInArrow(_postings(self.shards, True), POSTINGS)

    def insert(self, docs: DataFrame) -> DataFrame:
        """Count the lines of docs; gives docs' lines (doc, row, pos) that were there before.

        Only lines that the filter may know are joined with the exact counts.
        """
        new = cut(self.occurrences(docs))
        touched = [r[0] for r in new.select("shard").distinct().collect()]  # shards
        keys = ["shard", "hi", "lo"]
        old, filters = self.table("counts", touched), self.table("filters", touched)
        probed = new.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_probe, POSTINGS + ", maybe boolean")
        known = probed.where("maybe").join(old.select(*keys), keys, "left_semi").select("doc", "row", "pos")
        first = F.min(F.struct("doc", "row", "pos")).alias("f")
        added = cut(new.groupBy(*keys).agg(first, F.sum("refs").alias("refs")))
        repeated = new.join(added.select(*keys, "f"), keys).where(F.struct("doc", "row", "pos") != F.col("f")).select("doc", "row", "pos")
        repeated = cut(known.unionByName(repeated).distinct())
        both = old.withColumn("fresh", F.lit(0)).unionByName(added.select(*keys, "refs", "f.*", F.lit(1).alias("fresh")))
        # fresh in what is added alone
        counts = cut(both.groupBy(*keys).agg(F.sum("refs").alias("refs"), first, F.min("fresh").alias("fresh")).select(*keys, "refs", "f.doc", "f.row", "f.pos", "fresh"))
        self._write(counts.drop("fresh"), "counts")
        self._write(counts.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_grown, self.SCHEMAS["filters"]), "filters")
        self._write(new, "postings")
        self._write(new.select("doc", "shard", F.pmod(F.xxhash64("doc"), F.lit(self.shards)).cast("int").alias("bucket")).distinct(), "docs", "bucket")
        v = self.version + 1
        state = dict(self.state, docs=[*self.state["docs"], v], counts=self.state["counts"] | {s: v for s in touched})
        state["postings"] = self.state["postings"] | {s: [*self.state["postings"].get(s, []), v] for s in touched}
        self._commit(state)
        return repeated

    def touched_by(self, ids: DataFrame) -> list[int]:
        """The shards that have lines of these documents (doc), of which only the index of their own is read."""
        bucket = F.pmod(F.xxhash64("doc"), F.lit(self.shards)).cast("int")
        buckets = [r[0] for r in ids.select(bucket).distinct().collect()]  # at most as many as shards
        held = self._read("docs", {v: buckets for v in self.state["docs"]}, "bucket")
        return [r[0] for r in held.join(ids, "doc", "left_semi").select("shard").distinct().collect()]  # shards

    def delete(self, doc_ids: DataFrame) -> None:
        """Take the documents with these ids (column doc_id) out again.

        Counts of their lines go down; a line whose count falls to nothing
        leaves the table and has its fingerprint removed from the filter; one
        that loses its first owner gets the first that is left.
        """
        ids = cut(doc_ids.select(F.col("doc_id").cast("long").alias("doc")).where("doc is not null").distinct())
        touched = self.touched_by(ids)
        if not touched:
            return
        keys = ["shard", "hi", "lo"]
        postings, old, filters = (self.table(name, touched) for name in ("postings", "counts", "filters"))
        rest = cut(postings.join(ids, "doc", "left_anti").select(*postings.columns))
        less = cut(postings.join(ids, "doc", "left_semi").groupBy(*keys).agg(F.sum("refs").alias("less")))
        owners = rest.join(less, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct("doc", "row", "pos")).alias("f"))
        left = old.join(less, keys, "left").withColumn("refs", F.col("refs") - F.coalesce("less", F.lit(0))).where("refs > 0").join(owners, keys, "left")
        counts = cut(left.select(*keys, "refs", *[F.coalesce(F.col("f")[c], F.col(c)).alias(c) for c in ("doc", "row", "pos")]))
        gone = less.join(counts, keys, "left_anti").select("shard", "hi")
        self._write(counts, "counts")
        self._write(filters.groupBy("shard").cogroup(gone.groupBy("shard")).applyInArrow(_shrunk, self.SCHEMAS["filters"]), "filters")
        self._write(rest, "postings")
        v = self.version + 1
        self._commit(dict(self.state, counts=self.state["counts"] | dict.fromkeys(touched, v), postings=self.state["postings"] | {s: [v] for s in touched}))


def _keys(table: pa.Table) -> np.ndarray:
    return table.column("hi").to_numpy().view(np.uint64)


def _filter(table: pa.Table, size: int = 1024) -> Cuckoo:
    return Cuckoo.from_bytes(table.column("filter")[0].as_py()) if table.num_rows else Cuckoo(size)


def _stored(shard: int, cuckoo: Cuckoo) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([cuckoo.to_bytes()], pa.binary())})


def _probe(new: pa.Table, filters: pa.Table) -> pa.Table:
    """Occurrences with whether the filter may know them."""
    if not new.num_rows:
        return new.append_column("maybe", pa.array([], pa.bool_()))
    return new.append_column("maybe", pa.array(_filter(filters).contains(_keys(new)), pa.bool_()))


def _grown(counts: pa.Table, filters: pa.Table) -> pa.Table:
    """The filter with the fresh keys in it; all keys are there in case it must be larger."""
    if not counts.num_rows:
        return filters
    every, cuckoo = _keys(counts), _filter(filters, counts.num_rows)
    cuckoo.insert(every[counts.column("fresh").to_numpy() == 1], lambda: every)
    return _stored(counts.column("shard")[0].as_py(), cuckoo)


def _shrunk(filters: pa.Table, gone: pa.Table) -> pa.Table:
    """The filter without the fingerprints of the keys that are gone."""
    if not filters.num_rows:
        return filters
    cuckoo = _filter(filters)
    if gone.num_rows:
        cuckoo.remove(_keys(gone))
    return _stored(filters.column("shard")[0].as_py(), cuckoo)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without repeated lines; one that loses all its text goes.

    Lines are told apart and rows without id, with repeats or of null text are
    treated as in dedup_lines; a text that was null or blank before stays.
    n_chars, if there is such a column, becomes the new length.
    """
    rows = _deduped(docs, None)
    rows = rows.where((F.col("_gone") == 0) | F.col("_text").rlike(r"\S"))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        n = F.length("_text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("_gone") > 0, n).otherwise(F.col("_row.n_chars"))
    return unwrapped(rows, docs.columns, **changed)
