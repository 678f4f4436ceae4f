"""Exact deduplication by an extendible-hash index on shared files.

The key of a text is its 64-bit hash. The directory is addressed by the key's leading bits; a bucket that would hold more than
`capacity` bytes of different texts is split by its next bit, and the directory doubles when that bit is beyond its
depth. What the splits need is a histogram of the keys by their next `bits` bits (a copy counts once, so copies overfill nothing). The
keys are written down once; each level counts all slots that are still overfull in one grouped job and splits them where they are,
so the number of jobs grows with the depth and not with the number of overfull slots.

Buckets in the order of their prefixes are contiguous ranges of keys. Capacity is raised with the total, to 2^-15 of it, so there are at most 2^15
overfull prefixes of each length and the directory stays small enough to send to the tasks (checked: MOST_BUCKETS), whatever the input.

Building: tasks first put equal texts of a batch together, so a group of copies sends one row from each batch, then rows move to
the owner of their bucket; owners have ranges of keys with about the same number of bytes. An owner reads its buckets in the order of the keys, chains the texts of one key, compares them
byte for byte, and writes an entry for each different text: (bucket, key, chain, keep_id, group_size, text_sha256). Entries are
Parquet files in the folder that all executors share; the directory lies beside them. One chain at a time is in memory.

Probing: documents look their entry up by key and hash of the whole text, in a join whose large keys Spark may split. classify() and
dedup() remove their index once the probe is written down; build() leaves it for later probes.

Defined cases: null counts as the empty text; of equal texts the largest doc_id stays, a null doc_id only if all are null; of
rows with equal doc_id and text one is kept; a very long text is one row of its owner's task and has to fit it; an empty table gives an empty result; other columns are ignored by classify(),
and dedup() keeps them (of rows with equal doc_id and text, any one).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, fresh, remove, shared_dir, text_of

CAPACITY = 8 << 20
HISTOGRAM_BITS = 16
#: Buckets that the directory may list: 64 prefix lengths of at most 2^15 overfull prefixes each, two buckets under each. Nearly always 2^16 or so.
MOST_BUCKETS = 1 << 22
OWNED_BYTES = 16 << 20


@dataclass
class Bucket:
    prefix: int
    depth: int
    load: int


def split_buckets(load: dict[int, tuple[int, int]], bits: int, capacity: int, prefix: int = 0, depth: int = 0) -> tuple[list[Bucket], list[Bucket]]:
    """Buckets by splitting on one bit after another, and those of `bits` bits that are still overfull.

    load: bytes and keys by slot, a slot being the next `bits` bits of the keys that begin with prefix (of depth bits).
    """
    done, overfull, todo = [], [], [(0, 0, sorted(load.items()))]
    while todo:
        at, deep, held = todo.pop()
        total, keys = sum(x[1][0] for x in held), sum(x[1][1] for x in held)
        here = Bucket(prefix << deep | at, depth + deep, total)
        if total <= capacity or keys < 2:  # one key can't be split: its chain grows instead
            done.append(here)
        elif deep == bits:
            (done if depth + deep == 64 else overfull).append(here)
        else:
            shift = bits - deep - 1
            todo += [(at << 1 | b, deep + 1, [x for x in held if x[0] >> shift & 1 == b]) for b in (1, 0)]
    return done, overfull


@dataclass
class Index:
    """The index on shared files."""

    path: str

    def entries(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/entries")

    def directory(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/directory")


SPLIT = "prefix long, depth int, load long, overfull boolean"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def splitter(depth: int, bits: int, capacity: int):
    """Splits one overfull slot of the level above: a group of at most 2^bits rows."""

    def split(group):
        load = {s & (1 << bits) - 1: (b, n) for s, b, n in zip(*(group[c].to_pylist() for c in ("slot", "bytes", "n")))}
        done, over = split_buckets(load, bits, capacity, group["parent"][0].as_py() & (1 << 64) - 1, depth)
        rows = [(signed(b.prefix), b.depth, b.load, flag) for found, flag in ((done, False), (over, True)) for b in found]
        types = zip(("prefix", "depth", "load", "overfull"), (pa.int64(), pa.int32(), pa.int64(), pa.bool_()))
        return pa.table({name: pa.array(x, kind) for (name, kind), x in zip(types, zip(*rows))})

    return split


def directory_of(keys: DataFrame, capacity: int, bits: int) -> list[Bucket]:
    """The buckets, in the order of their keys. keys: (key, bytes), one row for each key, written down."""

    def leading(depth: int):
        return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")

    buckets, depth, open_ = [], 0, keys
    while True:
        step = min(bits, 64 - depth)
        slots = open_.groupBy(leading(depth).alias("parent"), leading(depth + step).alias("slot")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))

        found = durable(slots.groupBy("parent").applyInArrow(splitter(depth, step, capacity), SPLIT))
        buckets += [Bucket(p & (1 << 64) - 1, d, n) for p, d, n in found.where("not overfull").select("prefix", "depth", "load").limit(MOST_BUCKETS + 1).collect()]
        if len(buckets) > MOST_BUCKETS:
            raise ValueError(f"more than {MOST_BUCKETS} buckets: raise the capacity")
        if found.where("overfull").isEmpty():
            return sorted(buckets, key=lambda b: b.prefix << 64 - b.depth) or [Bucket(0, 0, 0)]
        depth += step
        over = found.where("overfull").select(F.col("prefix").alias("p"))
        open_ = open_.join(over, leading(depth) == F.col("p"), "left_semi")


COMBINED = "owner int, bucket int, key long, text string, last long, n long"
ENTRY = "bucket int, key long, chain int, keep_id long, group_size long, n_bytes long, text_sha256 string"


def combine(batches: Iterator[pa.RecordBatch], first: np.ndarray, owners: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Equal texts of a batch as one row, with the bucket that their key lies in and its owner. first: the least key of each bucket."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(["key", "text"]).aggregate([("doc_id", "max"), ([], "count_all")])
        at = np.searchsorted(first, t["key"].to_numpy().view(np.uint64), side="right") - 1
        columns = [pa.array(owners[at]), pa.array(at.astype(np.int32)), *(t[c] for c in ("key", "text", "doc_id_max", "count_all"))]
        yield from pa.table(columns, names=["owner", "bucket", "key", "text", "last", "n"]).combine_chunks().to_batches()


def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of an owner's buckets, whose rows come in the order of bucket and key."""
    names = [x.split()[0] for x in ENTRY.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    at, chain = None, []

    def entries() -> list[tuple]:
        return [(*at, i, last, n, len(text), hashlib.sha256(text).hexdigest()) for i, (text, last, n) in enumerate(chain)]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        out = []
        texts = batch["text"].cast(pa.binary())
        for i, (bucket, key, last, n) in enumerate(zip(*(batch[c].to_pylist() for c in ("bucket", "key", "last", "n")))):
            if (bucket, key) != at:
                out += entries() if at else []
                at, chain = (bucket, key), []
            text = texts[i].as_py()
            for link in chain:
                if link[0] == text:
                    link[1] = last if link[1] is None or last is not None and last > link[1] else link[1]
                    link[2] += n
                    break
            else:
                chain.append([text, last, n])
        if out:
            yield packed(out)
    if at:
        yield packed(entries())


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("key"), *more)


def build(docs: DataFrame, capacity: int = CAPACITY, bits: int = HISTOGRAM_BITS) -> Index:
    """The index of all texts, written to the shared folder."""
    spark, rows = docs.sparkSession, keyed(docs)
    keys = durable(rows.groupBy("key").agg(F.max(F.octet_length("text")).cast("long").alias("bytes")))
    total = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = directory_of(keys, max(capacity, total >> 15), bits)
    depth, index = max(b.depth for b in buckets), Index(f"{shared_dir(spark)}/extendible-{uuid.uuid4().hex}")
    tasks = max(1, min(len(buckets), max(-(-total // OWNED_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    before = np.cumsum([0] + [b.load for b in buckets[:-1]], dtype=np.float64)
    owners = np.minimum(before * tasks / max(1, total), tasks - 1).astype(np.int32)
    sent = spark.sparkContext.broadcast((np.array([b.prefix << 64 - b.depth for b in buckets], dtype=np.uint64), owners))
    owned = rows.select("key", "text", "doc_id").mapInArrow(lambda batches: combine(batches, *sent.value), COMBINED)
    owned.repartitionById(tasks, "owner").sortWithinPartitions("bucket", "key").drop("owner").mapInArrow(own, ENTRY).write.parquet(f"{index.path}/entries")
    listed = [(i, format(b.prefix, f"0{b.depth}b") if b.depth else "", b.depth, depth, b.load, int(o)) for i, (b, o) in enumerate(zip(buckets, owners))]
    schema = "bucket int, prefix string, local_depth int, global_depth int, bytes long, owner int"
    spark.createDataFrame(listed, schema).coalesce(1).write.parquet(f"{index.path}/directory")
    return index


def looked_up(docs: DataFrame, index: Index) -> DataFrame:
    """For each different (doc_id, text): its key, hash, number of rows, and entry."""
    members = keyed(docs).select("doc_id", "key", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    members = members.groupBy("doc_id", "key", "text_sha256").agg(F.count("*").alias("rows"))
    return members.join(index.entries(docs.sparkSession).select("key", "text_sha256", "keep_id", "group_size"), ["key", "text_sha256"])


def probed(docs: DataFrame, capacity: int) -> DataFrame:
    """looked_up() by an index made for it, written down; the index is removed."""
    index = build(docs, capacity)
    try:
        return durable(looked_up(docs, index))
    finally:
        remove(docs.sparkSession, index.path)


def classify(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row."""
    found = probed(docs, capacity).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows that stay, with all their columns."""
    key, sha, first = fresh(docs, "key", "sha", "first")
    stay = probed(docs, capacity).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    stay = stay.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), F.col("text_sha256").alias("s"))
    rows = docs.withColumns({key: F.xxhash64(text_of()), sha: F.sha2(text_of().cast("binary"), 256)})
    same = rows["doc_id"].cast("long").eqNullSafe(stay["id"]) & (rows[key] == stay["k"]) & (rows[sha] == stay["s"])
    joined = rows.join(stay, same).select(*(rows[c] for c in rows.columns))
    return joined.withColumn(first, F.row_number().over(Window.partitionBy(key, sha).orderBy("doc_id"))).where(F.col(first) == 1).select(*docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)
"""
