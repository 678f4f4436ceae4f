"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order of (doc_id, text_crc32, size), nulls first. A keyed Feistel network permutes
the least domain of an even number of bits that holds N; results outside 0..N-1 are permuted again until they
fall inside (cycle walking), which gives a permutation of exactly N numbers. Row p of the shuffle goes to shard p % shards, slot p // shards,
so the counts differ by one at most and both can be computed from the row number alone, in either direction.

Only (doc_id, size, crc) are shuffled, never texts; the permutation itself needs no shuffle.

Defined cases: null text has size 1 and crc32 0, as the empty one but for nothing; null and repeated doc_ids keep
a row each; very long texts only count with their size; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, text_of

PRIME = 2_147_483_647
ROUND_KEYS = (1_812_433_253, 374_761_393, 668_265_263, 974_711, 1_181_783_497, 2_118_042_229, 52_711, 1_640_531_527)


def half_bits(n: int) -> int:
    """Bits of each half of the least even-sized domain that holds n numbers."""
    return max(1, -(-max(1, (n - 1).bit_length()) // 2))


def mix(half: np.ndarray, key: int) -> np.ndarray:
    """Round function; every product stays under 2**62, so that SQL's 64-bit integers can follow it."""
    x = (half + key) % PRIME
    return (x * x % PRIME * 48_271 + key) % PRIME


def permute(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Where each of the numbers (all under n) goes in the keyed shuffle of 0..n-1."""
    bits = half_bits(n)
    mask, out, todo = (1 << bits) - 1, np.asarray(numbers, dtype=np.int64).copy(), np.arange(len(numbers))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for key in ROUND_KEYS:
            left, right = right, left ^ (mix(right, (key + seed) % PRIME) & mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= n]
    return out


def unpermute(places: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The inverse of permute(): the row number found at each place."""
    bits = half_bits(n)
    mask, out, todo = (1 << bits) - 1, np.asarray(places, dtype=np.int64).copy(), np.arange(len(places))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for key in reversed(ROUND_KEYS):
            left, right = right ^ (mix(left, (key + seed) % PRIME) & mask), left
        out[todo] = left << bits | right
        todo = todo[out[todo] >= n]
    return out


def number_rows(rows: DataFrame, order: list[str]) -> tuple[DataFrame, dict[int, int], int]:
    """Rows with (part, idx), the first number of each part, and the number of rows.

    What reaches the driver is one count for each partition. The rows are written down before they are counted, so
    that a rerun can't number them in another way.
    """
    (tie,) = fresh(rows, "tie")  # rows equal in all are one as good as another, and may be many
    placed = durable(
        rows.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(*order, tie)
        .sortWithinPartitions(*order, tie)
        .drop(tie)
        .withColumn("part", F.spark_partition_id())
        .withColumn("idx", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    starts, total = {}, 0
    for part, n in sorted(placed.groupBy("part").count().collect()):
        starts[part], total = total, total + n
    return placed, starts, total


def shard(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row."""
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text_of()).cast("long") + 1).alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
    )
    placed, starts, n = number_rows(rows, ["doc_id", "text_crc32", "size"])

    @F.pandas_udf("long")
    def place(part, idx):
        first = part.map(starts).to_numpy(dtype="int64") if len(part) else np.zeros(0, dtype="int64")
        return type(idx)(permute(first + idx.to_numpy(), n, seed))

    return placed.withColumn("p", place("part", "idx")).select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("p") % shards).cast("int").alias("shard"),
        F.floor(F.col("p") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The shuffle in SQL: one round of the network for each step of the recursion, on until the number lies under n.
ORACLE = f"""
WITH RECURSIVE numbered AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, coalesce(text, '') AS t,
         row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
dom AS (SELECT count(*) AS n, CAST(greatest(1, ceil(ceil(log2(count(*))) / 2)) AS BIGINT) AS b FROM documents),
walk(i, l, r, k) AS (
  SELECT i, i // (1 << b), i % (1 << b), 0 FROM numbered, dom
  UNION ALL
  SELECT i, r, xor(l, ((((r + key) % {PRIME}) * ((r + key) % {PRIME}) % {PRIME} * 48271 + key) % {PRIME}) % (1 << b)), k % 8 + 1
  FROM (SELECT w.*, b, n, CAST([{', '.join(str(k % PRIME) for k in ROUND_KEYS)}][k % 8 + 1] AS BIGINT) AS key FROM walk w, dom)
  WHERE k < 8 OR l * (1 << b) + r >= n),
done AS (SELECT i, l * (1 << b) + r AS p FROM walk, dom WHERE k = 8 AND l * (1 << b) + r < n)
SELECT doc_id, size, 'rows' AS law, CAST(p % 8 AS INTEGER) AS shard, CAST(p // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN done USING (i)
"""
