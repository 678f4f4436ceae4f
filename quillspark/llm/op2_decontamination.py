"""Benchmark decontamination with suffix arrays of the training shards.

A shard is a batch of whole documents. Its words become the numbers that the benchmark gives its own words, 0 for all others, and
the suffixes that start with a benchmark word are sorted: first by as many words as fit one 64-bit key, then the ties by twice as many
words each round, until they differ, meet a 0 or are longer than any benchmark item. The benchmark's windows are then searched in that
array by bisection, each distinct one once: the run of suffixes that share its words gives each place where it stands. Within a document's part of that run every
benchmark suffix that starts with the window is bisected to its neighbours, which have the longest verbatim match and say where it is. Work and memory grow with the words of the
shard, the benchmark and the pairs of document and item found, not with the product of repeats on both sides.

Only the benchmark is sent to the tasks, repeated items once. Its size is counted first; if it is over `block_bytes`, it is dealt into blocks by
a hash of item and text, written to the shared folder, and the documents are searched for one block after another: each block is a pass of its own
over the documents, whose hits, a row for each document hit, are written down before the block is dropped and the next one read. So the driver and
a task hold one block at a time (or one item, if that is longer). The last pass gives the result, to which the hits of those before are joined by document.
Texts are never shuffled by report(); filter_clean() with more than one block joins the hit documents' ids and hashes to the documents.

Words: A-Z lower-cased, runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. Defined cases: null and empty texts have no words and are not hit; items
without words have no windows; of items with equal ids either may match; items with a null id count under the id `null`; an empty benchmark hits
nothing; repeated rows give a row each; further columns stay in filter_clean() and are ignored elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, remove, shared_dir, split_words, text_of

WINDOW = 10
BLOCK_BYTES = 32 << 20
SHARD_WORDS = 4_000_000
#: Lower-cases A-Z and makes a space of every byte that isn't in a word.
FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Items:
    """A block of the benchmark: the numbers of its words, its suffixes, and the distinct windows with the suffixes that start with each."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        split = [(str(k) if k is not None else "null", w) for k, t in items if (w := words_of(t))]
        self.number = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for _, words in split for w in words))}
        self.ids = [k for k, _ in split]
        lengths = np.array([len(w) for _, w in split], dtype=np.int64)
        self.deepest = int(lengths.max(initial=0))
        # a 0 stands behind each item
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        self.flat = np.zeros(int(lengths.sum()) + len(split) + max(self.deepest, 1), dtype=np.int32)
        for s, (_, words) in zip(starts.tolist(), split):
            self.flat[s : s + len(words)] = [self.number[w] for w in words]
        self.item = np.repeat(np.arange(len(split)), lengths + 1)
        self.rest = np.repeat(starts + lengths, lengths + 1) - np.arange(len(self.item))
        #: Words that a suffix has to share for its window to stand there; 0 for those that start no window.
        need = np.where((self.rest >= window) | (np.arange(len(self.item)) == starts[self.item]), np.minimum(self.rest, window), 0)
        order = sorted_suffixes(self.flat, len(self.number), window)
        #: The suffixes that start a window, those of equal windows together.
        self.suffix = order[need[order] > 0]
        need = need[self.suffix]
        new = np.ones(len(self.suffix), dtype=bool)
        if len(new):
            new[1:] = need[1:] != need[:-1]
            for j in range(int(need.max())):
                new[1:] |= (self.flat[self.suffix[1:] + j] != self.flat[self.suffix[:-1] + j]) & (j < need[1:])
        first = np.flatnonzero(new)
        #: Of each distinct window: where it starts, its words, its first suffix and their number.
        self.start, self.need, self.first = self.suffix[first], need[first], first
        self.count = np.diff(np.r_[first, len(self.suffix)])


def sorted_suffixes(text: np.ndarray, top: int, depth: int) -> np.ndarray:
    """Where the suffixes of text start that don't start with 0, in the order of their first `depth` words (or more) up to a 0; of equals the first comes first.

    text: numbers up to top, with a 0 at its end. Sorted by as many words as fit one key; then ties by twice as many each round, from the
    places of what stands behind.
    """
    bits = max(1, int(top).bit_length())
    each = max(1, min(62 // bits, depth, len(text)))
    key, open_ = np.zeros(len(text), dtype=np.int64), text > 0
    for j in range(each):
        key <<= bits
        open_[: len(text) - j] &= text[j:] > 0
        open_[len(text) - j :] = False
        key[: len(text) - j] |= np.where(open_[: len(text) - j], text[j:], 0)
    order = np.flatnonzero(text)
    order = order[np.argsort(key[order], kind="stable")]
    own = key[order]
    new = np.r_[True, own[1:] != own[:-1]][: len(order)]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    rank = np.zeros(len(text), dtype=np.int64)
    rank[order] = begin + 1
    # a suffix that has met a 0 ends there: nothing behind it can match
    tied = np.flatnonzero((~new | np.r_[~new[1:], False][: len(order)]) & (own & (1 << bits) - 1 > 0))
    del key, own
    seen = each
    while seen < depth and len(tied):
        at, group = order[tied], begin[tied]
        behind = rank[np.minimum(at + seen, len(text) - 1)]
        by = np.lexsort((behind, group))
        at, behind = at[by], behind[by]
        new = np.r_[True, (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])]
        order[tied], begin[tied] = at, np.maximum.accumulate(np.where(new, tied, 0))
        rank[at] = begin[tied] + 1
        tied = tied[(~new | np.r_[~new[1:], False]) & (behind > 0)]
        seen *= 2
    return order


#: Words that are compared one by one, then at once.
SINGLY, ATONCE = 4, 64


def common(text: np.ndarray, at: np.ndarray, flat: np.ndarray, start: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """How many words text at each place shares with flat at each start, up to rest."""
    length = np.zeros(len(at), dtype=np.int64)
    live, j = np.flatnonzero(rest > 0), 0
    while len(live):
        if j < SINGLY:
            live = live[text[at[live] + j] == flat[start[live] + j]]
            j += 1
            length[live] = j
        else:
            further = []
            for part in np.array_split(live, -(-len(live) // 8192)):
                k = np.arange(j, j + ATONCE)
                same = text.take(at[part, None] + k, mode="clip") == flat.take(start[part, None] + k, mode="clip")
                same &= k < rest[part, None]
                n = np.where(same.all(axis=1), ATONCE, same.argmin(axis=1))
                length[part] += n
                further.append(part[n == ATONCE])
            live, j = np.concatenate(further), j + ATONCE
        live = live[rest[live] > j]
    return length


def bisect(text: np.ndarray, order: np.ndarray, flat: np.ndarray, start: np.ndarray, need: np.ndarray, right: bool, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    """For each query, the words flat[start : start + need], the first place in order, or from low up to high, that isn't below it (right: that is above)."""
    low = np.zeros(len(start), dtype=np.int64) if low is None else low.copy()
    high = np.full(len(start), len(order), dtype=np.int64) if high is None else high.copy()
    live = np.flatnonzero(low < high)
    while len(live):
        mid = (low[live] + high[live]) // 2
        at, s, n = order[mid], start[live], need[live]
        same = common(text, at, flat, s, n)
        sign = np.where(same == n, 0, np.sign(text.take(at + same, mode="clip") - flat.take(s + same, mode="clip")))
        below = (sign <= 0) if right else (sign < 0)
        low[live], high[live] = np.where(below, mid + 1, low[live]), np.where(below, high[live], mid)
        live = live[low[live] < high[live]]
    return low


#: Benchmark suffixes whose longest matches are looked for together.
ASKED = 1 << 20


def search(text: np.ndarray, starts: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(spans, matches) of a shard whose documents start at starts. spans: start and end of each stretch of text that is inside windows. matches: a row for each document and item
    of which a window stands there: document, item, the words of the longest match and where it starts; of equally long ones that which is first in the item, at its first place.

    Each distinct window is searched once. Its places in one document are a run of the suffix array, and each benchmark suffix that starts with it is put into that run:
    its longest match is with a neighbour there. So repeats on one side are never multiplied with those on the other.
    """
    order = sorted_suffixes(text, len(items.number), items.deepest)
    low = bisect(text, order, items.flat, items.start, items.need, False)
    n = bisect(text, order, items.flat, items.start, items.need, True) - low
    window = np.repeat(np.arange(len(n)), n)
    if not len(window):
        return np.zeros((0, 2), dtype=np.int64), np.zeros((0, 4), dtype=np.int64)
    at = order[np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + low[window]]
    by = np.argsort(at, kind="stable")
    end = np.maximum.accumulate(at[by] + items.need[window[by]])
    new = np.flatnonzero(np.r_[True, at[by][1:] > end[:-1]])
    spans = np.stack([at[by][new], np.r_[end[new[1:] - 1], end[-1]]], axis=1)

    doc = np.searchsorted(starts, at, side="right") - 1
    by = np.lexsort((doc, window))  # places stay in the order of their suffixes
    at, doc, window = at[by], doc[by], window[by]
    first = np.flatnonzero(np.r_[True, (window[1:] != window[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[first[1:], len(at)]
    found = []
    asked = np.cumsum(items.count[window[first]])
    for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(asked // ASKED)) + 1):
        n = items.count[window[first[part]]]
        run = np.repeat(part, n)
        q = items.suffix[np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + items.first[window[first[run]]]]
        rest = items.rest[q]
        place = bisect(text, at, items.flat, q, rest, False, first[run], last[run])
        before, behind = np.maximum(place - 1, first[run]), np.minimum(place, last[run] - 1)
        length = np.maximum(common(text, at[before], items.flat, q, rest), common(text, at[behind], items.flat, q, rest))
        best = np.stack([doc[first[run]], items.item[q], length, q, run], axis=1)
        found.append(best_of(best))
    best = best_of(np.concatenate(found))
    q, length, run = best[:, 3], best[:, 2], best[:, 4]
    low = bisect(text, at, items.flat, q, length, False, first[run], last[run]).tolist()
    high = bisect(text, at, items.flat, q, length, True, first[run], last[run]).tolist()
    where = {(a, b): int(at[a:b].min()) for a, b in set(zip(low, high))}
    return spans, np.column_stack([best[:, :3], [where[p] for p in zip(low, high)]])


def best_of(rows: np.ndarray) -> np.ndarray:
    """Of rows (document, item, words, suffix, run) for each document and item that of the most words, of equals the first suffix."""
    rows = rows[np.lexsort((rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]]


def longer(a: tuple[int, int], b: tuple[int, int] | None) -> tuple[int, int]:
    """Of two matches (words, start) the longer, of equals the first."""
    return a if b is None or (-a[0], a[1]) < (-b[0], b[1]) else b


def hits_of(texts: list[str | None], items: Items) -> list[tuple[int, np.ndarray, dict[str, tuple[int, int]]]]:
    """For each text its number of words, the stretches hit (start, end), and by item the longest match: words, and the word where it starts."""
    found: list[tuple[int, np.ndarray, dict[str, tuple[int, int]]]] = []
    get, batch, held = items.number.get, [], 0

    def shard() -> None:
        lengths = np.array([len(x) for x in batch], dtype=np.int64)
        text = np.zeros(int(lengths.sum()) + len(batch) + items.deepest + 1, dtype=np.int32)
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        for s, x in zip(starts.tolist(), batch):
            text[s : s + len(x)] = x
        spans, matches = search(text, starts, items)
        of_span = np.searchsorted(np.searchsorted(starts, spans[:, 0], side="right") - 1, np.arange(len(batch) + 1))
        of_match = np.searchsorted(matches[:, 0], np.arange(len(batch) + 1))
        for i, n in enumerate(lengths.tolist()):
            longest: dict[str, tuple[int, int]] = {}
            for item, words, at in matches[of_match[i] : of_match[i + 1], 1:].tolist():
                longest[items.ids[item]] = longer((words, at - int(starts[i])), longest.get(items.ids[item]))
            found.append((n, spans[of_span[i] : of_span[i + 1]] - starts[i], longest))

    for text in texts:
        folded = (text or "").encode().translate(FOLD)
        numbers = np.concatenate([np.fromiter(map(get, w, repeat(0)), dtype=np.int32, count=len(w)) for w in split_words(folded)])
        if held + len(numbers) > SHARD_WORDS and batch:
            shard()
            batch, held = [], 0
        batch.append(numbers)
        held += len(numbers)
    if batch:
        shard()
    return found


def covered(spans: np.ndarray) -> int:
    """Words inside any of the spans."""
    if not len(spans):
        return 0
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    return int(np.maximum(0, spans[:, 1] - np.maximum(spans[:, 0], np.r_[0, end[:-1]])).sum())


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's (item_id, text), one bounded block after another. More than one are written down first, a folder for each."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // block_bytes) or 1
    if n == 1:
        yield [tuple(r) for r in items.collect()]
        return
    at = f"{shared_dir(spark)}/benchmark-{uuid4().hex}"
    try:
        items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).write.partitionBy("block").parquet(at)
        dealt = spark.read.schema("item_id string, text string, block long").parquet(at)
        for i in range(n):
            if block := [tuple(r) for r in dealt.where(F.col("block") == i).select("item_id", "text").collect()]:
                yield block
    finally:
        remove(spark, at)


FOUND = "struct<n: bigint, spans: array<bigint>, items: array<string>, longest: array<bigint>, at: array<bigint>>"
ARROW_FOUND = pa.struct([("n", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.list_(pa.int64())), ("at", pa.list_(pa.int64()))])


def searched(docs: DataFrame, block: list[tuple[str, str]], window: int, name: str, all_rows: bool = True):
    """docs with a column of the given name: words, starts and ends of the windows found, items and their longest verbatim matches. Without all_rows,
    the documents hit, without their text. Also the broadcast block."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    kept = [c for c in docs.columns if c != "text" or all_rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value, window)
        for batch in batches:
            rows = []
            for n, spans, longest in hits_of(batch.column("text").to_pylist(), items):
                rows.append({"n": n, "spans": spans.ravel().tolist(), "items": list(longest), "longest": [x for x, _ in longest.values()], "at": [x for _, x in longest.values()]})
            out = pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(rows, ARROW_FOUND)], names=[*kept, name])
            yield out if all_rows else out.filter(pa.array([len(r["spans"]) > 0 for r in rows], pa.bool_()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return docs.mapInArrow(run, f"{schema}, `{name}` {FOUND}"), sent


def passes(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> tuple[list[tuple[str, str]], DataFrame | None]:
    """The last block, and the hits of all blocks before it: doc_id, h (hash of the text), block, found; None if there are none."""
    keyed = docs.select("doc_id", F.xxhash64(text_of()).alias("h"), "text")
    blocks, earlier = blocks_of(benchmark, block_bytes), None
    block = next(blocks, [])
    for i, following in enumerate(blocks):
        hits, sent = searched(keyed, block, window, "found", all_rows=False)
        hits = durable(hits.withColumn("block", F.lit(i)).dropDuplicates(["doc_id", "h"]))
        sent.destroy()
        earlier = hits if earlier is None else earlier.union(hits)
        block = following
    return block, earlier


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, items array<string>, places array<struct<item_id: string, words: bigint, at: bigint>>"
PLACES = pa.list_(pa.struct([("item_id", pa.string()), ("words", pa.int64()), ("at", pa.int64())]))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: SCHEMA. longest: the most words that match verbatim; places: by item the longest match and the word at which it starts."""
    types = [*[pa.int64()] * 4, pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.string()), PLACES]
    schema = pa.schema(list(zip("doc_id n_words n_hit n_items items_sha256 contaminated longest items places".split(), types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, f in zip(batch["doc_id"].to_pylist(), batch["found"].to_pylist()):
                best: dict[str, tuple[int, int]] = {}
                for i, *match in zip(f["items"], f["longest"], f["at"]):
                    best[i] = longer(tuple(match), best.get(i))
                n, ids = covered(np.array(f["spans"], dtype=np.int64).reshape(-1, 2)), sorted(best)
                places = [{"item_id": i, "words": best[i][0], "at": best[i][1]} for i in ids]
                hashed = hashlib.sha256(",".join(ids).encode()).hexdigest()
                rows.append({"doc_id": doc_id, "n_words": f["n"], "n_hit": n, "n_items": len(ids), "items_sha256": hashed, "contaminated": n > 0, "longest": max((x["words"] for x in places), default=0), "items": ids, "places": places})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    block, earlier = passes(docs, benchmark, window, block_bytes)
    located, _ = searched(docs.withColumn("h", F.xxhash64(text_of())), block, window, "found")
    located = located.drop("text")
    if earlier is not None:
        parts = ("spans", "items", "longest", "at")
        before = earlier.groupBy(F.col("doc_id").alias("id"), F.col("h").alias("hash")).agg(*(F.flatten(F.collect_list(f"found.{x}")).alias(x) for x in parts))
        located = located.join(before, located["doc_id"].eqNullSafe(before["id"]) & (located["h"] == before["hash"]), "left")
        merged = [F.concat(f"found.{x}", F.coalesce(x, F.array().cast("array<string>" if x == "items" else "array<bigint>"))).alias(x) for x in parts]
        located = located.select("doc_id", F.struct(F.col("found.n").alias("n"), *merged).alias("found"))
    return located.select("doc_id", "found").mapInArrow(run, SCHEMA)


def filter_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no window stands, with all their columns."""
    name, h = fresh(docs, "found", "h")
    block, earlier = passes(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, window, block_bytes)
    if earlier is not None:
        gone = durable(earlier.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct())
        rows = docs.withColumn(h, F.xxhash64(text_of()))
        docs = rows.join(gone, rows["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (rows[h] == gone["gone_h"]), "left_anti").select(*docs.columns)
    return searched(docs, block, window, name)[0].where(F.size(f"{name}.spans") == 0).drop(name)
