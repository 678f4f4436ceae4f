r"""SimHash near-duplicates by BK-trees.

A text's fingerprint has a bit set where over half of the hashes of its word shingles have it (`fingerprint`). Equal fingerprints
are one, so only distinct ones are compared; two of them are linked if they differ in `radius` bits or fewer, and documents whose fingerprints hang
together by links are a component.

The trees hold all fingerprints between them. The 64 bits are cut into blocks, `radius` more than a table keeps, so that two linked
fingerprints agree in all blocks of some table: (table, kept bits) is a shard, and only members of a shard are compared. How many blocks
there are follows from the number of fingerprints, so that a shard of evenly spread bits stays small; the links found are the same for any number.
In a shard each member is searched in the shard's BK-tree, whose children are keyed by their Hamming distance d to the parent: a query
at distance q from a node follows the edges of q - radius to q + radius and no others, since distances obey the triangle inequality.

A shard of more than `tile` members, such as that of a large group of near copies, is dealt into tiles with a tree each, and each tree is sent to the
tiles of its own shard alone. A tree is one row of bounded size; sending all of them to all tasks would grow with the square of the corpus.
First each tile is searched in its own tree and the components so far are found; then members are dealt anew, each component of a shard that
fills a tile into tiles of its own. Two tiles of one and the same component have nothing to tell each other and are left out, and a query
skips subtrees that hold only its own component. So a group of copies costs time in proportion to its size, and every pair that could join
two components is still looked at. A search gives one edge for each member at most, never the pairs.

Words: A-Z lower-cased, runs of `[^\x20\x09-\x0D]+`; shingles of four words joined by a space, repeats included; hashes XXH64 of the UTF-8 bytes
with seed 42. Defined cases: a text of fewer words is one shingle; a text without words (null, empty, white space) has fingerprint zero, which
links like any other; a very long text is read in slices of 4 MB, its row has to fit an Arrow batch; null doc_ids count as no id: the component's id is the least of
the others, null if there is none; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, split_words
from .op10_jaccard_join import components

RADIUS, SHINGLE, SEED = 4, 4, 42
TILE = 1024
#: Members that a shard of evenly spread fingerprints may have.
SHARD = 1024
#: Pairs of a query and a node that are looked at together.
FRONT = 1 << 16
#: Lower-cases A-Z and makes a space of the other white space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of a text."""
    from xxhash import xxh64_intdigest

    counts, total, before = np.zeros(64, dtype=np.int64), 0, []

    def add(words: list[bytes], size: int) -> int:
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(length + 1) - 1
        start, whole = (end - length).tolist(), b" ".join(words)
        spans = map(slice, start, end[size - 1 :].tolist())
        h = np.fromiter(map(xxh64_intdigest, map(whole.__getitem__, spans), repeat(SEED)), dtype="<u8", count=len(words) - size + 1)
        for at in range(0, len(h), FRONT):
            bits = np.unpackbits(h[at : at + FRONT].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[:] += bits.sum(axis=0, dtype=np.int64)
        return len(h)

    for words in split_words((text or "").encode("utf-8", "surrogatepass").translate(FOLD)):
        before += words
        if len(before) >= n:
            total += add(before, n)
            before = before[-(n - 1) :] if n > 1 else []
    if not total and before:
        total = add(before, len(before))
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), n) for x in batch["text"]], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Distinct fingerprints; children keyed by their distance to the parent. Nodes and queries may have a component each, by a number."""

    def __init__(self, fps: np.ndarray, component: np.ndarray | None = None) -> None:
        self.fps, n = fps, len(fps)
        parent, edge = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        level: list[np.ndarray] = []
        rest, under = np.arange(1, n), np.zeros(max(0, n - 1), dtype=np.int64)
        while len(rest):  # all that hang below a node at one distance go down together; the first of them is the child
            d = np.bitwise_count(fps[rest] ^ fps[under]).astype(np.int64)
            _, first, same = np.unique(under * 128 + d, return_index=True, return_inverse=True)
            child = rest[first]
            parent[child], edge[child] = under[first], d[first]
            level.append(child)
            below = np.ones(len(rest), dtype=bool)
            below[first] = False
            rest, under = rest[below], child[same][below]
        key = parent[1:] * 128 + edge[1:]
        by = np.argsort(key, kind="stable")
        self.key, self.child = key[by], by + 1
        self.component = component
        if component is not None:
            self.low, self.high = component.copy(), component.copy()  # of the components in a node's subtree
            for nodes in reversed(level):
                np.minimum.at(self.low, parent[nodes], self.low[nodes])
                np.maximum.at(self.high, parent[nodes], self.high[nodes])

    def search(self, queries: np.ndarray, radius: int, component: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) within the radius, in parts; with components those of different ones."""
        q = np.arange(len(queries) if len(self.fps) else 0)
        open_ = [(q, np.zeros(len(q), dtype=np.int64))]
        while open_:
            q, node = open_.pop()
            if len(q) > FRONT:
                open_.append((q[FRONT:], node[FRONT:]))
                q, node = q[:FRONT], node[:FRONT]
            if component is not None:
                other = (self.low[node] != component[q]) | (self.high[node] != component[q])
                q, node = q[other], node[other]
            if not len(q):
                continue
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            hit = d <= radius
            if component is not None:
                hit &= self.component[node] != component[q]
            if hit.any():
                yield q[hit], node[hit]
            first = np.searchsorted(self.key, node * 128 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.key, node * 128 + np.minimum(d + radius, 127), side="right") - first
            if n.any():
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                open_.append((np.repeat(q, n), self.child[at]))


def least_reached(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n members the least that it hangs together with."""
    up = np.arange(n)
    for a, b in links:
        while True:
            x, y = up[a], up[b]
            apart = x != y
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(up, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
            while not (up[up] == up).all():
                up = up[up]
    return up


def masks(n: int, radius: int, shard: int = SHARD) -> list[int]:
    """The kept bits of each table, as signed longs: of b blocks any b - radius, b being the least number by which n evenly spread fingerprints make shards of `shard` at most."""
    blocks = next(b for b in range(radius + 1, 64) if b == radius + 6 or n <= shard << 64 * (b - radius) // b)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [int(np.array([sum(x)], dtype=np.uint64).view(np.int64)[0]) for x in combinations(block, blocks - radius)]


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of equal long columns `names`, which come together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        of = np.stack([batch[x].to_numpy() for x in names])
        edges = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            if held and tuple(of[:, start]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = tuple(of[:, start])
    if held:
        yield pa.Table.from_batches(held)


EDGES = "a long, b long"


def edges_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def within(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Each tile's members searched in the tile's own tree: an edge from each to the first one it hangs together with."""
    for group in groups(batches, ["table", "key", "tile"]):
        fps = np.sort(group["fp"].to_numpy().view(np.uint64))
        up = least_reached(len(fps), BKTree(fps).search(fps, radius))
        moved = np.flatnonzero(up != np.arange(len(fps)))
        if len(moved):
            yield edges_of(fps[moved], fps[up[moved]])


PACKED = "table long, key long, tile long, fps binary, roots binary"


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A tile as one row."""
    for group in groups(batches, ["table", "key", "tile"]):
        row = [[group[x][0].as_py()] for x in ("table", "key", "tile")] + [[group[x].to_numpy().tobytes()] for x in ("fp", "root")]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.int64()] * 3 + [pa.binary()] * 2)], names=["table", "key", "tile", "fps", "roots"])


def across(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """The members of one tile searched in the tree of another: an edge from each component to the least that it hangs together with."""
    for batch in batches:
        for own, roots, other, other_roots in zip(*(batch[x] for x in ("fps", "roots", "other_fps", "other_roots"))):
            a, b = (np.frombuffer(x.as_py(), dtype=np.uint64) for x in (own, other))
            ra, rb = (np.frombuffer(x.as_py(), dtype=np.int64) for x in (roots, other_roots))
            name, number = np.unique(np.concatenate([ra, rb]), return_inverse=True)
            ca, cb = number[: len(ra)], number[len(ra) :]
            if name.size > 1:
                links = ((ca[q], cb[node]) for q, node in BKTree(b, cb).search(a, radius, ca))
                up = least_reached(len(name), links)
                moved = np.flatnonzero(up != np.arange(len(name)))
                if len(moved):
                    yield edges_of(name[moved], name[up[moved]])


def linked(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, shard: int = SHARD) -> DataFrame:
    """(node, root) for each of the distinct fps that has a link; root is the same for all that hang together. fps: fp, and written down."""
    kept = masks(fps.count(), radius, shard)
    met = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in kept)))).select("fp", F.col("pos").cast("long").alias("table"), F.col("col").alias("key"))
    shards = met.groupBy("table", "key").agg(F.count("*").alias("m")).where("m > 1")
    k = F.ceil(F.col("m") / tile)
    met = durable(met.join(shards, ["table", "key"]).select("table", "key", F.pmod(F.xxhash64("fp"), k).alias("tile"), (k > 1).alias("large"), "fp"))
    of_tile = ["table", "key", "tile"]
    edges = met.select(*of_tile, "fp").repartition(*of_tile).sortWithinPartitions(*of_tile).mapInArrow(lambda b: within(b, radius), EDGES)
    names = components(edges)
    large = met.where("large")
    if not large.limit(1).count():
        return names
    # deal the large shards anew, by component
    large = durable(large.select("table", "key", "fp").join(names, F.col("fp") == F.col("node"), "left").select("table", "key", "fp", F.coalesce("root", "fp").alias("root")))
    parts = large.groupBy("table", "key", "root").agg(F.count("*").alias("c")).withColumn("own", F.col("c") * 2 > tile)
    mixed = parts.where("not own").groupBy("table", "key").agg(F.ceil(F.sum("c") / tile).alias("k"))
    parts = durable(parts.join(mixed, ["table", "key"], "left"))
    # a tile's number: a hash of component and part for those of one component, 0 to k - 1 for the mixed ones
    k = F.ceil(F.col("c") / tile)
    number = F.when(F.col("own"), F.xxhash64("root", F.pmod(F.xxhash64("fp"), k)).bitwiseOR(F.lit(-1 << 63))).otherwise(F.pmod(F.xxhash64("root"), F.col("k")))
    dealt = large.join(parts, ["table", "key", "root"]).select("table", "key", number.alias("tile"), "fp", "root")
    trees = durable(dealt.repartition(*of_tile).sortWithinPartitions(*of_tile).mapInArrow(packed, PACKED))
    alone = F.when(F.col("tile") < 0, F.xxhash64(F.substring("roots", 1, 8)))  # the component of a tile that has one only
    tiles = trees.select("table", "key", "tile", alone.alias("alone"))
    others = tiles.select("table", "key", F.col("tile").alias("other"), F.col("alone").alias("other_alone"))
    pairs = tiles.join(others, ["table", "key"]).where("tile <= other and (alone is null or other_alone is null or alone <> other_alone)").select(*of_tile, "other")
    both = pairs.join(trees, of_tile).join(trees.select("table", "key", F.col("tile").alias("other"), F.col("fps").alias("other_fps"), F.col("roots").alias("other_roots")), ["table", "key", "other"])
    further = components(both.select("fps", "roots", "other_fps", "other_roots").repartition(both.sparkSession.sparkContext.defaultParallelism).mapInArrow(lambda b: across(b, radius), EDGES))
    # a single fingerprint that has met a component now has no name of the first round
    moved = names.join(further.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return moved.union(further.join(names, "node", "left_anti").select("node", "root"))


def near(docs: DataFrame, radius: int = RADIUS, n: int = SHINGLE, tile: int = TILE, shard: int = SHARD) -> DataFrame:
    """For each row: doc_id, fingerprint (16 lowercase hex digits), component_id (the least doc_id of its component), n_same (rows of the same fingerprint)."""
    rows = durable(fingerprints(docs, n))
    fps = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n_same")))
    names = linked(fps.select("fp"), radius, tile, shard)
    named = durable(fps.join(names, F.col("fp") == F.col("node"), "left").select("fp", "id", "n_same", F.coalesce("root", "fp").alias("root")))
    ids = named.groupBy("root").agg(F.min("id").alias("component_id"))
    found = durable(named.join(ids, "root").select("fp", "n_same", "component_id"))
    return rows.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")
