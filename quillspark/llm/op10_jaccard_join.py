"""N-gram Jaccard join by MinHash banding.

Documents are sets of word five-grams. Those with the same set form a class and are joined as one. Each class has a
MinHash signature cut into bands; the number of rows in a band and of bands follow from the recall wanted at the threshold. Classes
that share a band's hash meet in its bucket, after a shuffle on that hash, and each pair is verified on the full sets.

A pair is verified once, in the first band that it shares. A bucket of more than `tile` classes or TILE_BYTES of sets is dealt into tiles: first by
level, the logarithm of the set's size to the base of one over the threshold, since sets can only be near if their levels differ by one at most; then, within a level, into as many tiles
as its classes and bytes need. Only tiles of neighbouring levels are paired, and each pair of tiles is a group of its own, so a task holds no more than two tiles
(or two sets, if these are longer), however large the bucket.

What makes buckets large is many variants of one text, and most of their pairs need no set of their own: one minus the similarity is a metric, so two classes whose distances to a third add up to no more
than one minus the threshold are near. Each class of a large bucket is compared, on full sets, with one pivot, the member of its buckets that meets most others; pairs that this proves are
counted from the distances alone, and a bucket's tiles that hold only such pairs aren't paired. So what is sent for a tight cluster grows with its members, not with their square; pairs farther from their pivot are verified as before.

Pairs never become rows: a bucket gives
for each member the number of its links and one edge to the least member it is linked with, so what is written grows with the members.
Connected components of those edges (contraction of the graph to its components, each round written to the
shared folder) are the groups of near duplicates.

Texts are lower-cased and words are runs of ASCII letters and digits or characters beyond ASCII. Defined cases: a text of fewer than five words is one shingle; texts without words
(null, empty, punctuation) have an empty set and are linked with nothing, each a class of its own; equal sets have
similarity 1; repeated rows give a row each and are copies; an empty table gives no rows; other columns are ignored by join(), and near_dedup() keeps them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, release, split_words, text_of

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9995
TILE, TILE_BYTES = 500, 8 << 20
REMEMBERED = 300_000
STEPS = 10_000  # distances to pivots are rounded up to one part in so many
FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def banding(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): of those that find a pair at the threshold with the wanted probability, the cheapest.

    The cost is that of chance meetings under the threshold, where pairs thin out with the square of their similarity, and of hashes.
    """
    choices = []
    for rows in range(1, 13):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            chance = sum((1 - (1 - (s / 100) ** rows) ** bands) / (s / 100) ** 2 for s in range(1, int(threshold * 100))) / 100
            choices.append((chance + bands * rows / 100, bands, rows))
    return min(choices)[1:]


class WordHashes(dict):
    """64-bit hashes of words; the table is bounded."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes, n: int = SHINGLE) -> np.ndarray:
    """The sorted set of 64-bit hashes of the text's word n-grams."""
    folded = (text or "").lower().encode("utf-8", "surrogatepass").translate(FOLD)
    w = np.concatenate([np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words)) for words in split_words(folded)])
    n = min(n, len(w))
    if not n:
        return w
    h = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        h = scramble(h + w[j : len(w) - n + 1 + j])
    return np.unique(h)


def signature(grams: np.ndarray, bands: int, rows: int) -> list[int]:
    """The hash of each band of the MinHash signature."""
    k = np.arange(1, 2 * bands * rows + 1, dtype=np.uint64).reshape(2, -1) * np.uint64(0x9E3779B97F4A7C15)
    a, b = scramble(k[0]) | np.uint64(1), scramble(k[1])
    low = np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 8192):
        low = np.minimum(low, (grams[None, at : at + 8192] * a[:, None] + b[:, None]).min(axis=1))
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = scramble(key + low.reshape(bands, rows)[:, r])
    return key.view(np.int64)


def signed(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """doc_id, h (hash of the text), cid (class: hash of the set; null if empty), n_grams, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            cids, sizes, keys = [], [], []
            for text in batch["text"]:
                grams = shingles(text.as_py(), hashes, n)
                sizes.append(len(grams))
                cids.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                keys.append(signature(grams, bands, rows) if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], pa.array(cids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "h", "cid", "n_grams", "bands"])

    return docs.mapInArrow(run, "doc_id long, h long, cid binary, n_grams long, bands array<long>")


GROUP = ["key", "low", "high"]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each pair of tiles, which come together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch[x].to_numpy() for x in GROUP])
        edges = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            if held and tuple(group[:, start]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = tuple(group[:, start])
    if held:
        yield pa.Table.from_batches(held)


def limit(threshold: float) -> int:
    """The greatest distance of near classes, in STEPS."""
    return math.floor((1 - threshold) * STEPS + 1e-6)


def own_pairs(group: pa.Table, threshold: float) -> np.ndarray:
    """Which pairs of members this group verifies: they share no earlier band, lie in its two tiles, have sizes that can reach the threshold, and aren't proven by their pivot."""
    bands = np.array(group["bands"].to_pylist(), dtype=np.int64)
    key, low, high = (group[x][0].as_py() for x in GROUP)
    mine, n = group["mine"].to_numpy(), group["n_grams"].to_numpy()
    band = int(np.flatnonzero(bands[0] == key)[0])
    own = np.triu(np.ones((len(bands), len(bands)), dtype=bool), 1)
    if low != high:
        own &= mine[:, None] != mine[None, :]
    own &= np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9
    for k in range(band):
        own &= bands[:, None, k] != bands[None, :, k]
    pivots = group["pivot"].to_pylist()
    if any(p is not None for p in pivots):
        names: dict[bytes, int] = {}
        star = np.array([-1 - i if p is None else names.setdefault(p, len(names)) for i, p in enumerate(pivots)])
        far = group["far"].to_numpy()
        own &= (star[:, None] != star[None, :]) | (far[:, None] + far[None, :] > limit(threshold))
    return own


def needed(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The members that have a pair to be verified in their group."""
    for group in grouped(batches):
        own = own_pairs(group, threshold)
        yield from group.filter(pa.array(own.any(axis=0) | own.any(axis=1))).combine_chunks().to_batches()


#: Grams of more members than this are counted by matrix products, the others pair by pair.
RARE = 16


def overlaps(sets: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs."""
    size = len(sets)
    out = np.zeros((size, size), dtype=np.int64)
    if own.sum() <= 48:
        for i, j in zip(*np.nonzero(own)):
            out[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    member = np.repeat(np.arange(size), [len(s) for s in sets])
    grams = np.concatenate(sets)
    by = np.argsort(grams, kind="stable")  # members of a gram stay in order
    member, grams = member[by], grams[by]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    count = np.diff(np.r_[first, len(grams)])
    for k in range(2, RARE + 1):
        at = first[count == k]
        for i in range(k if len(at) else 0):
            for j in range(i + 1, k):
                np.add.at(out, (member[at + i], member[at + j]), 1)
    common = np.flatnonzero(count > RARE)
    for part in np.array_split(common, -(-len(common) // 4096)) if len(common) else ():
        x = np.zeros((size, len(part)), dtype=np.float32)
        x[member[np.concatenate([np.arange(first[g], first[g] + count[g]) for g in part])], np.repeat(np.arange(len(part)), count[part])] = 1
        out += (x @ x.T).astype(np.int64)
    return np.triu(out, 1)


LINKS = "cid binary, links long, link_docs long, least binary"


def verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each member of a bucket with links: their number, the documents behind them, and the least member reached."""
    for group in grouped(batches):
        own, cids, sizes, n = own_pairs(group, threshold), group["cid"].to_pylist(), group["size"].to_numpy(), group["n_grams"].to_numpy()
        sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in group["grams"]]
        both = overlaps(sets, own)
        linked = own & (both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9)
        linked |= linked.T
        near = np.flatnonzero(linked.any(axis=1))
        least = np.array(sorted(range(len(cids)), key=cids.__getitem__)).argsort()  # ranks
        while True:  # least rank reached, over the links until nothing changes
            reached = np.minimum(least, np.where(linked, least[None, :], len(cids)).min(axis=1))
            if (reached == least).all():
                break
            least = reached
        name = sorted(cids)
        yield pa.RecordBatch.from_arrays(
            [pa.array([cids[i] for i in near], pa.binary()), pa.array(linked.sum(axis=1)[near], pa.int64()), pa.array((linked @ sizes)[near], pa.int64()), pa.array([name[least[i]] for i in near], pa.binary())],
            names=["cid", "links", "link_docs", "least"],
        )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the least node of its component."""
    edges = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names = None
    while True:
        both = edges.union(edges.select("b", "a"))
        up = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
        while True:  # jump to the root's root until nothing moves
            over = up.select(F.col("node").alias("root"), F.col("root").alias("further"))
            moved = durable(up.join(over, "root", "left").select("node", F.coalesce("further", "root").alias("root"), (F.col("further") < F.col("root")).alias("moved")))
            up = moved.select("node", "root")
            if moved.where("moved").isEmpty():
                break
        found = up if names is None else names.join(up.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        names = durable(found)
        a, b = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(a, "a").join(b, "b").where("ra <> rb")
        edges = durable(edges.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if edges.isEmpty():
            return names
        del both, up, over, moved, found, a, b
        release(edges.sparkSession)


def placed(met: DataFrame, tile: int, tile_bytes: int) -> DataFrame:
    """(cid, n_grams, key, m, large) for each class that meets another in a bucket: the bucket's classes, and whether they need tiles."""
    buckets = met.groupBy("key").agg(F.count("*").alias("m"), (8 * F.sum("n_grams")).alias("bytes")).where("m > 1")
    return met.join(buckets, "key").select("cid", "n_grams", "key", "m", ((F.col("m") > tile) | (F.col("bytes") > tile_bytes)).alias("large"))


def tiled(met: DataFrame, threshold: float, tile: int, tile_bytes: int) -> DataFrame:
    """(cid, key, mine, low, high): for each class that meets another in a bucket its tile, and the pairs of tiles it takes part in.

    met: cid, n_grams, key; with large, as placed() gives it, and core, true for those of a large bucket whose pairs with each other are proven, such pairs are left out.
    """
    if "large" not in met.columns:
        met = durable(placed(met, tile, tile_bytes).withColumn("core", F.lit(False)))
    zero = F.lit(0).cast("long")
    small = met.where("not large").select("cid", "key", zero.alias("mine"), zero.alias("low"), zero.alias("high"))
    # a little over one over the threshold, so that rounding can't part levels by two
    large = met.where("large").withColumn("level", F.floor(F.log("n_grams") / math.log(1.001 / threshold)))
    need = F.greatest(F.lit(1.0), F.count("*") / tile, 8 * F.sum("n_grams") / tile_bytes)
    levels = durable(large.groupBy("key", "level", "core").agg(F.ceil(need).alias("k")))
    others = levels.select("key", F.col("level").alias("other_level"), F.col("core").alias("other_core"), F.col("k").alias("other_k"))
    near = levels.join(others, "key").where((F.abs(F.col("level") - F.col("other_level")) <= 1) & ~(F.col("core") & F.col("other_core")))
    near = near.groupBy("key", "level", "core", "k").agg(F.collect_list(F.struct("other_level", "other_core", "other_k")).alias("others"))  # six at most
    of = lambda level, core, at: F.shiftleft(level, 32) + F.shiftleft(F.col(core).cast("long"), 31) + at
    dealt = large.join(near, ["key", "level", "core"]).withColumn("mine", of("level", "core", F.pmod(F.xxhash64("cid"), F.col("k"))))
    dealt = dealt.withColumn("o", F.explode("others")).select("cid", "key", "mine", "o.*")
    other = of("other_level", "other_core", F.col("tile"))
    dealt = dealt.withColumn("tile", F.explode(F.sequence(zero, F.col("other_k") - 1)))
    return small.union(dealt.select("cid", "key", "mine", F.least("mine", other).alias("low"), F.greatest("mine", other).alias("high")))


def distances(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """far, the distance in STEPS, of members whose similarity to their pivot reaches the threshold. A pivot's set (kind 0) comes before its members."""
    most, pivot = limit(threshold), np.empty(0, dtype=np.uint64)
    for batch in batches:
        fars: list[int | None] = []
        for kind, grams in zip(batch["kind"].to_pylist(), batch["grams"]):
            mine = np.frombuffer(grams.as_py(), dtype=np.uint64)
            if not kind:
                pivot = mine
                fars.append(None)
                continue
            both = len(np.intersect1d(mine, pivot, assume_unique=True))
            all_ = len(mine) + len(pivot) - both
            far = -(-STEPS * (all_ - both) // all_)  # whole numbers, rounded up
            fars.append(far if far <= most else None)
        out = pa.RecordBatch.from_arrays([batch["cid"], batch["pivot"], pa.array(fars, pa.int64()), batch["k"]], names=["cid", "pivot", "far", "k"])
        yield out.filter(out["far"].is_valid())


def stars(large: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """(pivots: key, own; near: cid, pivot, far, k) of large buckets (cid, key, m). own is a bucket's pivot; near has each class that is near its own pivot, with the number k of parts that the pivot's members are dealt into.

    A bucket's pivot is the member that meets most classes in all; a class's pivot is the first, by the same order, of its buckets' pivots. A pivot's set is sent once for each `tile` members.
    """
    meets = large.groupBy("cid").agg(F.sum("m").alias("meets"))
    pivots = durable(large.join(meets, "cid").groupBy("key").agg(F.max(F.struct("meets", "cid")).alias("best")))
    chosen = durable(large.join(pivots, "key").groupBy("cid").agg(F.max("best").alias("best")).select("cid", F.col("best.cid").alias("pivot")))
    parts = chosen.groupBy("pivot").agg(F.ceil(F.count("*") / tile).alias("k"))
    zero, members = F.lit(0), chosen.join(parts, "pivot").select("cid", "pivot", "k", F.pmod(F.xxhash64("cid"), F.col("k")).alias("part"), F.lit(1).alias("kind"))
    heads = parts.select(F.col("pivot").alias("cid"), "pivot", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("part"), zero.alias("kind"))
    asked = members.unionByName(heads).join(sets_of(chosen.select("cid")), "cid").select("cid", "pivot", "k", "part", "kind", "grams")
    dealt = asked.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "kind")
    near = durable(dealt.mapInArrow(lambda b: distances(b, threshold), "cid binary, pivot binary, far long, k long"))
    return pivots.select("key", F.col("best.cid").alias("own")), near


def proven(near: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """LINKS of the pairs that their pivot proves near: for each class, those of its star whose distance and its own add up to no more than the limit."""
    most, sized = limit(threshold), near.join(classes.select("cid", "size"), "cid")
    counted = sized.groupBy("pivot", "far").agg(F.count("*").alias("c"), F.sum("size").alias("s"), F.max("k").alias("k"))
    others = counted.select("pivot", F.col("far").alias("other_far"), F.col("c").alias("other_c"), F.col("s").alias("other_s"))
    within = counted.join(others, "pivot").where(F.col("far") + F.col("other_far") <= most)  # a star has `most` distances at most
    totals = within.groupBy("pivot", "far", "k").agg(F.sum("other_c").alias("c"), F.sum("other_s").alias("s"))
    totals = totals.select("pivot", "far", "c", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("part"))
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("k"))).select("cid", "pivot", "far", "size", "part")
    oneself = 2 * F.col("far") <= most
    links, docs = F.col("c") - F.when(oneself, 1).otherwise(0), F.col("s") - F.when(oneself, F.col("size")).otherwise(0)
    return dealt.join(totals, ["pivot", "far", "part"]).select("cid", links.alias("links"), docs.alias("link_docs"), F.col("pivot").alias("least"))


def links_of(texts: DataFrame, classes: DataFrame, threshold: float, n: int, tile: int, tile_bytes: int) -> DataFrame:
    """LINKS of the classes (cid, size, rep, n_grams, bands), written down; texts: doc_id, text, h."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["cid"], batch["size"], pa.array([shingles(t.as_py(), hashes, n).tobytes() for t in batch["text"]], pa.binary())], names=["cid", "size", "grams"])

    def sets_of(asked: DataFrame) -> DataFrame:
        wanted = asked.select("cid").distinct().join(classes, "cid").select("cid", "size", "rep")
        same = texts["doc_id"].eqNullSafe(wanted["rep.doc_id"]) & (texts["h"] == wanted["rep.h"])
        return texts.join(wanted, same).select("cid", "size", "text").dropDuplicates(["cid"]).mapInArrow(sets, "cid binary, size long, grams binary")

    met = durable(placed(classes.select("cid", "n_grams", F.explode("bands").alias("key")), tile, tile_bytes))
    release(classes.sparkSession)
    pivots, near = stars(met.where("large").select("cid", "key", "m"), sets_of, threshold, tile)
    release(classes.sparkSession)
    central = near.where(2 * F.col("far") <= limit(threshold)).select("cid", F.col("pivot").alias("own"), F.lit(True).alias("central"))
    core = central.join(met.where("large").join(pivots, "key").select("cid", "key", "own"), ["cid", "own"]).select("cid", "key", "central")
    met = tiled(met.join(core, ["cid", "key"], "left").withColumn("core", F.coalesce("central", F.lit(False))), threshold, tile, tile_bytes)
    known = classes.select("cid", "n_grams", "bands").join(near.select("cid", "pivot", "far"), "cid", "left")
    bucket = met.join(known, "cid").select(*GROUP, "mine", "cid", "n_grams", "bands", "pivot", F.coalesce("far", F.lit(0).cast("long")).alias("far"))
    schema = "key long, low long, high long, mine long, cid binary, n_grams long, bands array<long>, pivot binary, far long"
    asked = durable(bucket.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(lambda b: needed(b, threshold), schema))
    del bucket, met, core, central
    release(classes.sparkSession)
    full = asked.join(sets_of(asked), "cid").select(*GROUP, "mine", "cid", "n_grams", "bands", "pivot", "far", "size", "grams")
    verified_ = full.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(lambda b: verified(b, threshold), LINKS)
    return durable(verified_.unionByName(proven(near, classes, threshold)))


def grouping(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = SHINGLE, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, h, cid), (classes: cid, rep, size, links, link_docs, group_rep, group_size); rep: struct of doc_id and h."""
    bands, rows = banding(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text_of()).alias("h"))
    members = durable(signed(texts, bands, rows, n))
    named = members.where("cid is not null")
    classes = durable(named.groupBy("cid").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "h")).alias("rep"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")))

    links = links_of(texts, classes, threshold, n, tile, tile_bytes)
    release(docs.sparkSession)
    roots = components(links.select(F.col("cid").alias("a"), F.col("least").alias("b")))
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"), F.sum("link_docs").alias("link_docs"))
    linked = durable(counts.join(classes.select("cid", "rep", "size"), "cid").join(roots.withColumnRenamed("node", "cid"), "cid").select("cid", "links", "link_docs", "rep", "size", "root"))
    groups = linked.groupBy("root").agg(F.min("rep").alias("group_rep"), F.sum("size").alias("group_size"))
    linked = linked.join(groups, "root").select("cid", "links", "link_docs", "group_rep", "group_size")
    all_ = classes.select("cid", "rep", "size").join(linked, "cid", "left")
    zero = F.lit(0).cast("long")
    judged = durable(
        all_.select("cid", "rep", "size", F.coalesce("links", zero).alias("links"), F.coalesce("link_docs", zero).alias("link_docs"), F.coalesce("group_rep", "rep").alias("group_rep"), F.coalesce("group_size", "size").alias("group_size"))
    )
    del named, classes, links, counts, roots, linked, groups, all_
    release(docs.sparkSession)
    return members.select("doc_id", "h", "cid"), judged


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = SHINGLE, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """For each row: doc_id; class_id, the least doc_id of its group of near duplicates; group_size; copy_of, the least
    doc_id with the same set; n_copies, rows with that set; n_links, other rows at or over the threshold, copies included;
    n_text_links, different sets at or over the threshold."""
    members, classes = grouping(docs, threshold, recall, n, tile, tile_bytes)
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    return members.join(classes, "cid", "left").select(
        "doc_id",
        F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("group_rep.doc_id")).alias("class_id"),
        F.coalesce("group_size", one).alias("group_size"),
        F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("copy_of"),
        F.coalesce("size", one).alias("n_copies"),
        F.coalesce(F.col("size") - 1 + F.col("link_docs"), zero).alias("n_links"),
        F.coalesce("links", zero).alias("n_text_links"),
    )


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One document of each group, that with the least doc_id, with all its columns. Rows equal in doc_id and text stay together: exact deduplication comes first."""
    members, classes = grouping(docs, threshold, recall)
    gone = members.join(classes, "cid").where(~F.struct("doc_id", "h").eqNullSafe(F.col("group_rep"))).select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    (h,) = fresh(docs, "h")
    rows = docs.withColumn(h, F.xxhash64(text_of()))
    return rows.join(gone, rows["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (rows[h] == gone["gone_h"]), "left_anti").select(*docs.columns)
