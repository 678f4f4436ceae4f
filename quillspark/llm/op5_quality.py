"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over UTF-8 bytes, so that it has a probability for every text of every script, one model for each language. n-grams
of the trusted documents are counted block by block and added up by language and n-gram. Lower orders hold
continuation counts, discounts come from the counts of counts, and each order is interpolated with the one below it down to a uniform
distribution over bytes: all of it grouped sums and joins on (language, n-gram), sharded by their hash.

Documents are packed into blocks of about `block_bytes`, written once into the shared folder as a table bucketed by block, with some buckets for each block
that the text makes, so that few hold two. The ids of a block's documents meet the
labels in a join, and those that are trusted go back to the block, where their n-grams are counted. A block asks for the probability of each
different n-gram in it; the asked n-grams meet the sharded counts in joins, and the answers go to their block, which lies in its bucket
already, so that texts are not shuffled. There each document's perplexity is read off.

Trusted documents are those labelled good and not toxic. A tenth of them is left out of the counts. A short text's perplexity says little, so each is weighed against
`prior_bytes` bytes of the median perplexity of those left out in its language. The quantile of theirs, so weighed,
is the language's threshold, above which documents are rejected. Both quantiles are exact, from ranks in rows sorted over all tasks.

Counts and thresholds come from all trusted documents; nothing that grows with them is collected or sent to the tasks.

Defined cases: null lang is the language `und`; a language without trusted documents has no threshold and keeps its documents; a
document without text (null, empty) has no perplexity and is rejected; conflicting labels of a document count as not
trusted; very long texts are held whole by their block's task and worked through in slices of 1 MB; repeated rows are judged each; an empty table gives no rows; other columns are ignored by classify(), and keep_good() keeps them.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh, remove, shared_dir, text_of

ORDER = 4
QUANTILE = 0.999
PRIOR_BYTES = 50
BLOCK_BYTES = 16 << 20
#: Buckets for each block, and what Spark allows in all.
SPREAD, MOST_BUCKETS = 4, 100_000
CALIBRATE = 10
#: Rows, one a language, that are sent to all tasks.
MOST_LANGUAGES = 100_000


def fold_of(ids: np.ndarray) -> np.ndarray:
    """0 to CALIBRATE - 1; documents of fold 0 set the thresholds and are not counted."""
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(CALIBRATE)).astype(np.int64)


def parts_of(texts: list[bytes], order: int, most: int = 1 << 20) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """(text's place, the bytes before, bytes) of texts, long ones cut, in lists of about `most` bytes."""
    held, size, zeros = [], 0, b"\0" * (order - 1)
    for i, text in enumerate(texts):
        for at in range(0, len(text), most):
            part = text[at : at + most]
            held.append((i, text[at - order + 1 : at] if at else zeros, part))
            size += len(part)
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def grams_of(parts: list[tuple[int, bytes, bytes]], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends in each byte of the parts, each after the order - 1 bytes before it; which bytes are the part's own; where each part starts."""
    lengths = np.array([len(part) + order - 1 for _, _, part in parts], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(b"".join(before + part for _, before, part in parts), dtype=np.uint8)
    code = np.zeros(len(raw), dtype=np.int64)
    for j in range(order):
        code[j:] |= raw[: len(raw) - j].astype(np.int64) << (8 * j)
    real = np.ones(len(raw), dtype=bool)
    for j in range(order - 1):
        real[starts + j] = False
    return code, real, starts


def packed(values: np.ndarray) -> bytes:
    """Sorted integers, small on disk."""
    raw = np.diff(values, prepend=0).astype(np.int64).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True), dtype=np.int64))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by n-gram."""
    grams, counts = (np.concatenate(x) for x in zip(*parts))
    u, at = np.unique(grams, return_inverse=True)
    return u, np.bincount(at, weights=counts, minlength=len(u)).astype(np.int64)


def gather(held: dict[str, list], lang: str, part: tuple[np.ndarray, np.ndarray], most: int = 4) -> None:
    """Keep a part of a language's counts; a few at a time are added up, so that no more than these are held."""
    parts = held.setdefault(lang, [])
    parts.append(part)
    if len(parts) >= most:
        parts[:] = [merged(parts)]


def by_language(batch: pa.RecordBatch, taken: np.ndarray, order: int) -> Iterator[tuple[str, tuple[np.ndarray, np.ndarray]]]:
    """(language, (n-grams, their counts)) of the taken documents, a language once for each part of its text."""
    langs = np.array(batch["lang"].to_pylist(), dtype=object)
    for lang in set(langs[taken].tolist()):
        texts = batch["text"].take(pa.array(np.flatnonzero(taken & (langs == lang))))
        for parts in parts_of([x.encode("utf-8", "surrogatepass") for x in texts.to_pylist()], order):
            code, real, _ = grams_of(parts, order)
            yield lang, np.unique(code[real], return_counts=True)


class Block:
    """Documents on their way into a block: the batches, and by language the n-grams asked for."""

    def __init__(self, order: int) -> None:
        self.order, self.batches, self.size = order, [], 0
        self.asked: dict[str, list] = {}

    def add(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch)
        self.size += batch["text"].nbytes
        for lang, parts in by_language(batch, np.ones(batch.num_rows, dtype=bool), self.order):
            gather(self.asked, lang, parts)

    def rows(self) -> Iterator[dict]:
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, self.batches[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
            for b in self.batches:
                out.write_batch(b)
        name = uuid.uuid4().int >> 65
        ids = np.unique(np.concatenate([b["doc_id"].drop_null().to_numpy() for b in self.batches]))
        yield {"block": name, "lang": None, "docs": sink.getvalue(), "ids": packed(ids), "asked": None}
        for lang, parts in self.asked.items():
            yield {"block": name, "lang": lang, "docs": None, "ids": None, "asked": packed(merged(parts)[0])}


BLOCKS = "block long, lang string, docs binary, ids binary, asked binary"


def arrow_of(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32()}
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]))


def blocks(docs: DataFrame, order: int, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(order)
        for whole in batches:
            step = max(1, int(whole.num_rows * min(1, (1 << 20) / max(1, whole["text"].nbytes))))
            for at in range(0, whole.num_rows, step):
                block.add(whole.slice(at, step))
                if block.size >= block_bytes:
                    yield arrow_of(list(block.rows()), BLOCKS)
                    block = Block(order)
        if block.batches:
            yield arrow_of(list(block.rows()), BLOCKS)

    return docs.mapInArrow(run, BLOCKS)


COUNTED = "block long, lang string, grams binary, counts binary"


def counts_of(left: pa.Table, right: pa.Table, order: int) -> pa.Table:
    """The n-gram counts, by language, of a block's documents whose ids are given."""
    known, held = np.sort(right["doc_id"].to_numpy()), {}
    for blob in left["docs"].to_pylist() if len(known) else ():
        for batch in pa.ipc.open_stream(blob):
            own = batch["doc_id"].fill_null(0).to_numpy()
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            taken = (known[place] == own) & batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            for lang, part in by_language(batch, taken, order):
                gather(held, lang, part)
    rows = []
    for lang, parts in held.items():
        grams, n = merged(parts)
        rows.append({"block": left["block"][0].as_py(), "lang": lang, "grams": packed(grams), "counts": packed(n)})
    return pa.Table.from_batches([arrow_of(rows, COUNTED)])


def listed(packs: DataFrame, schema: str, counts: bool) -> DataFrame:
    """One row for each n-gram of the packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, lang, grams, more in zip(*(batch.column(i).to_pylist() for i in range(4))):
                g = unpacked(grams)
                extra = unpacked(more) if counts else np.full(len(g), first, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(extra)], names=["lang", "gram", "n" if counts else "block"])

    return packs.mapInArrow(run, schema)


def each_language(df: DataFrame) -> DataFrame:
    """df, which has a row for each language at most, written down; sent to all tasks if it has no more than MOST_LANGUAGES rows, so that joins on the language don't shuffle what they meet."""
    df = durable(df)
    return F.broadcast(df) if df.count() <= MOST_LANGUAGES else df


def probabilities(counts: DataFrame, asked: DataFrame, order: int) -> DataFrame:
    """(lang, gram, logp) for the asked (lang, gram), from the counts (lang, gram, n) of the highest order."""
    levels = {order: durable(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))}
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")
        levels[k] = durable(levels[k + 1].groupBy("lang", suffix).agg(F.count("*").alias("n")))
    below = None
    for k in range(1, order + 1):
        c = levels[k]
        of = [F.sum((F.col("n") == i).cast("double")).alias(f"m{i}") for i in (1, 2, 3, 4)]
        y = F.col("m1") / (F.col("m1") + 2 * F.col("m2"))

        def discount(i: int, y=y):
            """i - (i + 1) y m(i+1) / m(i), between 0 and i; half of i where the counts of counts can't tell."""
            d = i - (i + 1) * y * F.try_divide(F.col(f"m{i + 1}"), F.col(f"m{i}"))
            return F.least(F.greatest(F.coalesce(d, F.lit(i / 2)), F.lit(0.05 * i)), F.lit(float(i))).alias(f"d{i}")

        discounts = each_language(c.groupBy("lang").agg(*of).where("m1 + m2 > 0").select("lang", *(discount(i) for i in (1, 2, 3))))
        contexts = c.groupBy("lang", F.shiftright("gram", 8).alias("context")).agg(
            F.sum("n").alias("total"), *(F.sum((F.col("n") == i).cast("double")).alias(f"k{i}") for i in (1, 2)), F.sum((F.col("n") > 2).cast("double")).alias("k3")
        )
        mine = asked.select("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).distinct()
        half = F.coalesce("d1", F.lit(0.5)), F.coalesce("d2", F.lit(1.0)), F.coalesce("d3", F.lit(1.5))
        off = F.when(F.col("n") == 1, half[0]).when(F.col("n") == 2, half[1]).otherwise(half[2])
        seen = mine.join(c, ["lang", "gram"], "left").withColumn("context", F.shiftright("gram", 8)).join(contexts, ["lang", "context"], "left").join(discounts, "lang", "left")
        if below is None:
            seen = seen.withColumn("p_below", F.when(F.col("total").isNotNull(), F.lit(1 / 256)))
        else:
            seen = seen.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(below.select("lang", F.col("gram").alias("tail"), F.col("p").alias("p_below")), ["lang", "tail"])
        held = F.coalesce(F.greatest(F.col("n") - off, F.lit(0.0)), F.lit(0.0))
        left = half[0] * F.col("k1") + half[1] * F.col("k2") + half[2] * F.col("k3")
        p = F.when(F.col("total").isNull(), F.col("p_below")).otherwise((held + left * F.col("p_below")) / F.col("total"))
        below = durable(seen.select("lang", "gram", p.alias("p")))
    return below.where("p is not null").select("lang", "gram", F.log("p").alias("logp"))


SCORED = "doc_id long, h long, lang string, n_bytes long, perplexity double"


def scores_of(left: pa.Table, right: pa.Table, order: int) -> pa.Table:
    """A block's documents with the answers for its n-grams."""
    answers = {}
    langs = np.array(right["lang"].to_pylist(), dtype=object)
    grams, logs = right["gram"].to_numpy(), right["logp"].to_numpy()
    for lang in set(langs.tolist()):
        g, p = grams[langs == lang], logs[langs == lang]
        by = np.argsort(g)
        answers[lang] = g[by], p[by]
    out = []
    for blob in left["docs"].to_pylist():
        for batch in pa.ipc.open_stream(blob) if blob is not None else ():
            texts = [x.encode("utf-8", "surrogatepass") for x in batch["text"].to_pylist()]
            own, size = batch["lang"].to_pylist(), np.array([len(t) for t in texts], dtype=np.int64)
            perplexity = np.full(len(texts), np.nan)
            for lang in set(own) & set(answers):
                mine = np.array([i for i, x in enumerate(own) if x == lang and size[i]], dtype=np.int64)
                total, (g, p) = np.zeros(len(mine)), answers[lang]
                for parts in parts_of([texts[i] for i in mine], order):
                    code, real, starts = grams_of(parts, order)
                    logp = np.where(real, p[np.minimum(np.searchsorted(g, code), len(g) - 1)], 0.0)
                    np.add.at(total, [i for i, _, _ in parts], np.add.reduceat(logp, starts))
                perplexity[mine] = np.exp(-total / size[mine])
            out.append(pa.RecordBatch.from_arrays([batch["doc_id"], batch["h"], batch["lang"], pa.array(size), pa.array(perplexity, pa.float64(), from_pandas=True)], names=["doc_id", "h", "lang", "n_bytes", "perplexity"]))
    return pa.Table.from_batches(out, schema=pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("lang", pa.string()), ("n_bytes", pa.int64()), ("perplexity", pa.float64())]))


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of the documents labelled good and, where the labels say so, not toxic."""
    clean = F.max(F.coalesce("toxic", F.lit(0))) if "toxic" in labels.columns else F.lit(0)
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), clean.alias("toxic"))
    return marked.where("quality = 1 and toxic = 0").select("doc_id")


def folded(ids: DataFrame) -> DataFrame:
    """doc_id, fold"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fold_of(batch["doc_id"].to_numpy()))], names=["doc_id", "fold"])

    return ids.mapInArrow(run, "doc_id long, fold long")


def quantile_of(rows: DataFrame, value: Column, q: float) -> DataFrame:
    """(lang, value): by language the least value that a share q of the values doesn't exceed. Rows (doc_id, lang, ...) are sorted over all tasks; a row's rank is its place in its task's
    part and what lies in the parts before, of which there are few rows: one for each part and language in it."""
    order = ["lang", "value", "doc_id"]
    placed = durable(
        rows.select("lang", value.alias("value"), "doc_id").repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumns({"part": F.spark_partition_id(), "idx": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    )
    parts = placed.groupBy("lang", "part").agg(F.count("*").alias("k"), F.min("idx").alias("first"))
    whole = Window.partitionBy("lang")
    parts = durable(parts.withColumns({"n": F.sum("k").over(whole), "before": F.sum("k").over(whole.orderBy("part")) - F.col("k")}))
    rank = F.col("before") + F.col("idx") - F.col("first")
    at = F.greatest(F.lit(1), F.ceil(q * F.col("n") - 1e-9)) - 1
    return placed.join(parts, ["lang", "part"]).where(rank == at).select("lang", "value")


def scored(docs: DataFrame, good: DataFrame, order: int, block_bytes: int) -> DataFrame:
    """SCORED for each row, under the models of the good documents (doc_id, fold) in the other folds than 0; written down."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("h"), F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), text_of().alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # no fewer than other shuffles have, or Spark would deal the blocks anew
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_BUCKETS, SPREAD * size // block_bytes))
    name = f"quill_blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    try:
        blocks(rows, order, block_bytes).write.bucketBy(n, "block").option("compression", "none").option("path", path).saveAsTable(name)
        table = spark.table(name)
        none, full = F.lit(None).cast("binary").alias("more"), table.where("docs is not null")
        held = listed(full.select("block", "lang", "ids", none), "lang string, gram long, block long", False).select("block", F.col("gram").alias("doc_id"))
        # fold 0 is left out of the counts
        train = held.join(good.where("fold > 0"), "doc_id").select("block", "doc_id")
        full = full.select("block", "docs").groupBy("block")
        counted = full.cogroup(train.groupBy("block")).applyInArrow(lambda a, b: counts_of(a, b, order), COUNTED)
        # written between the two, so that a task has one Python worker at a time
        counts = listed(durable(counted), "lang string, gram long, n long", True)
        asked = listed(table.where("asked is not null").select("block", "lang", "asked", none), "lang string, gram long, block long", False)
        answers = probabilities(counts, durable(asked.select("lang", "gram").distinct()), order)
        sent = asked.join(answers, ["lang", "gram"]).select("block", "lang", "gram", "logp")
        return durable(full.cogroup(sent.groupBy("block")).applyInArrow(lambda a, b: scores_of(a, b, order), SCORED))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def judged(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, prior_bytes: int = PRIOR_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, h (hash of the text), lang, n_bytes, perplexity, evidence (the weighed perplexity), threshold, kept for each row."""
    good = durable(folded(trusted(labels)))
    found = scored(docs, good, order, block_bytes)
    set_by = durable(found.join(good.where("fold = 0").select("doc_id"), "doc_id").where("perplexity is not null"))
    middle = each_language(quantile_of(set_by, F.log("perplexity"), 0.5).select("lang", F.exp("value").alias("middle")))

    def weighed(df: DataFrame) -> DataFrame:
        n = F.col("n_bytes")
        return df.join(middle, "lang", "left").withColumn("evidence", F.exp((n * F.log("perplexity") + prior_bytes * F.log("middle")) / (n + prior_bytes)))

    limits = each_language(quantile_of(weighed(set_by), F.col("evidence"), quantile).withColumnRenamed("value", "threshold"))
    kept = F.when(F.col("n_bytes") == 0, False).otherwise(F.coalesce(F.col("evidence") <= F.col("threshold"), F.lit(True)))
    return weighed(found).join(limits, "lang", "left").withColumn("kept", kept)


def classify(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, evidence, threshold, kept for each row."""
    return judged(docs, labels, **parameters).select("doc_id", "lang", "n_bytes", "perplexity", "evidence", "threshold", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    gone = judged(docs, labels, **parameters).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    (h,) = fresh(docs, "h")
    rows = docs.withColumn(h, F.xxhash64(text_of()))
    return rows.join(gone, rows["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (rows[h] == gone["gone_h"]), "left_anti").select(*docs.columns)
