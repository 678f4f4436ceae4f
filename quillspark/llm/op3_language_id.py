"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence are combined for each page and language:

    text      log-likelihood of the main text's hashed byte trigrams under each language's model, tempered to at most
              `most_grams` of them, as neighbouring trigrams repeat each other's evidence
    markup    how often pages of the language declare what this page's `lang` attribute says; some pages of each language are taken to declare it beforehand
    suffix    how often pages of the language stand under this address suffix
    host      the share of the language among the host's other pages, shrunk towards the share in its domain, and that
              towards the share among all pages

The last three come from grouped sums of the pages' posteriors by text alone, so no page is labelled. Pages are counted where
they are read; suffix and domain hang on the host, so pages meet their evidence in one join on the host, which Spark may
split, and a page's own posterior is taken out of every sum that judges it, so that a page is never evidence for itself.

The trigram models are trained on the documents' `lang`, for every language there, on about `most_documents` of each (those of the least
hashes; all where there are no more): 2^16 numbers a language. They are trained and sent to the tasks in blocks of `most_languages`; with more
than one block, the pages' trigrams are written down between the blocks. Declared languages count as those of the model, `other`, or none.

Defined cases: a page without text (null or empty html) has no text_lang and is judged by the other evidence; without url or host, by the shares of all pages; no
declared language is evidence like any other value; ties go to the first language by name; no labelled documents: language null; repeated
rows count each; very long pages take time in proportion to their length and are held whole by their task; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable
from .op1_html_extraction import main_text
from .op7_url_filter import domains, split_url

BUCKETS = 1 << 16
MOST_DOCUMENTS = 20_000
MOST_LANGUAGES = 32
MOST_GRAMS = 100
#: Pages that the share in the level above counts for.
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 20.0
#: Pages that an even spread counts for, in the tables of suffixes and declared languages.
EVEN = 1.0
#: Pages of a language that are taken to declare it, before any is seen.
AGREE = 20.0
ROOT = re.compile(r"<html\b([^>]*)", re.I)
DECLARED = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,8})", re.I)


def declared_in(page: str) -> str:
    """What the page's first `html` tag with a lang attribute says, or none. Each tag is read once, up to its end."""
    return next((m[1].lower() for tag in ROOT.finditer(page) if (m := DECLARED.search(tag[1]))), "none")


def trigrams(text: str) -> np.ndarray:
    """Buckets of the lower-cased text's byte trigrams."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2_654_435_761)
    return (h >> np.uint32(16)).astype(np.int64)


def train(told: DataFrame, counts: dict[str, int], most_documents: int = MOST_DOCUMENTS) -> np.ndarray:
    """Log-probabilities by language and bucket, for the languages with the given numbers of documents."""
    languages = list(counts)
    table = np.zeros((len(languages), BUCKETS))
    if not languages:
        return table.astype(np.float32)
    shares = told.sparkSession.createDataFrame([(x, int((1 << 30) * min(1.0, most_documents / n))) for x, n in counts.items()], "lang string, share long")
    taken = told.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                held.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                held[lang] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "bucket", "n"])

    summed = taken.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    place = {x: i for i, x in enumerate(languages)}
    table[[place[x] for x in summed["lang"].to_pylist()], summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return np.log((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)


READ = "page_id long, url string, declared string, n_grams long, grams binary, fit array<double>"


def fitted(pages: DataFrame, known: set[str], logs: np.ndarray, most_grams: int, first: bool, last: bool) -> DataFrame:
    """A block of languages added to the pages' tempered log-likelihoods; the last block puts the best at 0."""
    sent = pages.sparkSession.sparkContext.broadcast(logs)

    def read(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, list[float]]]:
        if not first:
            for said, grams, fit in zip(batch["declared"].to_pylist(), batch["grams"], batch["fit"].to_pylist()):
                yield said, np.frombuffer(grams.as_py(), dtype=np.uint16), fit
            return
        for x in batch["html"]:
            page = x.as_py() or ""
            said = declared_in(page)
            yield said if said in known or said == "none" else "other", trigrams(main_text(page)), []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            declared, counts, kept, fits = [], [], [], []
            for said, grams, before in read(batch):
                fit = np.concatenate([before, table[:, grams].sum(axis=1, dtype=np.float64) * min(1.0, most_grams / max(1, len(grams)))])
                declared.append(said)
                counts.append(len(grams))
                kept.append(None if last else grams.astype(np.uint16).tobytes())
                fits.append((fit - fit.max() if last and len(fit) else fit).tolist())
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(declared, pa.string()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary()), pa.array(fits, pa.list_(pa.float64()))], names=["page_id", "url", "declared", "n_grams", "grams", "fit"])

    return pages.mapInArrow(run, READ)


def read_pages(pages: DataFrame, told: DataFrame, counts: dict[str, int], most_grams: int, most_documents: int, most_languages: int) -> DataFrame:
    """page_id, url, declared, n_grams, fit: the tempered log-likelihoods by language, the best at 0."""
    languages, df = list(counts), pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    starts = range(0, max(1, len(languages)), most_languages)
    for at in starts:
        logs = train(told, {x: counts[x] for x in languages[at : at + most_languages]}, most_documents)
        df = fitted(df, set(languages), logs, most_grams, at == starts[0], at == starts[-1])
        if at != starts[-1]:
            df = durable(df)
    return df.drop("grams")


def normalized(weights: Column) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def sums(column: str, n: int) -> Column:
    """Aggregate: arrays of n numbers added up."""
    return F.array(*(F.sum(F.col(column)[i]) for i in range(n)))


def shrunk(counts: Column, size: Column, share: Column, weight: float) -> Column:
    """Shares of a level, drawn towards those of the level above."""
    return F.zip_with(counts, share, lambda c, s: (c + weight * s) / (size + weight))


def identify(pages: DataFrame, docs: DataFrame, most_grams: int = MOST_GRAMS, most_documents: int = MOST_DOCUMENTS, most_languages: int = MOST_LANGUAGES) -> DataFrame:
    """page_id, url, declared, text_lang (by text alone), lang, confidence, posterior (map of all languages)."""
    told = docs.where("lang is not null and text is not null and text <> ''").select("doc_id", "lang", "text")
    counts = dict(sorted((x, k) for x, k in told.groupBy("lang").count().collect()))
    languages, n = list(counts), len(counts)
    read = read_pages(pages, told, counts, most_grams, most_documents, most_languages)
    if not n:
        none = F.lit(None).cast("string")
        return read.select("page_id", "url", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("map<string,double>").alias("posterior"))
    host, _ = split_url(F.col("url"))
    by_text = durable(read.withColumns({"host": host, "p": normalized(F.transform("fit", lambda x: F.exp(x)))}))

    hosts = by_text.groupBy("host").agg(F.count("*").cast("double").alias("pages"), sums("p", n).alias("counts"))
    domain, suffix = domains(F.col("host"))
    hosts = durable(hosts.withColumns({"domain": domain, "suffix": suffix}))
    of_all = hosts.agg(sums("counts", n)).first()[0]
    of_all = [0.0 if x is None else x for x in of_all]
    in_domain = hosts.groupBy("domain").agg(F.sum("pages").alias("d_pages"), sums("counts", n).alias("d_counts"))
    suffixes = hosts.groupBy("suffix").agg(sums("counts", n).alias("s_counts"))
    kinds = hosts.select("suffix").distinct().count()
    evidence = durable(hosts.join(in_domain, "domain").join(suffixes, "suffix").where("host <> ''").select("host", "pages", "counts", "d_pages", "d_counts", "s_counts"))
    # as many rows as languages, and two
    markup = durable(by_text.groupBy("declared").agg(sums("p", n).alias("m_counts")))

    joined = by_text.join(evidence, "host", "left").join(F.broadcast(markup), "declared")
    others = {c: F.zip_with(c, "p", lambda x, own: F.greatest(x - own, F.lit(0.0))) for c in ("counts", "d_counts", "s_counts", "m_counts")}
    joined = joined.withColumns({**others, "a_counts": F.zip_with(F.array(*map(F.lit, of_all)), "p", lambda x, own: F.greatest(x - own, F.lit(0.0)))})
    share = F.transform("a_counts", lambda x: (x + EVEN) / (sum(of_all) - 1 + EVEN * n))
    by_domain = shrunk(F.col("d_counts"), F.col("d_pages") - 1, F.col("share"), DOMAIN_WEIGHT)
    by_host = F.coalesce(shrunk(F.col("counts"), F.col("pages") - 1, F.col("by_domain"), HOST_WEIGHT), F.col("share"))

    def likely(counts: str | Column, values: int, more: float = 0.0) -> Column:
        """How likely the page's value of a kind is by language, among so many values and, with more, so many pages taken as seen."""
        return F.zip_with(counts, "a_counts", lambda x, a: F.log((x + EVEN) / (a + EVEN * values + more)))

    meant = F.transform("m_counts", lambda x, i: x + F.when(F.get(F.array(*map(F.lit, languages)), i) == F.col("declared"), AGREE).otherwise(0.0))

    joined = joined.withColumn("share", share).withColumn("by_domain", by_domain).withColumn("by_host", by_host)
    fused = joined.select("page_id", "url", "declared", "n_grams", "fit", "by_host", F.coalesce(likely("s_counts", kinds), F.array(*[F.lit(0.0)] * n)).alias("by_suffix"), likely(meant, n + 2, AGREE).alias("by_markup"))
    score = F.zip_with(F.zip_with("fit", F.transform("by_host", lambda x: F.log(x)), lambda a, b: a + b), F.zip_with("by_suffix", "by_markup", lambda a, b: a + b), lambda a, b: a + b)
    named = F.array(*map(F.lit, languages))
    best = lambda x: F.get(named, (F.array_position(x, F.array_max(x)) - 1).cast("int"))
    fused = fused.withColumn("score", score)
    posterior = normalized(F.transform("score", lambda x: F.exp(x - F.array_max("score"))))
    fused = fused.withColumn("posterior", posterior)
    return fused.select("page_id", "url", "declared", F.when(F.col("n_grams") > 0, best(F.col("fit"))).alias("text_lang"), best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"), F.map_from_arrays(named, "posterior").alias("posterior"))
