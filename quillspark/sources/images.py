"""Scans of page images, and ingestion."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CONFIG
from ..functions.expressions import input_kind, suffix

#: What a streaming scan of files needs to be told.
BINARY_FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
PAGES = "document_id string, page_number int, path string, width int, height int, dpi int, bgr binary"


def files(spark: SparkSession, path: str) -> DataFrame:
    """All files under a path with their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def classified(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(taken, refused): files with their kind, and those of other formats with the reason, before anything is made of them."""
    kinds = found.withColumn("kind", input_kind(F.col("path")))
    why = F.concat(F.lit("unsupported format "), F.when(suffix(F.col("path")) == "", "(no extension)").otherwise(suffix(F.col("path"))))
    return kinds.where("kind is not null"), kinds.where("kind is null").select("path", why.alias("reason"))


def with_ids(found: DataFrame) -> DataFrame:
    """document_id from the content, so that the same file has the same id whoever takes it in, and whenever."""
    return found.withColumn("document_id", F.concat(F.lit("doc_"), F.substring(F.sha2("content", 256), 1, 16)))


def numbered(found: DataFrame, taken: DataFrame, key: str = "path") -> DataFrame:
    """found with document_id doc_001, doc_002, ..., after the highest that taken (document_id) has in use; names of another form take no number.

    Rows are numbered in the order of (first digits of the key's md5, key): windows over 4,096 parts and one over their sizes, so no task sees all rows. Keys that are
    null or repeated get a number each.
    """
    part = F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 3)
    own = Window.partitionBy("_part").orderBy(key)
    rows = found.withColumn("_part", part).withColumn("_n", F.row_number().over(own))
    sizes = found.select(part.alias("_part")).groupBy("_part").agg(F.count("*").alias("_k"))
    before = sizes.withColumn("_before", F.sum("_k").over(Window.orderBy("_part")) - F.col("_k")).drop("_k")  # 4,096 rows at most
    used = F.regexp_extract("document_id", r"^doc_([0-9]+)$", 1).try_cast("long")
    highest = taken.agg(F.coalesce(F.max(used), F.lit(0)).alias("_highest"))
    placed = rows.join(F.broadcast(before), "_part").crossJoin(F.broadcast(highest))
    return placed.withColumn("document_id", F.format_string("doc_%03d", F.col("_highest") + F.col("_before") + F.col("_n"))).drop("_part", "_n", "_before", "_highest")


def dpi_of(content: bytes, default: int = CONFIG.render_dpi) -> int:
    """Resolution that a PNG's pHYs or a JPEG's JFIF header states, rounded half to even; the default where it states none."""
    value = 0.0
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 12 <= len(content):
            n, kind = struct.unpack(">I4s", content[at : at + 8])
            if kind == b"pHYs" and n >= 9 and len(content) >= at + 17:
                x, _, unit = struct.unpack(">IIB", content[at + 8 : at + 17])
                value = x * 0.0254 if unit == 1 else 0.0
            if kind in (b"pHYs", b"IDAT"):
                break
            at += 12 + n
    elif content[:2] == b"\xff\xd8" and content[6:11] == b"JFIF\0" and len(content) >= 16:
        unit, x = content[13], struct.unpack(">H", content[14:16])[0]
        value = x * {1: 1.0, 2: 2.54}.get(unit, 0.0)
    return round(value) if round(value) > 0 else default


@F.pandas_udf(T.IntegerType())
def dpi(content: pd.Series) -> pd.Series:
    return content.map(lambda x: dpi_of(bytes(x)))


def scanned(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pages, refused: path, reason) of the files under a path: pages of PNG, JPEG and the other formats that Spark's image source decodes. Refused are files of other formats
    and those that can't be decoded, so that each file is in one of the two or, a PDF, in sources.paged.

    The two scans give the same file as differently written uris; both are brought to the form without an authority's empty slashes. WEBP needs a
    decoder that Spark lacks: it is refused here, use decoded_pages() with one.
    """
    plain = lambda uri: F.regexp_replace(uri, "^([a-z0-9]+):/+", "$1:/")
    taken, other = classified(files(spark, path))
    heads = with_ids(taken.where("kind = 'image'")).select(plain("path").alias("at"), "document_id", dpi("content").alias("dpi"))
    images = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path).select("image.*")
    found = heads.join(images.withColumn("at", plain("origin")).where("width > 0 and height > 0"), "at", "left")
    pages = found.where("width is not null").select("document_id", F.lit(1).alias("page_number"), F.col("at").alias("path"), "width", "height", "dpi", F.col("data").alias("bgr"))
    broken = found.where("width is null").select(F.col("at").alias("path"), F.lit("image that can't be decoded").alias("reason"))
    return pages, other.select(plain("path").alias("path"), "reason").unionByName(broken)


def image_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of scanned(); ask that for what is refused, too."""
    return scanned(spark, path)[0]


def decoded_pages(found: DataFrame, decode) -> DataFrame:
    """Pages of files (path, content) by a decoder: content -> iterable of (width, height, dpi, bgr bytes), one for each page. A file that it refuses raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, path, content in batch[["document_id", "path", "content"]].itertuples(index=False):
                pages = [(doc, i, path, *page) for i, page in enumerate(decode(bytes(content)), 1)]
                yield pd.DataFrame(pages, columns=["document_id", "page_number", "path", "width", "height", "dpi", "bgr"])

    return with_ids(found).mapInPandas(run, PAGES)
