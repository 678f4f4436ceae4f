"""Page geometry derived from the supplied text and event tables, which hold no page images.

A document is a page; each of its lines is a box whose size and place follow from its length and number, so that spaces between lines differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import PAGE, STATES


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("ln", "text"))
    return docs.withColumn("page_number", F.lit(1))


def line_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, page_number, ln, x, y, w, h, ink_area, density, text), for every line of every text."""
    n = F.length("text")
    return text_lines(spark, sf_dir).select(
        "document_id", "page_number", "ln",
        ((n % 7) * 4).alias("x"), (F.col("ln") * 30 + (n % 5) * 6).alias("y"), (n * 3).alias("w"), F.lit(12).alias("h"), n.alias("ink_area"),
        (F.length(F.replace("text", F.lit(" "), F.lit(""))).cast("double") / F.greatest(n, F.lit(1))).alias("density"), "text",
    )


def ink_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of ink on rows of pixels: a line's part up to its first space and the part behind it, six rows high: (document_id, page_number, height, y, x_start, x_end)."""
    lines = line_regions(spark, sf_dir).withColumn("height", F.max(F.col("y") + F.col("h")).over(Window.partitionBy(*PAGE)) + 20)
    cut = F.when(F.instr("text", " ") > 1, F.instr("text", " ") - 1).otherwise(F.length("text")) * 3
    parts = F.array(F.struct(F.col("x").alias("x_start"), (F.col("x") + cut).alias("x_end")), F.struct((F.col("x") + cut + 3).alias("x_start"), (F.col("x") + F.col("w")).alias("x_end")))
    runs = lines.select(*PAGE, "height", "y", F.explode(parts).alias("part")).where("part.x_end > part.x_start")
    rows = F.explode(F.sequence(F.col("y") + 3, F.col("y") + 8)).alias("y")
    return runs.select(*PAGE, "height", rows, "part.x_start", "part.x_end")


def margin_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ink_runs() and, right of a page's widest line, two bars: one of two to four columns that stops at every sixth line, and one at every other line, which is no line of its own: (document_id, page_number, y, x_start, x_end)."""
    lines = line_regions(spark, sf_dir)
    right = F.max(F.col("x") + F.col("w")).over(Window.partitionBy(*PAGE))
    lines = lines.withColumn("right", right).withColumn("y", F.explode(F.sequence(F.col("ln") * 30, F.col("ln") * 30 + 29)))
    at = lambda x, w: ((F.col("right") + x).alias("x_start"), (F.col("right") + x + w).cast("int").alias("x_end"))
    bars = lines.where("ln % 6 < 5").select(*PAGE, "y", *at(10, 2 + F.floor(F.col("ln") / 3) % 3)).unionByName(lines.where("ln % 2 = 0").select(*PAGE, "y", *at(30, 3)))
    return ink_runs(spark, sf_dir).select(*PAGE, "y", "x_start", "x_end").unionByName(bars)


def specks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two small blots for each line, one to five pixels apart and three to five rows high: (document_id, page_number, y, x_start, x_end)."""
    n = F.length("text")
    first = n % 11 + 3 + n % 6
    lines = line_regions(spark, sf_dir).select(*PAGE, F.explode(F.sequence(F.col("ln") * 8, F.col("ln") * 8 + 2 + n % 3)).alias("y"), (n % 11).alias("a"), first.alias("b"), (first + 1 + n % 5).alias("c"))
    return lines.select(*PAGE, "y", F.col("a").alias("x_start"), F.col("b").alias("x_end")).unionByName(lines.select(*PAGE, "y", F.col("c").alias("x_start"), (F.col("c") + 4).alias("x_end")))


def yellow_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of marker on rows of pixels, over every fourth line and half of the next one, up to which it reaches in every other document: (document_id, page_number, y, x_start, x_end)."""
    lines, first = line_regions(spark, sf_dir).where("ln % 4 < 2 and w > 3"), F.col("ln") % 4 == 0
    long = F.when(first, F.col("w")).otherwise(F.floor(F.col("w") / 2).cast("int"))
    top = F.col("ln") * 30 + F.when(first, 0).otherwise(1 - F.col("document_id") % 2 * 6).cast("int")
    rows = F.explode(F.sequence(top, F.col("ln") * 30 + 24)).alias("y")
    return lines.select(*PAGE, rows, F.col("x").alias("x_start"), (F.col("x") + long).alias("x_end"))


def row_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of a user's events as rows of a page: (document_id, page_number, y, row_ink, x_min, x_max)."""
    minute = F.floor(F.unix_timestamp("ts") / 60)
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.lit(1).alias("page_number"), minute.alias("y"), (F.col("event_id") % 1000).alias("x"))
    return e.groupBy("document_id", "page_number", "y").agg(F.count("*").alias("row_ink"), F.min("x").alias("x_min"), F.max("x").alias("x_max"))


def inked_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of a line as its columns, spaces without ink; neighbours with the same ink as one row: (document_id, page_number, ln, x, x_end, col_ink, width)."""
    # lines are shuffled, not their words; the page's number is one for all, and Spark leaves it out of the windows' keys; by number, so that partitions aren't put together by the size of lines alone
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = line_regions(spark, sf_dir).select(*PAGE, "ln", "text").repartition(n, "document_id", "ln")
    words = lines.select(*PAGE, "ln", F.length("text").alias("width"), F.posexplode(F.split("text", " ")).alias("i", "word")).withColumn("n", F.length("word")).drop("word")
    before = Window.partitionBy(*PAGE, "ln").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    x = F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)).cast("int")
    placed = words.withColumn("x", x).where("n > 0")
    return placed.select(*PAGE, "ln", "x", (F.col("x") + F.col("n") - 1).alias("x_end"), F.lit(5).alias("col_ink"), "width")


def ocr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcriptions of the lines: confidence by document and line number, an uncertain start on each fifth line."""
    ranges = F.when(F.col("ln") % 5 == 0, F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("unclear").alias("reason")))).otherwise(F.array().cast("array<struct<start:int,end:int,reason:string>>"))
    return line_regions(spark, sf_dir).select("document_id", "page_number", "ln", "text", (((F.col("document_id") * 37 + F.col("ln") * 11) % 101).cast("double") / 100).alias("confidence"), ranges.alias("uncertainty"))


def state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the states of a document, in the order of time: (document_id, seq, state)."""
    kinds = F.array(*map(F.lit, STATES))
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("document_id"), "ts", "event_id", F.element_at(kinds, (F.length("event_type") + F.col("event_id") % 3).cast("int") % len(STATES) + 1).alias("state"))
