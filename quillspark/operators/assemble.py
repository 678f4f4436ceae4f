"""Texts of paragraphs, answers and questions, and the nested documents made of them. Text is never corrected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.expressions import basename, ordered_text, strip
from ..schema import PAGE


def paragraph_text(lines: DataFrame) -> DataFrame:
    """Lines (page, paragraph, ln, text) as paragraphs: stripped, without blank ones, joined by spaces."""
    said = lines.withColumn("text", strip(F.col("text")))
    return said.groupBy(*PAGE, "paragraph").agg(ordered_text(F.col("ln"), F.when(F.col("text") != "", F.col("text")), " ").alias("text"))


def answer_text(paragraphs: DataFrame) -> DataFrame:
    """document_id, text: paragraphs, then pages, joined by blank lines; empty ones are left out."""
    pages = paragraphs.where("text <> ''").groupBy(*PAGE).agg(ordered_text(F.col("paragraph"), F.col("text"), "\n\n").alias("text"))
    return pages.groupBy("document_id").agg(ordered_text(F.col("page_number"), F.col("text"), "\n\n").alias("text"))


def question_text(lines: DataFrame) -> DataFrame:
    """document_id, text: lines as they are joined by spaces, pages by line ends; blank ones stay."""
    pages = lines.groupBy(*PAGE).agg(ordered_text(F.col("ln"), F.coalesce("text", F.lit("")), " ").alias("text"))
    return pages.groupBy("document_id").agg(ordered_text(F.col("page_number"), F.col("text"), "\n").alias("text"))


def review_export(questions: DataFrame, paragraphs: DataFrame, names: DataFrame) -> DataFrame:
    """document_id, filename, question, response of each document that has either. The response joins all paragraphs, blank ones too.

    questions: document_id, text. paragraphs: page, paragraph, text. names: document_id, path.
    """
    responses = paragraphs.groupBy("document_id").agg(ordered_text(F.struct("page_number", "paragraph"), F.coalesce("text", F.lit("")), "\n\n").alias("response"))
    either = questions.select("document_id", F.col("text").alias("question")).join(responses, "document_id", "full")
    named = either.join(names.select("document_id", basename(F.col("path")).alias("filename")), "document_id")
    return named.select("document_id", "filename", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("response", F.lit("")).alias("response"))


def export_json(rows: DataFrame) -> DataFrame:
    """document_id and the export's JSON."""
    responses = F.array(F.struct("question", "response"))
    body = F.struct(F.array(F.struct("filename", responses.alias("responses"))).alias("results"))
    return rows.select("document_id", F.to_json(body, {"pretty": "true"}).alias("json"))


def nested(paragraphs: DataFrame, lines: DataFrame) -> DataFrame:
    """document_id, pages: the tree of pages, paragraphs and lines, each in its order. Grouped level by level, so only a document's own rows meet.

    paragraphs: page, paragraph, id, x, y, w, h. lines: page, paragraph, ln, x, y, w, h, text.
    """
    box = F.struct("x", "y", "w", "h").alias("bbox")
    below = lines.groupBy(*PAGE, "paragraph").agg(F.sort_array(F.collect_list(F.struct("ln", box, "text"))).alias("lines"))
    own = paragraphs.select(*PAGE, "paragraph", "id", box).join(below, [*PAGE, "paragraph"], "left")
    pages = own.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("paragraph", "id", "bbox", "lines"))).alias("paragraphs"))
    return pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "paragraphs"))).alias("pages"))


def sparse_json(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys, and all other columns as JSON: nulls and empty arrays are left out."""
    rest = []
    for f in rows.schema:
        if f.name not in keys:
            c = F.col(f.name)
            rest.append(F.when(F.size(c) > 0, c).alias(f.name) if f.dataType.typeName() == "array" else c)
    return rows.select(*keys, F.to_json(F.struct(*rest)).alias("json"))


def from_sparse_json(rows: DataFrame, schema: StructType, *keys: str) -> DataFrame:
    """The keys and the columns of sparse_json() again: what was left out is null, or an empty array where the schema has an array."""
    read = rows.select(*keys, F.from_json("json", schema).alias("r"))
    columns = []
    for f in schema:
        c = F.col(f"r.{f.name}")
        columns.append((F.coalesce(c, F.array().cast(f.dataType)) if isinstance(f.dataType, ArrayType) else c).alias(f.name))
    return read.select(*keys, *columns)
