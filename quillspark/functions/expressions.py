"""Column expressions shared by the operators. All stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, Review
from ..schema import PAGE

#: Fixed value: what starts a question, in any case, with Unicode digits and spaces.
QUESTION_PREFIX = r"(?iU)^\s*(Q\s*\d+|QN\s*\d+|Question\s*\d*\b)"
#: Fixed value: the image formats that are taken.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp")


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case extension of a path's last part, with its dot; empty if none. A leading dot starts no extension."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def input_kind(path: Column) -> Column:
    """pdf, image, or null for formats that are not taken."""
    s = suffix(path)
    return F.when(s == ".pdf", "pdf").when(s.isin(*IMAGE_SUFFIXES), "image")


def redacted(text: Column, most: int = 300) -> Column:
    """Long strings replaced by their length, for logs."""
    return F.when(F.length(text) > most, F.concat(F.lit("<"), F.length(text).cast("string"), F.lit(" chars omitted>"))).otherwise(text)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def midpoint(y: Column, height: Column) -> Column:
    return y + height / F.lit(2.0)


def with_upper_median(rows: DataFrame, name: str, x: Column, by: Sequence[str] = PAGE) -> DataFrame:
    """rows with the middle value of x over each group, the higher of the two middle ones; nulls don't count.

    A rank and a count, so that a group is sorted once and no row carries the group's values.
    """
    group = Window.partitionBy(*by)
    rows = rows.withColumn("_x", x).withColumns({"_rank": F.row_number().over(group.orderBy(F.asc_nulls_last("_x"))), "_n": F.count("_x").over(group)})
    middle = F.when(F.col("_rank") == F.floor(F.col("_n") / 2) + 1, F.col("_x"))
    return rows.withColumn(name, F.max(middle).over(group)).drop("_x", "_rank", "_n")


def union_box(x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> list[Column]:
    """Aggregates of the box around all boxes."""
    return [
        F.min(x).alias("x"),
        F.min(y).alias("y"),
        (F.max(F.col(x) + F.col(w)) - F.min(x)).alias("w"),
        (F.max(F.col(y) + F.col(h)) - F.min(y)).alias("h"),
    ]


def ordinal_id(prefix: Column, number: Column, digits: int = 3) -> Column:
    return F.concat(prefix, F.format_string(f"%0{digits}d", number))


def confidence_class(confidence: Column, rule: Review = CONFIG.review) -> Column:
    return F.when(confidence >= rule.accept, "accepted").when(confidence >= rule.review, "review_recommended").otherwise("review_required")


def clipped_ranges(ranges: Column, text: Column) -> Column:
    """Ranges cut at the end of the text; those left empty are dropped."""
    cut = F.transform(ranges, lambda r: F.struct(r["start"].alias("start"), F.least(r["end"], F.length(text)).alias("end"), r["reason"].alias("reason")))
    return F.filter(cut, lambda r: r["end"] > r["start"])


def any_clipped(ranges: Column, text: Column) -> Column:
    return F.exists(ranges, lambda r: r["end"] > F.length(text))


def ordered_text(order: Column, text: Column, between: str) -> Column:
    """Aggregate: texts joined in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda r: r["t"]), between)
