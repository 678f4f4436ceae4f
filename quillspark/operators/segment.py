"""Runs of active positions: lines from row profiles, bands, words from column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, Segment
from ..schema import PAGE


def _numbered(active: DataFrame, by: Sequence[str], at: str, until: str, tolerance: int) -> DataFrame:
    """active with the number of its island within `by`."""
    w = Window.partitionBy(*by).orderBy(at)
    apart = F.col(at) - F.lag(until).over(w) - 1 > tolerance
    return active.withColumn("island", F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def _numbered_by_chunks(active: DataFrame, by: Sequence[str], at: str, until: str, tolerance: int, chunk: int) -> DataFrame:
    """The same, for groups without a bound: islands are numbered within chunks of positions, and a window over a group's chunks, one row each, tells
    how many islands lie before each and whether its first one goes on from the chunk before."""
    local = _numbered(active.withColumn("_chunk", F.floor(F.col(at) / chunk)), [*by, "_chunk"], at, until, tolerance)
    chunks = local.groupBy(*by, "_chunk").agg(F.max("island").alias("_n"), F.min(at).alias("_first"), F.max(until).alias("_last"))
    w = Window.partitionBy(*by).orderBy("_chunk")
    goes_on = F.coalesce((F.col("_first") - F.lag("_last").over(w) - 1 <= tolerance).cast("int"), F.lit(0))
    chunks = chunks.withColumn("_goes_on", goes_on).withColumn("_before", F.sum(F.col("_n") - F.col("_goes_on")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    placed = local.join(chunks.select(*by, "_chunk", "_before"), [*by, "_chunk"])
    return placed.withColumn("island", F.col("island") + F.col("_before")).drop("_chunk", "_before")


def runs(active: DataFrame, by: Sequence[str], at: str, tolerance: int, extent: Column | None = None, sums: Sequence[Column] = (), until: str | None = None, chunk: int | None = None) -> DataFrame:
    """Islands of active positions that lie at most `tolerance` empty positions apart. With until, a row stands for the positions from at to there; rows don't overlap.

    One window over `by`, one grouping on the same keys, so one shuffle; with a chunk, a number of positions, a group may be too large for one task. With an extent (positions in all), a run that is
    still open at the edge ends there. Gives by, island, first, last and the sums.
    """
    end = until or at
    marked = _numbered_by_chunks(active, by, at, end, tolerance, chunk) if chunk else _numbered(active, by, at, end, tolerance)
    last = F.max(end)
    if extent is not None:
        edge = F.max(extent)
        last = F.when(edge - last <= tolerance, edge - 1).otherwise(last)
    return marked.groupBy(*by, "island").agg(F.min(at).alias("first"), last.alias("last"), *sums)


def row_profile(ink: DataFrame, *more: str) -> DataFrame:
    """page, more, y, row_ink, x_min, x_max of each row of pixels with ink, from runs of ink (page, y, x_start, x_end), the end exclusive."""
    return ink.groupBy(*PAGE, *more, "y").agg(F.sum(F.col("x_end") - F.col("x_start")).alias("row_ink"), F.min("x_start").alias("x_min"), (F.max("x_end") - 1).alias("x_max"))


def segment_lines(profile: DataFrame, rule: Segment = CONFIG.segment, extent: Column | None = None, min_ink: int | None = None) -> DataFrame:
    """Lines of pages from (page, y, row_ink, x_min, x_max): page, line_no, x, y, w, h, ink_area.

    Rows under the minimum ink still count for a line that spans them only through the profile's active rows.
    """
    active = profile.where(F.col("row_ink") >= max(rule.min_row_ink, 1))
    sums = (F.min("x_min").alias("x"), F.max("x_max").alias("x_max"), F.sum("row_ink").alias("ink_area"))
    found = runs(active, PAGE, "y", rule.line_gap, extent, sums).where(F.col("ink_area") >= (rule.min_line_ink if min_ink is None else min_ink))
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("first"))
    return found.select(*PAGE, number.alias("line_no"), "x", F.col("first").alias("y"), (F.col("x_max") - F.col("x") + 1).alias("w"), (F.col("last") - F.col("first") + 1).alias("h"), "ink_area")


def merge_bands(bands: DataFrame, gap: int = CONFIG.segment.rule_merge_gap) -> DataFrame:
    """(page, start, end) merged where the space between neighbours is at most gap."""
    w = Window.partitionBy(*PAGE).orderBy("start", "end")
    apart = F.col("start") - F.lag("end").over(w) - 1 > gap
    marked = bands.withColumn("band", F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.struct("start", "end"))["end"]
    return marked.groupBy(*PAGE, "band").agg(F.min("start").alias("start"), last.alias("end"))


def segment_words(columns: DataFrame, by: Sequence[str], rule: Segment = CONFIG.segment) -> DataFrame:
    """Words of lines from (by, x, col_ink, width), with an x_end where a row stands for several columns: by, word_no, x, w.

    The runs of runs(), but told from the last row of each, which carries where its run began: all are windows in one order of a line's rows, and no table of words is
    kept in memory for a grouping. Columns that are dealt out by the line already aren't shuffled.
    """
    end, w = "x_end" if "x_end" in columns.columns else "x", Window.partitionBy(*by).orderBy("x")
    apart = lambda before, next_: F.coalesce(next_ - before - 1 > rule.word_gap, F.lit(True))
    active = columns.where(F.col("col_ink") >= rule.min_col_ink).select(*by, "x", F.col(end).alias("_end"), "width")
    active = active.withColumns({"_starts": apart(F.lag("_end").over(w), F.col("x")), "_ends": apart(F.col("_end"), F.lead("x").over(w))})
    first = F.max(F.when(F.col("_starts"), F.col("x"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # a run that is still open at the line's edge ends there
    last = F.when(F.col("width") - F.col("_end") <= rule.word_gap, F.col("width") - 1).otherwise(F.col("_end"))
    found = active.withColumn("_first", first).withColumn("_w", last - F.col("_first") + 1).where(F.col("_ends") & (F.col("_w") >= rule.min_word_width))
    return found.withColumn("word_no", F.row_number().over(w)).select(*by, "word_no", F.col("_first").alias("x"), F.col("_w").alias("w"))
