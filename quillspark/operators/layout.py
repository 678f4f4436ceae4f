"""Questions, answers and paragraphs from line regions (page, ln, x, y, w, h, ink_area, density, text).

Everything is a window or a grouping on the page, so a page's lines are shuffled once; medians are ranks, so no row carries a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, AnswerRule, ParagraphRule, QuestionRule
from ..functions.expressions import QUESTION_PREFIX, clamp, ordinal_id, union_box, with_upper_median
from ..schema import PAGE


def down():
    """The lines of a page from top to bottom."""
    return Window.partitionBy(*PAGE).orderBy("y", "x", "ln")


def running():
    return down().rowsBetween(Window.unboundedPreceding, 0)


def paragraph_lines(lines: DataFrame, rule: ParagraphRule = CONFIG.paragraph) -> DataFrame:
    """Lines with gap, score and the order of their paragraph."""
    w = rule.weights.normalized()
    width = F.max("w").over(Window.partitionBy(*PAGE))
    placed = with_upper_median(lines, "median_h", F.col("h")).withColumns({
        "median_h": F.when(F.col("median_h") == 0, 1).otherwise(F.col("median_h")), "left_x": F.min("x").over(Window.partitionBy(*PAGE)), "full_w": F.when(width == 0, 1).otherwise(width),
        "gap": F.col("y") - F.lag(F.col("y") + F.col("h")).over(down()), "thinner": F.abs(F.lag("density").over(down()) - F.col("density")),
    })
    score = (
        w.gap * clamp(F.col("gap") / (rule.gap_multiple * F.col("median_h")), 0.0, 1.0)
        + w.indent * clamp((F.col("x") - F.col("left_x")) / (0.25 * F.col("full_w")), 0.0, 1.0)
        + w.density * F.least(F.lit(1.0), F.col("thinner") * 4.0)
    )
    starts = F.when(F.col("gap").isNull() | (F.col("score") >= rule.threshold), 1).otherwise(0)
    return placed.withColumn("score", score).withColumn("paragraph", F.sum(starts).over(running())).drop("median_h", "left_x", "full_w", "thinner")


def paragraphs(lines: DataFrame, rule: ParagraphRule = CONFIG.paragraph) -> DataFrame:
    """page, paragraph, id, x, y, w, h, n_lines"""
    found = paragraph_lines(lines, rule).groupBy(*PAGE, "paragraph").agg(*union_box(), F.count("*").alias("n_lines"))
    return found.withColumn("id", ordinal_id(F.lit("p"), F.col("paragraph")))


def mark_questions(lines: DataFrame, rule: QuestionRule = CONFIG.question, text: str | None = None) -> DataFrame:
    """All lines, with the number of their question group (null for others) and whether they open it.

    Without a text column only the page's first content line starts a question. A line with a question mark inside a
    running group belongs to it; tall header lines belong to none.
    """
    content = with_upper_median(lines, "median_h", F.col("h")).withColumn("content", (F.col("median_h") > 0) & (F.col("h") <= rule.header_factor * F.col("median_h")))
    before = F.last(F.when(F.col("content"), F.col("y") + F.col("h")), ignorenulls=True).over(down().rowsBetween(Window.unboundedPreceding, -1))
    content = with_upper_median(content, "full_w", F.when(F.col("content"), F.col("w"))).withColumn("before", before)
    said = F.coalesce(F.col(text), F.lit("")) if text else F.lit("")
    starts = said.rlike(QUESTION_PREFIX)
    goes_on = (F.col("y") - F.col("before") <= rule.max_gap) & (F.col("w") < rule.short_ratio * F.col("full_w")) & ~starts
    hit = F.col("content") & (F.col("before").isNull() | starts | said.contains("?"))
    breaks = F.col("content") & ~F.coalesce(goes_on, F.lit(False))
    marked = content.withColumn("hit", hit.cast("int")).withColumn("stretch", F.sum(breaks.cast("int")).over(running()))
    within = Window.partitionBy(*PAGE, "stretch").orderBy("y", "x", "ln").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("hits", F.sum("hit").over(within)).withColumn("opens", (F.col("hit") == 1) & (F.col("hits") == 1))
    number = F.sum(F.col("opens").cast("int")).over(running())
    return marked.withColumn("question", F.when(F.col("content") & (F.col("hits") > 0), number)).drop("median_h", "content", "full_w", "before", "hit", "hits", "stretch")


def question_lines(lines: DataFrame, rule: QuestionRule = CONFIG.question, text: str | None = None) -> DataFrame:
    """The lines of question groups."""
    return mark_questions(lines, rule, text).where("question is not null").drop("opens")


def question_boxes(marked: DataFrame) -> DataFrame:
    """page, question, id, x, y, w, h, n_lines of marked lines."""
    found = marked.where("question is not null").groupBy(*PAGE, "question").agg(*union_box(), F.count("*").alias("n_lines"))
    return found.withColumn("id", ordinal_id(F.lit("q"), F.col("question")))


def questions(lines: DataFrame, rule: QuestionRule = CONFIG.question, text: str | None = None) -> DataFrame:
    return question_boxes(mark_questions(lines, rule, text))


def mark_answers(marked: DataFrame, rule: AnswerRule = CONFIG.answer) -> DataFrame:
    """Lines marked with questions, with `answers`: whether they bound the answer below the page's topmost question.

    Specks go first, by the density of the candidates, then scribbles in the margin, by the left edge of those that are left.
    """
    page = Window.partitionBy(*PAGE)
    bottom = F.max(F.when(F.col("question") == 1, F.col("y") + F.col("h"))).over(page)
    bounded = marked.withColumn("bottom", bottom).withColumn("cap", F.min(F.when(F.col("opens") & (F.col("y") > F.col("bottom")), F.col("y"))).over(page))
    below = (F.col("y") > F.col("bottom")) & (F.col("cap").isNull() | (F.col("y") < F.col("cap")))
    bounded = bounded.withColumn("below", F.coalesce(below, F.lit(False)))
    bounded = with_upper_median(bounded, "median_d", F.when(F.col("below"), F.col("density")))
    dense = F.col("below") & ((F.col("median_d") <= 0) | (F.col("density") >= rule.density_ratio * F.col("median_d")))
    bounded = bounded.withColumn("dense", dense)
    bounded = with_upper_median(bounded, "median_x", F.when(F.col("dense"), F.col("x")))
    kept = F.col("dense") & ~((F.col("x") < F.col("median_x") - rule.scribble_px) & (F.col("ink_area") < rule.min_ink))
    return bounded.withColumn("answers", F.coalesce(kept, F.lit(False))).drop("bottom", "cap", "below", "median_d", "dense", "median_x")


def answers(marked: DataFrame, rule: AnswerRule = CONFIG.answer) -> DataFrame:
    """page, id, x, y, w, h: the box around the answer's lines, from lines marked with questions."""
    found = mark_answers(marked, rule).where("answers").groupBy(*PAGE).agg(*union_box())
    return found.withColumn("id", ordinal_id(F.lit("answer_"), F.col("page_number")))


def answer_lines(marked: DataFrame, rule: AnswerRule = CONFIG.answer) -> DataFrame:
    """All lines that begin inside the answer's box, edges included."""
    page, own = Window.partitionBy(*PAGE), F.when(F.col("answers"), F.col("y"))
    bound = mark_answers(marked, rule).withColumns({"top": F.min(own).over(page), "end": F.max(own + F.col("h")).over(page)})
    return bound.where("y between top and end").drop("top", "end", "answers", "question", "opens")
