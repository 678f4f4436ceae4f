"""The whole way of a document: pages of pixels to lines, regions, crops, transcriptions, texts and review."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG, Config
from ..functions.expressions import ordinal_id
from ..operators import assemble, crops, ink, kernels, layout, once, review, segment, transcribe
from ..schema import PAGE


@dataclass(frozen=True)
class Layout:
    """What is found on pages; each frame has the page's key."""

    lines: DataFrame
    questions: DataFrame
    answers: DataFrame
    answer_lines: DataFrame
    paragraphs: DataFrame
    highlights: DataFrame
    crops: DataFrame


def ink_of(pages: DataFrame, threshold: int = 128) -> DataFrame:
    """Runs of ink of pages (page, height, width, bgr) by gray. Binarise with other tools first where pages are unevenly lit, skewed or noisy."""
    return kernels.pixel_runs(pages, lambda bgr: kernels.dark(bgr, threshold))


def marks_of(pages: DataFrame, config: Config = CONFIG) -> DataFrame:
    """Runs of marker, cleaned."""
    return ink.cleaned(kernels.pixel_runs(pages, lambda bgr: kernels.marker(bgr, config.highlight)), config.highlight.cleanup)


def find_lines(pages: DataFrame, config: Config = CONFIG, threshold: int = 128) -> DataFrame:
    """page, ln, x, y, w, h, ink_area, density, text (null) from pixels. The runs are small: write the lines if the pages are read again."""
    raw = ink_of(pages, threshold)
    profile = segment.row_profile(ink.without_rules(raw, config.segment), "height")
    lines = segment.segment_lines(profile, config.segment, F.col("height")).withColumn("ln", F.col("line_no") - 1).drop("line_no")
    return lines.join(ink.line_density(raw, lines), [*PAGE, "ln"], "left").withColumns({"density": F.coalesce("density", F.lit(0.0)), "text": F.lit(None).cast("string")})


def word_boxes(pages: DataFrame, lines: DataFrame, config: Config = CONFIG, threshold: int = 128) -> DataFrame:
    """page, ln, word_no, x, y, w, h of the words of lines, tight around their ink."""
    found = segment.segment_words(ink.line_columns(runs := ink_of(pages, threshold), lines), [*PAGE, "ln"], config.segment)
    return ink.tight(found, runs, lines)


def find_layout(pages: DataFrame, lines: DataFrame, config: Config = CONFIG, threshold: int = 128, page_height: int = 1 << 30) -> Layout:
    """Questions, answers, paragraphs, highlights and all crops of pages, from their lines."""
    marked = layout.mark_questions(lines, config.question)  # without text, one question for a page at most
    questions, answers = layout.question_boxes(marked), layout.answers(marked, config.answer)
    inside = layout.answer_lines(marked, config.answer)
    paragraphs = layout.paragraphs(inside, config.paragraph)
    bands = segment.merge_bands(ink.rule_bands(ink_of(pages, threshold), config.segment), config.segment.rule_merge_gap)
    grown = crops.to_bands(lines, bands, page_height).select(*PAGE, "ln", *(F.col(c).alias(f"c{c}") for c in "xywh"))
    of = {"question": crops.lines_of(questions, lines), "paragraph": crops.lines_of(paragraphs, lines)}
    line_crops = of["question"].unionByName(of["paragraph"], allowMissingColumns=True).join(grown, [*PAGE, "ln"])
    words = word_boxes(pages, lines, config, threshold).join(of["paragraph"].select(*PAGE, "ln", F.col("id").alias("parent_id")), [*PAGE, "ln"])
    none = F.lit(None).cast("string").alias("parent_id")
    box = ["x", "y", "w", "h"]
    found = questions.select(*PAGE, F.lit("question").alias("type"), "id", none, *box)
    for more in (
        answers.select(*PAGE, F.lit("answer").alias("type"), "id", none, *box),
        paragraphs.select(*PAGE, F.lit("paragraph").alias("type"), "id", none, *box),
        line_crops.select(*PAGE, F.lit("line").alias("type"), "id", "parent_id", *(F.col(f"c{c}").alias(c) for c in box)),
        words.select(*PAGE, F.lit("word").alias("type"), ordinal_id(F.concat("parent_id", F.lit("_word")), F.col("word_no"), 2).alias("id"), "parent_id", *box),
    ):
        found = found.unionByName(more)
    return Layout(lines, questions, answers, inside, paragraphs, ink.highlights(marks_of(pages, config), config.highlight), found)


def line_crops(found: Layout) -> DataFrame:
    """The crops that are transcribed: lines, and nothing else."""
    return found.crops.where("type = 'line'")


def read_lines(pages: DataFrame, found: Layout, cache: DataFrame, config: Config = CONFIG, transcriber=None, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, responses) of the line crops. With a store what the calls gave is written there first; without one write both before using them again."""
    images = kernels.crop_images(pages, line_crops(found))
    return transcribe.run(images.select(*PAGE, F.col("id").alias("crop_id"), "image"), cache, config.transcription, transcriber, store)


def read_and_keep(pages: DataFrame, found: Layout, at: str, config: Config = CONFIG, transcriber=None) -> DataFrame:
    """The results of the line crops, from the tables under a folder and added to them: responses (cache_key, raw, as they came) and results (page, crop_id, ...).

    Both only grow, by one commit each, so runs may write side by side; a run that is done again makes no call and adds nothing. Results that failed or were capped are given but not kept, so a later run tries again.
    """
    spark, responses, kept = pages.sparkSession, f"{at}/responses", f"{at}/results"
    known = once.table(spark, responses)
    if known is None:
        known = spark.createDataFrame([], "cache_key string, raw string")
    results, fresh = read_lines(pages, found, known, config, transcriber, store=f"{at}/calls")
    once.append_once(fresh, responses, ["cache_key"])
    once.append_once(results.where("result.validation_state <> 'unavailable'"), kept, [*PAGE, "crop_id"])
    return results


def texts(found: Layout, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions: document_id, text; paragraphs: page, paragraph, text; answers: document_id, text) from results (page, crop_id, result)."""
    said = results.select(*PAGE, F.col("crop_id").alias("id"), F.col("result.text").alias("said"))
    number = F.regexp_extract("id", r"_line(\d+)$", 1).cast("int").alias("ln")
    lines = found.crops.where("type = 'line'").select(*PAGE, "id", "parent_id", number).join(said, [*PAGE, "id"], "left")
    lines = lines.withColumn("text", F.coalesce("said", F.lit(""))).drop("said")
    questions = assemble.question_text(lines.join(found.questions.select(*PAGE, F.col("id").alias("parent_id")), [*PAGE, "parent_id"], "left_semi"))
    own = found.paragraphs.select(*PAGE, "paragraph", F.col("id").alias("parent_id"))
    paragraphs = assemble.paragraph_text(lines.join(own, [*PAGE, "parent_id"]))
    return questions, paragraphs, assemble.answer_text(paragraphs)


def to_review(results: DataFrame, config: Config = CONFIG) -> DataFrame:
    """page, crop_id, confidence, review_class and the result's own review state: two signals, kept apart."""
    flat = results.select(*PAGE, "crop_id", F.col("result.confidence").alias("confidence"), F.col("result.review_state").alias("review_state"), F.col("result.review_reason").alias("review_reason"))
    return review.with_class(flat, config.review)


def line_count_check(found: Layout) -> DataFrame:
    """page, id, members, cropped: regions whose group has another number of lines than lie in their box by the middle."""
    n = found.crops.where("type = 'line'").groupBy(*PAGE, F.col("parent_id").alias("id")).agg(F.count("*").alias("cropped"))
    regions = found.questions.select(*PAGE, "id", F.col("n_lines").alias("members")).unionByName(found.paragraphs.select(*PAGE, "id", F.col("n_lines").alias("members")))
    return regions.join(n, [*PAGE, "id"], "left").withColumn("cropped", F.coalesce("cropped", F.lit(0))).where("members <> cropped")
