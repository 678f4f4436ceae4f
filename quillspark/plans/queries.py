"""The engine's registered queries: each takes (spark, sf_dir) and runs an operator over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import HighlightRule
from ..functions import expressions as X
from ..operators import assemble, crops, ink, layout, review, segment, transcribe, tree
from ..schema import PAGE, STATES, states
from ..sources import images, proxy


def page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return layout.paragraphs(proxy.line_regions(spark, d)).select("document_id", "id", "paragraph", "x", "y", "w", "h", "n_lines")


def paragraph_scores(spark, d):
    return layout.paragraph_lines(proxy.line_regions(spark, d)).select("document_id", "ln", "gap", F.round("score", 9).alias("score"), "paragraph")


def question_groups_spatial(spark, d):
    return layout.questions(proxy.line_regions(spark, d)).select("document_id", "id", "x", "y", "w", "h", "n_lines")


def _asked(spark, d):
    """Lines with a question's marks put before every seventh and after every fifth, as the tables have none."""
    said = F.when(F.col("ln") % 7 == 3, F.concat(F.lit(" qn 12 "), "text")).when(F.col("ln") % 5 == 4, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    return proxy.line_regions(spark, d).withColumn("said", said)


def question_groups_text(spark, d):
    return layout.questions(_asked(spark, d), text="said").select("document_id", "id", "x", "y", "w", "h", "n_lines")


def answer_region(spark, d):
    return layout.answers(layout.mark_questions(_asked(spark, d), text="said")).select("document_id", "id", "x", "y", "w", "h")


def answer_lines(spark, d):
    return layout.answer_lines(layout.mark_questions(proxy.line_regions(spark, d))).select("document_id", "ln", "y")


#: Minutes; a user's events have no bound, so they are taken a week at a time.
EVENT_GAP, WEEK = 240, 7 * 24 * 60


def row_islands(spark, d):
    sums = (F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), F.sum("row_ink").alias("ink_area"))
    found = segment.runs(proxy.row_profile(spark, d), PAGE, "y", EVENT_GAP, None, sums, chunk=WEEK)
    return found.select("document_id", "island", "first", "last", "x_min", "x_max", "ink_area")


def row_islands_tail(spark, d):
    profile = proxy.row_profile(spark, d)
    tall = profile.join(profile.groupBy(*PAGE).agg((F.max("y") + F.col("document_id") % 3 * 200 + 1).alias("edge")), PAGE)
    found = segment.runs(tall, PAGE, "y", EVENT_GAP, F.col("edge"), (F.sum("row_ink").alias("ink_area"),), chunk=WEEK).where("ink_area >= 2")
    return found.select("document_id", "first", "last", "ink_area")


def band_merge(spark, d):
    bands = proxy.row_profile(spark, d).select(*PAGE, F.col("y").alias("start"), (F.col("y") + F.col("row_ink") * 30).alias("end"))
    return segment.merge_bands(bands, EVENT_GAP).select("document_id", "band", "start", "end")


def _words(spark, d):
    """Words of all lines; a character is a column here, so one is wide enough."""
    return segment.segment_words(proxy.inked_columns(spark, d), [*PAGE, "ln"], segment.Segment(word_gap=0, min_word_width=1))


def word_islands(spark, d):
    return _words(spark, d).select("document_id", "ln", "word_no", "x", "w")


def line_to_paragraph(spark, d):
    lines = proxy.line_regions(spark, d)
    return crops.lines_of(layout.paragraphs(lines), lines).select("document_id", "parent_id", "id", "ln")


def line_to_question(spark, d):
    lines = proxy.line_regions(spark, d)
    return crops.lines_of(layout.questions(lines), lines).select("document_id", "parent_id", "id", "ln")


def enclosing_band(spark, d):
    lines = crops.with_page_size(proxy.line_regions(spark, d))
    bands = lines.where("ln % 3 = 0").select(*PAGE, (F.col("y") - 5).alias("start"), (F.col("y") - 3).alias("end"))
    return crops.to_bands(lines, bands, F.col("page_height")).select("document_id", "ln", "x", "y", "w", "h")


def crop_hierarchy(spark, d):
    """Paragraphs, their lines and those lines' words, each with what it is part of."""
    lines = proxy.line_regions(spark, d)
    paragraphs = layout.paragraphs(lines)
    found = crops.family(paragraphs, crops.lines_of(paragraphs, lines), _words(spark, d))
    return found.select("document_id", "type", "id", "parent_id", "parent_type", "grandparent_id", "grandparent_type")


def crop_paths(spark, d):
    """Paths of the crops of transcribed lines, looked up by the whole key in the table of the crops that there are."""
    lines = proxy.line_regions(spark, d).select(*PAGE, F.lit("line").alias("type"), F.format_string("l%03d", "ln").alias("id"), "ln")
    table = crops.with_paths(lines.where("ln % 4 <> 1"))
    return crops.path_of(lines, table).select("document_id", "id", "path")


def crop_created(spark, d):
    """Crops that exist keep their time; the others have that of the run."""
    lines = proxy.line_regions(spark, d).select(*PAGE, F.lit("line").alias("type"), F.format_string("l%03d", "ln").alias("id"), "ln")
    then = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("ln"))
    known = lines.where("ln % 3 = 0").withColumn("created_at", then)
    return crops.created(lines, known, F.timestamp_seconds(F.lit(1_800_000_000))).select("document_id", "id", F.unix_timestamp("created_at").alias("created"))


def new_crops(spark, d):
    lines = proxy.line_regions(spark, d)
    all_ = lines.select(*PAGE, F.lit("line").alias("type"), F.format_string("l%03d", "ln").alias("id"), "ln")
    return crops.not_yet(all_, all_.where("ln % 3 = 0")).select("document_id", "type", "id")


def clamped_crops(spark, d):
    """Boxes grown beyond the page at all sides, cut to it."""
    boxes = crops.with_page_size(proxy.line_regions(spark, d))
    boxes = boxes.withColumns({"x": F.col("x") - 8, "y": F.col("y") - 10, "w": F.col("w") + 16, "h": F.col("h") + 20})
    return crops.clamped(boxes, F.col("page_width"), F.col("page_height")).select("document_id", "ln", "x", "y", "w", "h")


def _keyed(spark, d):
    lines = proxy.text_lines(spark, d).withColumn("crop_id", F.format_string("l%03d", "ln"))
    return transcribe.with_cache_key(lines.withColumn("image", F.col("text")))


def cache_keys(spark, d):
    return _keyed(spark, d).select("document_id", "crop_id", "cache_key")


def _cache(keyed):
    return keyed.where("ln % 3 = 0").select("cache_key", F.lit("{}").alias("raw"))


def cache_hits(spark, d):
    keyed = _keyed(spark, d)
    return transcribe.cache_hits(keyed, _cache(keyed)).select("document_id", "ln", "cache_key")


def cache_misses(spark, d):
    keyed = _keyed(spark, d)
    return transcribe.cache_misses(keyed, _cache(keyed)).select("document_id", "ln", "cache_key")


def call_cap(spark, d):
    misses = proxy.text_lines(spark, d).where("ln % 3 <> 0")
    return transcribe.call_cap(misses, "ln", 5).select("document_id", "ln", "call_no", "capped")


def uncertainty_repair(spark, d):
    """Ranges of each line, the second of them reaching or lying beyond its end."""
    n = F.length("text")
    reason = F.lit("r")
    two = F.array(F.struct((F.col("ln") % 4).alias("start"), F.lit(6).alias("end"), reason.alias("reason")), F.struct((n - 2 + F.col("ln") % 3).alias("start"), (n + F.col("ln") % 2).alias("end"), reason.alias("reason")))
    ranges = proxy.text_lines(spark, d).withColumn("u", two)
    return ranges.select(
        "document_id", "ln", X.any_clipped(F.col("u"), F.col("text")).alias("clamped"),
        F.size(X.clipped_ranges(F.col("u"), F.col("text"))).alias("n_ranges"),
        F.array_join(F.transform(X.clipped_ranges(F.col("u"), F.col("text")), lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",").alias("ranges"),
    )


def validate_response(spark, d):
    """Responses of ten sorts, by the line's number, among them each way to be malformed and both providers' envelopes."""
    t = F.to_json(F.array("text"))
    t = F.substring(t, F.lit(2), F.length(t) - 2)
    quoted = F.to_json(F.array(F.concat(F.lit('{"text":'), t, F.lit(',"confidence":1}'))))
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    raws = [
        F.concat(F.lit('{"text":'), t, F.lit(',"confidence":0.97,"uncertainty":[]}')),
        F.concat(F.lit('Here it is: {"text":'), t, F.lit(',"confidence":"0.5","uncertainty":[{"start":1.7,"end":"5","reason":"x"}]} Done.')),
        F.concat(F.lit('{"text":'), t, F.lit("}")),
        F.lit('{"text":5,"confidence":1}'),
        F.concat(F.lit('{"text":'), t, F.lit(',"confidence":true,"uncertainty":[{"start":2,"end":100000}]}')),
        F.concat(F.lit('{"text":'), t, F.lit(',"confidence":0.8,"uncertainty":[{"start":4,"end":4}]}')),
        F.concat(F.lit('{"text":'), t, F.lit(',"confidence":0.8,"uncertainty":[{"start":90000,"end":100000}]}')),
        F.lit(None).cast("string"),
        F.concat(F.lit('{"output":[{"type":"reasoning"},{"type":"message","content":[{"type":"output_text","text":'), quoted, F.lit("}]}]}")),
        F.concat(F.lit('{"choices":[{"message":{"content":'), quoted, F.lit("}}]}")),
    ]
    raw = F.lit(None).cast("string")
    for i, r in enumerate(raws):
        raw = F.when(F.col("ln") % 10 == i, r).otherwise(raw)
    judged = proxy.text_lines(spark, d).select("document_id", "ln", transcribe.validated(transcribe.message_text(raw)).alias("r"))
    r = F.col("r")
    return judged.select("document_id", "ln", F.length(r["text"]).alias("n_text"), r["confidence"].alias("confidence"), F.size(r["uncertainty"]).alias("n_ranges"), r["validation_state"].alias("validation_state"), r["review_state"].alias("review_state"), r["review_reason"].alias("review_reason"))


def confidence_class(spark, d):
    return review.with_class(proxy.ocr_results(spark, d)).select("document_id", "ln", "confidence", "review_class")


def review_flags(spark, d):
    return review.flags(proxy.ocr_results(spark, d)).select("document_id", "review_class", "n_lines", "lines")


def ocr_line_join(spark, d):
    results = proxy.ocr_results(spark, d).where("ln % 4 <> 1").withColumn("seq", F.col("ln"))
    again = results.where("ln % 6 = 0").withColumn("text", F.concat("text", F.lit("!"))).withColumn("seq", F.col("seq") + 1000)
    keys = [*PAGE, "ln"]
    last = review.last_of(results.unionByName(again), keys, "seq")
    return review.line_with_ocr(proxy.line_regions(spark, d).select(*keys), last, keys).select("document_id", "ln", "ocr_text", "confidence", "review_class")


def question_orphans(spark, d):
    keys = [*PAGE, "ln"]
    lines = layout.question_lines(proxy.line_regions(spark, d))
    return review.orphans(lines, proxy.ocr_results(spark, d).where("ln % 4 <> 0"), keys).select("document_id", "ln")


def paragraph_text(spark, d):
    return assemble.paragraph_text(layout.paragraph_lines(proxy.line_regions(spark, d))).select("document_id", "paragraph", "text")


def answer_text(spark, d):
    inside = layout.answer_lines(layout.mark_questions(proxy.line_regions(spark, d)))
    return assemble.answer_text(assemble.paragraph_text(layout.paragraph_lines(inside)))


def question_text(spark, d):
    return assemble.question_text(layout.question_lines(proxy.line_regions(spark, d)))


def _names(spark, d):
    return proxy.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.format_string("scans/%s/doc_%03d.png", "source", "doc_id").alias("path"))


def review_export(spark, d):
    inside = layout.answer_lines(layout.mark_questions(proxy.line_regions(spark, d)))
    return assemble.review_export(question_text(spark, d), assemble.paragraph_text(layout.paragraph_lines(inside)), _names(spark, d))


def overlay_layers(spark, d):
    lines = proxy.line_regions(spark, d)
    marked = layout.mark_questions(lines)
    layers = {"question": layout.question_boxes(marked), "answer": layout.answers(marked), "paragraph": layout.paragraphs(lines), "line": lines.withColumn("id", F.format_string("l%03d", "ln"))}
    return review.overlay(layers, ("question", "answer", "line")).select("document_id", "layer", "id", "x", "y", "w", "h")


def nested_documents(spark, d):
    """The tree's JSON, and how many of each level it holds."""
    lines = layout.paragraph_lines(proxy.line_regions(spark, d))
    tree = assemble.nested(layout.paragraphs(proxy.line_regions(spark, d)), lines)
    paragraphs = F.flatten(F.transform("pages", lambda p: p["paragraphs"]))
    first = F.element_at(F.element_at(paragraphs, 1)["lines"], 1)
    n = F.aggregate(F.transform(paragraphs, lambda p: F.size(p["lines"])), F.lit(0), lambda a, b: a + b)
    return tree.select("document_id", F.size("pages").alias("n_pages"), F.size(paragraphs).alias("n_paragraphs"), n.alias("n_lines"), first["text"].alias("first_text"))


def state_violations(spark, d):
    return review.violations(proxy.state_log(spark, d), F.to_date("ts"))


def current_state(spark, d):
    return review.current_state(proxy.state_log(spark, d))


def stage_reached(spark, d):
    return review.stages(proxy.state_log(spark, d))


def states_seen(spark, d):
    """How often each of the states occurs in the log; states that don't occur, too."""
    n = proxy.state_log(spark, d).groupBy("state").agg(F.count("*").alias("n"))
    return states(spark).join(n, "state", "left").select("ordinal", "state", "label", "next_state", F.coalesce("n", F.lit(0)).alias("n"))


def ocr_progress(spark, d):
    return review.progress(proxy.line_regions(spark, d)).select("document_id", "ln", "completed", "total")


def format_scan(spark, d):
    """The given pages' addresses as paths of files: those of a format that is taken with its kind, the others with the reason why they aren't."""
    path = F.regexp_replace(F.col("url"), r"[?#].*$", "").alias("path")
    taken, refused = images.classified(proxy.read(spark, d, "pages").select(path))
    none = F.lit(None).cast("string")
    return taken.select("path", "kind", none.alias("reason")).unionByName(refused.select("path", none.alias("kind"), "reason"))


def redacted_log(spark, d):
    return proxy.read(spark, d, "documents").select("doc_id", X.redacted(F.col("text")).alias("logged"))


def stripped_text(spark, d):
    padded = F.concat(F.lit("  \t"), "text", F.lit("  \n"))
    return proxy.text_lines(spark, d).select("document_id", "ln", X.strip(padded).alias("text"))


def markup_counts(spark, d):
    """Tags in transcriptions, here put around every third line; text itself passes untouched."""
    tagged = F.when(F.col("ln") % 3 == 0, F.concat(F.lit("<caret><strikethrough>"), "text", F.lit("</strikethrough></caret> [illegible]"))).otherwise(F.col("text"))
    t = proxy.text_lines(spark, d).withColumn("tagged", tagged)
    marks = {"strikes": "<strikethrough>", "carets": "<caret>", "illegible": r"\[illegible\]"}
    return t.groupBy("document_id").agg(*(F.sum(F.regexp_count("tagged", F.lit(p))).alias(name) for name, p in marks.items()))


def new_document_ids(spark, d):
    """Ids for every tenth document, as a new one, after the highest that the others have in use."""
    docs = proxy.read(spark, d, "documents")
    taken = docs.where("doc_id % 10 <> 3").select(F.format_string("doc_%03d", F.col("doc_id") + 5).alias("document_id"))
    found = docs.where("doc_id % 10 = 3").select("doc_id", F.format_string("scans/%s/%d.png", "source", "doc_id").alias("path"))
    return images.numbered(found, taken).select("doc_id", "path", "document_id")


def state_advance(spark, d):
    """Steps asked for by a log's later events, the state of most being the one that follows; which are taken, which refused."""
    log = proxy.state_log(spark, d)
    asked = proxy.read(spark, d, "events").where("event_id % 2 = 1")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kinds = F.array(*map(F.lit, STATES))
    then = log.where("event_id % 2 = 0").groupBy("document_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("now"))
    after = F.array_position(kinds, F.col("now")) - 1 + F.col("k") + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    asked = asked.select(F.col("user_id").alias("document_id"), "ts", "event_id", order.alias("k")).join(then, "document_id")
    asked = asked.select("document_id", "ts", "event_id", F.element_at(kinds, (after % len(STATES) + 1).cast("int")).alias("state"))
    return review.judged_steps(log.where("event_id % 2 = 0"), asked).select("document_id", "event_id", "state", "cur", "allowed", "accepted")


def json_round_trip(spark, d):
    """Results written as sparse JSON and read again."""
    rows = proxy.ocr_results(spark, d).select("document_id", "ln", F.when(F.length("text") > 0, F.col("text")).alias("text"), F.when(F.col("confidence") > 0.05, F.col("confidence")).alias("confidence"), "uncertainty")
    schema = rows.drop("document_id", "ln").schema
    read = assemble.from_sparse_json(assemble.sparse_json(rows, "document_id", "ln"), schema, "document_id", "ln")
    return read.select("document_id", "ln", "text", "confidence", F.size("uncertainty").alias("n_ranges"), F.get("uncertainty", F.lit(0))["end"].alias("first_end"))


def line_density(spark, d):
    """Ink in each line's box by the area of the box, from the runs of ink on its rows of pixels."""
    lines = proxy.line_regions(spark, d)
    found = ink.line_density(proxy.ink_runs(spark, d), lines)
    return found.select("document_id", "ln", F.round("density", 9).alias("density"))


def ink_profile(spark, d):
    """Ink of each row of pixels, from the runs of ink on it."""
    return segment.row_profile(proxy.ink_runs(spark, d), "height")


def drawn_lines(spark, d):
    """Lines found again in the rows of ink; those nearer than the gap are one."""
    rule = segment.Segment(min_row_ink=1, line_gap=3, min_line_ink=1)
    return segment.segment_lines(ink_profile(spark, d), rule, F.col("height")).select("document_id", "line_no", "x", "y", "w", "h", "ink_area")


def ruled_bands(spark, d):
    """Rows that long runs of ink cross, put together to bands."""
    return segment.merge_bands(ink.rule_bands(proxy.ink_runs(spark, d)), 8).select("document_id", "band", "start", "end")


def unruled_ink(spark, d):
    """Ink by row of pixels without the runs that are long, and a row more on both sides."""
    runs_ = proxy.ink_runs(spark, d).withColumn("width", F.lit(1 << 20))
    return segment.row_profile(ink.without_rules(runs_)).select("document_id", "y", "row_ink", "x_min", "x_max")


def highlight_boxes(spark, d):
    """Marks found again in their rows of pixels, those that touch as one."""
    return ink.highlights(proxy.yellow_runs(spark, d))


def margin_lines(spark, d):
    """Tall columns of ink, which are no writing, by where they start and end: how many columns, and the first and last of them."""
    found = ink.tall_runs(proxy.margin_runs(spark, d)).groupBy("document_id", "first", "last")
    return found.agg(F.sum(F.col("x_end") - F.col("x")).alias("n_columns"), F.min("x").alias("x_min"), F.max(F.col("x_end") - 1).alias("x_max"))


def line_columns(spark, d):
    """Ink of each line by columns of pixels, neighbours of the same ink as one row."""
    return ink.line_columns(proxy.ink_runs(spark, d), proxy.line_regions(spark, d)).select("document_id", "ln", "x", "x_end", "col_ink")


def cleaned_marks(spark, d):
    """Blots after small gaps are filled and small specks are gone, as runs."""
    return ink.cleaned(proxy.specks(spark, d), 5).select("document_id", "y", "x_start", "x_end")


def highlight_outlines(spark, d):
    """Corners of each mark's outline, and the area that they enclose."""
    corners = ink.outlines(proxy.yellow_runs(spark, d), HighlightRule(polygon_off=0.0))
    ring = F.sort_array(F.collect_list(F.struct("point", "x", "y")))
    rings = corners.groupBy("document_id", "id").agg(ring.alias("ring")).withColumn("next", F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)))
    # products of a long line's end and a low line's place go beyond an int
    cross = F.zip_with("ring", "next", lambda a, b: a["x"].cast("long") * b["y"] - b["x"].cast("long") * a["y"])
    twice = F.aggregate(cross, F.lit(0).cast("long"), lambda a, b: a + b)
    return rings.select("document_id", "id", F.size("ring").alias("n_corners"), (F.abs(twice) / 2).cast("long").alias("area"))


def _sparse_documents(spark, d):
    """Documents of one page as JSON in which much is left out, as an earlier version may have written them: document_id, json."""
    lines = proxy.line_regions(spark, d)
    name, box = F.format_string("l%03d", "ln"), F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"))
    review_ = F.when(F.col("ln") % 7 == 0, F.struct(name.alias("id"), F.lit("t").alias("targetId"), F.lit("low_confidence").alias("trigger"), F.col("ln").alias("latencyMs")))
    unsure = F.when(F.col("ln") % 5 == 0, F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.when(F.col("ln") % 2 == 0, "faint").alias("reason"))))
    state = F.when(F.col("ln") % 4 == 1, "repaired")
    ocr = F.struct("ln", F.struct(name.alias("cropId"), "text", F.lit(0.5).alias("confidence"), F.lit("m").alias("model"), review_.alias("llmReview"), unsure.alias("uncertainty"), state.alias("validationState")).alias("r"))
    own = F.struct("ln", F.struct(name.alias("id"), box.alias("bbox"), name.alias("cropId"), F.when(F.col("ln") % 3 > 0, F.col("text")).alias("text")).alias("r"))
    listed = lines.groupBy("document_id").agg(F.sort_array(F.collect_list(ocr)).alias("ocr"), F.sort_array(F.collect_list(own)).alias("own"))
    plain = lambda c: F.transform(c, lambda x: x["r"])
    none = F.struct(*(F.lit(0).alias(c) for c in ("x", "y", "width", "height")))
    paragraph = F.struct(F.lit("p001").alias("id"), F.lit(1).alias("pageNumber"), F.lit(1).alias("order"), none.alias("bbox"), F.lit("c").alias("cropPath"), plain("own").alias("lines"))
    question = F.when(F.col("document_id") % 3 == 0, F.struct(F.lit("q001").alias("id"), none.alias("bbox"), F.lit("c").alias("cropPath")))
    marks = F.when(F.col("document_id") % 2 == 0, F.array(F.struct(F.lit("highlight_001").alias("id"))))
    image = F.struct(F.lit(1).alias("pageNumber"), F.lit("p.png").alias("path"), F.lit(100).alias("width"), F.lit(200).alias("height"), F.lit(150).alias("dpi"))
    page = F.struct(F.lit(1).alias("pageNumber"), image.alias("image"), question.alias("question"), F.struct(none.alias("bbox"), F.array(paragraph).alias("paragraphs")).alias("answer"), marks.alias("highlights"), plain("ocr").alias("ocr"))
    source = F.struct(F.lit("image").alias("type"), F.lit("a.png").alias("originalPath"))
    whole = F.struct(F.col("document_id").cast("string").alias("documentId"), source.alias("source"), F.when(F.col("document_id") % 5 == 0, "APPROVED").alias("state"), F.array(page).alias("pages"))
    return listed.select("document_id", F.to_json(whole).alias("json"))


def document_trees(spark, d):
    """Documents read from JSON that leaves much out, with the defaults of every depth, written, and read again."""
    found, _ = tree.documents(_sparse_documents(spark, d))
    again = found.select("document_id", F.col("document").alias("first"), tree.written(F.col("document")).alias("json"))
    t, page = F.col("document"), F.col("document.pages")[0]
    said = page["ocr"]
    unsure = F.flatten(F.transform(said, lambda r: r["uncertainty"]))
    reviews = F.filter(F.transform(said, lambda r: r["llmReview"]), lambda r: r.isNotNull())
    lines = page["answer"]["paragraphs"][0]["lines"]
    return tree.documents(again)[0].select(
        "document_id", t["state"].alias("state"), F.size("document.pages").alias("n_pages"), F.size("document.llmReviews").alias("n_reviews_of_all"), t["final"]["answer"].alias("final_answer"),
        page["question"]["text"].alias("question_text"), F.size(page["question"]["lines"]).alias("question_lines"), F.get(page["highlights"]["type"], F.lit(0)).alias("mark_type"), F.size(page["crops"]).alias("n_crops"),
        F.size(said).alias("n_ocr"), F.size(F.filter(said, lambda r: r["validationState"] == "valid")).alias("n_valid"), F.size(F.filter(said, lambda r: r["reviewState"] == "pending")).alias("n_pending"),
        F.size(unsure).alias("n_unsure"), F.size(F.filter(unsure, lambda r: r["reason"] == "")).alias("n_without_reason"),
        F.size(reviews).alias("n_reviews"), F.size(F.filter(reviews, lambda r: (r["model"] == "") & ~r["applied"])).alias("n_plain_reviews"), F.aggregate(reviews, F.lit(0), lambda a, r: a + r["latencyMs"]).alias("latency"),
        F.size(F.filter(lines, lambda x: x["text"] == "")).alias("n_without_text"), (tree.written(F.col("first")) == tree.written(t)).alias("same"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        page_paragraphs, paragraph_scores, question_groups_spatial, question_groups_text, answer_region, answer_lines, row_islands, row_islands_tail, band_merge,
        word_islands, line_to_paragraph, line_to_question, enclosing_band, crop_hierarchy, crop_paths, new_crops, clamped_crops, cache_keys, cache_hits, cache_misses, call_cap, crop_created, state_advance, json_round_trip, ruled_bands, unruled_ink,
        uncertainty_repair, validate_response, confidence_class, review_flags, ocr_line_join, question_orphans, paragraph_text, answer_text, question_text,
        review_export, overlay_layers, nested_documents, state_violations, current_state, stage_reached, states_seen, ocr_progress, format_scan, redacted_log,
        stripped_text, markup_counts, new_document_ids, line_density, ink_profile, drawn_lines, highlight_boxes, margin_lines, line_columns, cleaned_marks, highlight_outlines, document_trees,
    )
}
