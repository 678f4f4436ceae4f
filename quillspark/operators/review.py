"""Review routing, the document's states, and the joins that the review screen needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, Review
from ..functions.expressions import confidence_class
from ..schema import PAGE, STATES, states, transitions
from .crops import append_new, exists, not_yet

LAYERS = ("question", "answer", "paragraph", "line", "highlight")


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def with_class(results: DataFrame, rule: Review = CONFIG.review) -> DataFrame:
    return results.withColumn("review_class", confidence_class(F.col("confidence"), rule))


def flags(results: DataFrame, order: str = "ln") -> DataFrame:
    """page, review_class, n_lines, lines: the lines of each class in document order."""
    listed = F.transform(F.sort_array(F.collect_list(F.col(order))), lambda x: x.cast("string"))
    return with_class(results).groupBy(*PAGE, "review_class").agg(F.count("*").alias("n_lines"), F.array_join(listed, ",").alias("lines"))


def line_with_ocr(lines: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with the last result of theirs, or none: text falls back to empty."""
    r = results.select(*keys, F.col("text").alias("ocr_text"), "confidence")
    joined = lines.join(r, keys, "left").withColumn("ocr_text", F.coalesce("ocr_text", F.lit("")))
    return joined.withColumn("review_class", F.when(F.col("confidence").isNotNull(), confidence_class(F.col("confidence"))))


def orphans(lines: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that must have a result and have none."""
    return lines.join(results, keys, "left_anti")


def overlay(layers: dict[str, DataFrame], shown: tuple[str, ...] = LAYERS) -> DataFrame:
    """Boxes of the layers shown: page, layer, id, x, y, w, h. Boxes without a place are left out."""
    out = None
    for name in LAYERS:
        if name in layers and name in shown:
            one = layers[name].where("x is not null").select(*PAGE, F.lit(name).alias("layer"), "id", "x", "y", "w", "h")
            out = one if out is None else out.unionByName(one)
    return out


def with_state_before(log: DataFrame, span: Column | None = None) -> DataFrame:
    """log with cur, the state before each step (null for a document's first). With a span, such as the day of ts, a document's log may be too long for one task: steps look back
    within their span, and the first of a span takes the last state of the span before."""
    if span is None:
        return log.withColumn("cur", F.lag("state").over(Window.partitionBy("document_id").orderBy("ts", "event_id")))
    log = log.withColumn("_span", span)
    own = F.lag("state").over(Window.partitionBy("document_id", "_span").orderBy("ts", "event_id"))
    lasts = log.groupBy("document_id", "_span").agg(F.max_by("state", F.struct("ts", "event_id")).alias("_last"))
    before = lasts.select("document_id", "_span", F.lag("_last").over(Window.partitionBy("document_id").orderBy("_span")).alias("_before"))
    return log.withColumn("_own", own).join(before, ["document_id", "_span"]).withColumn("cur", F.coalesce("_own", "_before")).drop("_span", "_own", "_before")


def violations(log: DataFrame, span: Column | None = None) -> DataFrame:
    """Steps of documents that are not allowed: document_id, event_id, cur, nxt, allowed. log: document_id, ts, event_id, state. span as in with_state_before()."""
    spark = log.sparkSession
    steps = with_state_before(log, span).where("cur is not null").select("document_id", "event_id", "cur", F.col("state").alias("nxt"))
    allowed = transitions(spark).groupBy("cur").agg(F.array_join(F.sort_array(F.collect_list("nxt")), ",").alias("allowed"))
    wrong = steps.join(F.broadcast(transitions(spark)), ["cur", "nxt"], "left_anti")
    return wrong.join(F.broadcast(allowed), "cur", "left").select("document_id", "event_id", "cur", "nxt", F.coalesce("allowed", F.lit("")).alias("allowed"))


def judged_steps(log: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (document_id, ts, event_id, state) with cur, allowed (names joined by commas) and accepted.

    A document's steps count in their order, the first of them from its last state in the log, or as its beginning if it has none. From the first step on that is
    not allowed none is accepted: what came after it rests on it.
    """
    spark, own = log.sparkSession, Window.partitionBy("document_id").orderBy("ts", "event_id")
    now = log.groupBy("document_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("now"))
    steps = asked.join(now, "document_id", "left").withColumn("cur", F.coalesce(F.lag("state").over(own), "now")).drop("now")
    edges = transitions(spark).groupBy("cur").agg(F.array_sort(F.collect_set("nxt")).alias("to"))
    steps = steps.join(F.broadcast(edges), "cur", "left").withColumn("to", F.when(F.col("cur").isNull(), F.array(F.lit(STATES[0]))).otherwise(F.coalesce("to", F.array().cast("array<string>"))))
    fits = F.array_contains("to", F.col("state")).cast("int")
    accepted = F.min(fits).over(own.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return steps.select("document_id", "ts", "event_id", "state", "cur", F.array_join("to", ",").alias("allowed"), accepted.alias("accepted"))


def advance(asked: DataFrame, path: str) -> DataFrame:
    """Append the steps that are allowed to the state log at path, a table that only grows, and give those that are refused: document_id, ts, event_id, state, cur, allowed.

    Steps that are in the log already are neither appended nor refused, so a call may be repeated.
    """
    spark, keys = asked.sparkSession, ["document_id", "event_id"]
    columns = [*keys, "ts", "state"]
    log = spark.read.parquet(path) if exists(spark, path) else asked.select(*columns).where("false")
    append_new(judged_steps(log, not_yet(asked.select(*columns), log, keys)).where("accepted").select(*columns), path, keys)
    after = spark.read.parquet(path) if exists(spark, path) else log
    # what the log lacks now was refused, and is judged by where its document stands
    return judged_steps(after, not_yet(asked.select(*columns), after, keys)).drop("accepted")


def current_state(log: DataFrame) -> DataFrame:
    """The last state of each document, its label and the state that follows; partial aggregates, no sort."""
    at = F.max_by("state", F.struct("ts", "event_id"))
    now = log.groupBy("document_id").agg(at.alias("state"), F.count("*").alias("n_steps"))
    return now.join(F.broadcast(states(log.sparkSession)), "state").select("document_id", "state", "ordinal", "label", "next_state", "n_steps")


def stages(log: DataFrame) -> DataFrame:
    """For each document and state whether it is reached: its place is not after that of the current one."""
    now = current_state(log).select("document_id", F.col("ordinal").alias("now"))
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("ordinal")) for i in range(11)]))
    listed = now.withColumn("s", every).select("document_id", "now", F.col("s.ordinal").alias("ordinal"))
    return listed.join(F.broadcast(states(log.sparkSession)), "ordinal").select("document_id", "ordinal", "label", (F.col("ordinal") <= F.col("now")).alias("reached"))


def progress(lines: DataFrame, order: str = "ln") -> DataFrame:
    """Each line of a page with how many are done and how many there are."""
    w = Window.partitionBy(*PAGE)
    return lines.select(*PAGE, order, F.row_number().over(w.orderBy(order)).alias("completed"), F.count("*").over(w).alias("total"))
