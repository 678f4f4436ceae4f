"""Types of the engine's tables and the document states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PAGE = ["document_id", "page_number"]

BOX = T.StructType([T.StructField(n, T.IntegerType()) for n in ("x", "y", "width", "height")])
UNCERTAINTY = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("reason", T.StringType())]))
OCR_RESULT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("uncertainty", UNCERTAINTY),
        T.StructField("validation_state", T.StringType()),
        T.StructField("review_state", T.StringType()),
        T.StructField("review_reason", T.StringType()),
    ]
)
CROP_TYPES = ("question", "answer", "paragraph", "line", "word")

#: The states of a document, in order.
STATES = ("UPLOADED", "NORMALIZED", "QUESTION_DETECTED", "ANSWER_DETECTED", "PARAGRAPHS_DETECTED", "CROPS_GENERATED", "OCR_PROCESSING", "MARKUP_RECONSTRUCTION", "REVIEW_REQUIRED", "APPROVED", "EXPORTED")
#: Each state leads to the next; review may also lead to itself.
EDGES = (*zip(STATES, STATES[1:]), ("REVIEW_REQUIRED", "REVIEW_REQUIRED"))


def states(spark: SparkSession) -> DataFrame:
    """(ordinal, state, label, next_state), one row for each of the 11 states."""
    rows = [(i, s, s.replace("_", " "), STATES[i + 1] if i + 1 < len(STATES) else None) for i, s in enumerate(STATES)]
    return spark.createDataFrame(rows, "ordinal int, state string, label string, next_state string")


def transitions(spark: SparkSession) -> DataFrame:
    """(cur, nxt), the allowed steps."""
    return spark.createDataFrame(list(EDGES), "cur string, nxt string")
