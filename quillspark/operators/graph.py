"""Components of graphs whose edges are rows."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """df as files of the folder in spark.checkpoint.dir, which all executors share; on local[n] a temporary one where none is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if at is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        context.setCheckpointDir(at)
    return df.checkpoint(eager=True)


def _unsettled(edges: DataFrame, key: list[str]) -> bool:
    """Does any node hang on two others, or on one that hangs on another itself?"""
    ends = edges.select(*key, F.col("a").alias("v"), F.lit(0).alias("below")).unionByName(edges.select(*key, F.col("b").alias("v"), F.lit(1).alias("below")))
    return bool(ends.groupBy(*key, "v").agg(F.sum("below").alias("n"), F.max(1 - F.col("below")).alias("up")).where("n > 1 or n = 1 and up = 1").limit(1).count())


def least_of(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, node, root: for each node of the edges (by, a, b) the least node that it hangs together with, within the same `by`.

    Each round hangs the nodes' neighbours on their least one, first those above a node and then those below it, until every node hangs on its root; the number of rounds grows with
    the logarithm of the longest way. A round is a grouping and a join of the edges that are left, of which there are never more than at first, and is written down.
    """
    key = list(by)
    now = written(edges.where("a <> b").select(*key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while _unsettled(now, key):
        both = now.unionByName(now.select(*key, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*key, "a").agg(F.least("a", F.min("b")).alias("m"))
        above = both.where("b > a").join(least, [*key, "a"]).select(*key, F.col("m").alias("a"), "b").where("a <> b").distinct()
        lower = above.groupBy(*key, "b").agg(F.min("a").alias("m"))
        hung = above.join(lower, [*key, "b"])
        moved = hung.select(*key, F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").unionByName(hung.select(*key, F.col("m").alias("a"), "b"))
        now = written(moved.distinct())
    roots = now.select(*key, F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(now.select(*key, F.col("a").alias("node"), F.col("a").alias("root")).distinct())
