"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. On local[n] a temporary one where none is set; a cluster without one is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at is None:
        at = spark.sparkContext.getCheckpointDir()
    if at is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def durable(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that a lost executor costs no more than the stage it ran.

    Spark removes the files once nothing refers to them (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files that nothing refers to any more. It does so after the driver's JVM has collected garbage, which a driver with memory to spare puts off
    while files pile up on the executors' disks; so jobs of many steps call this between them."""
    gc.collect()
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_of(column: str = "text"):
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that none of df's columns has, in upper or lower case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while (name := f"_{name}").lower() in taken:
            pass
        out.append(name)
    return out


def split_words(folded: bytes, most: int = 4 << 20) -> Iterator[list[bytes]]:
    """Words of a text whose other bytes are spaces, in lists from slices of about `most` bytes, so that a very long text makes few objects at once."""
    at = 0
    while len(folded) - at > most:
        end = folded.rfind(b" ", at, at + most) + 1 or folded.find(b" ", at + most) + 1 or len(folded)
        yield folded[at:end].split()
        at = end
    yield folded[at:].split()
