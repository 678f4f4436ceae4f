"""Crops and their hierarchy. Lines meet regions by bands of pixels and ruled bands by position, so no line meets all of a page."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import midpoint, ordinal_id
from ..schema import PAGE

KEY = [*PAGE, "type", "id"]
#: Pixels of a page that lines and regions are put together by.
BIN = 256


def lines_of(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines whose vertical middle lies in a region, edges included; numbered within it. regions: page, id, y, h.

    A region stands in each bin of BIN pixels that it reaches, a line in that of its middle, so they meet by equality and a line meets what is near it.
    """
    middle = midpoint(F.col("y"), F.col("h"))
    r = regions.select(*PAGE, F.col("id").alias("parent_id"), F.col("y").alias("ry"), (F.col("y") + F.col("h")).alias("re"))
    r = r.withColumn("bin", F.explode(F.sequence(F.floor(F.col("ry") / BIN), F.floor(F.col("re") / BIN))))
    met = lines.withColumn("bin", F.floor(middle / BIN)).join(r, [*PAGE, "bin"])
    inside = met.where(middle.between(F.col("ry"), F.col("re"))).drop("ry", "re", "bin")
    number = F.row_number().over(Window.partitionBy(*PAGE, "parent_id").orderBy("y", "x", "ln"))
    return inside.withColumn("number", number).withColumn("id", ordinal_id(F.concat("parent_id", F.lit("_line")), F.col("number")))


def to_bands(lines: DataFrame, bands: DataFrame, page_height: Column | int) -> DataFrame:
    """Line boxes grown to the ruled band around them: the nearest band that ends above the middle and the nearest that starts below.

    bands: page, start, end. page_height may be a column of lines. Lines of pages without bands stay as they are; boxes only grow. Lines and the edges of bands are put in
    one order, in which each line sees the last edge before it: two windows on the page.
    """
    own = lines.select(*PAGE, "ln", "x", "y", "w", "h", (page_height if isinstance(page_height, Column) else F.lit(page_height)).alias("page_height"), midpoint(F.col("y"), F.col("h")).alias("at"))
    edges = bands.select(*PAGE, F.explode(F.array(F.struct(F.col("end").alias("upper"), F.lit(None).cast("long").alias("lower")), F.struct(F.lit(None).cast("long").alias("upper"), F.col("start").alias("lower")))).alias("e"))
    edges = edges.select(*PAGE, "e.upper", "e.lower", F.coalesce("e.upper", "e.lower").cast("double").alias("at"))
    both = own.withColumn("line", F.lit(True)).unionByName(edges, allowMissingColumns=True)
    # a line comes before an edge at the same place, whichever way the page is read
    first, whole = F.col("line").isNull(), Window.partitionBy(*PAGE)
    down = whole.orderBy("at", first).rowsBetween(Window.unboundedPreceding, 0)
    up = whole.orderBy(F.desc("at"), first).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumns({"upper": F.last("upper", ignorenulls=True).over(down), "lower": F.last("lower", ignorenulls=True).over(up)}).where("line")
    bottom = F.col("y") + F.col("h")
    top = F.greatest(F.lit(0), F.least(F.coalesce(F.col("upper") + 1, F.col("y")), F.col("y"))).cast("int")
    end = F.least(F.col("page_height"), F.greatest(F.coalesce(F.col("lower"), bottom), bottom)).cast("int")
    return near.select(*PAGE, "ln", "x", top.alias("y"), "w", (end - top).alias("h"))


def with_page_size(boxes: DataFrame) -> DataFrame:
    """boxes with the width and height that their page has at least."""
    page = Window.partitionBy(*PAGE)
    return boxes.withColumns({"page_width": F.max(F.col("x") + F.col("w")).over(page), "page_height": F.max(F.col("y") + F.col("h")).over(page)})


def clamped(boxes: DataFrame, width: Column | int, height: Column | int) -> DataFrame:
    """Boxes cut to the page, whose size may stand in columns."""
    width, height = (x if isinstance(x, Column) else F.lit(x) for x in (width, height))
    x0, y0 = F.greatest(F.lit(0), "x"), F.greatest(F.lit(0), "y")
    x1, y1 = F.least(width, F.col("x") + F.col("w")), F.least(height, F.col("y") + F.col("h"))
    return boxes.withColumns({"x": x0, "y": y0, "w": F.greatest(F.lit(0), x1 - x0), "h": F.greatest(F.lit(0), y1 - y0)})


def family(regions: DataFrame, lines: DataFrame, words: DataFrame, kind: str = "paragraph") -> DataFrame:
    """page, type, id, parent_id, parent_type, grandparent_id, grandparent_type of regions, their lines and the lines' words, in one pass: each crop is
    made from its parent, so it knows it. regions: page, id. lines: those of lines_of(). words: page, ln, word_no."""
    none = F.lit(None).cast("string")
    own = lines.select(*PAGE, "ln", F.col("id").alias("line_id"), "parent_id")
    named = words.join(own, [*PAGE, "ln"]).withColumn("id", ordinal_id(F.concat("line_id", F.lit("_word")), F.col("word_no"), 2))

    def rows(df: DataFrame, what: str, parent: Column, parent_type: Column, grandparent: Column, grandparent_type: Column) -> DataFrame:
        return df.select(*PAGE, F.lit(what).alias("type"), "id", parent.alias("parent_id"), parent_type.alias("parent_type"), grandparent.alias("grandparent_id"), grandparent_type.alias("grandparent_type"))

    return (
        rows(regions, kind, none, none, none, none)
        .unionByName(rows(lines, "line", F.col("parent_id"), F.lit(kind), none, none))
        .unionByName(rows(named, "word", F.col("line_id"), F.lit("line"), F.col("parent_id"), F.lit(kind)))
    )


def hierarchy(crops: DataFrame) -> DataFrame:
    """Each crop of a table with its parent's and grandparent's id and type, within the page. The depth is fixed, so two joins do; words, which are most, are no parents."""
    parents = crops.where("type <> 'word'")
    up = parents.select(*PAGE, F.col("id").alias("parent_id"), F.col("type").alias("parent_type"), F.col("parent_id").alias("grandparent_id"))
    top = parents.where("type <> 'line'").select(*PAGE, F.col("id").alias("grandparent_id"), F.col("type").alias("grandparent_type"))
    return crops.join(up, [*PAGE, "parent_id"], "left").join(top, [*PAGE, "grandparent_id"], "left")


def with_paths(crops: DataFrame) -> DataFrame:
    """Crops with their place under the document's folder."""
    folder = F.concat(F.lit("crops/"), F.col("type"), F.lit("s/"), ordinal_id(F.lit("page_"), F.col("page_number")), F.lit("/"))
    return crops.withColumn("path", F.concat(folder, F.col("id"), F.lit(".png")))


def not_yet(crops: DataFrame, existing: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Rows that are not written yet: the table only ever grows."""
    return crops.join(existing.select(*keys), keys, "left_anti")


def path_of(wanted: DataFrame, crops: DataFrame) -> DataFrame:
    """wanted (page, type, id) with the path that the table of crops has under the whole key, or none."""
    return wanted.join(crops.select(*KEY, "path"), KEY, "left")


def created(crops: DataFrame, existing: DataFrame, now: Column | None = None) -> DataFrame:
    """crops with created_at: that of the table for those that are there already, now for the others."""
    known = existing.select(*KEY, F.col("created_at").alias("_then"))
    return crops.join(known, KEY, "left").withColumn("created_at", F.coalesce("_then", now if now is not None else F.current_timestamp())).drop("_then")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def append_new(crops: DataFrame, path: str, keys: list[str] = KEY) -> int:
    """Append the rows whose keys the table at path lacks, for crops, results, responses and states alike. Returns how many were new.

    A second call with the same rows appends nothing. The new rows are written beside the table first, so what is counted is what is appended, whatever executors are lost
    meanwhile. One writer at a time: the files of a table have no lock.
    """
    spark = crops.sparkSession
    fresh = crops.dropDuplicates(keys)
    if exists(spark, path):
        fresh = not_yet(fresh, spark.read.parquet(path), keys)
    aside = f"{path.rstrip('/')}_new_{uuid4().hex}"
    try:
        fresh.write.parquet(aside)
        made = spark.read.schema(fresh.schema).parquet(aside)
        if n := made.count():
            made.write.mode("append").parquet(path)
        return n
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(aside)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
