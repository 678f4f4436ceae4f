"""Ink as runs: (page, y, x_start, x_end), the end exclusive, runs of a row apart from each other.

Runs are what pixels become before anything else is done with them; rules, projections, densities and marks are joins, groupings and
windows on them, keyed by the page and mostly by the row of pixels, so that a large page is spread over tasks like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..config import CONFIG, HighlightRule, Segment
from ..schema import PAGE
from .graph import least_of, written
from .segment import runs

ROW = [*PAGE, "y"]


def long_runs(ink: DataFrame, rule: Segment = CONFIG.segment) -> DataFrame:
    """The runs that are pieces of a ruled line."""
    return ink.where(F.col("x_end") - F.col("x_start") >= rule.rule_kernel_width)


def rule_bands(ink: DataFrame, rule: Segment = CONFIG.segment) -> DataFrame:
    """page, start, end of the rows that a ruled line crosses, one row of pixels more on both sides; broken lines are put together by merge_bands()."""
    rows = long_runs(ink, rule).select(*PAGE, F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1)).alias("y")).where("y >= 0").distinct()
    return runs(rows, PAGE, "y", 0).select(*PAGE, F.col("first").alias("start"), F.col("last").alias("end"))


def _depths(marks: DataFrame, by: list[str]) -> DataFrame:
    """by, x, x_end, n: stretches between neighbouring edges and how many of the intervals (by, x_start, x_end) cover them, by a running sum of starts less ends."""
    edge = F.explode(F.array(F.struct(F.col("x_start").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x_end").alias("x"), F.lit(-1).alias("d")))).alias("edge")
    turns = marks.select(*by, edge).groupBy(*by, "edge.x").agg(F.sum("edge.d").alias("d")).where("d <> 0")
    w = Window.partitionBy(*by).orderBy("x")
    return turns.select(*by, "x", F.lead("x").over(w).alias("x_end"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n")).where("n > 0")


def tall_runs(ink: DataFrame, rule: Segment = CONFIG.segment) -> DataFrame:
    """page, x, x_end, first, last of the columns of pixels that are pieces of a margin line, the end exclusive; columns that start and end in the same rows are one where they are met together.

    A run of so many rows covers a whole block of half as many. So a sweep over each block's edges finds the columns that are inked in all of its rows,
    which are few; only ink in those columns is followed from row to row, cut where one of its edges lies in them. No pixel has a row of its own.
    """
    least = rule.margin_kernel_height
    height = (least + 1) // 2
    blocks = ink.withColumn("_block", F.floor(F.col("y") / height))
    full = _depths(blocks, [*PAGE, "_block"]).where(F.col("n") == height).select(*PAGE, "x", "x_end").distinct()
    w = Window.partitionBy(*PAGE).orderBy("x", "x_end")
    apart = F.col("x") > F.max("x_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    strips = full.withColumn("strip", F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    strips = strips.groupBy(*PAGE, "strip").agg(F.min("x").alias("s"), F.max("x_end").alias("e"))
    # as many as a page is wide at most, mostly a few
    listed = strips.groupBy(*PAGE).agg(F.collect_list(F.struct("strip", "s", "e")).alias("strips"))
    met = F.filter("strips", lambda t: (t["s"] < F.col("x_end")) & (t["e"] > F.col("x_start")))
    inside = ink.join(listed, PAGE).select(*ROW, "x_start", "x_end", F.explode(met).alias("t"))
    inside = inside.select(*ROW, "t.strip", F.greatest("x_start", "t.s").alias("s"), F.least("x_end", "t.e").alias("e"))
    edges = inside.select(*PAGE, "strip", F.explode(F.array("s", "e")).alias("x")).distinct()
    cells = edges.select(*PAGE, "strip", "x", F.lead("x").over(Window.partitionBy(*PAGE, "strip").orderBy("x")).alias("until")).where("until is not null")
    cells = cells.groupBy(*PAGE, "strip").agg(F.collect_list(F.struct("x", "until")).alias("cells"))
    own = F.filter("cells", lambda c: (c["x"] >= F.col("s")) & (c["until"] <= F.col("e")))
    rows = inside.join(cells, [*PAGE, "strip"]).select(*ROW, F.explode(own).alias("c")).select(*ROW, F.col("c.x").alias("x"), F.col("c.until").alias("x_end"))
    return runs(rows, [*PAGE, "x", "x_end"], "y", 0).where(F.col("last") - F.col("first") + 1 >= least).drop("island")


def less(ink: DataFrame, cuts: DataFrame) -> DataFrame:
    """Runs without the parts that cuts (page, y, cut_start, cut_end) cover. A row of pixels has few cuts, since they are long or have to be tall."""
    listed = cuts.groupBy(*ROW).agg(F.sort_array(F.collect_set(F.struct("cut_start", "cut_end"))).alias("cuts"))

    def apart(parts: Column, cut: Column) -> Column:
        two = F.transform(parts, lambda p: F.array(F.struct(p["s"].alias("s"), F.least(p["e"], cut["cut_start"]).alias("e")), F.struct(F.greatest(p["s"], cut["cut_end"]).alias("s"), p["e"].alias("e"))))
        return F.filter(F.flatten(two), lambda p: p["e"] > p["s"])

    whole = F.array(F.struct(F.col("x_start").alias("s"), F.col("x_end").alias("e")))
    none = F.array().cast("array<struct<cut_start:int,cut_end:int>>")
    left = F.aggregate(F.coalesce("cuts", none), whole, apart)
    rest = [c for c in ink.columns if c not in (*ROW, "x_start", "x_end")]
    return ink.join(listed, ROW, "left").select(*ROW, *rest, F.explode(left).alias("part")).select(*ROW, *rest, F.col("part.s").alias("x_start"), F.col("part.e").alias("x_end"))


def without_rules(ink: DataFrame, rule: Segment = CONFIG.segment) -> DataFrame:
    """Ink without ruled and margin lines, each a pixel wider than it is, and without the page's edges. ink: page, height, width, y, x_start, x_end."""
    y = F.explode(F.sequence(F.col("y") - 1, F.col("y") + 1)).alias("y")
    flat = long_runs(ink, rule).select(*PAGE, y, F.col("x_start").alias("cut_start"), F.col("x_end").alias("cut_end"))
    ink = less(ink, flat)
    tall = tall_runs(ink, rule).select(*PAGE, F.explode(F.sequence("first", "last")).alias("y"), (F.col("x") - 1).alias("cut_start"), (F.col("x_end") + 1).alias("cut_end"))
    ink = less(ink, tall)
    inside = (F.col("y") >= rule.crop_top) & (F.col("y") < F.col("height") - rule.crop_bottom)
    edges = {"x_start": F.greatest("x_start", F.lit(rule.crop_left)), "x_end": F.least("x_end", F.col("width") - rule.crop_right)}
    return ink.where(inside).withColumns(edges).where("x_end > x_start")


def in_lines(ink: DataFrame, lines: DataFrame) -> DataFrame:
    """page, ln, lx, width, area, y, x_start, x_end: the runs inside each line's box, cut to it. lines: page, ln, x, y, w, h."""
    x0, y0 = F.greatest(F.lit(0), "x"), F.greatest(F.lit(0), "y")
    box = lines.select(*PAGE, "ln", x0.alias("lx"), y0.alias("ly"), (F.col("x") + F.col("w")).alias("lend"), (F.col("y") + F.col("h")).alias("lbottom")).where("lend > lx and lbottom > ly")
    rows = box.select(*PAGE, "ln", "lx", "lend", ((F.col("lend") - F.col("lx")) * (F.col("lbottom") - F.col("ly"))).alias("area"), F.explode(F.sequence(F.col("ly"), F.col("lbottom") - 1)).alias("y"))
    met = ink.select(*ROW, "x_start", "x_end").join(rows, ROW)
    cut = met.withColumns({"x_start": F.greatest("x_start", "lx"), "x_end": F.least("x_end", "lend")}).where("x_end > x_start")
    return cut.select(*PAGE, "ln", "lx", (F.col("lend") - F.col("lx")).alias("width"), "area", "y", "x_start", "x_end")


def line_columns(ink: DataFrame, lines: DataFrame) -> DataFrame:
    """page, ln, x, x_end, col_ink, width: the columns of each line that have ink, from the line's left edge; neighbours of the same ink are one row, the end inclusive."""
    inside = in_lines(ink, lines).withColumns({"x_start": F.col("x_start") - F.col("lx"), "x_end": F.col("x_end") - F.col("lx")})
    return _depths(inside, [*PAGE, "ln", "width"]).select(*PAGE, "ln", "x", (F.col("x_end") - 1).alias("x_end"), F.col("n").alias("col_ink"), "width")


def tight(words: DataFrame, ink: DataFrame, lines: DataFrame) -> DataFrame:
    """words (page, ln, word_no, x from the line's left edge, w) with y and h of the ink in their columns, x from the page's left edge."""
    inside = in_lines(ink, lines).select(*PAGE, "ln", "lx", "y", (F.col("x_start") - F.col("lx")).alias("s"), (F.col("x_end") - F.col("lx")).alias("e"))
    met = words.join(inside, [*PAGE, "ln"]).where((F.col("s") < F.col("x") + F.col("w")) & (F.col("e") > F.col("x")))
    found = met.groupBy(*PAGE, "ln", "lx", "word_no", "x", "w").agg(F.min("y").alias("y"), (F.max("y") - F.min("y") + 1).alias("h"))
    return found.select(*PAGE, "ln", "word_no", (F.col("x") + F.col("lx")).alias("x"), "y", "w", "h")


def line_density(ink: DataFrame, lines: DataFrame) -> DataFrame:
    """page, ln, density of each line that has ink: its ink by the area of its box, cut at the page's upper left."""
    found = in_lines(ink, lines).groupBy(*PAGE, "ln").agg(F.sum(F.col("x_end") - F.col("x_start")).alias("n"), F.first("area").alias("area"))
    return found.select(*PAGE, "ln", (F.col("n") / F.greatest(F.lit(1), "area")).alias("density"))


def _edge(marked: DataFrame, name: str) -> Column:
    """The page's height or width; far away where the runs don't say."""
    return F.col(name) if name in marked.columns else F.lit(1 << 30)


def _grown(marked: DataFrame, r: int, kept: list[str]) -> DataFrame:
    """Runs of all pixels that are r pixels or fewer from ink, in rows and columns."""
    y = F.explode(F.sequence(F.greatest(F.lit(0), F.col("y") - r), F.least(_edge(marked, "height") - 1, F.col("y") + r))).alias("y")
    sides = F.greatest(F.lit(0), F.col("x_start") - r).alias("x_start"), F.least(_edge(marked, "width"), F.col("x_end") + r).alias("x_end")
    wide = marked.select(*PAGE, *kept, y, *sides)
    w = Window.partitionBy(*PAGE, *kept, "y").orderBy("x_start", "x_end")
    apart = F.col("x_start") > F.max("x_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = wide.withColumn("island", F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*PAGE, *kept, "y", "island").agg(F.min("x_start").alias("x_start"), F.max("x_end").alias("x_end")).drop("island")


def _shrunk(marked: DataFrame, r: int, kept: list[str]) -> DataFrame:
    """Runs of all pixels that have nothing but ink r pixels around them; what lies beyond the page doesn't count. A pixel stays if all the rows around it cover it, which is
    a running sum over the edges of their runs."""
    height, width = _edge(marked, "height"), _edge(marked, "width")
    sides = F.when(F.col("x_start") > 0, F.col("x_start") + r).otherwise(0).alias("x_start"), F.when(F.col("x_end") < width, F.col("x_end") - r).otherwise(F.col("x_end")).alias("x_end")
    thin = marked.select(*PAGE, *kept, "y", *sides).where("x_end > x_start")
    around = thin.select(*PAGE, *kept, "x_start", "x_end", F.explode(F.sequence(F.greatest(F.lit(0), F.col("y") - r), F.least(height - 1, F.col("y") + r))).alias("y"))
    rows = F.least(height - 1, F.col("y") + r) - F.greatest(F.lit(0), F.col("y") - r) + 1
    return _depths(around, [*PAGE, *kept, "y"]).where(F.col("n") == rows).select(*PAGE, *kept, "y", F.col("x").alias("x_start"), "x_end")


#: Rows of pixels of a band that is cleaned by itself.
CLEAN_ROWS = 128


def cleaned(marked: DataFrame, size: int = CONFIG.highlight.cleanup) -> DataFrame:
    """Runs closed and then opened by a square of so many (an odd number of) pixels: small gaps are filled, then small specks go. On runs, a row of pixels at a time, with height and width where
    the runs have them.

    A pixel depends on the rows up to four times half the square from it, so each band of a page's rows, with that many more on both sides, is cleaned by itself: the given runs are shuffled once,
    and none of what they grow to.
    """
    kept, r = [c for c in ("height", "width") if c in marked.columns], size // 2
    if r == 0:
        return marked
    own = F.floor(F.col("y") / CLEAN_ROWS)
    near = F.sequence(F.greatest(F.lit(0), F.floor((F.col("y") - 4 * r) / CLEAN_ROWS)), F.floor((F.col("y") + 4 * r) / CLEAN_ROWS))
    bands = marked.select(*ROW, *kept, "x_start", "x_end", F.explode(near).alias("band"))
    # one column to deal out by, as Spark leaves a key that is a constant, like the page's number may be, out of the windows' keys; by number, or partitions are put together by their size before they grow
    n = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bands = bands.withColumn("part", F.xxhash64(*PAGE, "band")).repartition(n, "part")
    by = [*kept, "band", "part"]
    closed = _shrunk(_grown(bands, r, by), r, by)
    return _grown(_shrunk(closed, r, by), r, by).where(F.col("band") == own).drop("band", "part")


def pieces(marked: DataFrame) -> DataFrame:
    """page, x_start, x_end, y0, y1: runs of the same place in rows below each other as one."""
    same = [*PAGE, "x_start", "x_end"]
    return runs(marked.select(*same, "y").distinct(), same, "y", 0).select(*same, F.col("first").alias("y0"), F.col("last").alias("y1"))


#: Rows and columns of pixels of a tile, and columns of a bin at a border.
TILE_HEIGHT, TILE_WIDTH, BIN = 64, 4096, 64
TILE = [*PAGE, "ty", "tx"]
LABELED = "x_start int, x_end int, y0 int, y1 int, label long"


def _differ(tiles: pa.Table, others: pa.Table) -> np.ndarray:
    """Which rows are of another tile than that of the other table's same row, or of its only one; nulls are equal."""
    out = np.zeros(len(tiles), bool)
    for k in TILE:
        a, b = tiles[k].combine_chunks(), others[k].combine_chunks()
        b = b[0] if len(b) == 1 else b
        out |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return out


def _labels(tiles: pa.Table) -> pa.Table:
    """The pieces of whole tiles (page, ty, tx, sorted by them) with a label: the same for those that touch within a tile, corners too. The tiles are laid side by side, apart from each other, so that
    one pass over a tile's rows of pixels does for all of them."""
    tile = np.cumsum(np.append(False, _differ(tiles.slice(1), tiles.slice(0, len(tiles) - 1))))
    y0, y1, s, e, ty, tx = (tiles[c].to_numpy().astype(np.int64) for c in ("y0", "y1", "x_start", "x_end", "ty", "tx"))
    by = np.lexsort((s, y0, tile))
    shift, top = tile * (TILE_WIDTH + 2) - tx * TILE_WIDTH, ty * TILE_HEIGHT
    y0, y1, s, e, tile = ((y0 - top)[by], (y1 - top)[by], (s + shift)[by], (e + shift)[by], tile[by])
    up = np.arange(len(by))
    for y in np.unique(y0):
        own = np.flatnonzero(y0 == y)
        open_ = np.flatnonzero((y0 < y) & (y1 >= y - 1))  # in the row above, so apart from each other
        open_ = open_[np.argsort(s[open_], kind="stable")]
        low = np.searchsorted(e[open_], s[own])
        n = np.searchsorted(s[open_], e[own], side="right") - low
        a = np.repeat(own, n)
        b = open_[np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        while len(a):  # hang the greater of two roots on the less until they are one
            x, z = up[a], up[b]
            apart = x != z
            a, b = a[apart], b[apart]
            np.minimum.at(up, np.maximum(x, z)[apart], np.minimum(x, z)[apart])
            while not (up[up] == up).all():
                up = up[up]
    found = tiles.take(pa.array(by))
    place = (ty[by] << 42) | (tx[by] << 21)
    label = up - np.searchsorted(tile, tile) + place
    return pa.table([*(found[c] for c in (*PAGE, "x_start", "x_end", "y0", "y1")), pa.array(label)], names=[*PAGE, "x_start", "x_end", "y0", "y1", "label"])


def _labels_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_labels() for a task's tiles, which come sorted. The last tile of a batch may go on in the next one, so it waits for it."""
    waits: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        tiles = pa.Table.from_batches([batch])
        done = np.flatnonzero(_differ(tiles, tiles.slice(len(tiles) - 1)))
        cut = int(done[-1]) + 1 if len(done) else 0
        if cut:
            yield from _labels(pa.concat_tables([*waits, tiles.slice(0, cut)])).to_batches()
            waits = []
        waits.append(tiles.slice(cut))
    if waits:
        yield from _labels(pa.concat_tables(waits)).to_batches()


def labeled(marked: DataFrame) -> DataFrame:
    """page, x_start, x_end, y0, y1, label: the runs, those of the same place below each other as one and cut at tiles' borders, with the label of the connected mark they are part of.

    Tiles are dealt out by their place, so a page is spread over as many tasks as it has tiles; a task labels its small tiles together. What touches across their borders becomes edges between labels (bins of a border's
    columns meet by equality), and rounds of joins bring the labels of a mark down to the least of them.
    """
    key = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.select(*PAGE).schema)
    rows = F.explode(F.sequence(F.floor(F.col("y0") / TILE_HEIGHT), F.floor(F.col("y1") / TILE_HEIGHT))).alias("ty")
    cut = pieces(marked).select("*", rows)
    cut = cut.withColumn("tx", F.explode(F.sequence(F.floor(F.col("x_start") / TILE_WIDTH), F.floor((F.col("x_end") - 1) / TILE_WIDTH))))
    top, left = F.col("ty") * TILE_HEIGHT, F.col("tx") * TILE_WIDTH
    sides = {"y0": F.greatest("y0", top), "y1": F.least("y1", top + TILE_HEIGHT - 1), "x_start": F.greatest("x_start", left), "x_end": F.least("x_end", left + TILE_WIDTH)}
    cut = cut.withColumns({k: v.cast("int") for k, v in sides.items()})
    # by number, or a few MB of small tiles, which are much work, would be put into one task
    n = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(cut.repartition(n, *TILE).sortWithinPartitions(*TILE).mapInArrow(_labels_of, f"{key}, {LABELED}"))

    bins = F.explode(F.sequence(F.floor(F.col("x_start") / BIN), F.floor(F.col("x_end") / BIN))).alias("bin")
    above = found.where((F.col("y1") + 1) % TILE_HEIGHT == 0).select(*PAGE, (F.col("y1") + 1).alias("border"), bins, F.col("x_start").alias("s"), F.col("x_end").alias("e"), F.col("label").alias("a"))
    below = found.where(F.col("y0") % TILE_HEIGHT == 0).select(*PAGE, F.col("y0").alias("border"), bins, "x_start", "x_end", F.col("label").alias("b"))
    stacked = above.join(below, [*PAGE, "border", "bin"]).where("s <= x_end and x_start <= e").select(*PAGE, "a", "b")
    row = F.floor(F.col("y0") / TILE_HEIGHT).alias("ty")
    before = found.where(F.col("x_end") % TILE_WIDTH == 0).select(*PAGE, row, F.col("x_end").alias("border"), F.col("y0").alias("s"), F.col("y1").alias("e"), F.col("label").alias("a"))
    behind = found.where(F.col("x_start") % TILE_WIDTH == 0).select(*PAGE, row, F.col("x_start").alias("border"), "y0", "y1", F.col("label").alias("b"))
    beside = before.join(behind, [*PAGE, "ty", "border"]).where("s <= y1 + 1 and y0 <= e + 1").select(*PAGE, "a", "b")
    roots = least_of(stacked.unionByName(beside), PAGE).withColumnRenamed("node", "label")
    return found.join(roots, [*PAGE, "label"], "left").withColumn("label", F.coalesce("root", "label")).drop("root")


def _numbered(found: DataFrame, rule: HighlightRule) -> DataFrame:
    """page, id, label and the box of marks of the least area on, numbered from top to bottom."""
    size = F.sum((F.col("x_end") - F.col("x_start")) * (F.col("y1") - F.col("y0") + 1))
    x, y = F.min("x_start"), F.min("y0")
    boxes = found.groupBy(*PAGE, "label").agg(x.alias("x"), y.alias("y"), (F.max("x_end") - x).alias("w"), (F.max("y1") + 1 - y).alias("h"), size.cast("int").alias("area"))
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y", "x", "label"))
    return boxes.where(F.col("area") >= rule.min_area).select(*PAGE, F.format_string("highlight_%03d", number).alias("id"), "label", "x", "y", "w", "h", "area")


def highlights(marked: DataFrame, rule: HighlightRule = CONFIG.highlight) -> DataFrame:
    """page, id, x, y, w, h, area of the connected parts of runs of marker, of the least area on."""
    return _numbered(labeled(marked), rule).drop("label")


def _loop(rows: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The corners of the outer edge of connected pixels, given as their runs (y, x_start, x_end): clockwise from the top left. Pixels that touch at a corner hang together there."""
    by_row: dict[int, list[tuple[int, int]]] = {}
    for y, s, e in rows:
        by_row.setdefault(y, []).append((s, e))
    turns: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def bare(own: list[tuple[int, int]], other: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """What of a row has none of the other row's ink beside it."""
        out, k = [], 0
        for s, e in own:
            while k < len(other) and other[k][1] <= s:
                k += 1
            at, j = s, k
            while j < len(other) and other[j][0] < e:
                if other[j][0] > at:
                    out.append((at, other[j][0]))
                at = max(at, other[j][1])
                j += 1
            if at < e:
                out.append((at, e))
        return out

    for own in by_row.values():
        own.sort()
    for y, own in by_row.items():
        for s, e in own:
            turns.setdefault((s, y + 1), []).append((s, y))
            turns.setdefault((e, y), []).append((e, y + 1))
        for s, e in bare(own, by_row.get(y - 1, [])):
            turns.setdefault((s, y), []).append((e, y))
        for s, e in bare(own, by_row.get(y + 1, [])):
            turns.setdefault((e, y + 1), []).append((s, y + 1))
    first = (min(by_row[min(by_row)])[0], min(by_row))
    loop, at, back = [first], first, (first[0], first[1] + 1)
    while True:
        ways = turns[at]
        go = (at[0] - back[0], at[1] - back[1])
        # where two ways lead on, the left one keeps to pixels that touch at this corner
        to = ways[0] if len(ways) == 1 else min(ways, key=lambda w: go[0] * (w[1] - at[1]) - go[1] * (w[0] - at[0]))
        back, at = at, to
        if at == first:
            return loop
        loop.append(at)


def _fewer(points: np.ndarray, most: float) -> np.ndarray:
    """Which corners of a closed outline stay so that no other is further than `most` from it (Douglas and Peucker's rule)."""
    n = len(points)
    far = int(((points - points[0]) ** 2).sum(axis=1).argmax())
    ring = np.vstack([points, points[:1]]).astype(float)
    keep = np.zeros(n + 1, dtype=bool)
    keep[[0, far]] = True
    todo = [(0, far), (far, n)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        line, off = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        length = float(np.hypot(*line))
        # from the stretch, not from the line through it
        along = np.clip(off @ line / length**2, 0, 1) if length else np.zeros(len(off))
        apart = np.hypot(*(off - along[:, None] * line).T)
        i = int(apart.argmax())
        if apart[i] > most + 1e-9:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return np.flatnonzero(keep[:n])


@F.udtf
class Outline:
    """page, id, point, x, y: the corners of a mark's outline, from its runs (page, id, y0, y1, x_start, x_end): one partition for each mark."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int]] = []

    @staticmethod
    def analyze(row: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        keys = [f for f in row.dataType if f.name in (*PAGE, "id")]
        return AnalyzeResult(T.StructType([*keys, *(T.StructField(n, T.IntegerType()) for n in ("point", "x", "y"))]))

    def eval(self, row, most: float):
        self.key, self.most = tuple(row[c] for c in (*PAGE, "id")), most
        self.rows += [(y, row["x_start"], row["x_end"]) for y in range(row["y0"], row["y1"] + 1)]

    def terminate(self):
        if self.rows:
            points = np.array(_loop(_whole(self.rows)))
            for i, k in enumerate(_fewer(points, self.most)):
                yield *self.key, i, int(points[k, 0]), int(points[k, 1])


def _whole(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs that were cut at a tile's border, in one again."""
    out: list[tuple[int, int, int]] = []
    for y, s, e in sorted(rows):
        if out and out[-1][0] == y and out[-1][2] == s:
            out[-1] = (y, out[-1][1], e)
        else:
            out.append((y, s, e))
    return out


def outlines(marked: DataFrame, rule: HighlightRule = CONFIG.highlight) -> DataFrame:
    """page, id, point, x, y: the corners of each mark's outer outline in their order, clockwise, with `polygon_off` pixels at most left out beside it; corners lie between pixels."""
    found = written(labeled(marked))
    named = found.join(_numbered(found, rule).select(*PAGE, "label", "id"), [*PAGE, "label"]).select(*PAGE, "id", "y0", "y1", "x_start", "x_end")
    return Outline(named.asTable().partitionBy(*PAGE, "id"), F.lit(float(rule.polygon_off)))
