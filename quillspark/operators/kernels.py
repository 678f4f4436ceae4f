"""Pixels to runs, and boxes back to pixels: the two places where pixels are touched. All between is DataFrame work (operators.ink).

Pages are dealt into strips of rows before any of their pixels reach Python, so that a tall page is many small rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG, HighlightRule
from ..schema import PAGE

STRIP = 128


def strips(pages: DataFrame, rows: int = STRIP) -> DataFrame:
    """page, height, width, top, bgr: pages (page, height, width, bgr) in strips of so many rows of pixels, dealt over the tasks."""
    top = F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(rows))).alias("top")
    row = F.col("width") * 3
    cut = pages.where("height > 0 and width > 0").select(*PAGE, "height", "width", "bgr", top)
    return cut.select(*PAGE, "height", "width", "top", F.substring("bgr", F.col("top") * row + 1, row * rows).alias("bgr"))


def dark(bgr: np.ndarray, threshold: int = 128) -> np.ndarray:
    """Ink: pixels whose gray is under the threshold."""
    return np.rint(bgr @ np.array([0.114, 0.587, 0.299])) < threshold


def marker(bgr: np.ndarray, rule: HighlightRule = CONFIG.highlight) -> np.ndarray:
    """Pixels in the marker's range of hue (0 to 179), saturation and value."""
    high, low = bgr.max(-1), bgr.min(-1)
    hit = high > low
    b, g, r = bgr[hit].astype(np.float32).T
    v, d = high[hit].astype(np.float32), (high - low)[hit].astype(np.float32)
    hue = np.where(v == r, 60 * (g - b) / d, np.where(v == g, 120 + 60 * (b - r) / d, 240 + 60 * (r - g) / d))
    inside = np.ones(len(v), bool)
    for x, (least, most) in ((np.mod(hue, 360) / 2, rule.hue), (255 * d / v, rule.saturation), (v, rule.value)):
        inside &= (np.rint(x) >= least) & (np.rint(x) <= most)
    hit[hit] = inside
    return hit


def pixel_runs(pages: DataFrame, of: Callable[[np.ndarray], np.ndarray], rows: int = STRIP) -> DataFrame:
    """page, height, width, y, x_start, x_end of the runs of pixels that `of` picks from BGR pixels."""
    cut = strips(pages, rows)
    key = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.select(*PAGE, "height", "width").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (width, top, bgr) in enumerate(zip(*(batch[c].to_pylist() for c in ("width", "top", "bgr")))):
                hit = of(np.frombuffer(bgr, np.uint8).reshape(-1, width, 3))
                edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                (y, start), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
                keys = [pa.array([batch[c][i].as_py()] * len(y), batch.schema.field(c).type) for c in (*PAGE, "height", "width")]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x.astype(np.int32)) for x in (y + top, start, end))], names=[*PAGE, "height", "width", "y", "x_start", "x_end"])

    return cut.mapInArrow(run, f"{key}, y int, x_start int, x_end int")


def png(page: np.ndarray) -> bytes:
    """A PNG of BGR pixels."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w = page.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), page[..., ::-1].reshape(h, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def crop_images(pages: DataFrame, crops: DataFrame) -> DataFrame:
    """page, type, id, x, y, w, h, image (PNG) of crops, cut to the page; empty ones are left out. crops: page, type, id, x, y, w, h.

    A crop takes its own rows of pixels from the page before they reach Python.
    """
    met = crops.join(pages.select(*PAGE, "height", "width", "bgr"), PAGE)
    x0, y0 = F.greatest(F.lit(0), "x"), F.greatest(F.lit(0), "y")
    x1, y1 = F.least("width", F.col("x") + F.col("w")), F.least("height", F.col("y") + F.col("h"))
    met = met.withColumns({"x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0}).where("w > 0 and h > 0")
    met = met.select(*PAGE, "type", "id", "x", "y", "w", "h", "width", F.substring("bgr", F.col("y") * F.col("width") * 3 + 1, F.col("h") * F.col("width") * 3).alias("rows"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema if f.name not in ("width", "rows"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = zip(*(batch[c] for c in ("x", "w", "width", "rows")))
            yield batch.drop(columns=["width", "rows"]).assign(image=[png(np.frombuffer(r, np.uint8).reshape(-1, width, 3)[:, x : x + w]) for x, w, width, r in parts])

    return met.mapInPandas(cut, f"{schema}, image binary")
