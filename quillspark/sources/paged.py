"""Documents of many pages, such as PDF, as a data source of ranges of pages.

`spark.read.format("quillspark_pages")` plans its partitions from the files' names and sizes alone: a file is cut into as many ranges as its bytes need,
small files share a partition. A task opens its file, asks the decoder how many pages there are and renders its share of them one after another, so a
long scan is spread over many tasks, no task holds more than a page of pixels at a time (and what the decoder keeps of the file), and the driver opens no file.

Options: `path` (a file, or a folder that is read with all below it), `decoder` (the importable name `module:attribute` of a decoder; PyMuPDF by default),
`dpi`, `bytesPerPartition`, `suffixes` (of the files that are taken in a folder, by commas; `pdf`), `refused` (`fail`, or `rows`: a file that the decoder refuses gives a row with the reason and no page).

Files are read through pyarrow's file systems (local, HDFS, S3, GCS, ABFS), since a Python task has no others.
"""

from __future__ import annotations

import hashlib
import importlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import CONFIG

SCHEMA = "document_id string, page_number int, path string, width int, height int, dpi int, bgr binary, reason string"
BYTES = 8 << 20
READ = 1 << 20


class Refused(ValueError):
    """A file that can't be taken in: encrypted, empty or broken."""


class Decoder(Protocol):
    """What makes pages of files. Both take a file that can be read and sought."""

    def count(self, file) -> int:
        """How many pages there are; raises Refused where none can be made."""

    def render(self, file, first: int, last: int, dpi: int) -> Iterator[tuple[int, int, bytes]]:
        """Width, height and BGR bytes of the pages from first up to last, counted from 0, the end exclusive."""


class PyMuPdf:
    """PDF by PyMuPDF, where it is installed."""

    def _open(self, file):
        try:
            import pymupdf
        except ImportError as e:
            raise RuntimeError("PDF pages need PyMuPDF") from e
        file.seek(0)
        try:
            pdf = pymupdf.open(stream=file.read(), filetype="pdf")
        except Exception as e:
            raise Refused(f"broken file: {e}") from e
        if pdf.needs_pass:
            raise Refused("encrypted file")
        return pdf

    def count(self, file) -> int:
        with self._open(file) as pdf:
            return len(pdf)

    def render(self, file, first: int, last: int, dpi: int) -> Iterator[tuple[int, int, bytes]]:
        with self._open(file) as pdf:
            for i in range(first, last):
                pix = pdf[i].get_pixmap(dpi=dpi, alpha=False)
                rgb, bgr = memoryview(pix.samples).cast("B"), bytearray(pix.samples)
                bgr[0::3], bgr[2::3] = rgb[2::3], rgb[0::3]
                yield pix.width, pix.height, bytes(bgr)


def decoder_of(name: str) -> Decoder:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


@dataclass
class Ranges(InputPartition):
    """Parts of files: (path, part, parts). A file's pages are dealt evenly over its parts."""

    files: list[tuple[str, int, int]]


def planned(sizes: list[tuple[str, int]], most: int) -> list[Ranges]:
    """Files in parts of about so many bytes; those of less are put together."""
    found, held, full = [], [], 0
    for path, size in sorted(sizes):
        parts = -(-size // most)
        if parts > 1:
            found += [Ranges([(path, k, parts)]) for k in range(parts)]
        else:
            if held and full + size > most:
                found.append(Ranges(held))
                held, full = [], 0
            held.append((path, 0, 1))
            full += size
    return [*found, Ranges(held)] if held else found


def content_id(file) -> str:
    """The id that sources.images.with_ids() gives to the same content, from a file read in pieces."""
    file.seek(0)
    h = hashlib.sha256()
    while piece := file.read(READ):
        h.update(piece)
    return f"doc_{h.hexdigest()[:16]}"


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.decoder = options.get("decoder", f"{__name__}:PyMuPdf")
        self.dpi, self.most = int(options.get("dpi", CONFIG.render_dpi)), int(options.get("bytesperpartition", BYTES))
        self.rows = options.get("refused", "fail") == "rows"
        self.suffixes = set(options.get("suffixes", "pdf").lower().split(","))

    def _at(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Ranges]:
        from pyarrow import fs

        store, at = self._at()
        info = store.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        taken = [f for f in found if f.type == fs.FileType.File and (f is info or f.extension.lower() in self.suffixes)]
        return planned([(f.path, f.size) for f in taken], self.most)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        store, _ = self._at()
        decoder = decoder_of(self.decoder)
        for path, part, parts in partition.files:
            with store.open_input_file(path) as file:
                doc = content_id(file)
                try:
                    file.seek(0)
                    n = decoder.count(file)
                    if not n:
                        raise Refused("file without pages")
                    first, last = n * part // parts, n * (part + 1) // parts
                    for number, (width, height, bgr) in enumerate(decoder.render(file, first, last, self.dpi) if last > first else (), first + 1):
                        yield doc, number, path, width, height, self.dpi, bgr, None
                except Refused as e:
                    if not self.rows:
                        raise
                    if not part:
                        yield doc, None, path, None, None, None, None, str(e)


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillspark_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pages)


def paged(spark: SparkSession, path: str, decoder: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(pages, refused: path, reason) of the documents under a path."""
    register(spark)
    given = {k: str(v) for k, v in options.items()} | ({"decoder": decoder} if decoder else {})
    read = spark.read.format("quillspark_pages").options(refused="rows", **given).load(path)
    return read.where("reason is null").drop("reason"), read.where("reason is not null").select("path", "reason")
