"""Tables that only grow, into which each key is written once, whoever writes and however many at a time.

`df.write.format("quillspark_once")` writes in two phases. Tasks write files that nobody reads yet; the commit puts one manifest, which names them, under the
number that follows the last one the writer has seen, and only if nothing is there. So of two writers that started from the same state one commits and the other is refused, with
its files removed; it looks again at what is there now and tries anew (append_once). A task that fails, or a driver that is lost before the
commit, leaves nothing that counts. Readers take the files that manifests name (table).

The manifest needs a store that can put a file only where none is: local and shared POSIX folders (a hard link) and HDFS (a rename). Others are refused.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from threading import Lock
from uuid import uuid4
from weakref import WeakSet

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .crops import KEY, exists, not_yet

LOG = "_log"
MANIFEST = "version long, commit string, files array<string>, n long"


class Conflict(RuntimeError):
    """Another writer has committed since."""


@dataclass
class Part(WriterCommitMessage):
    file: str | None
    n: int


def store_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def put_if_absent(store, path: str, content: bytes) -> bool:
    """A file with this content, whole or not at all; False if one is there already."""
    from pyarrow import fs

    aside = f"{path}.{uuid4().hex}"
    if not isinstance(store, fs.LocalFileSystem | fs.HadoopFileSystem):
        raise ValueError(f"{store.type_name} can't put a file only where none is")
    with store.open_output_stream(aside) as out:
        out.write(content)
    try:
        if isinstance(store, fs.LocalFileSystem):
            os.link(aside, path)
        elif store.get_file_info(path).type != fs.FileType.NotFound:
            return False
        else:
            store.move(aside, path)  # which HDFS refuses where a file is
        return True
    except FileExistsError:
        return False
    except OSError:
        if store.get_file_info(path).type != fs.FileType.NotFound:
            return False
        raise
    finally:
        if store.get_file_info(aside).type != fs.FileType.NotFound:
            store.delete_file(aside)


class OnceWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.version = options["path"].rstrip("/"), int(options["version"])
        self.commit_id = options.get("commit") or uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyarrow import parquet

        store, at = store_of(self.path)
        store.create_dir(at, recursive=True)
        name, out, n = f"part-{self.commit_id}-{uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                if batch.num_rows:
                    out = out or parquet.ParquetWriter(f"{at}/{name}", batch.schema, filesystem=store)
                    out.write_batch(batch)
                    n += batch.num_rows
        except BaseException:
            if out:
                out.close()
                store.delete_file(f"{at}/{name}")
            raise
        if out:
            out.close()
        return Part(name if n else None, n)

    def _remove(self, messages: Sequence[Part | None]) -> None:
        store, at = store_of(self.path)
        for m in messages:
            if m and m.file:
                store.delete_file(f"{at}/{m.file}")

    def commit(self, messages: list[Part | None]) -> None:
        files = [m.file for m in messages if m and m.file]
        if not files:
            return
        store, at = store_of(self.path)
        store.create_dir(f"{at}/{LOG}", recursive=True)
        manifest = {"version": self.version, "commit": self.commit_id, "files": files, "n": sum(m.n for m in messages if m)}
        if not put_if_absent(store, f"{at}/{LOG}/{self.version:012d}.json", json.dumps(manifest).encode()):
            self._remove(messages)
            raise Conflict(f"version {self.version} of {self.path} was committed by another writer")

    def abort(self, messages: list[Part | None]) -> None:
        self._remove(messages)


class Once(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillspark_once"

    def writer(self, schema, overwrite: bool) -> OnceWriter:
        if overwrite:
            raise ValueError("the table only grows")
        return OnceWriter(self.options)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/{LOG}")


def version(spark: SparkSession, path: str) -> int:
    """The number of the last commit, 0 before the first."""
    log = f"{path.rstrip('/')}/{LOG}"
    if not exists(spark, log):
        return 0
    at = spark._jvm.org.apache.hadoop.fs.Path(log)
    names = [f.getPath().getName() for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    return max((int(x.removesuffix(".json")) for x in names if x.endswith(".json")), default=0)


def table(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """The rows that are committed, up to a version; None before the first commit. A driver holds one name for each file, as it does for any scan."""
    upto = version(spark, path) if upto is None else upto
    if not upto:
        return None
    names = [f for r in manifests(spark, path).where(f"version <= {upto}").select("files").collect() for f in r["files"]]
    return spark.read.parquet(*(f"{path.rstrip('/')}/{n}" for n in names))


_sessions: WeakSet = WeakSet()
_registering = Lock()


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, once. A writer's thread looks it up in its active session, which a new thread has none of."""
    spark._jvm.org.apache.spark.sql.classic.SparkSession.setActiveSession(spark._jsparkSession)
    with _registering:
        if spark not in _sessions:
            spark.dataSource.register(Once)
            _sessions.add(spark)


def append_once(rows: DataFrame, path: str, keys: Sequence[str] = KEY, attempts: int = 20) -> int:
    """Appends the rows whose keys the table lacks and returns how many these were. Other writers may do the same at the same time: whoever finds that another has been quicker
    leaves out what that one wrote and tries again. A second call with the same rows appends nothing."""
    spark, keys = rows.sparkSession, list(keys)
    register(spark)
    for _ in range(attempts):
        seen, commit = version(spark, path), uuid4().hex
        fresh, there = rows.dropDuplicates(keys), table(spark, path, seen)
        if there is not None:
            fresh = not_yet(fresh, there, keys)
        try:
            fresh.write.format("quillspark_once").option("version", str(seen + 1)).option("commit", commit).mode("append").save(path)
        except Exception as e:  # noqa: BLE001 - it comes as the JVM's, with the name of ours in its text
            if "Conflict" not in str(e):
                raise
            continue
        if version(spark, path) == seen:
            return 0  # nothing was new
        own = manifests(spark, path).where(f"version = {seen + 1} and commit = '{commit}'").first()
        return own["n"] if own else 0
    raise Conflict(f"{path} was committed to by others {attempts} times meanwhile")
