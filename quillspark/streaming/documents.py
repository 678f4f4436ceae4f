"""Incremental ingestion, and the documents' states as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from queue import Empty, Queue
from threading import Lock

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from ..operators.crops import KEY, append_new
from ..schema import EDGES
from ..sources.images import BINARY_FILE, classified, with_ids

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: States in which nothing more is to be waited for.
DONE = ("REVIEW_REQUIRED", "APPROVED", "EXPORTED", "ERROR")


def incoming(spark: SparkSession, path: str) -> DataFrame:
    """Files as they arrive in a folder."""
    return spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").load(path)


def ingest(spark: SparkSession, path: str, table: str, checkpoint: str, make: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Take in all files that have arrived and stop: make(files with kind and id) gives crops, of which the new ones are appended.

    A batch that is run again appends nothing, as rows that are in the table are left out.
    """

    def each(batch: DataFrame, number: int) -> None:
        taken, _ = classified(batch)
        append_new(make(with_ids(taken)), table)

    return incoming(spark, path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unseen(rows: DataFrame, keys: Sequence[str] = KEY, at: str = "modificationTime", within: str = "7 days") -> DataFrame:
    """A stream's rows without those whose keys came before, within so long a time of the rows' own clock.

    The state is a row for each key of that time and goes with the watermark, however long the stream runs and however large the table behind it is; a repeat
    that comes later than that is for append_new() or the write-once sink to leave out.
    """
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark(list(keys))


def ingest_new(spark: SparkSession, path: str, table: str, checkpoint: str, make: Callable[[DataFrame], DataFrame], keys: Sequence[str] = KEY, within: str = "7 days") -> StreamingQuery:
    """As ingest(), but no trigger reads the table: what came within that time is known to the stream's own state. make() must keep modificationTime.

    Rows reach the table's files once, by the checkpoint.
    """
    taken, _ = classified(incoming(spark, path))
    new = unseen(make(with_ids(taken)), keys, within=within)
    return new.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(table)


class Walk(StatefulProcessor):
    """A document's rows wait until the watermark has passed them; then they are steps, in the order of (time, event_id), from where the document stands.

    State: the rows that wait, the last state, and the time of the timer, which is that of the first row that waits.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, state string")
        self.last = handle.getValueState("last", "state string")
        self.timer = handle.getValueState("timer", "ms long")

    def _wait(self, first: int | None) -> None:
        """Sets the timer to the millisecond from which on a row of this time is passed."""
        ms, now = None if first is None else -(-first // 1000), self.timer.get()[0] if self.timer.exists() else None
        if now is not None and (ms is None or ms < now):
            self.handle.deleteTimer(now)
            self.timer.clear()
            now = None
        if ms is not None and now is None:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        came = pd.concat(list(rows))
        self.waiting.appendList([(int(at), int(e), s) for at, e, s in zip(came["at"], came["event_id"], came["state"])])
        self._wait(int(came["at"].min()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get())
        ready, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        self.timer.clear()
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self._wait(rest[0][0])
        cur = self.last.get()[0] if self.last.exists() else None
        found = []
        for _, event_id, state in ready:
            if cur is not None:
                found.append((key[0], event_id, cur, state, (cur, state) in EDGES))
            cur = state
        if ready:
            self.last.update((cur,))
        if found:
            yield pd.DataFrame(found, columns=["document_id", "event_id", "cur", "nxt", "allowed"])

    def close(self) -> None:
        pass


def steps(log: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each step of each document as its log streams in, and whether it is allowed: document_id, event_id, cur, nxt, allowed.

    Rows may come in any order and up to `lateness` late by their own time ts: a step is given once the watermark has passed it, in its place, so the steps are those that
    review.violations() sees in the whole log. Rows that come later than that are dropped by Spark, which counts them (numRowsDroppedByWatermark). The state needs the RocksDB
    store, which is set for the session.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = log.schema["document_id"].dataType.simpleString()
    given = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts"))
    return given.groupBy("document_id").transformWithStateInPandas(Walk(), f"document_id {kind}, event_id long, cur string, nxt string, allowed boolean", "append", "eventtime")


def progress(log: DataFrame) -> DataFrame:
    """The latest state of each document of a stream (output mode complete or update)."""
    return log.groupBy("document_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("n_steps"))


class Followers:
    """One streaming query over a log's progress, for any number of followers.

    Each trigger looks up the documents that are followed just now (`most` at most) in a join, and hands their rows to those who follow them. The query starts with the first follower
    and stops with the last; when it ends for another reason, a listener tells all followers, so none waits in vain. A document that stood still since is
    given from snapshot(), a batch frame of the log, where there is one.
    """

    def __init__(self, log: DataFrame, checkpoint: str, done: Sequence[str] = DONE, snapshot: Callable[[], DataFrame] | None = None, most: int = 10_000) -> None:
        self.log, self.checkpoint, self.done, self.snapshot, self.most = log, checkpoint, tuple(done), snapshot, most
        self._lock, self._heard = Lock(), {}
        self._query: StreamingQuery | None = None
        self._ended: _Ended | None = None

    def _each(self, batch: DataFrame, number: int) -> None:
        with self._lock:
            wanted = list(self._heard)
        for r in self._of(batch, wanted):
            with self._lock:
                queues = list(self._heard.get(r["document_id"], ()))
            for queue in queues:
                queue.put((r["state"], r["n_steps"]))

    def _of(self, rows: DataFrame, wanted: list) -> list:
        """The rows of followed documents: as many as there are, so no more than `most`."""
        if not wanted:
            return []
        ids = rows.sparkSession.createDataFrame([(i,) for i in wanted], f"document_id {rows.schema['document_id'].dataType.simpleString()}")
        return rows.join(F.broadcast(ids), "document_id").select("document_id", "state", "n_steps").collect()

    def _start(self) -> None:
        self._query = progress(self.log).writeStream.outputMode("update").option("checkpointLocation", self.checkpoint).foreachBatch(self._each).start()
        self._ended = _Ended(str(self._query.id), self.tell_end)
        self.log.sparkSession.streams.addListener(self._ended)

    def tell_end(self) -> None:
        with self._lock:
            queues = [q for held in self._heard.values() for q in held]
        for queue in queues:
            queue.put(None)

    def join(self, document_id) -> Queue:
        """Takes a follower in. Its queue gets (state, steps so far) with each change, and None when the query has ended."""
        queue: Queue = Queue()
        with self._lock:
            if len(self._heard) >= self.most and document_id not in self._heard:
                raise ValueError(f"{self.most} documents are followed already")
            self._heard.setdefault(document_id, []).append(queue)
            if self._query is None:
                self._start()
        if self.snapshot:
            for r in self._of(progress(self.snapshot()), [document_id]):
                queue.put((r["state"], r["n_steps"]))
        return queue

    def leave(self, document_id, queue: Queue) -> None:
        with self._lock:
            self._heard[document_id].remove(queue)
            if not self._heard[document_id]:
                del self._heard[document_id]
            query, ended = (self._query, self._ended) if not self._heard else (None, None)
            if query:
                self._query = self._ended = None
        if query:  # outside the lock: a trigger that runs needs it to end
            self.log.sparkSession.streams.removeListener(ended)
            query.stop()

    def follow(self, document_id, patience: float = 600.0) -> Iterator[tuple[str, int]]:
        """(state, steps so far) of a document each time they change, until it is in one of the last states, the query ends or nothing has come for so many seconds."""
        queue, steps_so_far = self.join(document_id), 0
        try:
            while found := queue.get(timeout=patience):
                if found[1] > steps_so_far:  # a snapshot may come after what it lacks
                    steps_so_far = found[1]
                    yield found
                    if found[0] in self.done:
                        return
        except Empty:
            return
        finally:
            self.leave(document_id, queue)


class _Ended(StreamingQueryListener):
    """Tells when a query has ended."""

    def __init__(self, query_id: str, tell: Callable[[], None]) -> None:
        self.query_id, self.tell = query_id, tell

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.id) == self.query_id:
            self.tell()


def follow(log: DataFrame, document_id, checkpoint: str, done: Sequence[str] = DONE, patience: float = 600.0) -> Iterator[tuple[str, int]]:
    """Followers for one document alone."""
    return Followers(log.where(F.col("document_id") == document_id), checkpoint, done).follow(document_id, patience)
