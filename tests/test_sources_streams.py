"""Files as sources, and streams."""

import struct
import zlib

from pyspark.sql import functions as F

from quillspark.operators import review
from quillspark.sources import images, proxy
from quillspark.streaming import documents


def png(width: int, height: int, per_metre: int | None = None, color=(10, 20, 30)) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + bytes(color) * width for _ in range(height))
    phys = chunk(b"pHYs", struct.pack(">IIB", per_metre, per_metre, 1)) if per_metre else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + phys + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_dpi():
    assert images.dpi_of(png(1, 1, 11811)) == 300 and images.dpi_of(png(1, 1)) == 150 and images.dpi_of(b"") == 150
    jfif = b"\xff\xd8\xff\xe0\x00\x10JFIF\0\x01\x01\x01" + struct.pack(">HH", 96, 96)
    assert images.dpi_of(jfif) == 96


def test_image_scan_and_refusal(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(7, 5, 11811))
    (tmp_path / "b.png").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"text")
    taken, refused = images.classified(images.files(spark, str(tmp_path)))
    assert taken.count() == 2 and refused.first().reason == "unsupported format .txt"
    pages, refused = images.scanned(spark, str(tmp_path))
    assert {(r.path.rsplit("/", 1)[1], r.reason) for r in refused.collect()} == {("b.png", "image that can't be decoded"), ("c.txt", "unsupported format .txt")}
    page = pages.collect()
    assert [(r.width, r.height, r.dpi, bytes(r.bgr[:3])) for r in page] == [(7, 5, 300, bytes((30, 20, 10)))]
    assert images.with_ids(taken).select("document_id").distinct().count() == 2
    two = images.decoded_pages(taken.where("path like '%a.png'"), lambda content: [(1, 2, 150, b"x"), (3, 4, 150, b"y")])
    assert [(r.page_number, r.width) for r in two.orderBy("page_number").collect()] == [(1, 1), (2, 3)]


def test_ingest_twice_appends_once(spark, tmp_path):
    inbox, table = tmp_path / "in", f"file://{tmp_path}/crops"
    inbox.mkdir()
    (inbox / "a.png").write_bytes(png(3, 3))
    make = lambda df: df.select("document_id", F.lit(1).alias("page_number"), F.lit("page").alias("type"), F.lit("p").alias("id"))
    for run in ("one", "two"):  # the second knows nothing of the first but the table
        documents.ingest(spark, str(inbox), table, f"{tmp_path}/{run}", make).awaitTermination(60)
    assert spark.read.parquet(table).count() == 1
    (inbox / "b.png").write_bytes(png(4, 3))
    documents.ingest(spark, str(inbox), table, f"{tmp_path}/two", make).awaitTermination(60)
    assert spark.read.parquet(table).count() == 2


def drained(df, name, tmp_path):
    q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-check").trigger(availableNow=True).start(f"{tmp_path}/{name}")
    q.awaitTermination(300)
    df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/{name}").createOrReplaceTempView(name)
    return q


def test_steps_of_a_shuffled_and_late_log_equal_the_batch(spark, sf, tmp_path):
    log = proxy.state_log(spark, sf).where("document_id < 60")
    span = log.agg(F.max("ts").alias("a"), F.min("ts").alias("b")).first()
    days = (span.a - span.b).days + 2
    # rows in any order over several triggers, and at last one of far later, by which all the others have passed
    for i in range(4):
        log.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i).orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    last = spark.createDataFrame([(-1, 1, "UPLOADED")], "document_id long, event_id long, state string").withColumn("ts", (F.lit(span.a) + F.expr(f"interval {2 * days} days")).cast("timestamp_ntz"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    found = documents.steps(stream, f"{days} days")
    drained(found, "steps", tmp_path)
    assert spark.table("steps").count() == 0  # nothing is told before its time
    last.select(*log.columns).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    drained(found, "steps", tmp_path)
    want = review.with_state_before(log).where("cur is not null")
    got = spark.table("steps")
    assert {(r.document_id, r.event_id, r.cur, r.nxt) for r in got.collect()} == {(r.document_id, r.event_id, r.cur, r.state) for r in want.collect()} and got.count() == want.count() > 100
    assert {(r.document_id, r.event_id) for r in got.where("not allowed").collect()} == {(r.document_id, r.event_id) for r in review.violations(log).collect()}


def test_steps_are_told_as_the_watermark_passes(spark, tmp_path):
    schema, at = "document_id long, ts timestamp, event_id long, state string", f"{tmp_path}/log"
    mk = lambda *rows: spark.createDataFrame([(1, i, s, f"2024-01-01 {t}") for i, s, t in rows], "document_id long, event_id long, state string, t string").selectExpr("document_id", "to_timestamp(t) ts", "event_id", "state").coalesce(1).write.mode("append").parquet(at)
    (tmp_path / "log").mkdir()
    stream = documents.steps(spark.readStream.schema(schema).parquet(at), "10 minutes")
    mk((3, "QUESTION_DETECTED", "00:03:00"), (1, "UPLOADED", "00:01:00"))
    drained(stream, "told", tmp_path)
    mk((2, "NORMALIZED", "00:02:00"), (4, "ANSWER_DETECTED", "00:12:30"))  # 2 is late; the watermark comes to 00:02:30
    drained(stream, "told", tmp_path)
    assert [(r.event_id, r.cur, r.nxt, r.allowed) for r in spark.table("told").collect()] == [(2, "UPLOADED", "NORMALIZED", True)]
    mk((5, "APPROVED", "05:00:00"))
    drained(stream, "told", tmp_path)
    assert [(r.event_id, r.cur, r.allowed) for r in spark.table("told").orderBy("event_id").collect()][1:] == [(3, "NORMALIZED", True), (4, "QUESTION_DETECTED", True)]


def test_repeats_within_the_watermark_are_dropped_and_the_state_stays_flat(spark, tmp_path):
    schema, at = "document_id string, page_number int, type string, id string, modificationTime timestamp", f"{tmp_path}/in"
    for day in range(12):
        rows = [(f"d{day}", 1, "line", f"l{i}", day) for i in range(5)] + [(f"d{day}", 1, "line", "l0", day)] + [(f"d{day - 1}", 1, "line", "l1", day)] * (day > 0)
        spark.createDataFrame(rows, "document_id string, page_number int, type string, id string, day int").selectExpr("document_id", "page_number", "type", "id", "timestamp_seconds(1700000000 + day * 86400) modificationTime").coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
    q = drained(documents.unseen(stream, within="2 days"), "fresh", tmp_path)
    assert spark.table("fresh").count() == 60 == spark.table("fresh").dropDuplicates(["document_id", "id"]).count()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert len(held) >= 12 and max(held) == held[5] == held[11] == 25  # a key stays until its time and the watermark's are over: five days of five keys, not all twelve


def test_ingest_new_writes_each_file_once(spark, tmp_path):
    inbox, table = tmp_path / "in", f"file://{tmp_path}/crops"
    inbox.mkdir()
    make = lambda df: df.select("document_id", F.lit(1).alias("page_number"), F.lit("page").alias("type"), F.lit("p").alias("id"), "modificationTime")
    for name, size in (("a.png", 3), ("b.png", 4), ("again.png", 3)):  # the last has the first one's content
        (inbox / name).write_bytes(png(size, 3))
        documents.ingest_new(spark, str(inbox), table, f"{tmp_path}/check", make).awaitTermination(120)
    assert spark.read.parquet(table).count() == 2


def test_progress_ends_at_a_last_state(spark, tmp_path):
    schema, at = "document_id long, ts long, event_id long, state string", f"{tmp_path}/log"
    for i, s in enumerate(("UPLOADED", "NORMALIZED", "REVIEW_REQUIRED", "APPROVED")):
        spark.createDataFrame([(1, i, i, s), (2, i, i + 10, "UPLOADED")], schema).coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
    seen = list(documents.follow(stream, 1, f"{tmp_path}/check", patience=60))
    assert seen[-1][0] in ("REVIEW_REQUIRED", "APPROVED") and not [s for s, _ in seen[:-1] if s in ("REVIEW_REQUIRED", "APPROVED")]
    assert not spark.streams.active


def test_hundred_followers_share_one_query(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    schema, at = "document_id long, ts long, event_id long, state string", f"{tmp_path}/log"
    ends = ("UPLOADED", "NORMALIZED", "QUESTION_DETECTED", "REVIEW_REQUIRED")
    for i, s in enumerate(ends):
        spark.createDataFrame([(d, i, 1000 * i + d, s) for d in range(120)], schema).coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
    hub = documents.Followers(stream, f"{tmp_path}/check", snapshot=lambda: spark.read.schema(schema).parquet(at))
    running = set()

    def one(d):
        seen = []
        for found in hub.follow(d, patience=120):
            running.update(str(q.id) for q in spark.streams.active)
            seen.append(found)
        return seen

    with ThreadPoolExecutor(100) as pool:
        told = list(pool.map(one, range(100)))
    assert all(seen[-1] == ("REVIEW_REQUIRED", 4) for seen in told) and len(running) <= 1 and not spark.streams.active


def test_followers_are_told_when_the_query_ends(spark, tmp_path):
    schema, at = "document_id long, ts long, event_id long, state string", f"{tmp_path}/log"
    spark.createDataFrame([(1, 1, 1, "UPLOADED")], schema).write.parquet(at)
    hub = documents.Followers(spark.readStream.schema(schema).parquet(at), f"{tmp_path}/check")
    heard = hub.follow(1, patience=120)
    assert next(heard) == ("UPLOADED", 1)
    (query,) = spark.streams.active
    query.stop()
    assert list(heard) == []


class Scans:
    """A stand-in for a decoder: a file's first line says how many pages it has."""

    def count(self, file):
        from quillspark.sources.paged import Refused

        head = file.read(20).split(b"\n")[0]
        if not head.isdigit():
            raise Refused("encrypted file")
        return int(head)

    def render(self, file, first, last, dpi):
        for i in range(first, last):
            yield i + 1, dpi, bytes([i % 256])


def test_long_scans_are_read_by_ranges_of_pages(spark, tmp_path):
    from quillspark.sources import paged

    (tmp_path / "sub").mkdir()
    (tmp_path / "long.pdf").write_bytes(b"103\n" + b"x" * 10_000)
    (tmp_path / "sub/short.PDF").write_bytes(b"2\n")
    (tmp_path / "locked.pdf").write_bytes(b"locked")
    (tmp_path / "empty.pdf").write_bytes(b"0\n")
    (tmp_path / "other.txt").write_bytes(b"5\n")
    pages, refused = paged.paged(spark, str(tmp_path), "tests.test_sources_streams:Scans", dpi=72, bytesPerPartition=1000)
    assert pages.rdd.getNumPartitions() == 12  # eleven for the long one, one for the others
    got = pages.withColumn("part", F.spark_partition_id()).collect()
    long = sorted((r.page_number, r.width, r.height, r.part) for r in got if r.path.endswith("long.pdf"))
    assert [r[:3] for r in long] == [(i, i, 72) for i in range(1, 104)] and len({r[3] for r in long}) == 11
    assert len(got) == 105 and {r.reason for r in refused.collect()} == {"encrypted file", "file without pages"}
    ids = {r.path.rsplit("/", 1)[1]: r.document_id for r in got}
    assert ids == {r.path.rsplit("/", 1)[1]: r.document_id for r in images.with_ids(images.files(spark, str(tmp_path))).collect() if r.path.rsplit("/", 1)[1] in ids}
    whole = spark.read.format("quillspark_pages").option("decoder", "tests.test_sources_streams:Scans").load(f"{tmp_path}/locked.pdf")
    try:
        whole.count()
        raise AssertionError("a locked file was read")
    except Exception as e:
        assert "encrypted file" in str(e)
