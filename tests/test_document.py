"""Drawn pages all the way: pixels, layout, crops, transcription, texts, review, export."""

import json
import re
import threading
import time
from dataclasses import fields

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import assemble, kernels, once, transcribe, tree
from quillspark.plans import document

HEIGHT, WIDTH = 420, 500


def drawn() -> np.ndarray:
    """A question of one short line, and two paragraphs of three lines of three words, the second far below; rules between the lines."""
    page = np.full((HEIGHT, WIDTH, 3), 255, np.uint8)

    def line(y, x, widths):
        for w in widths:
            page[y : y + 14, x : x + w] = 0
            page[y + 3, x : x + w] = 255  # words are no solid bars
            x += w + 10

    line(20, 60, [50])
    for y in (70, 100, 130, 260, 290, 320):
        line(y, 60, [55, 40, 50])
    page[125:127, 40:460] = 0
    page[200:205, 300:400] = (60, 230, 250)
    return page


@pytest.fixture(scope="module")
def pages(spark):
    schema = "document_id long, page_number int, height int, width int, bgr binary"
    return spark.createDataFrame([(d, 1, HEIGHT, WIDTH, bytearray(drawn().tobytes())) for d in (1, 2)], schema)


def written(df, at):
    """df as a table, as the parts of a document are on a cluster."""
    df.write.parquet(f"file://{at}")
    return df.sparkSession.read.schema(df.schema).parquet(f"file://{at}")


@pytest.fixture(scope="module")
def found(pages, tmp_path_factory):
    at = tmp_path_factory.mktemp("layout")
    found = document.find_layout(pages, written(document.find_lines(pages, threshold=128), at / "found"), threshold=128, page_height=HEIGHT)
    return document.Layout(**{f.name: written(getattr(found, f.name), at / f.name) for f in fields(found)})


def test_lines_without_the_rule(found):
    got = found.lines.where("document_id = 1").orderBy("y").collect()
    assert [(r.x, r.y, r.w, r.h) for r in got] == [(60, 20, 50, 14)] + [(60, y, 165, 14) for y in (70, 100, 130, 260, 290, 320)]
    assert all(0.5 < r.density < 1 for r in got)


def test_regions_and_crops(found):
    assert [(r.y, r.h) for r in found.questions.where("document_id = 2").collect()] == [(20, 14)]
    assert [(r.id, r.y, r.n_lines) for r in found.paragraphs.where("document_id = 2").orderBy("paragraph").collect()] == [("p001", 70, 3), ("p002", 260, 3)]
    n = {(r.document_id, r.type): r["count"] for r in found.crops.groupBy("document_id", "type").count().collect()}
    assert n == {(d, t): c for d in (1, 2) for t, c in (("question", 1), ("answer", 1), ("paragraph", 2), ("line", 7), ("word", 18))}
    word = found.crops.where("document_id = 1 and id = 'p001_line002_word02'").first()
    assert (word.parent_id, word.x, word.y, word.w, word.h) == ("p001_line002", 125, 100, 40, 14)
    grown = found.crops.where("document_id = 1 and id = 'p001_line003'").first()
    assert grown.y <= 130 and grown.y + grown.h >= 144
    assert document.line_count_check(found).count() == 0
    assert found.highlights.where("document_id = 1").count() == 1


def test_transcription_to_export(spark, pages, found, tmp_path):
    def said(request, image):
        assert image[:4] == b"\x89PNG"
        unsure = request["cropId"] == "p001_line002"
        return {"text": f"{request['cropId']} <caret>x</caret>", "confidence": 0.5 if unsure else 0.95, "uncertainty": [{"start": 0, "end": 4, "reason": "faint"}] if unsure else []}

    none = spark.createDataFrame([], "cache_key string, raw string")
    results, fresh = document.read_lines(pages, found, none, transcriber=said)
    results, fresh = written(results, tmp_path / "results"), written(fresh, tmp_path / "fresh")
    assert results.count() == 14 and fresh.count() == 7  # both documents have the same lines
    questions, paragraphs, answers = document.texts(found, results)
    assert {r.text for r in questions.collect()} == {"q001_line001 <caret>x</caret>"}
    want = "\n\n".join(" ".join(f"p00{p}_line00{i} <caret>x</caret>" for i in (1, 2, 3)) for p in (1, 2))
    assert {r.text for r in answers.collect()} == {want}
    routed = document.to_review(results).where("document_id = 1 and review_class <> 'accepted'").collect()
    assert [(r.crop_id, r.review_class, r.review_state, r.review_reason) for r in routed] == [("p001_line002", "review_required", "required", "model_uncertainty")]
    names = spark.createDataFrame([(1, "scans/a.png"), (2, "scans/b.png")], "document_id long, path string")
    out = assemble.export_json(assemble.review_export(questions, paragraphs, names)).where("document_id = 1").first()
    assert json.loads(out.json)["results"][0] == {"filename": "a.png", "responses": [{"question": "q001_line001 <caret>x</caret>", "response": want}]}

    def never(request, image):
        raise AssertionError("everything is cached")

    again, made = document.read_lines(pages, found, fresh, transcriber=never)
    assert made.count() == 0 and {r.result.validation_state for r in again.collect()} == {"valid"}


def test_calls_and_results_are_kept(spark, pages, found, tmp_path):
    at, made = f"file://{tmp_path}/doc", spark.sparkContext.accumulator(0)

    def said(request, image):
        made.add(1)
        if request["cropId"] == "p002_line003":
            raise TimeoutError("late")
        return json.dumps({"choices": [{"message": {"content": json.dumps({"text": request["cropId"], "confidence": 1})}}]})

    first = document.read_and_keep(pages, found, at, transcriber=said).collect()
    assert made.value == 7 and {r.result.review_reason for r in first if r.crop_id == "p002_line003"} == {"provider_failure:TimeoutError:late"}
    kept = spark.read.parquet(f"{at}/results")
    assert kept.count() == 12 and spark.read.parquet(f"{at}/responses").count() == 6
    document.read_and_keep(pages, found, at, transcriber=said).collect()
    assert made.value == 8 and spark.read.parquet(f"{at}/results").count() == 12  # only the one that failed was tried again
    assert {r.crop_id: r.result.text for r in kept.collect()}["p001_line001"] == "p001_line001"


def test_crops_reach_the_edge_only(spark, pages):
    crops = spark.createDataFrame([(1, 1, "word", "a", -5, -5, 10, 10), (1, 1, "word", "b", 9000, 0, 5, 5)], "document_id long, page_number int, type string, id string, x int, y int, w int, h int")
    got = kernels.crop_images(pages, crops).collect()
    assert [(r.id, r.x, r.y, r.w, r.h) for r in got] == [("a", 0, 0, 5, 5)]


KEY = "document_id long, page_number int, type string, id string"


def rows_of(spark, start, end):
    return spark.range(start, end, 1, 3).selectExpr("id document_id", "1 page_number", "'line' type", "concat('l', id) id")


def test_of_two_writers_from_one_state_one_commits(spark, tmp_path):
    at = f"file://{tmp_path}/once"
    assert once.append_once(rows_of(spark, 0, 10), at) == 10 and once.append_once(rows_of(spark, 5, 12), at) == 2 and once.append_once(rows_of(spark, 0, 12), at) == 0
    assert once.version(spark, at) == 2 and once.table(spark, at).count() == 12 and once.table(spark, at, 1).count() == 10

    def write(rows):
        rows.write.format("quillspark_once").option("version", "3").mode("append").save(at)

    write(rows_of(spark, 20, 25))
    with pytest.raises(Exception, match="Conflict"):
        write(rows_of(spark, 24, 30))
    assert once.table(spark, at).count() == 17 and spark.read.parquet(at).count() == 17  # the other's files are gone
    with pytest.raises(Exception, match="lost on the way"):
        rows_of(spark, 100, 110).selectExpr("if(document_id = 109, raise_error('lost on the way'), document_id) document_id", "page_number", "type", "id").write.format("quillspark_once").option("version", "4").mode("append").save(at)
    assert once.version(spark, at) == 3 and once.table(spark, at).count() == 17


def test_writers_side_by_side_write_each_key_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    at = f"file://{tmp_path}/once"
    once.append_once(rows_of(spark, 0, 1), at)
    with ThreadPoolExecutor(4) as pool:
        n = list(pool.map(lambda k: once.append_once(rows_of(spark, 10 * k, 10 * k + 25), at), range(4)))
    got = once.table(spark, at)
    assert sum(n) + 1 == got.count() == got.select("id").distinct().count() == 55


def moved(df):
    """The columns that each exchange of a plan carries."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [re.sub(r"#\d+L?", "", m) for m in re.findall(r"\n\(\d+\) (?:Exchange|BroadcastExchange)[^\n]*\nInput \[\d+\]: \[([^\]]*)\]", plan)]


def test_images_move_once_and_the_cache_does_not(spark):
    crops = spark.range(50).selectExpr("id document_id", "1 page_number", "concat('l', id) crop_id", "cast(concat('png', id % 40) as binary) image")
    table = "bucketed_cache"
    seen = transcribe.with_cache_key(crops).where("document_id % 2 = 0").selectExpr("cache_key", "'{\"text\":\"kept\",\"confidence\":1}' raw")
    try:
        transcribe.keep_cache(seen, table, 4)
        transcribe.keep_cache(seen, table, 4)
        cache = spark.table(table)
        assert cache.count() == seen.distinct().count()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        results, made = transcribe.run(crops, cache, transcriber=lambda request, image: {"text": bytes(image).decode(), "confidence": 1.0})
        called = [x for x in moved(made) if "image" in x]
        assert len(called) == 1 and len(moved(made)) > 2
        assert not [x for x in moved(results) if x.split(", ") == ["cache_key", "raw"] or x == "cache_key"]  # the table's rows stay in their buckets
        got = {r.document_id: r.result.text for r in results.collect()}
        assert len(got) == 50 and all(got[i] == ("kept" if i % 2 == 0 else f"png{i % 40}") for i in range(50))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE IF EXISTS {table}")


class Busy:
    """A server that counts what is under way, and at first says to each third line that it is busy."""

    def __init__(self):
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        self.now = self.most = self.calls = 0
        self.told, lock, own = set(), threading.Lock(), self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):  # noqa: N802
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                crop = json.loads(body["input"][0]["content"][0]["text"])["cropId"]
                with lock:
                    own.now, own.calls = own.now + 1, own.calls + 1
                    own.most = max(own.most, own.now)
                    busy = int(crop[1:]) % 3 == 0 and crop not in own.told
                    own.told.add(crop)
                time.sleep(0.02 * (int(crop[1:]) % 4))
                with lock:
                    own.now -= 1
                code = 503 if busy else 400 if crop == "l7" else 200
                said = json.dumps({"output": [{"content": [{"type": "output_text", "text": json.dumps({"text": crop, "confidence": 1})}]}]}).encode()
                self.send_response(code)
                self.send_header("Content-Length", str(len(said)))
                self.end_headers()
                self.wfile.write(said)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/"


def test_calls_in_flight_are_bounded_and_tried_again(spark):
    from quillspark.config import Transcription

    busy = Busy()
    how = Transcription(provider="responses", endpoint=busy.url, api_key_env="HOME", in_flight=3, first_pause=0.01, max_calls_per_page=40)
    crops = spark.range(0, 45, 1, 1).selectExpr("1L document_id", "1 page_number", "concat('l', id) crop_id", "cast(cast(id as string) as binary) image", "id", "cast(id as string) cache_key")
    try:
        made = transcribe.transcribe(crops, transcribe.http_transcriber(how, "responses"), how).collect()
        assert 2 <= busy.most <= 3 and busy.calls == 45 + 15  # each third line twice
        assert [r.id for r in made] == list(range(45)) and {r.id for r in made if r.failure} == {7}
        assert [r.failure for r in made if r.id == 7] == ["provider_failure:HTTPError:HTTP Error 400: Bad Request"]
        assert all(json.loads(json.loads(r.raw)["output"][0]["content"][0]["text"])["text"] == r.crop_id for r in made if r.id != 7)
        results, _ = transcribe.run(crops.select("document_id", "page_number", "crop_id", "image"), spark.createDataFrame([], "cache_key string, raw string"), how)
        by = {}
        for r in results.collect():
            by.setdefault(r.result.review_reason, []).append(r.crop_id)
        assert len(by["page_call_cap_reached"]) == 5  # tries don't count for the cap
    finally:
        busy.server.shutdown()


def test_bucket_spreads_calls_over_time():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 6))
        now[0] += s

    bucket = transcribe.Bucket(2.0, 2, clock=lambda: now[0], sleep=sleep)
    for _ in range(5):
        bucket.take()
    assert slept == [0.5, 0.5, 0.5]
    now[0] += 10
    bucket.take()
    bucket.take()
    assert len(slept) == 3
    transcribe.Bucket(0).take()


def whole_tree():
    """A document in which every entity has every field."""
    box = {"x": 1, "y": 2, "width": 3, "height": 4}
    mark = {"id": "h", "type": "circle", "bbox": box, "polygon": [{"x": 1, "y": 2}, {"x": 3, "y": 4}]}
    review = {"id": "r", "targetId": "t", "trigger": "low_confidence", "inputs": {"a": [1, {"b": None}]}, "rawResponse": {"x": 1.5}, "chosen": 2, "agreedWithDeterministic": True, "applied": True, "model": "m", "latencyMs": 7}
    line = {"id": "l", "bbox": box, "cropId": "c", "text": "é", "confidence": 0.25}
    result = {"cropId": "c", "text": "x", "confidence": 0.5, "model": "m", "tokens": [{"text": "x", "confidence": 0.5}], "processingTimeMs": 3, "llmReview": review, "requestSchemaVersion": "v", "cacheKey": "k", "rawResponse": {"a": None}, "uncertainty": [{"start": 0, "end": 1, "reason": "r"}], "validationState": "repaired", "reviewState": "required", "reviewRequiredReason": "why"}
    paragraph = {"id": "p", "pageNumber": 1, "order": 2, "bbox": box, "cropPath": "c", "lines": [line], "highlights": [mark], "text": "t"}
    page = {
        "pageNumber": 1, "image": {"pageNumber": 1, "path": "p", "width": 1, "height": 2, "dpi": 150}, "question": {"id": "q", "bbox": box, "cropPath": "c", "lines": ["l"], "text": "t", "confidence": 0.125},
        "answer": {"bbox": box, "paragraphs": [paragraph], "cropPath": "c"}, "highlights": [mark], "crops": [{"id": "c", "type": "line", "pageNumber": 1, "path": "p", "bbox": box, "createdAt": "now", "parentId": "p"}], "ocr": [result],
    }
    return {"documentId": "d", "source": {"type": "pdf", "originalPath": "a.pdf"}, "state": "APPROVED", "pages": [page], "final": {"question": "q", "answer": "a"}, "llmReviews": [review]}


def test_trees_are_written_and_read_at_every_depth(spark):
    full = whole_tree()
    box = full["pages"][0]["answer"]["bbox"]
    image = full["pages"][0]["image"]
    bare = {"documentId": "b", "source": full["source"], "pages": [{"pageNumber": 1, "image": image, "answer": {"bbox": box, "paragraphs": [{"id": "p", "pageNumber": 1, "order": 1, "bbox": box, "cropPath": "c", "highlights": [{"id": "h"}], "lines": [{"id": "l", "bbox": box, "cropId": "c"}]}]}, "ocr": [{"cropId": "c", "text": "", "confidence": 0.5, "model": "m", "llmReview": {"id": "r", "targetId": "t", "trigger": "low"}}]}]}
    want = {
        "documentId": "b", "source": full["source"], "state": "UPLOADED", "final": {"question": "", "answer": ""}, "llmReviews": [],
        "pages": [{
            "pageNumber": 1, "image": image, "highlights": [], "crops": [],
            "answer": {"bbox": box, "paragraphs": [{"id": "p", "pageNumber": 1, "order": 1, "bbox": box, "cropPath": "c", "text": "", "highlights": [{"id": "h", "type": "highlight"}], "lines": [{"id": "l", "bbox": box, "cropId": "c", "text": ""}]}]},
            "ocr": [{"cropId": "c", "text": "", "confidence": 0.5, "model": "m", "validationState": "valid", "reviewState": "pending", "llmReview": {"id": "r", "targetId": "t", "trigger": "low", "inputs": {}, "rawResponse": None, "chosen": None, "agreedWithDeterministic": False, "applied": False, "model": "", "latencyMs": 0}}],
        }],
    }
    broken = {"documentId": "x", "source": {"type": "pdf"}, "pages": [{"pageNumber": 1, "image": {"pageNumber": 1}, "ocr": [{"text": "x"}, {"cropId": "c"}]}]}
    rows = spark.createDataFrame([(1, json.dumps(full)), (2, json.dumps(bare)), (3, json.dumps(broken)), (4, "no json"), (5, None), (6, "{}")], "n int, json string")
    found, refused = tree.documents(rows)
    got = {r.n: json.loads(r.out) for r in found.select("n", tree.written(F.col("document")).alias("out")).collect()}
    assert got == {1: full, 2: want}
    why = {r.n: r.reason for r in refused.collect()}
    assert why[3] == "lacks source.originalPath, pages.image.path, pages.image.width, pages.image.height, pages.image.dpi, pages.ocr.cropId, pages.ocr.confidence, pages.ocr.model, pages.ocr.text"
    assert why[4] == why[5] == why[6] == "no document"
    again = tree.documents(found.select("n", tree.written(F.col("document")).alias("json")))[0]
    assert {r.n: json.loads(r.out) for r in again.select("n", tree.written(F.col("document")).alias("out")).collect()} == got
