"""Line transcription: cache keys, call caps, the external call, and validation of what comes back."""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, Transcription
from ..functions.expressions import any_clipped, clipped_ranges
from ..schema import OCR_RESULT, PAGE, UNCERTAINTY

#: (request, image) -> response: a provider's body, or an object
Transcriber = Callable[[dict, bytes], str | dict]
TIMEOUT = 60.0

#: Fixed value: the shape that responses must have.
RESPONSE_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["text", "confidence", "uncertainty"],
    "properties": {
        "text": {"type": "string"},
        "confidence": {"type": "number", "minimum": 0, "maximum": 1},
        "uncertainty": {
            "type": "array",
            "items": {"type": "object", "additionalProperties": False, "required": ["start", "end", "reason"], "properties": {"start": {"type": "integer"}, "end": {"type": "integer"}, "reason": {"type": "string"}}},
        },
    },
}


def request_for(crop_id: str, how: Transcription) -> dict:
    shape = {"text": "string", "confidence": "number[0,1]", "uncertainty": [{"start": "integer", "end": "integer", "reason": "string"}]}
    return {"type": "line_transcription", "schemaVersion": how.schema_version, "model": how.model, "instruction": how.prompt, "cropId": crop_id, "responseSchema": shape}


def canonical_request(crop_id, how: Transcription = CONFIG.transcription):
    """The request's canonical JSON as a column: keys sorted, no spaces. All but the crop's id is built once, on the driver."""
    mark = "\0"
    before, after = json.dumps(request_for(mark, how), sort_keys=True, separators=(",", ":"), ensure_ascii=False).split(json.dumps(mark)[1:-1])
    quoted = F.to_json(F.array(crop_id))  # ["..."]
    return F.concat(F.lit(before[:-1]), F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(after[1:]))


def with_cache_key(crops: DataFrame, image: str = "image", crop_id: str = "crop_id", how: Transcription = CONFIG.transcription) -> DataFrame:
    """cache_key: sha256 of the image, a zero byte and the canonical request."""
    canonical = canonical_request(F.col(crop_id), how).cast("binary")
    return crops.withColumn("cache_key", F.sha2(F.concat(F.col(image).cast("binary"), F.lit(b"\0"), canonical), 256))


def cache_hits(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Crops whose key is in the cache, with the raw response kept there."""
    return keyed.join(cache.select("cache_key", "raw").dropDuplicates(["cache_key"]), "cache_key")


def cache_misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def call_cap(misses: DataFrame, order: str, most: int = CONFIG.transcription.max_calls_per_page) -> DataFrame:
    """call_no within the page, and whether it lies beyond the page's calls. Equal keys should be made one before."""
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy(order))
    return misses.withColumn("call_no", number).withColumn("capped", F.col("call_no") > most)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def json_object(text: Column) -> Column:
    """Variant: the JSON object that a text is, or that stands between its first and last brace; null if there is none."""

    def object_or_none(part: Column) -> Column:
        return let(F.try_parse_json(part), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))

    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return let(F.try_parse_json(text), lambda whole: F.when(whole.isNotNull(), F.when(F.schema_of_variant(whole).startswith("OBJECT"), whole)).otherwise(object_or_none(inner)))


def message_text(body: Column) -> Column:
    """The model's text in a provider's answer (JSON): that of the first message of `output`, or of the first of `choices`; other text as it is."""
    get = F.try_variant_get

    def texts(item: Column) -> Column:
        said = F.array(get(item, "$.text", "string"))
        inner = F.coalesce(get(item, "$.content", "array<variant>"), F.array().cast("array<variant>"))
        of_message = F.transform(F.filter(inner, lambda c: get(c, "$.type", "string") == "output_text"), lambda c: get(c, "$.text", "string"))
        kind = get(item, "$.type", "string")
        return F.when(kind == "output_text", said).when(kind == "message", of_message).otherwise(F.array().cast("array<string>"))

    def found(v: Column) -> Column:
        output = F.get(F.flatten(F.transform(get(v, "$.output", "array<variant>"), texts)), F.lit(0))
        return F.coalesce(output, get(v, "$.choices[0].message.content", "string"), body)

    enveloped = body.contains('"output"') | body.contains('"choices"')  # other text need not be parsed here
    return let(body, lambda b: F.when(enveloped, let(F.try_parse_json(b), found)).otherwise(b))


INTEGER, FLOAT = r"^\s*[+-]?[0-9]+\s*$", r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _number(v: Column, kind: Column, pattern: str) -> Column:
    """A variant as double: numbers, truth values and strings of the pattern; null for all else."""
    said = F.try_variant_get(v, "$", "string")
    plain = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    of_text = F.when(said.rlike(pattern), F.trim(F.translate(said, "\t\n\r", "   ")).try_cast("double"))
    return F.when(plain, F.try_variant_get(v, "$", "double")).when(kind == "BOOLEAN", F.when(said == "true", 1.0).otherwise(0.0)).when(kind == "STRING", of_text)


def _offset(item: Column, name: str) -> Column:
    """A whole number of a range, cut towards zero; null if there is none."""
    cut = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
    value = let(F.try_variant_get(item, f"$.{name}", "variant"), lambda v: _number(v, F.schema_of_variant(v), INTEGER))
    bounded = lambda x: F.least(F.greatest(cut(x), F.lit(-(1 << 31))), F.lit((1 << 31) - 1)).cast("int")
    return let(value, lambda x: F.when(x.isNotNull(), bounded(x)))


def _result(text, confidence, uncertainty, validation: str, review, reason) -> Column:
    parts = (text, confidence, uncertainty, F.lit(validation), review, reason)
    return F.struct(*(x.alias(f.name) for x, f in zip(parts, OCR_RESULT.fields))).cast(OCR_RESULT)


def _failed(validation: str, reason: Column) -> Column:
    return _result(F.lit(""), F.lit(0.0), F.array().cast(UNCERTAINTY), validation, F.lit("required"), reason)


def unavailable(reason: Column) -> Column:
    return _failed("unavailable", reason)


def _judged(v: Column) -> Column:
    """OCR_RESULT of a response object. Anything malformed makes the whole response invalid."""
    get, none = F.try_variant_get, F.array().cast("array<variant>")
    names = ("text", "confidence", "uncertainty")
    parts = F.struct(*(get(v, f"$.{x}", "variant").alias(x) for x in names))

    def typed(p: Column) -> Column:
        return F.struct(*(p[x].alias(x) for x in names), *(F.schema_of_variant(p[x]).alias(f"{x}_kind") for x in names))

    def ranges_of(p: Column) -> Column:
        listed = F.when(p["uncertainty_kind"].isNull() | (p["uncertainty_kind"] == "OBJECT<>"), none).otherwise(get(p["uncertainty"], "$", "array<variant>"))
        return F.transform(listed, lambda u: F.struct(_offset(u, "start").alias("start"), _offset(u, "end").alias("end"), F.coalesce(get(u, "$.reason", "string"), F.lit("")).alias("reason")))

    def read(p: Column) -> Column:
        said = F.when(p["text_kind"] == "STRING", get(p["text"], "$", "string"))
        missing = F.when(p["text_kind"].isNull(), "'text'").when(p["confidence_kind"].isNull(), "'confidence'")
        return F.struct(said.alias("text"), _number(p["confidence"], p["confidence_kind"], FLOAT).alias("confidence"), ranges_of(p).alias("ranges"), missing.alias("missing"))

    def judge(r: Column) -> Column:
        said, sure, ranges = r["text"], r["confidence"], r["ranges"]
        known = F.coalesce(sure.between(0.0, 1.0), F.lit(False)) & said.isNotNull()
        broken = F.coalesce(F.exists(ranges, lambda u: u["start"].isNull() | u["end"].isNull()), F.lit(True))
        outside = F.exists(ranges, lambda u: (u["start"] < 0) | (u["end"] <= u["start"]))
        why = (
            F.when(r["missing"].isNotNull(), r["missing"]).when(~known, F.lit("invalid text or confidence"))
            .when(broken, F.lit("uncertainty is no list of ranges")).when(outside, F.lit("uncertainty range outside literal text"))
        )

        def good(left: Column) -> Column:
            reason = F.when(any_clipped(ranges, said), F.lit("uncertainty_range_clamped")).when(F.size(left) > 0, F.lit("model_uncertainty"))
            return _result(said, sure, left, "valid", F.when(F.size(left) > 0, "required").otherwise("pending"), reason)

        return let(why, lambda w: F.when(w.isNotNull(), _failed("invalid", F.concat(F.lit("malformed_response:"), w))).otherwise(let(clipped_ranges(ranges, said), good)))

    return let(let(let(parts, typed), read), judge)


def validated(raw: Column) -> Column:
    """OCR_RESULT of raw responses, JSON strings that may have prose around them; null is a provider that isn't there. All of it stays in the JVM."""
    malformed = _failed("invalid", F.lit("malformed_response:no JSON object"))

    def of(text: Column) -> Column:
        judged = let(json_object(text), lambda v: F.when(v.isNull(), malformed).otherwise(_judged(v)))
        return F.when(text.isNull(), unavailable(F.lit("provider_unavailable"))).otherwise(judged)

    return let(raw, of)


class Bucket:
    """Lets so many calls through a second, and up to `burst` at once after a pause; 0 lets all through. Safe for threads."""

    def __init__(self, per_second: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.per_second, self.burst, self.clock, self.sleep = per_second, max(1, burst), clock, sleep
        self.lock, self.held, self.at = Lock(), float(self.burst), clock()

    def take(self) -> None:
        if self.per_second <= 0:
            return
        with self.lock:  # a call takes its place even if it has to wait for it
            now = self.clock()
            self.held = min(self.burst, self.held + (now - self.at) * self.per_second) - 1
            self.at = now
            wait = max(0.0, -self.held / self.per_second)
        if wait:
            self.sleep(wait)


def patient(call: Transcriber, how: Transcription, bucket: Bucket, sleep: Callable[[float], None] = time.sleep) -> Transcriber:
    """call, with its place in the bucket each time, and tried again where the other side says that it is busy (429) or broken (5xx): `retries` times at most, after a
    pause that doubles or as long as the answer says, no longer than `longest_pause`. For the cap of a page a line counts once, however often it is tried."""

    def tried(request: dict, image: bytes) -> str | dict:
        for k in range(how.retries + 1):
            bucket.take()
            try:
                return call(request, image)
            except urllib.error.HTTPError as e:
                if k == how.retries or not (e.code == 429 or e.code >= 500):
                    raise
                said = (e.headers or {}).get("Retry-After", "")
                sleep(min(how.longest_pause, float(said) if said.isdigit() else how.first_pause * 2**k))
        raise AssertionError("not reached")

    return tried


def transcribe(misses: DataFrame, transcriber: Transcriber | None, how: Transcription = CONFIG.transcription) -> DataFrame:
    """raw (JSON) and failure for each crop (page, crop_id, cache_key, image).

    A task has `in_flight` calls out at most and starts `per_second` at most; their answers come back in the order of the crops. In all there are as many
    as tasks run at once, so set these by the cluster's cores. A call goes out once for each row of the input (and again as patient() says) and can't be undone: write the result
    before using it twice, and keep speculation off.
    """
    keep = [c for c in misses.columns if c != "image"]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = patient(transcriber, how, Bucket(how.per_second, how.in_flight)) if transcriber else None

        def one(crop_id: str, image: bytes) -> tuple[str | None, str | None]:
            if ask is None:
                return None, "provider_unavailable"
            try:
                raw = ask(request_for(crop_id, how), bytes(image))
                return raw if isinstance(raw, str) else json.dumps(raw, ensure_ascii=False), None
            except Exception as e:  # noqa: BLE001 - one failing line must not end the document
                return None, f"provider_failure:{type(e).__name__}:{e}"

        with ThreadPoolExecutor(max(1, how.in_flight)) as pool:
            for batch in batches:
                made = list(pool.map(one, batch["crop_id"], batch["image"]))
                yield batch[keep].assign(raw=[r for r, _ in made], failure=[f for _, f in made])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in misses.schema if f.name in keep)
    return misses.mapInPandas(call, f"{fields}, raw string, failure string")


def http_transcriber(how: Transcription, style: str) -> Transcriber:
    """A live provider, of the `responses` or the `chat` style. It gives the answer's body as it came; message_text() finds the model's words in it."""

    def body_of(request: dict, image: bytes) -> dict:
        said, url = json.dumps(request, ensure_ascii=False), "data:image/png;base64," + base64.b64encode(image).decode("ascii")
        schema = {"name": "line_transcription", "strict": True, "schema": RESPONSE_SCHEMA}
        if style == "responses":
            content = [{"type": "input_text", "text": said}, {"type": "input_image", "image_url": url, "detail": "high"}]
            return {"model": how.model, "input": [{"role": "user", "content": content}], "text": {"format": {"type": "json_schema", **schema}}}
        content = [{"type": "text", "text": said}, {"type": "image_url", "image_url": {"url": url}}]
        return {"model": how.model, "messages": [{"role": "user", "content": content}], "response_format": {"type": "json_schema", "json_schema": schema}}

    def call(request: dict, image: bytes) -> str:
        sent = urllib.request.Request(how.endpoint, data=json.dumps(body_of(request, image)).encode("utf-8"), method="POST")
        sent.add_header("Content-Type", "application/json")
        sent.add_header("Authorization", "Bearer " + os.environ[how.api_key_env])
        with urllib.request.urlopen(sent, timeout=TIMEOUT) as answer:  # refusals and broken lines raise, and are written down by transcribe()
            return answer.read().decode("utf-8")

    return call


#: By name; a name that isn't here has no transcriber, and its lines become unavailable.
PROVIDERS: dict[str, Callable[[Transcription], Transcriber]] = {
    "responses": lambda how: http_transcriber(how, "responses"),
    "chat": lambda how: http_transcriber(how, "chat"),
    "stub": lambda how: lambda request, image: {"text": request["cropId"], "confidence": 1.0, "uncertainty": []},
}


def keep_cache(responses: DataFrame, table: str, buckets: int) -> None:
    """Appends responses (cache_key, raw) to a table that lies in buckets by the key: a lookup moves the keys asked for and leaves the table where it is.

    Pass its frame, `spark.table(table)`, to run(). Entries that are there already are left out.
    """
    spark = responses.sparkSession
    new = responses.select("cache_key", "raw").dropDuplicates(["cache_key"])
    if spark.catalog.tableExists(table):
        new = new.join(spark.table(table).select("cache_key"), "cache_key", "left_anti")
    new.repartition(buckets, "cache_key").write.bucketBy(buckets, "cache_key").sortBy("cache_key").format("parquet").mode("append").saveAsTable(table)


def run(crops: DataFrame, cache: DataFrame, how: Transcription = CONFIG.transcription, transcriber: Transcriber | None = None, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results: page, crop_id, cache_key, result), (responses: cache_key, raw) for line crops (page, crop_id, image), one for each (page, crop_id).

    Hits come from the cache; of equal misses the first goes out and all share its answer; misses beyond the page's calls are
    not made. All of that is decided on keys; only the images of calls that are made move, once. With a store, a folder, what the calls gave is written there before anything is made of it,
    so no call goes out twice. Without one, write the responses, the new cache entries, before using either frame again.
    """
    make = transcriber or (PROVIDERS[how.provider](how) if how.provider in PROVIDERS else None)
    others = [c for c in crops.columns if c not in (*PAGE, "crop_id", "image")]
    keyed = with_cache_key(crops, how=how).select(*PAGE, "crop_id", *others, "cache_key")
    first = Window.partitionBy("cache_key").orderBy(*PAGE, "crop_id")
    missed = cache_misses(keyed.select(*PAGE, "crop_id", "cache_key"), cache)
    misses = call_cap(missed.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n"), "crop_id", how.max_calls_per_page)
    asked = misses.where("not capped").select(*PAGE, "crop_id", "cache_key")
    called = crops.select(*PAGE, "crop_id", "image").join(asked, [*PAGE, "crop_id"])
    made = transcribe(called, make, how).select("cache_key", "raw", "failure")
    if store:
        at = f"{store.rstrip('/')}/calls-{uuid4().hex}"
        made.write.parquet(at)
        made = crops.sparkSession.read.schema(made.schema).parquet(at)
    capped = misses.where("capped").select("cache_key", F.lit(None).cast("string").alias("raw"), F.lit("page_call_cap_reached").alias("failure"))
    known = cache.select("cache_key", "raw").dropDuplicates(["cache_key"]).withColumn("failure", F.lit(None).cast("string"))
    result = F.when(F.col("failure").isNotNull(), unavailable(F.col("failure"))).otherwise(validated(message_text(F.col("raw"))))
    # the cache is met apart from what is new, so that its buckets stay as they are
    results = keyed.join(known, "cache_key").unionByName(keyed.join(made.unionByName(capped), "cache_key")).withColumn("result", result)
    return results.drop("raw", "failure"), made.where("raw is not null").select("cache_key", "raw")
