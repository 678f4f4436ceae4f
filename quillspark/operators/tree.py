"""The whole document as one typed tree, written to JSON and read again.

An entity is a StructType whose fields say in their metadata what stands in for them when they are absent (`default`, as JSON) and whether they are
left out when they are empty (`sparse`). Writing and reading walk the type, not the data: they build one column expression for a tree of any depth,
so a document is written or read in one projection inside the JVM.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT, INT, REAL, FLAG, ANY = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.VariantType()


def entity(**fields) -> T.StructType:
    """A struct of fields: a type (the field has to be there), or (type, default), or (type, default, True) for those that are left out when they are empty."""
    out = []
    for name, what in fields.items():
        kind, *rest = what if isinstance(what, tuple) else (what,)
        out.append(T.StructField(name, kind, True, ({"default": json.dumps(rest[0])} if rest else {}) | ({"sparse": True} if rest[1:] else {})))
    return T.StructType(out)


def many(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(kind)


#: The 17 entities, their fields, defaults, and which of these are left out when empty.
BOX = entity(x=INT, y=INT, width=INT, height=INT)
POINT = entity(x=INT, y=INT)
PAGE_IMAGE = entity(pageNumber=INT, path=TEXT, width=INT, height=INT, dpi=INT)
QUESTION = entity(id=TEXT, bbox=BOX, cropPath=TEXT, lines=(many(TEXT), []), text=(TEXT, ""), confidence=(REAL, None, True))
TOKEN = entity(text=TEXT, confidence=REAL)
LINE = entity(id=TEXT, bbox=BOX, cropId=TEXT, text=(TEXT, ""), confidence=(REAL, None, True))
HIGHLIGHT = entity(id=TEXT, type=(TEXT, "highlight"), bbox=(BOX, None, True), polygon=(many(POINT), [], True))
REVIEW = entity(
    id=TEXT, targetId=TEXT, trigger=TEXT, inputs=(ANY, {}), rawResponse=(ANY, None), chosen=(ANY, None), agreedWithDeterministic=(FLAG, False), applied=(FLAG, False), model=(TEXT, ""), latencyMs=(INT, 0)
)
CROP = entity(id=TEXT, type=TEXT, pageNumber=INT, path=TEXT, bbox=BOX, createdAt=TEXT, parentId=(TEXT, None, True))
RANGE = entity(start=INT, end=INT, reason=(TEXT, ""))
RESULT = entity(
    cropId=TEXT, text=TEXT, confidence=REAL, model=TEXT, tokens=(many(TOKEN), [], True), processingTimeMs=(INT, None, True), llmReview=(REVIEW, None, True), requestSchemaVersion=(TEXT, "", True),
    cacheKey=(TEXT, "", True), rawResponse=(ANY, None, True), uncertainty=(many(RANGE), [], True), validationState=(TEXT, "valid"), reviewState=(TEXT, "pending"), reviewRequiredReason=(TEXT, None, True),
)
PARAGRAPH = entity(id=TEXT, pageNumber=INT, order=INT, bbox=BOX, cropPath=TEXT, lines=(many(LINE), []), highlights=(many(HIGHLIGHT), []), text=(TEXT, ""))
ANSWER = entity(bbox=BOX, paragraphs=(many(PARAGRAPH), []), cropPath=(TEXT, "", True))
DOCUMENT_PAGE = entity(pageNumber=INT, image=PAGE_IMAGE, question=(QUESTION, None, True), answer=(ANSWER, None, True), highlights=(many(HIGHLIGHT), []), crops=(many(CROP), []), ocr=(many(RESULT), []))
SOURCE = entity(type=TEXT, originalPath=TEXT)
FINAL = entity(question=(TEXT, ""), answer=(TEXT, ""))
DOCUMENT = entity(documentId=TEXT, source=SOURCE, state=(TEXT, "UPLOADED"), pages=(many(DOCUMENT_PAGE), []), final=(FINAL, {}), llmReviews=(many(REVIEW), []))


def _default(kind: T.DataType, said: str) -> Column:
    """What a default means in a type: a struct's own fields have theirs."""
    if isinstance(kind, T.StructType) and said != "null":
        return F.struct(*(_filled(F.lit(None).cast(f.dataType), f).alias(f.name) for f in kind))
    if isinstance(kind, T.VariantType):
        return F.parse_json(F.lit(said))
    if isinstance(kind, T.ArrayType):
        return F.array().cast(_bare(kind))
    value = json.loads(said)
    return F.lit(value).cast(kind)


def _bare(kind: T.DataType) -> T.DataType:
    """The type without metadata, as casts take it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _bare(f.dataType)) for f in kind])
    return T.ArrayType(_bare(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def _within(value: Column, kind: T.DataType, each) -> Column:
    """value with `each` (column, field) done to all fields of all structs in it, from the leaves up."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(each(value[f.name], f).alias(f.name) for f in kind)))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(value, lambda x: _within(x, kind.elementType, each))
    return value


def _filled(value: Column, f: T.StructField) -> Column:
    inner = _within(value, f.dataType, _filled)
    said = f.metadata.get("default", "null")
    if isinstance(f.dataType, T.VariantType):
        return F.coalesce(inner, _default(f.dataType, said))
    return inner if said == "null" else F.coalesce(inner, _default(f.dataType, said))


def _sparse(value: Column, f: T.StructField) -> Column:
    inner = _within(value, f.dataType, _sparse)
    if not f.metadata.get("sparse"):
        return _filled(inner, f) if isinstance(f.dataType, T.VariantType) else inner
    if isinstance(f.dataType, T.ArrayType):
        return F.when(F.size(value) > 0, inner)
    if isinstance(f.dataType, T.VariantType):
        return F.when(~F.is_variant_null(value), inner)
    return F.when(value != "", inner) if f.metadata["default"] == '""' else inner


def written(tree: Column, kind: T.StructType = DOCUMENT) -> Column:
    """The JSON of a tree: what is left out when empty is left out at every depth, all else is there."""
    return F.to_json(_within(tree, kind, _sparse))


def read(text: Column, kind: T.StructType = DOCUMENT) -> Column:
    """The tree of a JSON text, with the defaults of each entity at every depth; null where the text is no JSON object."""
    once = F.array(F.from_json(text, _bare(kind)))  # the text is read once, however many fields are taken from it
    return F.element_at(F.transform(once, lambda t: _within(t, kind, _filled)), 1)


def lacking(tree: Column, kind: T.StructType = DOCUMENT) -> Column:
    """The names of fields that have to be there and aren't, by the entity's place (`pages.image.dpi`), each once."""

    def names(value: Column, f: T.StructField, at: str) -> list[Column]:
        place = f"{at}.{f.name}" if at else f.name
        own = [] if "default" in f.metadata else [F.when(value.isNull(), F.array(F.lit(place))).otherwise(F.array().cast("array<string>"))]
        return [*own, *inside(value, f.dataType, place)]

    def inside(value: Column, part: T.DataType, place: str) -> list[Column]:
        none = F.array().cast("array<string>")
        if isinstance(part, T.StructType):
            found = [n for f in part for n in names(value[f.name], f, place)]
            return [F.when(value.isNotNull(), F.flatten(F.array(*found))).otherwise(none)] if found else [none]
        if isinstance(part, T.ArrayType) and isinstance(part.elementType, T.StructType):
            return [F.coalesce(F.flatten(F.transform(value, lambda x: inside(x, part.elementType, place)[0])), none)]
        return []

    return F.array_distinct(F.coalesce(inside(tree, kind, "")[0], F.array().cast("array<string>")))


def documents(rows: DataFrame, text: str = "json") -> tuple[DataFrame, DataFrame]:
    """(rows with their tree in `document`, refused rows with a reason) of JSON texts."""
    found = rows.withColumn("document", read(F.col(text)))
    missing = lacking(F.col("document"))
    why = F.when(F.col("document").isNull() | F.col("document.documentId").isNull() & F.col("document.source").isNull(), F.lit("no document")).when(F.size(missing) > 0, F.concat(F.lit("lacks "), F.array_join(missing, ", ")))
    judged = found.withColumn("reason", why)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").drop("document")
