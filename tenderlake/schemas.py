"""Schemas of recipes, stored documents and the rows the page scan emits."""

from __future__ import annotations

from pyspark.sql import types as T

ITEM_FIELDS = ("modality", "agency", "number", "openDate", "publishDate", "description")


def _fields(*pairs) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


_TEXTS = T.MapType(T.StringType(), T.StringType())

RECIPE = _fields(
    ("name", T.StringType()),
    ("baseURI", T.StringType()),
    ("charset", T.StringType()),
    ("delay", T.StringType()),
    ("randomizeDelay", T.BooleanType()),
    ("aspnet", T.BooleanType()),
    (
        "routine",
        T.ArrayType(
            _fields(
                ("id", T.StringType()),
                ("name", T.StringType()),
                ("list", T.BooleanType()),
                ("pagination", T.BooleanType()),
                (
                    "request",
                    _fields(
                        ("uri", T.StringType()),
                        ("baseURI", T.StringType()),
                        ("getURI", T.StringType()),
                        ("postURI", T.StringType()),
                        ("method", T.StringType()),
                        ("form", _TEXTS),
                    ),
                ),
                ("selectors", _TEXTS),
                ("patterns", _TEXTS),
            )
        ),
    ),
)

RESULT = _fields(
    ("scraper", T.StringType()),
    ("_hash", T.StringType()),
    ("modality", T.IntegerType()),
    ("number", T.StringType()),
    ("agency", T.StringType()),
    ("openDate", T.TimestampNTZType()),
    ("publishDate", T.TimestampNTZType()),
    ("extractionDate", T.TimestampNTZType()),
    ("description", T.StringType()),
    ("amount", T.DoubleType()),
    ("approved", T.BooleanType()),
    ("ignored", T.BooleanType()),
    ("exclusive", T.BooleanType()),
    ("website", T.StringType()),
    ("category", _fields(("id", T.StringType()), ("name", T.StringType()))),
    (
        "download",
        _fields(
            ("relativeUri", T.StringType()),
            ("uri", T.StringType()),
            ("fileName", T.StringType()),
            ("fileFormat", T.StringType()),
        ),
    ),
    (
        "processed",
        _fields(
            ("uri", T.StringType()), ("fileName", T.StringType()), ("fileFormat", T.StringType())
        ),
    ),
)

SCRAPER = _fields(
    ("id", T.StringType()),
    ("name", T.StringType()),
    ("city", T.StringType()),
    ("running", T.BooleanType()),
    ("hidden", T.BooleanType()),
    ("lastRunDate", T.TimestampNTZType()),
)

SCHEDULE = _fields(
    ("scraper", T.StringType()),
    ("weekday", T.IntegerType()),
    ("hours", T.IntegerType()),
    ("minutes", T.IntegerType()),
    ("frequency", T.StringType()),
    ("fileName", T.StringType()),
    ("cronExpression", T.StringType()),
)
