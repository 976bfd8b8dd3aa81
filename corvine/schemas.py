"""Declared schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("ext", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("size", T.LongType()),
        T.StructField("md5", T.StringType()),
        T.StructField("mtime", T.LongType()),
    ]
)
#: One row for a symbol: kind is class, method or function; ordinal is its place in the file's listing.
SYMBOLS = "path string, ordinal int, kind string, owner string, name string, start_line int, end_line int, args string, is_async boolean, docstring string, calls array<string>"
IMPORTS = "path string, ordinal int, raw string, lang string"
LISTING = "path string, size long, mtime long"
