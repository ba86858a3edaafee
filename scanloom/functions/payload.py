"""Classification of downloaded archives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.constants import MAX_ARCHIVE_BYTES
from scanloom.functions.text import js_trim


def payload_class(http_code: Column, size: Column, content: Column) -> Column:
    """Ordered checks, the first failure names the class."""
    return (
        F.when(~F.coalesce(js_trim(http_code).startswith("2"), F.lit(False)), "http_error")
        .when(size.isNull(), "missing")
        .when(size == 0, "empty")
        .when(size > F.lit(MAX_ARCHIVE_BYTES), "too_large")
        .when(~F.coalesce(F.substring(content, 1, 2) == F.lit(b"PK"), F.lit(False)), "not_zip")
        .otherwise("ok")
    )


def looks_like_html(content: Column) -> Column:
    """Hint on a rejected archive; like the source, looks at its first 200 bytes."""
    head = F.substring(content, 1, 200).cast("string")
    return F.coalesce(head.contains("<!DOCTYPE") | head.contains("<html"), F.lit(False))


def size_mib(size: Column) -> Column:
    return F.floor(size / F.lit(1024 * 1024) + F.lit(0.5))
