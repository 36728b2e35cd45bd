"""Number and text formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_text(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with two digits; null for null."""
    return (
        F.when(n.isNull(), F.lit(None).cast("string"))
        .when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024**2, F.format_string("%.2f KB", n / 1024.0))
        .when(n < 1024**3, F.format_string("%.2f MB", n / 1024.0**2))
        .otherwise(F.format_string("%.2f GB", n / 1024.0**3))
    )


def percent_text(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100.0)


def trimmed(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\s\p{Z}\u0085]+", ""), r"[\s\p{Z}\u0085]+$", "")


def tag(tags: Column, name: str, default: str = "unknown") -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(name)), F.lit(default))


def require(value: Column, ok: Column, message: str) -> Column:
    """The value, or an error at run time where `ok` isn't true."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("string").cast("double"))
