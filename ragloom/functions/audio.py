"""Guards on audio bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragloom.functions.fixed import AUDIO_MAGIC, AUDIO_TYPES, MAX_AUDIO_MB


def guard(data: Column, max_mb: float = MAX_AUDIO_MB) -> Column:
    """'empty', 'too_large' or null; exactly the limit passes."""
    size = F.coalesce(F.octet_length(data), F.lit(0))
    return F.when(size == 0, "empty").when(size > int(max_mb * 1024 * 1024), "too_large")


def sniff(data: Column) -> Column:
    """MIME type by leading bytes, or null; never a reason to reject."""
    out = F.lit(None).cast("string")
    for magic, mime in reversed(AUDIO_MAGIC):
        out = F.when(F.startswith(F.hex(F.substring(data, 1, 4)), F.lit(magic)), mime).otherwise(out)
    return out


def unusual(content_type: Column) -> Column:
    """Only a warning."""
    return F.coalesce((content_type != "") & ~F.lower(content_type).isin(AUDIO_TYPES), F.lit(False))


def duration_ms(data: Column) -> Column:
    """16 kHz, 16 bit, mono: 32 bytes a millisecond; null if empty."""
    size = F.octet_length(data)
    return F.when(size > 0, F.expr("1") * F.floor(size / 32)).cast("long")
