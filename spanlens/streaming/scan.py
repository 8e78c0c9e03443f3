"""Rule scans over a stream of texts: every step is local to a row, so the batch operators run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.detect import flat, scan_text


def scan_stream(rows: DataFrame, watermark: tuple[str, str] | None = None, **options) -> DataFrame:
    """Spans of a streaming DataFrame with a text column. watermark: (time column, delay), for what is aggregated after it."""
    if watermark is not None:
        rows = rows.withWatermark(*watermark)
    return flat(scan_text(rows, **options))


def counts_by_window(found: DataFrame, time: str, width: str = "5 minutes") -> DataFrame:
    """Hits by window and detector; rows later than the watermark are left out by the engine."""
    from pyspark.sql import functions as F

    return found.groupBy(F.window(time, width), "detector").agg(F.count("*").alias("hits"))
