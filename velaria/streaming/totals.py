"""The live feed as a stream: minute totals with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from velaria.operators.feed import minute_totals


def minute_totals_stream(events: DataFrame, late: str = "5 minutes") -> DataFrame:
    """One-minute totals of a stream of live events; a window closes `late` after its minute."""
    return minute_totals(events.withWatermark("at", late))
