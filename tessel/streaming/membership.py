"""Membership of streamed points in an expression of solids.

The solids are a static table, so every micro-batch is the batch plan of ``winding.membership``: no state, no
watermark.  Works in append mode with any sink that takes batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import winding
from ..plans.indicator import Indicator


def classify_stream(points: DataFrame, triangles: DataFrame, expression: Indicator, b: int, cell: int, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that hands each micro-batch with its ``member`` column to ``sink`` (batch, batch id)."""

    def each(batch: DataFrame, number: int) -> None:
        sink(winding.membership(batch, triangles, expression, b, cell), number)

    return points.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
