"""The boundary filter over a stream: a stateless join with a static table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from rangeloom.operators.boundaries import apply_boundaries


def filter_stream(stream: DataFrame, boundaries: DataFrame, params: dict[str, Column], **options) -> DataFrame:
    """Rows of a stream inside their class's ranges; needs no state and no watermark."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return apply_boundaries(stream, boundaries, params, **options)
