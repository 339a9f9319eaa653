"""Row-wise expressions on streams.

Masks, scrubbing, normal forms, filters and document rules are plain projections, so they
take a streaming frame as they are.  There is no stateful operator here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def stream_to_parquet(source: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Write a transformed stream to Parquet, processing what is there and then stopping.

    ``path`` and ``checkpoint`` belong in shared storage; the file sink is exactly-once, so
    a lost executor or a restart neither drops nor repeats rows.
    """
    if not source.isStreaming:
        raise ValueError("the source is not a stream")
    return (
        transform(source).writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
