"""Extension: adjudication of a stream of samples. It is row by row, so it needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators.critics import Policy, adjudicate, decisions


def adjudicate_stream(samples: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Decisions on a streaming (or static) table of samples; the same plan as over a table."""
    return decisions(adjudicate(samples, policy))


def write_decisions(samples: DataFrame, path: str, checkpoint: str, policy: Policy = Policy(), once: bool = True) -> StreamingQuery:
    """Append decisions to Parquet; with `once`, of what is there now."""
    writer = adjudicate_stream(samples, policy).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
