"""Score purchase lines as they arrive, with a forest fitted in batch.

The batch run fits the forest on all lines and fixes the contamination threshold
(the score quantile), like a fitted detector's decision offset.  New lines then only
need per-row work: a stream-static join with the batch group price statistics, the
line features, the forest score (same Arrow-batched UDF as in batch) and the
comparison with the fixed threshold.  No state is kept between micro-batches.

With a file sink and a checkpoint location the query restarts exactly where it
stopped after a failure (Structured Streaming's file-sink commit protocol).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ledgerlark.functions.moments import moments
from ledgerlark.operators import anomaly, iforest


def batch_group_stats(lines: DataFrame, keys=("vendorid", "productid")) -> DataFrame:
    """Group price statistics of the batch lines (one row per group)."""
    keys = list(keys)
    stats = lines.groupBy(*keys).agg(*moments(lines, "unitprice"))
    return stats.select(*keys, *anomaly.price_stats(lines))


def score_stream(
    stream: DataFrame,
    stats: DataFrame,
    model: iforest.IsolationForestModel,
    threshold: float,
    keys=("vendorid", "productid"),
) -> DataFrame:
    """Label streaming PO lines (``po_line_base`` columns) with the batch model."""
    featured = anomaly.line_features(stream.join(stats, list(keys), "left"))
    scored = iforest.iforest_score(featured, model)
    flagged = anomaly.contamination_flag(scored, "anomaly_raw", threshold=threshold)
    return anomaly.anomaly_label(flagged)


def start_scoring(
    stream: DataFrame,
    stats: DataFrame,
    model: iforest.IsolationForestModel,
    threshold: float,
    out_path: str,
    checkpoint_location: str,
    trigger_seconds: int | None = None,
) -> StreamingQuery:
    """Append labelled lines to parquet at ``out_path`` (exactly-once file sink)."""
    labelled = score_stream(stream, stats, model, threshold)
    w = (
        labelled.writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint_location)
        .outputMode("append")
    )
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
