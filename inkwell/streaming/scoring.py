"""Scoring of documents as they arrive, against a static profile: stateless, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from inkwell.api import Profile


def measured_stream(docs: DataFrame, areas: tuple[str, ...] | None = None) -> DataFrame:
    """Row metrics of a stream of (chunk_id, document, text): a projection, with no shuffle and no state."""
    from inkwell.operators.measure import prepared, wide

    return wide(prepared(docs), areas)


def score_stream(docs: DataFrame, profile: Profile, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends each micro-batch's chunk scores to a Parquet folder. A batch that is run again overwrites its own folder."""

    def scored(batch: DataFrame, number: int) -> None:
        profile.score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(scored).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
