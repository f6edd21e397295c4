"""Continuous ingest: landing folder to request table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from hitledger.plans.ingest import finish_requests, judged_requests, refused
from hitledger.sources import rollups as stored_rollups
from hitledger.sources.sinks import append_requests


def dedupe_stream(df: DataFrame, *, delay: str = "60 seconds") -> DataFrame:
    """Drop repeats that arrive within ``delay`` of each other; rows later than that are dropped too.

    For live views. Stored data is de-duplicated against the table instead, which keeps late rows.
    """
    return df.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["request_hash"])


def start_ingest(
    lines: DataFrame,
    table_path: str,
    checkpoint: str,
    *,
    parser: str = "auto",
    places: Callable[[DataFrame], DataFrame] | None = None,
    rejects_path: str | None = None,
    rollups: Mapping[str, Sequence[str]] | None = None,
    interval: str | None = "30 seconds",
) -> StreamingQuery:
    """Parse, enrich, de-duplicate and append each micro-batch.

    ``places`` maps a batch's client addresses to their places, so only addresses seen in the batch
    are looked up. ``rejects_path`` takes what is not stored, with reasons, by batch number: a retried batch
    replaces its own. ``rollups`` names hourly rollups by folder, with their keys: the hours a batch touches are
    made anew in each, after the append, so a retry mends them. ``interval=None`` processes what is there and stops. Every batch adds a file or more to
    the months it touches; ``sinks.compact`` merges them.

    Parsing is part of the stream, so its plan is made once and not for each batch. With ``rejects_path`` the
    batch's lines themselves are needed, and each batch plans its parsing.
    """
    by_batch = rejects_path is not None
    several = by_batch or places is not None  # else only the append reads a batch, and keeps it itself
    source = lines if by_batch else judged_requests(lines, parser=parser)

    def store(batch: DataFrame, batch_id: int) -> None:
        judged = judged_requests(batch, parser=parser) if by_batch else batch
        if several:
            judged = judged.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good = judged.filter("broken_rule = ''").drop("broken_rule")
            dimension = places(good.select("client_ip").distinct()) if places else None
            hours = append_requests(finish_requests(good, dimension), table_path)
            for path, keys in (rollups or {}).items():
                stored_rollups.refresh(batch.sparkSession, table_path, path, hours, keys)
            if by_batch:
                refused(batch, judged).write.mode("overwrite").parquet(f"{rejects_path}/batch={batch_id}")
        finally:
            if several:
                judged.unpersist()

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = source.writeStream.foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
