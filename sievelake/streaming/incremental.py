"""Streams: candidates without repeats, and term profiles kept up to date by micro-batches (extensions of A1 and T4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sievelake.operators.terms import merge_profiles


def distinct_candidates(stream: DataFrame, key: str, time: str, lateness: str = "1 day") -> DataFrame:
    """The first event of each key; state older than the watermark goes."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def keep_profile(batches: DataFrame, root: str, checkpoint: str, score) -> StreamingQuery:
    """Merges each micro-batch's scored terms into the profile: every batch writes a new version under ``root``.

    ``score`` makes (term, score, accepted) rows of a batch. A batch that is run again writes its version again, from the one
    before it, so a lost driver changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        new = score(batch)
        if number:
            new = merge_profiles(batch.sparkSession.read.parquet(f"{root}/version={number - 1}"), new)
        new.write.mode("overwrite").parquet(f"{root}/version={number}")

    return batches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
