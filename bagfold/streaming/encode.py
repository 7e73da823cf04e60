"""Encoding a stream of bags: with the repetitions chosen and the projection fitted, each row is encoded on its own, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.retrieval import Offline, _projected


def encoded_stream(bags: DataFrame, built: Offline) -> DataFrame:
    """(id, vec) of a streaming (or batch) frame of document bags, as the index holds them."""
    return _projected(bags, built.config, built.reps, built.model, "document" if built.hybrid else "standardised")


def write_index(bags: DataFrame, built: Offline, path: str, checkpoint: str):
    """Append the vectors of arriving bags to ``path``; returns the running query."""
    return encoded_stream(bags, built).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
