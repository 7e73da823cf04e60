"""Encoding a stream of single vectors, with state.

The vectors of a bag arrive one by one, in any order, late or more than once. For each bag the state keeps the sum and the count of each bucket that it has met, and which
places it has seen; a place counts once, as it first came. So at any time the state gives the encoding of the bag as far as it has arrived, and at last that of
the whole bag. Updates touch the buckets of the arriving vectors only. State lies in the RocksDB store, which the session has to name (``use_rocksdb``).

Rows without an id, a place or a vector are left out. Empty buckets are zeros: filling needs the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import EncoderConfig, Encoding
from ..operators import encode as enc
from ..plans.retrieval import Offline, projected_rows
from ..runtime import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(PROVIDER, ROCKSDB)


class BagEncoder(StatefulProcessor):
    """Keeps sums and counts of a bag's buckets; ``built`` projects the encoding as its index does. State that isn't touched for ``keep_ms`` goes."""

    def __init__(self, config: EncoderConfig, reps: list[int], built: tuple | None, keep_ms: int | None):
        self.config, self.reps, self.built, self.keep_ms = config, reps, built, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.encoder = enc.Encoder(self.config, self.reps)
        self.buckets = handle.getMapState("buckets", "slot int", "sums array<double>, n long", ttlDurationMs=self.keep_ms)
        self.seen = handle.getMapState("seen", "pos long", "here boolean", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: dict[int, np.ndarray] = {}
        for part in rows:
            for pos, vec in zip(part["pos"], part["vec"], strict=True):
                if int(pos) not in new and not self.seen.containsKey((int(pos),)):
                    new[int(pos)] = np.asarray(vec, np.float32)
        if not new:
            return  # nothing but repetitions
        if any(len(v) != self.config.dimension for v in new.values()):
            raise ValueError(f"vectors must have {self.config.dimension} numbers")
        for pos in new:
            self.seen.updateValue((pos,), (True,))
        places = sorted(new)
        parts, projected = self.encoder.looked_up(np.stack([new[p] for p in places]))
        for j in range(len(self.reps)):
            slots, which = np.unique(parts[:, j], return_inverse=True)
            for s, slot in enumerate(slots.tolist()):
                at = (j * self.config.buckets + slot,)
                sums, n = projected[j][which == s].sum(0), int((which == s).sum())
                if self.buckets.containsKey(at):
                    before = self.buckets.getValue(at)
                    sums, n = sums + np.asarray(before[0]), n + before[1]
                self.buckets.updateValue(at, (sums.tolist(), n))
        yield self.encoding(key)

    def encoding(self, key) -> pd.DataFrame:
        dense = np.zeros((1, len(self.reps), self.config.buckets, self.config.width))
        flat, total = dense.reshape(-1, self.config.width), 0
        for (slot,), (sums, n) in self.buckets.iterator():
            flat[slot] = np.asarray(sums) / (n if self.config.encoding is Encoding.AVERAGE else 1)
            total += n if slot < self.config.buckets else 0  # every repetition has each vector once
        out = self.encoder.final(dense)
        if self.built is not None:
            out = projected_rows(self.built[0], out, self.built[1])
        return pd.DataFrame({"id": [key[0]], "vec": [out[0].tolist()], "vectors": [total]})

    def close(self) -> None:
        pass


def encoded_tokens(tokens: DataFrame, config: EncoderConfig, reps: list[int] | None = None, built: Offline | None = None, keep_ms: int | None = None) -> DataFrame:
    """(id, vec, vectors) of each bag that has new vectors among a micro-batch of ``tokens`` (id, pos, vec): its encoding so far and how many vectors that holds."""
    if config.fill_empty:
        raise ValueError("a stream can't fill empty buckets")
    ship(tokens.sparkSession)
    how = None if built is None else (built.model, "document" if built.hybrid else "standardised")
    rows = tokens.filter("id is not null and pos is not null and vec is not null").select("id", F.col("pos").cast("long").alias("pos"), F.col("vec").cast("array<float>").alias("vec"))
    processor = BagEncoder(config, config.chosen(reps), how, keep_ms)
    schema = f"id {dict(tokens.dtypes)['id']}, vec array<double>, vectors long"
    return rows.groupBy("id").transformWithStateInPandas(processor, schema, "Update", "ProcessingTime" if keep_ms else "None")
