"""Incremental runs.  The evidence queries are batch queries; what comes in
pieces (records of fetches, requests against a cache) is taken up by a stream
that appends each unseen key once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sinks.store import SnapshotStore


def append_unseen(arriving: DataFrame, store: str, keys: list[str], checkpoint: str, name: str = "stream", schema_version: int = 1):
    """Start a stream that appends rows whose keys the store lacks.  A batch reads
    the index of keys only, and is one commit under its number, so a batch that runs
    again after a failure is stored once, whether or not it was published.  ``name``
    tells streams into one store apart."""
    kept = SnapshotStore(arriving.sparkSession, store, keys, schema_version)

    def one(batch: DataFrame, number: int) -> None:
        SnapshotStore(batch.sparkSession, kept.root, keys, schema_version).commit(batch, tag=f"{name}-{number}", known="skip")

    return arriving.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
