"""Feeding a store from a stream of N-Triples lines."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.triples import TripleStore
from ..sources.turtle import ntriples_lines


def ingest(lines: DataFrame, store: TripleStore, checkpoint: str, delete: bool = False, **trigger) -> StreamingQuery:
    """Every micro-batch of a stream with one column of lines becomes a version of the store.

    A batch that is run again after a failure is committed once: versions bear
    the stream's name, made from its checkpoint, and the batch's number.
    """
    stream = f"{zlib.crc32(checkpoint.encode()):08x}"

    def commit(batch: DataFrame, number: int) -> None:
        triples = ntriples_lines(batch)
        (store.delete if delete else store.insert)(triples)
        try:
            store.commit(f"{stream}-{number}")
        except Exception:
            store.rollback()  # the batch comes again
            raise

    writer = lines.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
