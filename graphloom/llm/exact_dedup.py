"""Exact deduplication with counting quotient filters (operator 5).

Each task builds counting quotient filters over 64-bit text fingerprints. A
filter keeps the fingerprints' low bits (remainders) sorted inside the run of
their high bits (quotient), with a counter where a fingerprint occurs more than
once, so filters merge without loss by merging their sorted remainders. Only
texts whose merged count is above one are compared byte by byte.

Defined results: a null text counts as the empty text; a null doc_id is smaller
than any other; of rows with the same doc_id and text one, whichever, is kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, eq, map_arrow, passing, small_enough

#: Fingerprints that one filter takes before a task starts the next one.
FILTER_ROWS = 1 << 20
#: Fingerprints that a merge task shall have on average.
BLOCK_ROWS = 1 << 16


class CountingQuotientFilter:
    """Bulk-built filter over ``bits``-wide fingerprints that share their higher bits."""

    def __init__(self, bits: int, qbits: int, occupied, runends, remainders, counted, counts):
        self.bits, self.qbits = bits, qbits
        self.occupied, self.runends = occupied, runends
        self.remainders, self.counted, self.counts = remainders, counted, counts

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """keys: sorted and distinct uint64 values below 2**bits."""
        n = len(keys)
        qbits = min(bits, max(1, math.ceil(math.log2(max(n, 1) / 0.75 + 1))))
        rbits = bits - qbits
        quotients = keys >> np.uint64(rbits) if rbits < 64 else np.zeros(n, np.uint64)
        occupied = np.zeros(1 << qbits, bool)
        occupied[quotients.astype(np.int64)] = True
        runends = np.ones(n, bool)
        runends[:-1] = quotients[1:] != quotients[:-1]
        remainders = keys & np.uint64((1 << rbits) - 1)
        counted = counts > 1
        return cls(bits, qbits, occupied, runends, remainders, counted, counts[counted])

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, sorted, and their counts."""
        starts = np.ones(len(self.runends), bool)
        starts[1:] = self.runends[:-1]
        run = np.cumsum(starts) - 1
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)[run]
        keys = (quotients << np.uint64(self.bits - self.qbits)) | self.remainders
        counts = np.ones(len(keys), np.int64)
        counts[self.counted] = self.counts
        return keys, counts

    def to_bytes(self) -> bytes:
        width = max(1, -(-(self.bits - self.qbits) // 8))
        packed = np.ascontiguousarray(self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
        head = struct.pack("<BBqq", self.bits, self.qbits, len(self.remainders), len(self.counts))
        parts = [np.packbits(x).tobytes() for x in (self.occupied, self.runends, self.counted)]
        return b"".join([head, *parts, packed.tobytes(), self.counts.astype("<i8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, qbits, n, n_counts = struct.unpack_from("<BBqq", data)
        at, flags = struct.calcsize("<BBqq"), []
        for size in (1 << qbits, n, n):
            flags.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        width = max(1, -(-(bits - qbits) // 8))
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        counts = np.frombuffer(data, "<i8", n_counts, at + n * width).astype(np.int64)
        return cls(bits, qbits, flags[0], flags[1], wide.reshape(-1).view("<u8").astype(np.uint64), flags[2], counts)

    @classmethod
    def merge(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Lossless: the sum of all counts of each fingerprint."""
        parts = [f.entries() for f in filters]
        keys, counts = _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        return cls.build(keys, counts, filters[0].bits)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of all values of the single column of ``prints`` that occur more than once."""
    block_bits = max(4, math.ceil(math.log2(max(rows, 1) / BLOCK_ROWS + 1)))
    bits = 64 - block_bits

    def build(batches):
        held: list[np.ndarray] = []

        def filters():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            blocks = (keys >> np.uint64(bits)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
            low = keys & np.uint64((1 << bits) - 1)
            out = [
                CountingQuotientFilter.build(low[a:b], counts[a:b], bits).to_bytes()
                for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)
            ]
            return pa.RecordBatch.from_arrays([pa.array(blocks[cuts], pa.int64()), pa.array(out, pa.binary())], ["block", "filter"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, held)) >= FILTER_ROWS:
                yield filters()
        if held:
            yield filters()

    def merge(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        merged = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x) for x in group.column("filter").to_pylist()])
        keys, counts = merged.entries()
        keys, counts = keys[counts > 1], counts[counts > 1]
        keys = keys | np.uint64(block << bits)
        return pa.table({"fp": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

    return map_arrow(prints, build, "block long, filter binary").groupBy("block").applyInArrow(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs``."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    base = base.withColumn("fp", F.xxhash64("body"))
    with passing(docs.sparkSession) as keep:
        slim = keep(cut(base.select("doc_id", "fp", F.sha2("body", 256).alias("sha"), F.monotonically_increasing_id().alias("row")), "exact-slim"))
        repeated = cut(repeated_fingerprints(slim.select("fp"), slim.count()), "exact-repeated")
        # equal bytes meet in one group; each task sends one row for each of its distinct texts
        groups = (
            base.join(small_enough(repeated.select("fp")), "fp", "left_semi")
            .groupBy("fp", "body")
            .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .where("group_size > 1")
            .select(F.col("fp").alias("g_fp"), F.sha2("body", 256).alias("g_sha"), "keep_id", "group_size")
        )
        groups = small_enough(cut(groups, "exact-groups"))
        same = (F.col("fp") == F.col("g_fp")) & (F.col("sha") == F.col("g_sha"))
        # several rows may have a group's largest doc_id: the first of them stays
        stays = slim.join(groups, same & eq((F.col("doc_id"), F.col("keep_id")))).groupBy("g_fp", "g_sha").agg(
            F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"), F.min("row").alias("keep_row")
        )
        found = slim.join(small_enough(keep(cut(stays, "exact-stays"))), same, "left")
    return found.select(
        "doc_id", F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"),
    )
