"""Near-duplicate texts by the Jaccard similarity of their word shingles.

64-bit SimHash fingerprints of texts with a similarity of 0.8 differ in about
ten bits, at which pigeonring filtering prunes nothing. So texts that SimHash
links (see ``simhash``) are candidates, as are texts that share one of
``BANDS`` bands of ``ROWS`` MinHash values, which finds a pair of similarity
0.8 with a probability of over 0.9995. Candidates meet in groups of bounded
size, where the similarity of their shingle sets (32-bit hashes) is computed;
a spanning forest of each group's links goes on to the components.

Defined results: texts with fewer words than a shingle have one shingle, texts
without words are all similar to each other; null texts are empty; of a group
the row with the smallest doc_id stays, of several rows with it one, and one
without a doc_id only where none has one; an empty table gives an empty result;
other columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, map_arrow, passing, small_enough
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Texts that are compared with each other in one group of rows.
BLOCK = 256

_rng = np.random.default_rng(7)
_FACTORS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A 56-bit key for each band of MinHash values."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None] * _FACTORS[None, :]
        least = np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0))
    mixed = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        mixed = (mixed ^ least.reshape(BANDS, ROWS)[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return (mixed >> np.uint64(8)).astype(np.int64)


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, fp, keys, shingles) of a table of two columns, id and text."""

    def run(batches):
        for batch in batches:
            prints, keys, sets = [], [], []
            for text in batch.column(1).cast(pa.large_binary()).to_pylist():
                hashes = np.array(simhash.shingle_hashes(text or b"", n), np.uint64)
                prints.append(simhash.fingerprint_of(hashes))
                distinct = np.unique(hashes)
                keys.append(band_keys(distinct))
                sets.append(np.unique((distinct >> np.uint64(32)).astype("<u4")).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())],
                ["doc_id", "fp", "keys", "shingles"],
            )

    return map_arrow(docs, run, "doc_id long, fp long, keys array<long>, shingles binary")


def similar_forest(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the texts whose similarity is high enough."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    left, links, frontier = np.ones(len(sets), bool), [], []
    for _ in range(len(sets)):
        if not frontier:
            frontier = [int(np.flatnonzero(left)[0])]
            left[frontier[0]] = False
        pivot = frontier.pop()
        if not left.any():
            break
        mine = sets[pivot]
        if len(mine):
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            both = np.bincount(owner[mine[at] == flat], minlength=len(sets))
            hit = left & (both >= similarity * (sizes + len(mine) - both) - 1e-9)
        else:
            hit = left & (sizes == 0)
        for x in np.flatnonzero(hit):
            links.append((int(ids[pivot]), int(ids[x])))
            frontier.append(int(x))
        left &= ~hit
    return links


def similar_links(made: DataFrame, similarity: float, distance: int) -> DataFrame:
    """(a, b): links between doc_ids of the sketches ``made`` that keep the components."""
    made = made.where("doc_id is not null")
    numbered = F.transform("keys", lambda key, i: F.shiftleft(i.cast("long"), 56).bitwiseOR(key))
    bands = made.select("doc_id", F.explode(numbered).alias("key"))
    prints = made.select("fp").distinct()
    roots = cut(components(simhash.linked_pairs(prints, distance)), "simhash-roots")
    by_print = made.select("doc_id", "fp").join(roots, F.col("fp") == F.col("node"), "left").select("doc_id", F.coalesce("root", "fp").alias("fp_root"))
    # a key of the texts that SimHash links, apart from those of the bands
    last = F.lit(BANDS << 56).cast("long").bitwiseOR(F.shiftrightunsigned(F.xxhash64("fp_root"), 8))
    rows = bands.unionByName(by_print.select("doc_id", last.alias("key"))).distinct()
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("shared_key"))
    rows = cut(rows.join(cut(shared, "shared-bands"), F.col("key") == F.col("shared_key"), "left_semi"), "candidates")
    groups = simhash.spread_buckets(rows, "doc_id", BLOCK).groupBy("key", "pair").agg(F.sort_array(F.collect_set("doc_id")).alias("members"))
    # the same group comes from many bands
    groups = groups.where(F.size("members") > 1).groupBy("members").agg(F.min(F.xxhash64("key", "pair")).alias("group"))
    members = cut(groups.select("group", F.explode("members").alias("member")), "candidate-groups")
    # only the shingles of candidates are sent
    wanted = small_enough(cut(members.select(F.col("member").alias("wanted")).distinct(), "candidate-texts"))
    some = made.select("doc_id", "shingles").join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi")
    full = members.join(some, F.col("member") == F.col("doc_id")).select("group", "doc_id", "shingles")
    full = full.repartition("group").sortWithinPartitions("group", "doc_id")

    def verify(batches):
        group, ids, sets = None, [], []

        def links():
            found = similar_forest(np.array(ids), sets, similarity) if len(ids) > 1 else []
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for g, doc_id, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    yield from links()
                    group, ids, sets = g, [], []
                ids.append(doc_id)
                sets.append(np.frombuffer(data, "<u4"))
        yield from links()

    return map_arrow(full, verify, "a long, b long")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, similarity: float = SIMILARITY, distance: int = simhash.DISTANCE
) -> DataFrame:
    """(doc_id, component_id) of the documents that are similar to another one and not its group's smallest doc_id."""
    with passing(docs.sparkSession) as keep:
        made = cut(sketches(docs.select(F.col(id_col).cast("long"), F.col(text_col)), n), "sketches")
        found = keep(cut(components(similar_links(made, similarity, distance)), "near-roots"))
    return found.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))


def drop_near_texts(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of similar texts."""
    ids = docs.select(F.col("doc_id").cast("long").alias("again"))
    again = cut(ids.groupBy("again").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or again is null").select("again"), "near-twins")
    if not again.limit(1).count():
        gone = near_groups(docs, similarity=similarity).select(F.col("doc_id").alias("near_gone"))
        rows = docs.select(F.struct(*docs.columns).alias("row"))  # the rows' columns keep their names whatever they are
        return rows.join(small_enough(gone), F.col("row")["doc_id"].cast("long") == F.col("near_gone"), "left_anti").select("row.*")
    # rows that share a doc_id or have none are judged by a number of their own; numbers are in the order of doc_id
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    rows = rows.orderBy(F.col("id").asc_nulls_last(), F.xxhash64("text")).withColumn("near_id", F.monotonically_increasing_id())
    rows = cut(rows.select("row", "near_id", "text"), "near-rows")
    gone = near_groups(rows, id_col="near_id", similarity=similarity).select(F.col("doc_id").alias("near_gone"))
    return rows.join(small_enough(gone), F.col("near_id") == F.col("near_gone"), "left_anti").select("row.*")
