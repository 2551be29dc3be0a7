"""SimHash near-duplicates with pigeonring filtering (operator 1).

A fingerprint has a bit for every bit that is set in over half of the XXH64
hashes of a text's word shingles. Two fingerprints are linked when they differ
in few bits.

Pigeonring filtering: the 64 bits are a ring of ``segments`` segments. If two
fingerprints differ in at most ``distance`` bits, then from some segment on
every chain of l consecutive segments differs in at most l * distance / segments
bits. So the first segment is equal and, as the second may differ in one bit at
most, one half of it is equal too: these are the bucket keys. Inside a bucket a
pair must pass the budgets of all chain lengths from the key's start before the
full Hamming check.

Only different fingerprints are compared, each once however many documents have
it. A bucket with more fingerprints than ``BLOCK`` is split into blocks, whose
pairs are spread over tasks; of each group of rows only a spanning forest of
its links is emitted, so a dense group of n yields at most n - 1 links.

Defined results: a null text, like one without words, has fingerprint zero and
is linked like any other; a document with fewer words than a shingle has one
shingle; a null doc_id is larger than any other as a component's id (it shows
only where the component has no other); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, passing, small_enough
from .components import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Segments of the ring (bits): 13 + 13 + 13 + 13 + 12.
WIDTHS = (13, 13, 13, 13, 12)
#: Fingerprints of a bucket that are compared with each other in one group of rows.
BLOCK = 2048
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 16


def shingle_hashes(text: bytes, n: int = SHINGLE, seed: int = SEED):
    """XXH64 of every n-word shingle of an ASCII-lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    flat = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, size: at + size + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(flat[a:b], seed) for a, b in zip(starts, ends[n - 1 :])]  # noqa: B905


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    return fingerprint_of(np.array(shingle_hashes(text or b"", n), np.uint64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) from a table of two columns, id and text; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t, n) for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs, run, f"doc_id {docs.schema[0].dataType.simpleString()}, fp long")


def _segments(widths=WIDTHS) -> list[tuple[int, int]]:
    """(shift, width) of each segment, from the highest bits down."""
    ends = list(accumulate(widths))
    return [(64 - e, w) for e, w in zip(ends, widths, strict=True)]


def bucket_keys(fp: str, distance: int, widths=WIDTHS):
    """A column of two keys for each start: an equal segment and an equal half of the next one."""
    parts = _segments(widths)
    keys = []
    for i, (shift, width) in enumerate(parts):
        next_shift, next_width = parts[(i + 1) % len(parts)]
        low = next_width // 2
        first = F.shiftrightunsigned(F.col(fp), shift).bitwiseAND(F.lit((1 << width) - 1))
        for half, (s, w) in enumerate(((next_shift + low, next_width - low), (next_shift, low))):
            second = F.shiftrightunsigned(F.col(fp), s).bitwiseAND(F.lit((1 << w) - 1))
            tag = (i * 2 + half) << 48
            keys.append(F.lit(tag).cast("long").bitwiseOR(F.shiftleft(first, 16)).bitwiseOR(second))
    return F.array(*keys)


def _chain_ok(diff: np.ndarray, start: int, distance: int, parts: list[tuple[int, int]]) -> np.ndarray:
    """Which XORs pass the budgets of all chains from ``start``; the longest is the full Hamming check."""
    total, alive = np.zeros(len(diff), np.int64), np.arange(len(diff))
    ok = np.zeros(len(diff), bool)
    for length in range(1, len(parts) + 1):
        shift, width = parts[(start + length - 1) % len(parts)]
        total = total + np.bitwise_count((diff[alive] >> np.uint64(shift)) & np.uint64((1 << width) - 1))
        keep = total * len(parts) <= length * distance
        total, alive = total[keep], alive[keep]
        if not len(alive):
            return ok
    ok[alive] = True
    return ok


def _forest(fps: np.ndarray, start: int, distance: int, parts) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of one group: every element is compared with those not reached yet."""
    left, out = fps, []
    while len(left) > 1:
        frontier, left = [left[:1]], left[1:]
        while frontier and len(left):
            pivots = frontier.pop()
            for pivot in pivots:
                hit = _chain_ok(left ^ pivot, start, distance, parts)
                if hit.any():
                    found, left = left[hit], left[~hit]
                    out.append((np.full(len(found), pivot, np.uint64), found))
                    frontier.append(found)
                    if not len(left):
                        break
    return out


def spread_buckets(rows: DataFrame, member: str, block: int) -> DataFrame:
    """(key, member, pair) of (key, member): groups of two blocks at most in which all members of a key meet.

    A key with up to ``block`` members is one group. The members of a larger one
    are dealt into blocks, and each goes to all pairs of blocks with its own.
    """
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    hot = cut(sizes.select(F.col("key").alias("hot_key"), F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot-buckets")
    joined = rows.join(small_enough(hot), F.col("key") == F.col("hot_key"), "left")
    own = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, own).cast("long") * F.col("blocks") + F.greatest(x, own))
    )
    return joined.select("key", member, F.explode(pairs).alias("pair"))


def linked_pairs(prints: DataFrame, distance: int = DISTANCE, widths=WIDTHS) -> DataFrame:
    """(a, b): links between the distinct fingerprints of ``prints`` (column fp) that keep its components.

    distance must leave the first segment of a ring's chain no difference and the
    first two at most one: 2 * distance < 2 * len(widths).
    """
    if distance >= len(widths):
        raise ValueError("more segments than differing bits are needed")
    parts = _segments(widths)
    rows = prints.select("fp", F.explode(bucket_keys("fp", distance, widths)).alias("key"))
    spread = spread_buckets(rows, "fp", BLOCK)
    grouped = spread.repartition("key", "pair").sortWithinPartitions("key", "pair", "fp")

    def link(batches):
        held = None
        for batch in batches:
            key, pair = (batch.column(i).to_numpy() for i in (0, 2))
            fp = batch.column(1).to_numpy().view(np.uint64)
            if held is not None:
                key, pair, fp = (np.concatenate(x) for x in zip(held, (key, pair, fp), strict=True))
            if not len(key):
                continue
            last = np.flatnonzero((key != key[-1]) | (pair != pair[-1]))
            done = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch; it is bounded
            held = key[done:], pair[done:], fp[done:]
            yield from compare(key[:done], pair[:done], fp[:done])
        if held is not None:
            yield from compare(*held)

    def compare(key, pair, fp):
        if len(key) < 2:
            return
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]))
        size = np.diff(np.append(first, len(key)))
        starts = (key >> 49).astype(np.int64)
        found = []
        two = first[size == 2]
        for s in range(len(parts)):
            at = two[starts[two] == s]
            ok = _chain_ok(fp[at] ^ fp[at + 1], s, distance, parts)
            found.append((fp[at[ok]], fp[at[ok] + 1]))
        for at, n in zip(first[size > 2], size[size > 2], strict=True):
            found.extend(_forest(fp[at : at + n], int(starts[at]), distance, parts))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return map_arrow(grouped, link, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp (signed long), fingerprint (16 hex digits) and component_id of every row."""
    with passing(docs.sparkSession) as keep:
        base = keep(cut(fingerprints(docs.select(F.col(id_col), F.col(text_col)), n), "fingerprints"))
        prints = cut(base.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
        roots = cut(components(linked_pairs(prints.select("fp"), distance)), "roots")
        named = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
        least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
        named = keep(cut(named.select("fp", "root").join(least, "root").select(F.col("fp").alias("of"), "component_id"), "components"))
    return base.join(named, F.col("fp") == F.col("of")).select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
