"""Substring deduplication with sliding sentence spans (operator 2).

A text is cut into sentences. From every sentence on, and up to every sentence,
the shortest run of consecutive sentences with ``MIN_WORDS`` words is hashed to
128 bits. Runs are joined globally: of all runs with the same hash the first, by
doc_id and position, stays, and sentences covered by any other one are removed.

Passages that begin or end inside sentences are found by their words: of all
stretches of ``PASSAGE`` words with the same words the first, by doc_id and
position, stays, and words covered by any other one are removed, unless it
overlaps the first one. Not every stretch is sent: one of its ``ANCHOR``-word
parts, the one with the least hash, stands for it. Only where such an anchor
repeats and one of its stretches is not yet removed with sentences, stretches
are hashed (64 bits, besides the anchor's 64) and joined.

A sentence ends at ``.``, ``!`` or ``?`` before white space, at their full-width
forms and at a line break. Runs and stretches are compared by their words only:
letters, digits and bytes beyond ASCII, A-Z lower-cased. The white space behind
a sentence goes with it, and all up to the next word goes with a stretch; what
stays is not changed.

Skew: equal hashes are counted on the map side first, and the join back to the
runs is one that Spark splits, so a run that most documents share is spread.
Where doc_ids repeat or several are null, removals are gathered by doc_id and a
hash of the text, so that such rows are spread and a list is of one text.

Defined results: a null or empty text has no sentence and becomes the empty
text; texts with fewer words than a run keep all; rows with the same doc_id
count as one place where they have the same run at the same position, so all
keep it; a null doc_id comes first; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, eq, forget, map_arrow, small_enough

MIN_WORDS = 20
#: Words of a stretch that is found wherever it begins, and of the part that stands for it.
PASSAGE, ANCHOR = 50, 16
#: Bytes of text whose words are hashed at once.
CHUNK = 1 << 18

_END = re.compile(rb"(?:[.!?]+[\"')\]]*(?=\s)|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\n)\s*")
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def sentences(text: bytes) -> list[bytes]:
    """Pieces that make up the text."""
    ends = [m.end() for m in _END.finditer(text)]
    if len(text) and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return [text[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


def runs(pieces: list[bytes], min_words: int = MIN_WORDS) -> dict[tuple[int, int], bytes]:
    """The hash of every run, by its first and last sentence."""
    words = [_WORD.findall(p.lower()) for p in pieces]
    upto = [0, *accumulate(map(len, words))]
    n, found, keys = len(pieces), set(), [b" ".join(w) for w in words]
    last = 0
    for first in range(n):  # the shortest run from each sentence on; its end never moves back
        while last < n and upto[last + 1] - upto[first] < min_words:
            last += 1
        if last == n:
            break
        if words[first]:
            found.add((first, last))
    first = n - 1
    for last in range(n - 1, -1, -1):  # and up to each sentence
        first = min(first, last)
        while first >= 0 and upto[last + 1] - upto[first] < min_words:
            first -= 1
        if first < 0:
            break
        if words[last]:
            found.add((first, last))
    return {(a, b): xxhash.xxh3_128_digest(b" ".join(k for k in keys[a : b + 1] if k)) for a, b in found}


_rng = np.random.default_rng(11)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_IS_WORD = np.array([bool(_WORD.fullmatch(bytes([c]))) for c in _LOWER])
_CODES = np.where(_IS_WORD, _rng.integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER], np.uint64(0))
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of the base and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _windows(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each values[start:end] that depends on the order, but not on the start."""
    up, down = _power(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    out = (sums[ends] - sums[starts]) * down[starts]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


class Passages:
    """The words of some texts, and the stretches of ``PASSAGE`` words that lie in one text.

    starts, ends: where words are, in bytes from the first text's start; first:
    the first word of each stretch; key, anchor: its hash and its anchor's;
    group: where stretches begin that have another anchor than those before.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """offsets: where texts begin in data, and the end of the last."""
        word = np.zeros(len(data) + 1, bool)
        word[:-1] = _IS_WORD[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edges] = word[edges]  # a word ends with its text
        ends[edges - 1] = word[edges - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        words = _windows(_CODES[data], self.starts, self.ends)
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        n = max(0, len(words) - PASSAGE + 1)
        at = np.arange(n)
        parts = _windows(words, np.arange(n + PASSAGE - ANCHOR), np.arange(ANCHOR, n + PASSAGE)) if n else words[:0]
        if n:
            view = np.lib.stride_tricks.sliding_window_view(parts, PASSAGE - ANCHOR + 1)
            least = at + view.argmin(axis=1)
        else:
            least = at
        inside = self.text[at] == self.text[at + PASSAGE - 1] if n else np.zeros(0, bool)
        self.first = at[inside]
        least = least[inside]
        self.anchor = parts[least].view(np.int64)
        self.key = _windows(words, self.first, self.first + PASSAGE).view(np.int64)
        self.group = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]])) if len(least) else least
        self.group_end = np.append(self.group[1:], len(least))[: len(self.group)]

    def upto(self, first: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the next word begins behind stretches, or their text ends."""
        return np.minimum(np.append(self.starts, offsets[-1])[np.minimum(first + PASSAGE, len(self.starts))], offsets[self.text[first] + 1])


def _chunks(column: pa.Array):
    """(first row, Passages, offsets) for some texts of a column at a time."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        own = offsets[row : end + 1]
        if own[-1] > own[0]:
            yield row, Passages(data[own[0] : own[-1]], own - own[0]), own - own[0]
        row = end


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(h, doc_id, lo, hi): the anchors of a table of two columns, id and text, and the bytes that their stretches cover."""

    def run(batches):
        for batch in batches:
            for row, found, offsets in _chunks(batch.column(1)):
                head, tail = found.first[found.group], found.first[found.group_end - 1] + PASSAGE - 1
                text = found.text[head]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.anchor[found.group]), batch.column(0).take(pa.array(text + row)), pa.array((found.starts[head] - offsets[text]).astype(np.int32)), pa.array((found.ends[tail] - offsets[text]).astype(np.int32))],
                    ["h", "doc_id", "lo", "hi"],
                )

    return map_arrow(docs, run, f"h long, doc_id {docs.schema[0].dataType.simpleString()}, lo int, hi int")


def _flat(column: pa.ListArray, *names: str) -> list[np.ndarray]:
    """Fields of the structs in all lists; the last two are bytes of a text and made apart for each row."""
    row = pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
    items = column.flatten()
    fields = [items.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]
    return [*fields[:-2], fields[-2] + (row << 32), fields[-1] + (row << 32)]


def uncovered(anchors: DataFrame) -> DataFrame:
    """(h): the anchors with a stretch that is not in removed sentences, from (hs, gone) of documents."""

    def run(batches):
        for batch in batches:
            h, lo, hi = _flat(batch.column(0), "h", "lo", "hi")
            first, last = _flat(batch.column(1), "first", "last")
            order = np.argsort(first, kind="stable")
            first, last = first[order], np.maximum.accumulate(last[order])  # merged where they touch
            new = first[1:] > last[:-1]
            first, last = first[np.append(True, new)[: len(first)]], last[np.append(new, True)[: len(last)]]
            at = np.searchsorted(first, lo, side="right")
            yield pa.RecordBatch.from_arrays([pa.array(h[np.append(-1, last)[at] < hi])], ["h"])

    return map_arrow(anchors, run, "h long").distinct()


def passage_rows(docs: DataFrame) -> DataFrame:
    """(key, anchor, doc_id, lo, hi): stretches whose anchors are listed, of a table of id, text and anchors; hi: the next word."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            for row, found, offsets in _chunks(batch.column(1)):
                # what is listed for one text is listed for all that have it
                listed = np.isin(found.anchor[found.group], lists.slice(row, len(offsets) - 1).flatten().to_numpy(zero_copy_only=False))
                take = np.repeat(listed, found.group_end - found.group)
                first, text = found.first[take], found.text[found.first[take]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.key[take]), pa.array(found.anchor[take]), batch.column(0).take(pa.array(text + row)), pa.array((found.starts[first] - offsets[text]).astype(np.int32)), pa.array((found.upto(first, offsets) - offsets[text]).astype(np.int32))],
                    ["key", "anchor", "doc_id", "lo", "hi"],
                )

    return map_arrow(docs, run, f"key long, anchor long, doc_id {docs.schema[0].dataType.simpleString()}, lo int, hi int")


def repeated_passages(base: DataFrame, again: DataFrame, own_id: Column) -> DataFrame:
    """(of, passages): stretches of ``PASSAGE`` words that an earlier place has, for documents; ``again`` has their removed runs."""
    anchors = cut(anchor_rows(base), "anchors")
    held = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(own_id.alias("doc_id"), "lo")).alias("holder")).where("n > 1")
    held = cut(held.select("h", F.col("holder.doc_id").alias("h_doc"), F.col("holder.lo").alias("h_lo")), "repeated-anchors")
    later = (
        anchors.join(held, "h")
        .where(~(eq((own_id, F.col("h_doc"))) & (F.col("lo") == F.col("h_lo"))))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("h", "lo", "hi")).alias("hs"))
    )
    wanted = cut(uncovered(later.join(again, eq((F.col("doc_id"), F.col("of"))), "left").select("hs", "gone")), "open-anchors")
    wanted = anchors.join(wanted, "h", "left_semi").groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("h").alias("anchors"))
    wanted = cut(wanted, "asked-anchors")
    forget(anchors)
    asked = base.join(wanted.hint("shuffle_hash"), eq((F.col("doc_id"), F.col("of")))).select("doc_id", "text", "anchors")
    rows = cut(passage_rows(asked), "passages")
    first = rows.groupBy("key", "anchor").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(own_id.alias("doc_id"), "lo", "hi")).alias("holder")).where("n > 1")
    first = cut(first.select("key", "anchor", F.col("holder.doc_id").alias("h_doc"), F.col("holder.lo").alias("h_lo"), F.col("holder.hi").alias("h_hi")), "repeated-passages")
    return (
        rows.join(first, ["key", "anchor"])
        .where(~(eq((own_id, F.col("h_doc"))) & (F.col("lo") < F.col("h_hi"))))
        .groupBy(F.col("doc_id").alias("of"))
        .agg(F.collect_set(F.struct("key", "lo", "hi")).alias("passages"))
    )


def span_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """(h1, h2, doc_id, first, last): every run of a table of two columns, id and text, and its first byte and end."""

    def made(ids, digests, rows, firsts, lasts):
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), ids.take(pa.array(rows, pa.int64())), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())],
            ["h1", "h2", "doc_id", "first", "last"],
        )

    def run(batches):
        for batch in batches:
            held, size = ([], [], [], []), 0
            for row, text in enumerate(batch.column(1).cast(pa.large_binary())):
                text = text.as_py()
                if text:
                    pieces = sentences(text)
                    own, ends = runs(pieces, min_words), [0, *accumulate(map(len, pieces))]
                    for column, more in zip(held, (own.values(), [row] * len(own), [ends[a] for a, _ in own], [ends[b + 1] for _, b in own]), strict=True):
                        column.extend(more)
                    size += len(text)
                    if size >= CHUNK:
                        yield made(batch.column(0), *held)
                        held, size = ([], [], [], []), 0
            yield made(batch.column(0), *held)

    return map_arrow(docs, run, f"h1 long, h2 long, doc_id {docs.schema[0].dataType.simpleString()}, first int, last int")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, passages: bool = True) -> DataFrame:
    """doc_id, n_sentences, n_removed (also those removed in part), removed and text (what stays) of every row.

    passages: whether repeated stretches that begin or end inside sentences go too.

    removed: the removed stretches as ``start:end`` in code points, end exclusive, joined by commas.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, own_id, twin = base.schema["doc_id"].dataType.simpleString(), F.col("doc_id"), F.lit(False)
    twins = base.groupBy(F.col("doc_id").alias("of")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("of")
    if twins.limit(1).count():
        twins = cut(twins, "repeated-ids").select("of", F.lit(True).alias("twin"))
        base = base.join(small_enough(twins), eq((F.col("doc_id"), F.col("of"))), "left")
        base = base.select(F.struct(F.col("doc_id").alias("id"), F.when(F.col("twin"), F.xxhash64("text")).alias("mark")).alias("doc_id"), "text")
        own_id, twin = F.col("doc_id")["id"], F.col("doc_id")["mark"].isNotNull()
    spans = cut(span_rows(base, min_words), "spans")
    held = spans.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(own_id.alias("doc_id"), "first")).alias("holder")).where("n > 1")
    held = cut(held.select("h1", "h2", F.col("holder.doc_id").alias("h_doc"), F.col("holder.first").alias("h_first")), "repeated-spans")
    again = (
        spans.join(held, ["h1", "h2"])
        .where(~(eq((own_id, F.col("h_doc"))) & (F.col("first") == F.col("h_first"))))
        .groupBy(F.col("doc_id").alias("of"))
        .agg(F.collect_set(F.struct("h1", "first", "last")).alias("gone"))
    )
    again = cut(again, "span-drops")
    forget(spans)
    more = cut(repeated_passages(base, again, own_id), "passage-drops") if passages else again.select("of", F.array().cast("array<struct<key:long,lo:int,hi:int>>").alias("passages")).limit(0)
    drops = again.unionByName(more, allowMissingColumns=True)
    # each row has one of the two
    drops = drops.groupBy("of").agg(*[F.first(c, True).alias(c) for c in ("gone", "passages")])
    joined = base.join(drops.hint("shuffle_hash"), eq((F.col("doc_id"), F.col("of"))), "left").select("doc_id", "text", "gone", "passages", twin.alias("twin"))

    def rebuild(batches):
        for batch in batches:
            totals, counts, removed, kept = [], [], [], []
            gone, passages = _listed(batch.column(2)), _listed(batch.column(3))
            for row, (text, twin) in enumerate(zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                text = text or b""
                pieces = sentences(text)
                ends = [0, *accumulate(map(len, pieces))]
                runs_h, *run_at = gone(row)
                keys, *at = passages(row)
                if twin and len(runs_h):  # rows that share a doc_id and a hash may differ in text
                    own = _own_runs(pieces, ends, runs_h, *run_at)
                    run_at = [x[own] for x in run_at]
                if twin and len(keys):
                    own = _own_passages(text, keys, at[0])
                    at = [x[own] for x in at]
                depth = np.zeros(len(text) + 1, np.int32)
                for lows, highs in (run_at, at):
                    np.add.at(depth, lows, 1)
                    np.add.at(depth, highs, -1)
                away = np.cumsum(depth[:-1]) > 0
                totals.append(len(ends) - 1)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], away.view(np.int8), [0]]))).tolist()
                counts.append(int(np.logical_or.reduceat(away, ends[:-1]).sum()) if edges else 0)
                removed.append(_stretches(text, edges))
                kept.append(b"".join(text[a:b] for a, b in zip([0, *edges[1::2]], [*edges[::2], len(text)], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_sentences", "n_removed", "removed", "text"],
            )

    held = base.schema["doc_id"].dataType.simpleString()
    out = map_arrow(joined, rebuild, f"doc_id {held}, n_sentences long, n_removed long, removed string, text string")
    return out if held == kind else out.withColumn("doc_id", own_id)


def _listed(column: pa.ListArray):
    """The fields of the structs in the list of a row, none where it is null."""
    offsets, fields = column.offsets.to_numpy(), [x.to_numpy(zero_copy_only=False) for x in column.values.flatten()]
    null = column.is_null().to_pylist()
    return lambda row: [x[:0] if null[row] else x[offsets[row] : offsets[row + 1]] for x in fields]


def _own_runs(pieces: list[bytes], ends: list[int], hashes: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Which of the removed runs are in this text."""
    nth, own = {end: n for n, end in enumerate(ends)}, []
    for h, first, last in zip(hashes.tolist(), firsts.tolist(), lasts.tolist(), strict=True):
        a, b = nth.get(first), nth.get(last)
        words = [] if a is None or b is None else [w for p in pieces[a:b] for w in _WORD.findall(p.lower())]
        own.append(bool(words) and int.from_bytes(xxhash.xxh3_128_digest(b" ".join(words))[:8], "little", signed=True) == h)
    return np.array(own, bool)


def _own_passages(text: bytes, keys: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """Which of the removed stretches are in this text."""
    found = Passages(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    own = set(zip(found.key.tolist(), found.starts[found.first].tolist(), strict=True))
    return np.array([x in own for x in zip(keys.tolist(), lows.tolist(), strict=True)], bool)


def _stretches(text: bytes, edges: list[int]) -> str:
    if not edges:
        return ""
    upto = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])[edges]
    return ",".join(f"{a}:{b}" for a, b in upto.reshape(-1, 2))
