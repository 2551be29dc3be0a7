"""Packing by lexical retrieval (operator 10).

Texts become token ids. Documents with the same telling terms (highest tf-idf)
are ranged into the same task, which cuts them into shards of bounded size. A
shard has a BM25 inverted index, with document frequencies and lengths of the
whole corpus. A window starts with a seed document; the index returns the
seed's best unused neighbours, which fill the window greedily. The document
that is cut at the window's end seeds the next window. So all windows are full
but a task's last one, which is cut into sequences of lengths that are powers
of two: nothing is padded.

Defined results: a null text is empty and has the end id only; every row is
packed, rows with the same doc_id each on their own; documents without a common
term follow in the order of the shard; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

WINDOW, END_ID, TOKENIZER = 2048, 1, "word_bpe_49k.json"
#: A shard ends with whichever comes first.
SHARD_DOCS, SHARD_TOKENS = 1024, 1 << 22
#: Terms of a seed that are looked up, and neighbours a look-up returns.
QUERY_TERMS, NEIGHBOURS = 24, 32
K1, B = 1.2, 0.75
#: Keys that are sampled for each task's range.
RANGE_SAMPLE = 60
#: Ids that a task shall have on average, and tasks at most; a task holds one shard at a time, however many it has.
TASK_IDS, MAX_TASKS = 1 << 26, 50_000
#: Strings whose ids a task remembers.
CACHE = 200_000
#: Rows and bytes of text that are encoded together.
PIECE_ROWS, PIECE_BYTES = 1024, 2 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_classes() -> np.ndarray:
    """0 white space, 1 letters, 2 digits, 3 other signs of ASCII, 4 the apostrophe, 5 bytes beyond ASCII."""
    kinds = np.full(256, 5, np.uint8)
    kinds[:128] = 3
    kinds[list(b" \t\n\v\f\r")], kinds[list(b"abcdefghijklmnopqrstuvwxyz")], kinds[list(b"0123456789")], kinds[ord("'")] = 0, 1, 2, 4
    return kinds


_KINDS = _byte_classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Whether the tokenizer always begins anew between bytes of two classes: an apostrophe and bytes beyond ASCII may belong to either side.
_PARTS = np.zeros((6, 6), bool)
_PARTS[0, 1:] = _PARTS[1:, 0] = True
_PARTS[1, 2:4] = _PARTS[2, 1:4] = _PARTS[3, 1:3] = True
#: Strings that are one word to the tokenizer: letters, a digit or signs.
_ONE_WORD = "^(?:[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:-@\\[-`{-~]+)$"


class ChunkTokenizer:
    """Ids by ``tokenizers``, remembered for each string between places where the tokenizer begins anew.

    These are ASCII white space and changes between letters (a to z and the
    lower-case ones of Latin-1), digits and other signs of ASCII. The strings lie
    in one array and the ids of all of them in another; a string's number tells
    where. At most ``CACHE`` strings are remembered from call to call, the most
    frequent ones, and only as long as the task runs.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # a shorter way to the same ids for strings that are one word
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends_word = np.zeros(1 << 16, bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        # number 0 is the end id; no text has a string of white space
        self.known = pa.array([b" "], pa.large_binary())
        self.pool, self.lengths, self.hits = np.array([end_id], "<u2"), np.array([1], np.int32), np.array([1], np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, each text's followed by the end id, and where each text's end."""
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        pieces, of_text = self._pieces(column, data, offsets - offsets[0])
        coded = pieces.dictionary_encode()
        indices = coded.indices.to_numpy()
        numbers = self.numbers(coded.dictionary, np.bincount(indices, minlength=len(coded.dictionary)))
        bounds = np.searchsorted(of_text, np.arange(len(column)), side="right")
        sequence = np.insert(numbers[indices], bounds, 0)
        lengths, starts = self.lengths[sequence], (np.cumsum(self.lengths) - self.lengths)[sequence]
        upto = np.cumsum(lengths, dtype=np.int64)
        ids = self.pool[np.arange(upto[-1]) + np.repeat(starts - upto + lengths, lengths)]
        ends = upto[bounds + np.arange(len(bounds))]
        if len(self.known) > CACHE:
            self.shrink()
        return ids, ends

    @staticmethod
    def _pieces(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The strings of all texts, lower-cased, and the text that each is of."""
        low = _LOWER[data]
        kinds = _KINDS[low]
        lead = np.flatnonzero(data[:-1] == 0xC3)  # the letters of Latin-1, but for the signs of multiplication and division
        second = data[lead + 1]
        letter = (second != 0x97) & (second != 0xB7)
        lead, second = lead[letter], second[letter]
        low[lead + 1] = np.where(second < 0x9F, second + 32, second)
        kinds[lead] = kinds[lead + 1] = 1
        begins = np.ones(len(low), bool)
        begins[1:] = _PARTS[kinds[:-1], kinds[1:]] | ((kinds[:-1] == 2) & (kinds[1:] == 2))
        # the tokenizer finds its special tokens before it lower-cases
        for row in np.flatnonzero(pc.match_substring(column, "<|").to_numpy(zero_copy_only=False)):
            a, b = offsets[row], offsets[row + 1]
            low[a:b] = data[a:b]
            space = kinds[a:b] == 0
            begins[a + 1 : b] = space[1:] != space[:-1]
        begins[offsets[offsets < len(low)]] = True
        word = kinds != 0
        first = np.flatnonzero(begins & word)
        upto = np.cumsum(word, dtype=np.int32 if len(word) < 1 << 31 else np.int64)
        ends = np.append(upto[first] - 1, upto[-1] if len(upto) else 0).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(low[word])])
        return pieces, np.searchsorted(offsets, first, side="right") - 1

    def shrink(self) -> None:
        """Keep the strings that were met most often, half of what can be kept."""
        kept = np.sort(np.append(0, 1 + np.argpartition(-self.hits[1:], CACHE // 2)[: CACHE // 2]))
        starts, lengths = (np.cumsum(self.lengths) - self.lengths)[kept], self.lengths[kept]
        upto = np.cumsum(lengths, dtype=np.int64)
        self.pool = self.pool[np.arange(upto[-1]) + np.repeat(starts - upto + lengths, lengths)]
        self.lengths, self.hits, self.known = lengths, self.hits[kept] // 2, self.known.take(pa.array(kept))

    def numbers(self, strings: pa.Array, times: np.ndarray) -> np.ndarray:
        """The number of each of some distinct strings, which were met some times."""
        found = pc.index_in(strings, value_set=self.known)
        out = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(out < 0)
        if len(fresh):
            new = strings.take(pa.array(fresh))
            one = pc.match_substring_regex(new.view(pa.large_string()), _ONE_WORD).to_numpy(zero_copy_only=False)
            words, others = np.flatnonzero(one), np.flatnonzero(~one)
            pools, lengths = [self.pool], [self.lengths]
            for at in range(0, len(words), 1 << 16):
                ids, ends = self._words(new.take(pa.array(words[at : at + (1 << 16)])).view(pa.large_string()))
                pools.append(ids)
                lengths.append(np.diff(ends, prepend=0))
            for at in range(0, len(others), 4096):
                ids, ends = self._strings([s.decode("utf-8", "replace") for s in new.take(pa.array(others[at : at + 4096])).to_pylist()])
                pools.append(ids)
                lengths.append(np.diff(ends, prepend=0))
            order = np.concatenate([words, others])
            out[fresh[order]] = len(self.known) + np.arange(len(order))
            self.pool, self.lengths = np.concatenate(pools), np.concatenate(lengths).astype(np.int32)
            self.known = pa.concat_arrays([self.known, new.take(pa.array(order))])
            self.hits = np.concatenate([self.hits, np.zeros(len(order), np.int64)])
        self.hits[out] += times
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Single words, encoded as texts of many; each ends with an id that ends a word."""
        edges = np.append(np.arange(0, len(words), 256), len(words))
        lines = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges), words), pa.scalar(" ", pa.large_string()))
        encoded = self.plain.encode_batch_fast(lines.to_pylist(), add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in encoded), "<u2")
        return ids, np.flatnonzero(self.ends_word[ids]) + 1

    def _strings(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Any strings, encoded as texts of many; each id belongs to the string at its offset."""
        groups = [words[at : at + 64] for at in range(0, len(words), 64)]
        encoded = self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
        shifts = np.cumsum([0, *(sum(map(len, g)) + len(g) for g in groups)])
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])[:-1]
        at = np.concatenate([np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(e))[::2] + shift for e, shift in zip(encoded, shifts)])  # noqa: B905
        ends = np.cumsum(np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(words)))
        return np.fromiter(chain.from_iterable(e.ids for e in encoded), "<u2", len(at)), ends


#: Where a vector of document frequencies has the number of documents and of ids.
DOCUMENTS, IDS = 1 << 16, (1 << 16) + 1


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, df) of a table of two columns, id and text; ids are 16-bit.

    Every task adds one row without ids: df is then the vector of its document frequencies.
    """
    path = path or tokenizer_path()

    def run(batches):
        tokenizer, kind = None, None
        counts = np.zeros((1 << 16) + 2, "<i8")
        for batch in batches:
            tokenizer, kind = tokenizer or ChunkTokenizer(path), batch.column(0).type
            for rows in pieces(batch):
                ids, ends = tokenizer.encode(rows.column(1))
                met = np.repeat(np.arange(len(ends), dtype=np.uint32) << np.uint32(16), np.diff(ends, prepend=0)) | ids
                met.sort()
                counts[: 1 << 16] += np.bincount(met[np.append(True, met[1:] != met[:-1])] & np.uint32(0xFFFF), minlength=1 << 16)
                counts[DOCUMENTS] += len(ends)
                counts[IDS] += len(ids)
                offsets = np.concatenate([[0], ends * 2]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([rows.column(0), data, pa.nulls(len(ends), pa.binary())], ["doc_id", "ids", "df"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["doc_id", "ids", "df"])

    def pieces(batch):
        """Slices of up to PIECE_ROWS rows and, but for single longer texts, PIECE_BYTES bytes."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            n = max(1, min(PIECE_ROWS, int(np.searchsorted(sizes, before + PIECE_BYTES, "right")) - at))
            yield batch.slice(at, n)
            at += n

    return map_arrow(docs, run, f"doc_id {docs.schema[0].dataType.simpleString()}, ids binary, df binary")


def document_frequencies(tokens: DataFrame) -> np.ndarray:
    """For each id the documents that have it, and at DOCUMENTS and IDS the corpus's size: a vector of the vocabulary's size."""

    def run(batches):
        counts = np.zeros((1 << 16) + 2, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                counts += np.frombuffer(data, "<i8")
        terms = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int32)), pa.array(counts[terms])], ["term", "n"])

    out = np.zeros((1 << 16) + 2, np.int64)
    for row in map_arrow(tokens.where("df is not null").select("df"), run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out


class Shard:
    """An inverted index of some documents, scored by BM25."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        terms, owners, weights, self.queries = [], [], [], []
        for i, ids in enumerate(docs):
            own, tf = np.unique(ids, return_counts=True)
            w = idf[own] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean_length))
            terms.append(own)
            owners.append(np.full(len(own), i, np.int32))
            weights.append(w)
            best = np.argpartition(-w, QUERY_TERMS)[:QUERY_TERMS] if len(w) > QUERY_TERMS else np.arange(len(w))
            self.queries.append(own[best])
        terms, self.owners, self.weights = np.concatenate(terms), np.concatenate(owners), np.concatenate(weights)
        order = np.argsort(terms, kind="stable")
        self.owners, self.weights = self.owners[order], self.weights[order]
        self.starts = np.searchsorted(terms[order], np.arange((1 << 16) + 1))
        self.size = len(docs)

    def neighbours(self, seed: int, used: np.ndarray) -> list[int]:
        """The best unused documents with a term of the seed, best first, ties in the shard's order."""
        spans = [slice(self.starts[t], self.starts[int(t) + 1]) for t in self.queries[seed]]
        scores = np.bincount(
            np.concatenate([self.owners[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), self.size
        )
        scores[used] = 0
        top = np.argpartition(-scores, NEIGHBOURS)[:NEIGHBOURS] if self.size > NEIGHBOURS else np.arange(self.size)
        top = top[scores[top] > 0]
        return top[np.lexsort((top, -scores[top]))].tolist()


class Packer:
    """Fills windows and keeps what it has laid out as columns."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.sequence, self.window = first_sequence, window
        self.pieces: list[tuple] = []
        self.fill = 0
        self.clear()

    def clear(self) -> None:
        self.out = [[] for _ in range(8)]

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            wide = ids.astype("<u4").tobytes()
            for column, value in zip(self.out, (doc_id, start, len(ids), zlib.crc32(wide), total, self.sequence, offset, wide), strict=True):
                column.append(value)
            offset += len(ids)
        self.sequence += 1

    def add(self, doc_id, ids: np.ndarray) -> bool:
        """Lay out a document; whether a window became full."""
        at, filled = 0, False
        while at < len(ids):
            n = min(self.window - self.fill, len(ids) - at)
            self.pieces.append((doc_id, at, ids[at : at + n], len(ids)))
            self.fill += n
            at += n
            if self.fill == self.window:
                self.emit(self.pieces)
                self.pieces, self.fill, filled = [], 0, True
        return filled

    def finish(self) -> None:
        """Cut what is left into sequences whose lengths are powers of two, the longest first."""
        while self.fill:
            size = 1 << (self.fill.bit_length() - 1)
            now, rest, room = [], [], size
            for doc_id, start, ids, total in self.pieces:
                n = min(room, len(ids))
                if n:
                    now.append((doc_id, start, ids[:n], total))
                if n < len(ids):
                    rest.append((doc_id, start + n, ids[n:], total))
                room -= n
            self.emit(now)
            self.pieces, self.fill = rest, self.fill - size


def pack_shard(packer: Packer, ids_of: list, docs: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
    shard = Shard(docs, idf, mean_length)
    used, at, seed, ranking = np.zeros(len(docs), bool), 0, None, []
    for _ in range(len(docs)):
        ranking = [d for d in ranking if not used[d]]
        if not ranking and seed is not None:
            ranking = shard.neighbours(seed, used)
        if ranking:
            doc = ranking.pop(0)
        else:
            while used[at]:
                at += 1
            doc = at
        used[doc] = True
        if packer.add(ids_of[doc], docs[doc]) or seed is None:
            seed, ranking = doc, []


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, by default, ids.

    ids: the piece's ids, as little-endian unsigned 32-bit numbers.
    """
    tokens = cut(token_ids(docs.select(F.col(id_col), F.col(text_col)), path), "token-ids")
    df = document_frequencies(tokens)
    count, mean_length = int(df[DOCUMENTS]), float(df[IDS] or 1) / max(1, int(df[DOCUMENTS]))
    idf = np.log1p((count - df[: 1 << 16] + 0.5) / (df[: 1 << 16] + 0.5)).astype(np.float32)
    idf[END_ID] = 0
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(idf)
    tokens = tokens.where("ids is not null").select("doc_id", "ids", F.xxhash64("doc_id", "ids").alias("tie"))
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def key_of(data: bytes, weight: np.ndarray) -> int:
        """The two most telling terms."""
        own, tf = np.unique(np.frombuffer(data, "<u2"), return_counts=True)
        w = weight[own] * tf / (tf + K1)
        first = int(w.argmax())
        w[first] = -1
        return int(own[first]) << 16 | int(own[w.argmax() if len(own) > 1 else first])

    def keys_only(batches):
        for batch in batches:
            keys = [key_of(data, shared.value) for data in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(1)], ["key", "tie"])

    # the ranges of the tasks, from a sample of keys that is bounded by the number of tasks
    tasks = max(1, min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(df[IDS]) // TASK_IDS), MAX_TASKS, count // 64))
    share = min(1.0, tasks * RANGE_SAMPLE / max(1, count))
    chosen = F.pmod("tie", F.lit(1_000_003)) < share * 1_000_003  # by content, so that reruns agree
    sampled = map_arrow(tokens.where(chosen).select("ids", "tie"), keys_only, "key long, tie long").toArrow()
    sampled = sorted(zip(sampled["key"].to_pylist(), sampled["tie"].to_pylist(), strict=True))
    bounds = spark.sparkContext.broadcast([sampled[i * len(sampled) // tasks] for i in range(1, tasks)] if sampled else [])

    def keyed(batches):
        weight, limits = shared.value, bounds.value
        for batch in batches:
            keys = [key_of(data, weight) for data in batch.column(1).to_pylist()]
            parts = [bisect_right(limits, pair) for pair in zip(keys, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64()), pa.array(parts, pa.int32())], ["doc_id", "ids", "tie", "key", "part"])

    near = map_arrow(tokens, keyed, f"doc_id {kind}, ids binary, tie long, key long, part int")
    near = near.repartitionById(tasks, "part").sortWithinPartitions("key", "tie")

    def run(batches: Iterator[pa.RecordBatch]):
        weight = shared.value
        packer = Packer(TaskContext.get().partitionId() << 40)
        ids_of, held, size = [], [], 0

        def rows() -> pa.RecordBatch:
            o = packer.out
            columns = [pa.array(o[0], id_type), *(pa.array(c, pa.int64()) for c in o[1:7])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array(o[7], pa.binary()))
                names.append("ids")
            packer.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids_of.append(doc_id)
                held.append(np.frombuffer(data, "<u2"))
                size += len(held[-1])
                if len(held) >= SHARD_DOCS or size >= SHARD_TOKENS:
                    pack_shard(packer, ids_of, held, weight, mean_length)
                    ids_of, held, size = [], [], 0
                    yield rows()
        if held:
            pack_shard(packer, ids_of, held, weight, mean_length)
        packer.finish()
        if packer.out[0]:
            yield rows()

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    return map_arrow(near.select("doc_id", "ids"), run, schema)
