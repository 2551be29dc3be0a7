"""Language identification by cross-parsing entropy (operator 4).

For each language a suffix automaton is built over a bounded sample of labelled
text. A document is parsed greedily, for each language, into the longest
phrases that occur in that language's sample; the language that needs the
fewest phrases for each symbol wins. Texts are parsed whole, in pieces of
``PIECE`` bytes that each start a phrase, so that one automaton step serves all
pieces of a batch. The automata's steps are packed: a state's steps lie in the
gaps between other states' ones, so a table has about as many entries as steps.

Bounds of the sample: ``SAMPLE_ROWS`` rows a language and the first
``ROW_CHARS`` characters of each, in the order of a hash of the id, up to
``SAMPLE_BYTES`` bytes a language and ``MODEL_BYTES`` bytes in all. So the
automata, which are sent to every executor, have a fixed bound.

Defined results: ``und`` with score 0 for a null text and one without a letter,
and where no language could be learned; ties go to the language that comes first
by code point; a null doc_id isn't held out and isn't learned from; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

SAMPLE_ROWS, ROW_CHARS, SAMPLE_BYTES, MODEL_BYTES = 200, 2000, 32_768, 2 << 20
PIECE = 256
#: Bytes of text that are parsed at once.
BATCH_BYTES = 4 << 20
_LETTER = re.compile(rb"[A-Za-z]")


def folded() -> np.ndarray:
    """Byte classes: letters without case, digits alike, white space and ASCII signs alike, other bytes as they are."""
    fold = np.full(256, ord(" "), np.int64)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            fold[b] = b
        elif c.isalpha():
            fold[b] = ord(c.lower())
        elif c.isdigit():
            fold[b] = ord("0")
    return fold


def suffix_automaton(symbols) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    nexts, links, lengths, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(nexts)
        nexts.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = new
            p = links[p]
        if p != -1:
            q = nexts[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[new] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = links[p]
                links[q] = links[new] = clone
        last = new
    return nexts


#: Gaps that are tried for a state's steps before they go behind all others.
TRIES = 200


def packed(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, owner, target): the step of state s with symbol c is target[place[s] + c] if owner[place[s] + c] is s, else there is none."""
    n = sum(map(len, rows))
    taken, place = bytearray(2 * width + 2 * n), np.zeros(len(rows), np.int32)
    slots: list[tuple[int, int, int]] = []
    low = top = width
    for s in sorted(range(len(rows)), key=lambda s: -len(rows[s])):
        if not rows[s]:
            break
        first, *more = sorted(rows[s])
        at, tries = taken.find(0, low), 0
        low = at
        while any(taken[at - first + c] for c in more):
            at, tries = taken.find(0, at + 1), tries + 1
            if tries == TRIES:
                at = top + first
        if at + width >= len(taken) - width:
            taken.extend(bytes(len(taken)))
        place[s] = at - first
        for c, t in rows[s].items():
            taken[at - first + c] = 1
            slots.append((at - first + c, s, t))
        top = max(top, at - first + width)
    size = int(place.max(initial=0)) + width
    owner, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    if slots:
        at, of, to = np.array(slots).T
        owner[at], target[at] = of, to
    return place, owner, target


class CrossParser:
    """Automata of all languages in one packed table of steps, with a state before any phrase for each."""

    def __init__(self, samples: dict[str, bytes]):
        fold = folded()
        used = sorted({int(x) for s in samples.values() for x in np.unique(fold[np.frombuffer(s, np.uint8)])})
        code = {b: i for i, b in enumerate(used)}
        self.symbol = np.array([code.get(int(b), len(used)) for b in fold], np.int32)
        self.width = len(used) + 1  # the last symbol is unknown to all
        self.langs = sorted(samples)
        self.fresh = np.zeros(len(self.langs), np.int32)
        self.start = np.zeros((len(self.langs), self.width), np.int32)  # where a phrase's first symbol leads
        parts, states, size = [], 0, 0
        for i, lang in enumerate(self.langs):
            nexts = suffix_automaton(self.symbol[np.frombuffer(samples[lang], np.uint8)].tolist())
            self.fresh[i] = self.start[i] = states + len(nexts)
            for c, t in nexts[0].items():
                self.start[i, c] = states + t
            place, owner, target = packed([*nexts, {}], self.width)
            parts.append((place + np.int32(size), np.where(owner < 0, owner, owner + np.int32(states)), target + np.int32(states)))
            states += len(nexts) + 1
            size += len(owner)
        self.place, self.owner, self.target = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int32)] * 3

    @classmethod
    def of(cls, state: dict) -> CrossParser:
        """From the plain values of another one."""
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) for each language (columns)."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        todo, size = [], 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), PIECE):
                todo.append((i, text, at))
                size += PIECE
                if size >= BATCH_BYTES:
                    self._parse(todo, out)
                    todo, size = [], 0
        self._parse(todo, out)
        return out

    def _parse(self, pieces, out) -> None:
        if not pieces or not self.langs:
            return
        cut = [text[at : at + PIECE] for _, text, at in pieces]
        lengths = np.array([len(x) for x in cut])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        grid = np.frombuffer(b"".join([cut[i].ljust(PIECE, b"\0") for i in order]), np.uint8).reshape(-1, PIECE)
        grid = np.ascontiguousarray(self.symbol[grid].T)
        state = np.repeat(self.fresh[:, None], len(cut), axis=1)
        count = np.zeros(state.shape, np.int32)
        alive = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left")
        for t in range(int(lengths[0])):
            n = alive[t]
            symbols, now = grid[t, :n], state[:, :n]
            at = self.place[now] + symbols
            goes_on = self.owner[at] == now
            count[:, :n] += ~goes_on
            state[:, :n] = np.where(goes_on, self.target[at], self.start[:, symbols])
        np.add.at(out, np.array([i for i, _, _ in pieces])[order], count.T)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame) -> CrossParser:
    """Fit on doc_id, text and lang of a bounded sample of the rows that aren't held out."""
    rows = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("lang").isNotNull() & (F.length("text") > 0))
    rows = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), F.substring("text", 1, ROW_CHARS).alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= SAMPLE_ROWS)
    before = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("lang").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    sample = rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < SAMPLE_BYTES).select("lang", "nth", "text").collect()
    by_lang: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["nth"])):
        by_lang.setdefault(r["lang"], []).append(r["text"].encode())
    bound = min(SAMPLE_BYTES, MODEL_BYTES // max(1, len(by_lang)))
    return CrossParser({lang: b" ".join(texts)[:bound] for lang, texts in by_lang.items()})


def _predictions(parser: CrossParser, texts: list[bytes]) -> list[tuple[str, float, float | None]]:
    """(lang_pred, score, phrase_rate) of each text."""
    out = []
    for text, row in zip(texts, parser.phrases(texts), strict=True):
        if not parser.langs or not (_LETTER.search(text) or any(c.isalpha() for c in text.decode("utf-8", "replace"))):
            out.append(("und", 0.0, None))
            continue
        best = int(row.argmin())
        others = np.delete(row, best)
        out.append((parser.langs[best], 1.0 - float(row[best]) / float(others.min()) if len(others) else 1.0, float(row[best]) / len(text)))
    return out


def _learned(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> CrossParser:
    return learn(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: CrossParser | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and phrase_rate (phrases a symbol for the winner) of every row."""
    base = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model or _learned(docs, id_col, text_col, lang_col)))

    def run(batches):
        parser = CrossParser.of(shared.value)
        for batch in batches:
            found = _predictions(parser, [t or b"" for t in batch.column(2).cast(pa.large_binary()).to_pylist()])
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "held_out", "lang_pred", "score", "phrase_rate"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return map_arrow(base, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, phrase_rate double")


def told_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: CrossParser | None = None) -> DataFrame:
    """The rows of ``docs``, as they are, whose language was told; each is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model or _learned(docs, id_col, text_col, lang_col)))
    at = docs.columns.index(text_col)

    def run(batches):
        parser = CrossParser.of(shared.value)
        for batch in batches:
            found = _predictions(parser, [t or b"" for t in batch.column(at).cast(pa.large_binary()).to_pylist()])
            yield batch.filter(pa.array([lang != "und" for lang, _, _ in found], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
