"""Corpus-wide line deduplication (operator 9).

Every text is exploded into lines; a line's key (ASCII white space stripped,
A-Z lower-cased) is hashed to 128 bits; documents are counted for each hash.
The lines whose key is long enough and found in enough documents are dropped
everywhere but in the document with the largest id; the rest is reassembled by
position.

Skew: what a row loses depends on its doc_id and its text alone. So removals
are gathered by doc_id and a hash of the text: rows without a doc_id, or with
one repeated doc_id, are spread, and a list holds lines of one text.

Defined results: a null text is one empty line; each row is a document of its
own, rows that share the largest doc_id all keep their lines; a null doc_id is
smaller than any other; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, eq, map_arrow

MIN_CHARS, MIN_DOCS = 20, 3


def _key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key, or None where the key is too short."""
    key = line.strip().lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, mark): each distinct line key of each document, of a table of id, text and the text's mark."""

    def keys(batches):
        for batch in batches:
            digests, rows = [], []
            for row, text in enumerate(batch.column(1).cast(pa.large_binary()).to_pylist()):
                if text:
                    own = {_key(line, min_chars) for line in text.split(b"\n")}
                    own.discard(None)
                    digests.extend(own)
                    rows.extend([row] * len(own))
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), batch.column(0).take(at), batch.column(2).take(at)],
                ["h1", "h2", "doc_id", "mark"],
            )

    kind = docs.schema[0].dataType.simpleString()
    return map_arrow(docs, keys, f"h1 long, h2 long, doc_id {kind}, mark long")


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, with_text: bool = True
) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and, by default, kept_text of every document."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    lines = cut(line_keys(base, min_chars), "lines")
    common = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("holder")).where(F.col("n") >= min_docs)
    common = cut(common.select("h1", "h2", "holder"), "common-lines")
    drops = (
        lines.join(common, ["h1", "h2"])
        .where(~eq((F.col("doc_id"), F.col("holder"))))
        .groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark"))
        .agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    )
    drops = cut(drops, "line-drops")
    same = eq((F.col("doc_id"), F.col("of"))) & (F.col("mark") == F.col("of_mark"))
    joined = base.join(drops.hint("shuffle_hash"), same, "left").select("doc_id", "text", "gone")

    def rebuild(batches):
        for batch in batches:
            totals, dropped, shas, kept_texts = [], [], [], []
            gone_lists = batch.column(2).to_pylist()
            for text, gone in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), gone_lists, strict=True):
                parts = (text or b"").split(b"\n")
                kept = parts
                if gone:
                    bad = {int(x["h1"]).to_bytes(8, "little", signed=True) + int(x["h2"]).to_bytes(8, "little", signed=True) for x in gone}
                    kept = [x for x in parts if _key(x, min_chars) not in bad]
                body = b"\n".join(kept)
                totals.append(len(parts))
                dropped.append(len(parts) - len(kept))
                shas.append(hashlib.sha256(body).hexdigest())
                if with_text:
                    kept_texts.append(body)
            out = [batch.column(0), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                out.append(pa.array(kept_texts, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(out, names)

    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return map_arrow(joined, rebuild, schema)
