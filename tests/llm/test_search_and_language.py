"""Operators 3 and 4: recall against brute force, held-out accuracy, and the automata against plain search."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from graphloom.llm import ann, langid, queries

from .helpers import docs_of, documents, odd_docs


def exact(rows, k=20, every=20):
    """rows: (id, vector). Each query's nearest by brute force."""
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for i, v in zip(ids, vectors, strict=True):
        if i % every == 0:
            scores = vectors @ v
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def test_op3_recall_and_form(spark, small):
    table = duckdb.sql(f"select vec_id, embedding from '{small}/embeddings.parquet'").fetchall()
    want = exact(table)
    vectors = {i: np.array(v, np.float64) for i, v in table}
    got = {}
    for r in queries.op3_ann(spark, small).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert got.keys() == want.keys()
    hits = 0
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert len({r["vec_id"] for r in rows} - {q}) == 20
        keys = [(-r["score"], r["vec_id"]) for r in rows]
        assert keys == sorted(keys)
        for r in rows:
            assert math.isclose(r["score"], float(vectors[q] @ vectors[r["vec_id"]]), rel_tol=1e-9, abs_tol=1e-12)
        hits += len({r["vec_id"] for r in rows} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("kind", ["gaussian", "clustered"])
def test_op3_recall_on_many_vectors(spark, tmp_path, kind):
    """Vectors without structure and in clusters, with the recall that the library measures and one by brute force."""
    rng, n, width = np.random.default_rng(5), 20_000, 64
    x = rng.standard_normal((n, width))
    if kind == "clustered":
        x = rng.standard_normal((100, width))[rng.integers(0, 100, n)] + 0.3 * x
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), width).cast(pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "v.parquet", row_group_size=2500)
    df = spark.read.parquet(str(tmp_path / "v.parquet"))
    ann.nearest(df).write.parquet(str(tmp_path / "found"))
    found = spark.read.parquet(str(tmp_path / "found"))
    for q in (0, 19_980):
        scores = x.astype(np.float64) @ x[q].astype(np.float64)
        scores[q] = -np.inf
        assert [r["vec_id"] for r in ann.exact_nearest(df, [q]).orderBy("rank").collect()] == np.argsort(-scores)[:20].tolist()
    assert found.count() == n
    got = ann.recall(df, found, sample=400)
    print("recall", kind, got)
    assert got >= 0.9


def test_op3_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [9.0, 9.0]), (8, [1.0, 2.0, 3.0]), (9, [-1.0, 0.5]), (40, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "q", 1.0) for r in rows], "vec_id long, embedding array<float>, node string, v double")
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {0: [(2, 2.0), (1, 1.0), (20, 1.0), (9, -1.0)], 20: [(2, 2.0), (0, 1.0), (1, 1.0), (9, -1.0)]}
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id = 0")).count() == 0


def test_op3_many_equal_vectors(spark):
    rows = [(i, [1.0, float(i % 3 == 0)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == exact(rows)


def test_op4_held_out_accuracy(spark, small):
    docs = {d["doc_id"]: d for d in documents(small)}
    rows = queries.op4_langid(spark, small).collect()
    assert len(rows) == len(docs)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang_pred"] != "und" and len(docs[r["doc_id"]]["text"].split()) >= 5]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held)
    assert right >= 0.95 * len(held), (right, len(held))


def test_op4_nothing_held_out_is_learned(spark):
    """Labels of held-out rows change no prediction."""
    import zlib

    texts = {"en": "the cat and the dog went to the house", "fr": "le chat et le chien sont dans la maison"}
    rows = [(i, texts[la] + f" {i}", la, "s") for i, la in enumerate(["en", "fr"] * 30)]
    wrong = [(i, t, ("xx" if zlib.crc32(str(i).encode()) % 5 == 0 else la), None) for i, t, la, _ in rows]
    first = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs_of(spark, rows)).collect()}
    second = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs_of(spark, wrong)).collect()}
    assert first == second and all(first[i][0] == la for i, _, la, _ in rows)


def test_op4_odd_rows(spark):
    df = odd_docs(spark)
    rows = langid.identify(df).collect()
    assert len(rows) == df.count()
    for r in rows:
        if r["doc_id"] in (1, 2, 3, 8):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.where("lang is null")).collect()} == {"und"}


@pytest.mark.parametrize("text", ["banana bandana", "abcabcx", "", "zzz", "the band ate a banana" * 40])
def test_phrases_are_longest_matches(text):
    samples = {"a": b"banana band", "b": b"abcab the and"}
    parser = langid.CrossParser(samples)
    fold = langid.folded()
    flat = lambda data: bytes(int(fold[b]) for b in data)
    want = []
    for lang in sorted(samples):
        known, n = flat(samples[lang]), 0
        for at in range(0, len(text), langid.PIECE):
            piece, i = flat(text.encode()[at : at + langid.PIECE]), 0
            while i < len(piece):
                j = i + 1
                while j < len(piece) and piece[i : j + 1] in known:
                    j += 1
                i, n = j, n + 1
        want.append(n)
    assert parser.phrases([text.encode()])[0].tolist() == want


def test_op4_is_brute_force(spark, small):
    """lang_pred and score of every text by plain search in the samples, which are drawn here again."""
    import struct
    import zlib

    import xxhash

    docs, by_lang = documents(small), {}
    for d in docs:
        if zlib.crc32(str(d["doc_id"]).encode()) % 5 and d["lang"] and d["text"]:
            h = xxhash.xxh64_intdigest(struct.pack("<q", d["doc_id"]), 42)
            by_lang.setdefault(d["lang"], []).append((h - (h >> 63 << 64), d["doc_id"], d["text"][: langid.ROW_CHARS].encode()))
    fold = bytes(int(x) for x in langid.folded())
    samples = {la: b" ".join(t for _, _, t in sorted(rows)[: langid.SAMPLE_ROWS])[: langid.SAMPLE_BYTES].translate(fold) for la, rows in by_lang.items()}
    got = {r["doc_id"]: r for r in queries.op4_langid(spark, small).collect()}
    for d in docs:
        text, counts = (d["text"] or "").encode().translate(fold), {}
        for la, known in sorted(samples.items()):
            n = 0
            for at in range(0, len(text), langid.PIECE):
                piece, i = text[at : at + langid.PIECE], 0
                while i < len(piece):
                    j = i + 1
                    while j < len(piece) and piece[i : j + 1] in known:
                        j += 1
                    i, n = j, n + 1
            counts[la] = n
        r = got[d["doc_id"]]
        if not any(c.isalpha() for c in d["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        best, second = sorted(counts.values())[:2]
        assert r["lang_pred"] == min(counts, key=lambda la: (counts[la], la))
        assert math.isclose(r["score"], 1 - best / second, abs_tol=1e-12)


def test_op4_tables_are_packed():
    """A table of steps has few entries more than the automaton has steps, and gives the same steps."""
    rng = np.random.default_rng(1)
    nexts = langid.suffix_automaton(rng.integers(0, 40, 3000).tolist())
    place, owner, target = langid.packed(nexts, 41)
    for s, row in enumerate(nexts):
        for c in range(41):
            at = place[s] + c
            assert (owner[at] == s) == (c in row) and (c not in row or target[at] == row[c])
    assert len(owner) <= 2 * sum(map(len, nexts)) + 41
