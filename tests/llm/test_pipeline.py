"""The pipeline, stage by stage, against brute force."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm.common import table

from .helpers import docs_of, documents, odd_docs
from .test_dedup import jaccard_groups
from .test_mix_chat_secret_pack import WORDS, filled


def test_every_stage_is_brute_force(spark, small, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "pack"]
    docs, rows = table(spark, small, "documents"), documents(small)
    columns = docs.columns

    def step(name):
        stages[name](spark, docs, small).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    docs = step("language")
    assert docs.columns == columns
    rows = [d for d in rows if any(c.isalpha() for c in d["text"] or "")]
    assert Counter(map(tuple, docs.collect())) == Counter(tuple(d[c] for c in columns) for d in rows)

    docs = step("exact")
    last = {}
    for d in rows:
        last[d["text"]] = max(last.get(d["text"], d["doc_id"]), d["doc_id"])
    rows = [d for d in rows if last[d["text"]] == d["doc_id"]]
    assert docs.columns == columns and Counter(map(tuple, docs.collect())) == Counter(tuple(d[c] for c in columns) for d in rows)

    docs = step("near")
    rows.sort(key=lambda d: d["doc_id"])
    groups = jaccard_groups([(d["doc_id"], d["text"]) for d in rows])
    rows = [d for i, d in enumerate(rows) if groups[i] == i]
    assert docs.columns == columns and Counter(map(tuple, docs.collect())) == Counter(tuple(d[c] for c in columns) for d in rows)

    docs = step("mix")
    totals, words, source = defaultdict(int), defaultdict(int), {}
    for d in rows:
        totals[d["source"]] += len(WORDS.findall(d["text"]))
        source[d["doc_id"]] = d
    target = filled(totals)
    mixed = docs.collect()
    for r in mixed:
        own = source[r["doc_id"]]
        assert own["text"].startswith(r["text"]) and r["source"] == own["source"] and r["n_chars"] == len(r["text"])
        words[r["source"]] += len(WORDS.findall(r["text"]))
    assert docs.columns == columns and all(abs(words[s] - target[s]) <= 1 for s in totals)

    packed = step("pack").collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in mixed)
    assert Counter(map(tuple, corpus_pipeline.run(spark, small).drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect())) == Counter({(r["doc_id"], r["doc_tokens"]): 1 for r in packed})


ODDER = [
    (6, "copy A of it", "en", "a"), (6, "copy A of it", "en", "a"), (7, "copy A of it", "en", "b"), (6, "text B alone", "en", "a"), (8, "copy C here", "en", "a"), (8, "copy C here", "fr", "b"),
    (None, "one text", "en", "a"), (None, "one text", "fr", "b"), (None, "its own", "en", "a"), (None, "twin", "en", "a"), (3, "twin", "en", "a"), (9, "12345", "en", "a"), (9, "with letters", "en", "a"),
]


def test_stages_take_odd_rows(spark, small):
    """Each stage, over nulls, repeated and missing ids, repeated rows and other columns, against brute force with exact counts of rows."""
    stages = dict(corpus_pipeline.STAGES)
    for df in (odd_docs(spark), docs_of(spark, ODDER), odd_docs(spark).unionByName(docs_of(spark, ODDER)).withColumn("m_size", F.lit(5)).withColumn("words", F.lit("w"))):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        outs = {name: stage(spark, df, small) for name, stage in corpus_pipeline.STAGES}
        assert all(outs[name].columns == df.columns for name in outs if name != "pack")
        got = {name: Counter((r["doc_id"], r["text"]) for r in outs[name].collect()) for name in outs if name != "pack"}

        assert got["language"] == Counter((i, t) for i, t in rows if any(c.isalpha() for c in t or ""))

        texts = defaultdict(list)
        for i, t in rows:
            texts[t or ""].append((i is not None, i))
        exact = Counter((max(ids, key=lambda x: (x[0], x[1] or 0))[1], t) for t, ids in texts.items())
        assert Counter((i, t or "") for (i, t), n in got["exact"].items() for _ in range(n)) == exact

        groups, near = jaccard_groups(rows), defaultdict(list)
        for g, (i, t) in zip(groups, rows, strict=True):
            near[g].append((i is None, i or 0, t))
        assert sum(got["near"].values()) == len(near)
        kept = sorted((i is None, i or 0) for i, _ in got["near"].elements())
        assert kept == sorted(min(g, key=lambda x: x[:2])[:2] for g in near.values())
        assert all(min(n, 1) and (i, t) in rows for (i, t), n in got["near"].items())

        shares = Counter(r["doc_id"] for r in outs["mix"].collect())
        assert set(shares) <= {i for i, t in rows if WORDS.search(t or "")}
        assert Counter(r["doc_id"] for r in outs["pack"].collect() if r["start"] == 0) == Counter(i for i, _ in rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd_docs(spark).limit(0), small).count() == 0, name


def test_mix_keeps_clashing_columns(spark, small):
    df = docs_of(spark, [(i, "some words here", "en", "ab"[i % 2]) for i in range(10)])
    for name in ("m_size", "m_words", "size", "words", "tie", "row", "taken", "epochs"):
        odd = df.withColumn(name, F.lit("mine"))
        out = dict(corpus_pipeline.STAGES)["mix"](spark, odd, small)
        assert out.columns == odd.columns and {r[name] for r in out.collect()} == {"mine"}
