"""Operators 1, 2, 5 and 9 and near texts against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from graphloom.llm import exact_dedup, line_dedup, near_texts, queries, simhash, sql, substring_dedup
from graphloom.llm.components import components

from .helpers import docs_of, documents, odd_docs, roots_of, same_rows


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g.encode(), seed=42).intdigest()
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def plain_components(ids, prints):
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    groups = roots_of(len(prints), links)
    least = {}
    for g, i in zip(groups, ids, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return [least.get(g) for g in groups]


def test_op1_is_brute_force(spark, small):
    docs = documents(small)
    prints = [plain_fingerprint(d["text"]) for d in docs]
    ids = [d["doc_id"] for d in docs]
    want = {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, plain_components(ids, prints), strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, small).collect()}
    assert got == want


def test_op1_odd_rows(spark):
    df = odd_docs(spark)
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in df.collect()]
    parts = plain_components([i for i, _ in rows], [p for _, p in rows])
    want = Counter((i, f"{p:016x}", c) for (i, p), c in zip(rows, parts, strict=True))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_dedup(df).collect())
    assert got == want
    assert simhash.near_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [7, 2048])
def test_op1_links_keep_all_components(spark, monkeypatch, block):
    """Chains and clouds of fingerprints, with buckets larger than a block."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    prints = {0, (1 << 64) - 1}
    for _ in range(25):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):
            prints.add(at)
            for _ in range(rng.choice([1, 3, 4, 5])):
                at ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.linked_pairs(df)).collect()}
    got = defaultdict(set)
    for s, p in zip(signed, prints, strict=True):
        got[roots.get(s, s)].add(p)
    groups = roots_of(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    want = defaultdict(set)
    for g, p in zip(groups, prints, strict=True):
        want[g].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def plain_spans(docs, min_words=substring_dedup.MIN_WORDS):
    """Kept text by brute force: all stretches of sentences are tried."""
    parsed, seen = [], {}
    for i, text in docs:
        raw = (text or "").encode()
        ends = sorted({m.end() for m in re.finditer(rb"(?:[.!?]+[\"')\]]*(?=\s)|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\n)\s*", raw)} | ({len(raw)} if raw else set()))
        pieces = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        words = [re.findall(rb"[a-z0-9\x80-\xff]+", p.lower()) for p in pieces]
        found = set()
        for a in range(len(pieces)):
            for b in range(a, min(len(pieces), a + 60)):
                size = sum(map(len, words[a : b + 1]))
                if size >= min_words:
                    if size - len(words[b]) < min_words and words[a] or size - len(words[a]) < min_words and words[b]:
                        found.add((a, b))
                    if size - len(words[b]) >= min_words and size - len(words[a]) >= min_words:
                        break
        parsed.append((i, pieces, {(a, b): tuple(w for x in words[a : b + 1] for w in x) for a, b in found}))
    for i, _, found in parsed:
        for (a, _), run in found.items():
            seen[run] = min(seen.get(run, (i, a)), (i, a))
    out = {}
    for i, pieces, found in parsed:
        gone = {k for (a, b), run in found.items() if seen[run] != (i, a) for k in range(a, b + 1)}
        out[i] = (len(pieces), len(gone), b"".join(p for k, p in enumerate(pieces) if k not in gone).decode())
    return out


def test_op2_is_brute_force(spark, small):
    """The runs of sentences, and the form of the query's result, which has passages inside sentences on top (see below)."""
    docs = documents(small)
    runs = substring_dedup.substring_dedup(spark.read.parquet(f"{small}/documents.parquet"), passages=False).collect()
    assert {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["text"]) for r in runs} == plain_spans([(d["doc_id"], d["text"]) for d in docs])
    got = {r["doc_id"]: r for r in queries.op2_substring_dedup(spark, small).collect()}
    assert all(len(got[r["doc_id"]]["text"]) <= len(r["text"]) and got[r["doc_id"]]["n_sentences"] == r["n_sentences"] for r in runs)
    for d in docs:
        text, at, kept = d["text"], 0, ""
        for a, b in (map(int, s.split(":")) for s in got[d["doc_id"]]["removed"].split(",") if s):
            kept, at = kept + text[at:a], b
        assert kept + text[at:] == got[d["doc_id"]]["text"]


def test_op2_catches_a_passage(spark):
    passage = "It was the best of times for all of them. It was also the worst of times, as many said. They had everything before them! They had nothing? All went direct to heaven."
    rows = [(3, f"A clean start of one document. {passage} An end.", "en", "a"), (1, f"Something else stands here first. {passage}", "en", "a"), (2, f"| {passage.lower()} More.", "en", "b"), (4, "A clean text of its own. It has nothing in common with them.", "en", "a")]
    got = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(docs_of(spark, rows)).collect()}
    assert got[1] == rows[1][1] and got[4] == rows[3][1]
    assert got[3] == "A clean start of one document. An end." and got[2] == "More."


def test_op2_catches_a_passage_inside_sentences(spark):
    passage = [f"word{k}" for k in range(55)]
    copies = {4: "at the start of it we read {} and so it went on.", 2: "This is another one, in which {} stands too", 3: "{}", 9: "It ends so: {}."}
    marks = {4: " ", 2: " ", 3: ".&&& ", 9: ", "}
    rows = [(i, t.format(marks[i].join(passage)), "en", "a") for i, t in copies.items()]
    rows += [(5, "Only a part of it, " + " ".join(passage[:49]) + " is here", "en", "a"), (6, "no " * 300, "en", "a")]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs_of(spark, rows)).collect()}
    assert got[2]["text"] == rows[1][1] and got[5]["text"] == rows[4][1] and got[6]["text"] == "no " * 50
    assert [got[i]["text"] for i in (4, 3, 9)] == ["at the start of it we read and so it went on.", "", "It ends so: "]
    assert [got[i]["n_removed"] > 0 for i in (2, 3, 4, 5, 6, 9)] == [False, True, True, False, True, True]


def test_op2_keeps_no_repeated_stretch(spark, small):
    """Words that stay, by brute force over all stretches of 50 words besides the runs of sentences."""
    docs, n = sorted((d["doc_id"], d["text"]) for d in documents(small)), 50
    sentence_words, first, want, cut_inside = plain_spans(docs), {}, {}, 0
    for i, text in docs:
        raw, at, away = text.encode(), 0, set()
        words = [(m.start(), m.end(), m.group()) for m in re.finditer(rb"[a-z0-9\x80-\xff]+", raw.lower())]
        for p in range(len(words) - n + 1):
            held = first.setdefault(tuple(w for *_, w in words[p : p + n]), (i, p))
            if held[0] != i or p - held[1] >= n:
                away |= set(range(p, p + n))
        left = iter(re.findall(rb"[a-z0-9\x80-\xff]+", sentence_words[i][2].encode().lower()))
        want[i] = (words, away, list(left))
    for r in substring_dedup.substring_dedup(docs_of(spark, [(i, t, "en", "a") for i, t in docs])).collect():
        words, away, by_sentences = want[r["doc_id"]]
        text = dict(docs)[r["doc_id"]]
        gone = [tuple(len(text[:int(x)].encode()) for x in s.split(":")) for s in r["removed"].split(",") if s]
        stay = [k for k, (a, _, _) in enumerate(words) if not any(x <= a < y for x, y in gone)]
        assert not away & set(stay)
        assert re.findall(rb"[a-z0-9\x80-\xff]+", r["text"].encode().lower()) == [words[k][2] for k in stay]
        if not away:
            assert [words[k][2] for k in stay] == by_sentences
        assert len(stay) <= len(by_sentences)
        cut_inside += len(stay) < len(by_sentences)
    assert cut_inside


def test_op2_odd_rows(spark):
    df = odd_docs(spark)
    out = substring_dedup.substring_dedup(df).collect()
    assert len(out) == df.count()
    texts = {(r["doc_id"], r["text"]) for r in out}
    assert {(1, ""), (2, ""), (3, " \t\n"), (None, ""), (6, "the same short text here")} <= texts
    assert len(next(r["text"] for r in out if r["doc_id"] == 4)) < 30_000 * 15
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_op5_sql(spark, small, duck):
    same_rows(queries.op5_exact_dedup(spark, small).toPandas(), duck.sql(sql.OP5).df())


def test_op5_odd_rows(spark):
    df = odd_docs(spark)
    out = exact_dedup.exact_dedup(df).collect()
    groups = defaultdict(list)
    for r in df.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == want
    assert sum(r["kept"] for r in out) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_op5_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 500, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C1) & np.uint64((1 << 60) - 1) for _ in range(5)]
    filters = []
    for p in parts:
        keys, counts = np.unique(p, return_counts=True)
        built = exact_dedup.CountingQuotientFilter.build(keys, counts, 60)
        filters.append(exact_dedup.CountingQuotientFilter.from_bytes(built.to_bytes()))
    keys, counts = exact_dedup.CountingQuotientFilter.merge(filters).entries()
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == Counter(np.concatenate(parts).tolist())


def plain_lines(rows):
    where, out = defaultdict(list), []
    for n, (i, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
            where[key].append((n, i))
    order = lambda i: (i is not None, i or 0)
    for i, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
            common = len(key) >= 20 and len({n for n, _ in where[key]}) >= 3
            if not common or i == max((x for _, x in where[key]), key=order):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_op9_sql_and_brute_force(spark, small, duck):
    got = queries.op9_line_dedup(spark, small).toPandas()
    same_rows(got, duck.sql(sql.OP9).df())
    rows = [(d["doc_id"], d["text"]) for d in documents(small)]
    assert Counter(got[["doc_id", "n_lines", "n_dropped", "kept_sha256"]].itertuples(index=False, name=None)) == plain_lines(rows)


def test_op9_odd_rows(spark):
    line = "A line that is Long enough to count"
    more = [(20 + i, f"own {i}\n  {line} \n{line.upper()}\nshort", "en", "a") for i in range(4)]
    more += [(None, line, "en", "a"), (30, "é" * 20 + "\n", "en", None), (31, "É" * 20, "en", None), (32, "é" * 20, "en", None), (33, "é" * 20 + "\r", "en", None)]
    df = odd_docs(spark).unionByName(docs_of(spark, more))
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.line_dedup(df, with_text=False).collect())
    assert got == plain_lines([(r["doc_id"], r["text"]) for r in df.collect()])
    with_text = line_dedup.line_dedup(df).collect()
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in with_text)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def jaccard_groups(rows, n=5, similarity=0.8):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in (text or "")))
        sets.append({" ".join(words)} if 0 < len(words) < n else {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)})
    links = []
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            union = len(sets[i]) + len(sets[j]) - both
            if (not union) or both >= similarity * union:
                links.append((j, i))
    return roots_of(len(sets), links)


@pytest.mark.parametrize("block", [3, 256])
def test_near_texts_are_jaccard_components(spark, small, monkeypatch, block):
    monkeypatch.setattr(near_texts, "BLOCK", block)
    docs = sorted(((d["doc_id"], d["text"]) for d in documents(small)), key=lambda x: x[0])
    rng = random.Random(5)
    for k in range(40):  # near copies of the first texts
        words = docs[k % 4][1].split()
        for _ in range(max(1, len(words) // 60)):
            words[rng.randrange(len(words))] = f"new{k}"
        docs.append((10_000 + k, " ".join(words)))
    groups = jaccard_groups(docs)
    want = {docs[i][0] for i, g in enumerate(groups) if g != i}
    df = docs_of(spark, [(i, t, "en", "a") for i, t in docs])
    kept = near_texts.drop_near_texts(df)
    assert kept.columns == df.columns
    assert {i for i, _ in docs} - {r["doc_id"] for r in kept.select("doc_id").collect()} == want


def test_near_texts_odd_rows(spark):
    df = odd_docs(spark)
    kept = near_texts.drop_near_texts(df)
    assert {r["doc_id"] for r in kept.collect()} >= {None, 8, 9, -3, 10}
    assert near_texts.drop_near_texts(df.limit(0)).count() == 0


def shared_ids(spark):
    """Many rows without an id and many with one id, with lines and sentences that they share, and repeated rows."""
    rng = random.Random(3)
    shared = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(24)) + f" {n}." for n in range(12)]
    rows = []
    for n in range(120):
        own = f"Only row {n} says what this line has to say, row {n}."
        text = "\n".join([own, *rng.sample(shared, 3)])
        rows.append(((None, 5, n)[n % 3], text, "en", "a"))
    return docs_of(spark, rows + rows[:20])


def test_op9_rows_that_share_an_id(spark):
    df = shared_ids(spark)
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.line_dedup(df, with_text=False).collect())
    assert got == plain_lines([(r["doc_id"], r["text"]) for r in df.collect()])
    assert any(dropped for _, _, dropped, _ in got)


@pytest.mark.parametrize("passages", [False, True])
def test_op2_rows_that_share_an_id(spark, passages):
    """Each row loses the runs that an earlier place has; rows of one id are one place where the run begins at the same byte."""
    df = shared_ids(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    order = lambda place: (place[0] is not None, place[0] or 0, place[1])
    places = defaultdict(set)
    for i, text in rows:
        for line in text.split("\n")[1:]:
            places[line].add((i, text.index(line)))
    want = Counter()
    for i, text in rows:
        lines = text.split("\n")
        kept = [x for n, x in enumerate(lines) if n == 0 or (i, text.index(x)) == min(places[x], key=order)]
        # the line break goes with the line
        want[(i, "".join(x + ("\n" if x is not lines[-1] else "") for x in kept))] += 1
    out = substring_dedup.substring_dedup(df, passages=passages)
    assert out.schema["doc_id"].dataType.simpleString() == "bigint"
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want
