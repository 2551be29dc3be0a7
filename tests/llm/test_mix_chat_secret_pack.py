"""Operators 6, 7, 8 and 10."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import chat, mixing, packing, queries, secrets, sql

from .helpers import docs_of, documents, odd_docs, same_rows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {s: 0.0 for s in names}, set(names)
    left = share * sum(sizes.values())
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > cap * sizes[s]}
        if not over:
            for s in open_:
                target[s] = left * weight[s] / whole
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def check_mix(rows, docs):
    size = {id(d): len(WORDS.findall(d["text"] or "")) for d in docs}
    totals = defaultdict(int)
    for d in docs:
        totals[d["source"]] += size[id(d)]
    target, taken, largest = filled(totals), defaultdict(int), defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        s = r["source"]
        assert r["source_size"] == totals[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in totals:
        assert abs(taken[s] - target[s]) <= 1, s
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d["doc_id"], size[id(d)]) for d in docs)


def test_op6_targets_and_sql(spark, small, duck):
    same_rows(queries.op6_mixing(spark, small).toPandas(), duck.sql(sql.OP6).df())
    rows = mixing.mix_sources(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    check_mix(rows.collect(), documents(small))


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 10}, {"a": 1, "b": 1, "c": 1, "d": 5000}, {"a": 900, "b": 5, "c": 70, None: 300}, {"a": 0, "b": 7}])
def test_op6_uneven_sources(spark, sizes):
    rows, i = [], 0
    for s, n in sizes.items():
        while n > 0:
            k = min(n, 7)
            rows.append((i, "w " * k, "en", s))
            n, i = n - k, i + 1
        rows.append((i, None, "en", s))
        i += 1
    df = docs_of(spark, rows)
    got = mixing.mix_sources(df).collect()
    check_mix(got, [{"doc_id": a, "text": t, "source": s} for a, t, _, s in rows])
    words = defaultdict(int)
    for r in mixing.mixed_documents(df).collect():
        words[r["doc_id"]] += len(WORDS.findall(r["text"]))
    assert {i: n for i, n in words.items() if n} == {r["doc_id"]: r["taken"] for r in got if r["taken"]}


def test_op6_odd_rows(spark):
    df = odd_docs(spark)
    rows = mixing.mix_sources(df).collect()
    check_mix(rows, [r.asDict() for r in df.collect()])
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix_sources(df.repartition(5)).collect()))
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() > 0
    assert mixing.mix_sources(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_op6_quality_weighs(spark):
    rows = [(i, "w " * 10, "en", s) for s in "ab" for i in range(1000 if s == "a" else 0, 2000 if s == "a" else 1000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, quality int")
    got = mixing.mix_sources(docs_of(spark, rows), labels, share=0.75).where("source = 'b'").collect()
    part = Counter()
    for r in got:
        part[r["doc_id"] % 2] += r["taken"]
    assert part[1] > 1.5 * part[0]


def test_op7_sql(spark, small, duck):
    same_rows(queries.op7_chat(spark, small).toPandas(), duck.sql(sql.OP7).df())


def test_op7_round_trip(spark):
    odd = ["", " ", "<|end|>\n", "<|turn|>user<|text|>", "<\\|end|>", "<\\\\|", "<||>", "<<|", "<", "|", "\\<|", "$1 \\1", "é\U0001f600<|", "\n\n", r"\### Assistant: </turn> ok", None, "a" * 100_000 + "<|"]
    rows = [(c, t, ["user", "assistant", "system<|text|>", None][(c + t) % 4], odd[(c * 5 + t) % len(odd)]) for c in range(20) for t in range(9)]
    rows += [(None, 1, "user", "no conversation"), (None, None, "assistant", "x"), (99, None, None, None), (99, 1, "assistant", "b"), (99, 1, "assistant", "a"), (99, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, "s", "k") for r in rows], "conv_id long, turn long, role string, text string, seq string, kind string")
    back = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.fold_events(chat.turn_events(df)))).collect()}
    rank = lambda v: (v is not None, v if v is not None else 0)
    word = lambda v: (v is not None, v or "")
    want = defaultdict(list)
    for c, _, r, x in sorted(rows, key=lambda r: (rank(r[1]), word(r[2]), word(r[3]))):
        want[c].append((r or "", x or ""))
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in back.items()} == dict(want)
    for r in back.values():
        assert [t["loss"] for t in r["turns"]] == [t["role"] == "assistant" for t in r["turns"]]
        assert r["formatted"].count("<|end|>\n") == len(r["turns"])
    for r in chat.render(chat.fold_events(chat.turn_events(df))).collect():
        assert sum(m["chars"] for m in r["mask"]) == len(r["formatted"])
        at, loss = 0, []
        for m in r["mask"]:
            if m["loss"]:
                loss.append(re.sub(r"<\\(\\*)\|", r"<\1|", r["formatted"][at : at + m["chars"]]))
            at += m["chars"]
        assert loss == [x for role, x in want[r["conv_id"]] if role == "assistant"]
    assert chat.render(chat.fold_events(chat.turn_events(df.limit(0)))).count() == 0


def test_op7_folds_events(spark):
    log = [
        (1, 1, 0, "message", "user", "Hel"), (1, 2, 0, "delta", None, "lo"), (1, 3, 1, "message", "assistant", ""), (1, 4, 1, "delta", None, "fir"),
        (1, 5, 1, "delta", None, "st"), (1, 6, 2, "message", "user", "gone"), (1, 7, 1, "regenerate", None, None), (1, 8, 1, "delta", None, "second"),
        (1, 9, 0, "edit", None, "Hello!"), (1, 10, 2, "message", "user", "after"), (2, 1, 0, "message", "user", "x"), (2, 2, 0, "unknown", None, "y"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string").repartition(7)
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.fold_events(df).collect()}
    assert got == {(1, 0): ("user", "Hello!"), (1, 1): ("assistant", "second"), (1, 2): ("user", "after"), (2, 0): ("user", "x")}


def plain_secrets(text):
    text, found = text or "", []
    kinds = [
        ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    for k, (name, pattern, good) in enumerate(kinds):
        found += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, text, re.ASCII) if good(m)]
    found.sort()
    n = Counter(f[3] for f in found)
    line = ",".join(f"{name}:{a}:{b}" for a, _, b, name in found)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(line.encode()).hexdigest(), set(line.split(",")) - {""}


NASTY = [
    "password=abc token: secretsecret", "PASSWORD = 'hunter22' and api_key=\"x\" apikey:abcdef", "toKen:toKen:abcdefg", "é AKIA" + "A" * 16 + " AKIAAAA", "AKIAAKIA" + "Z9" * 10,
    "f" * 24 + " " + "0" * 23 + "g" + "a" * 30 + "F", "secret  ::  abcdefghij", "apiKey=ſecret token=ab.cd/ef+gh_=-", "ſecret=abcdefgh Key", "İtoken=abcdefgh", "token=" + "a" * 100_000, "passwordtoken=abcdef",
]


def plain_verdicts(rows):
    """(all spans, counts of verdicts) of each (text, owner), by brute force: every row is a repository."""

    def entropy(v):
        return -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values())

    def mixed(v):
        return any("a" <= c <= "z" for c in v) and any("A" <= c <= "Z" for c in v) and any("0" <= c <= "9" for c in v) and entropy(v) >= 3.0

    parsed, owners, repos = [], defaultdict(set), defaultdict(set)
    for row, (text, owner) in enumerate(rows):
        text = text or ""
        found = [(m.start(), 0, m.end(), m[2]) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        taken = np.zeros(len(text) + 1, bool)
        for a, _, b, _ in found:
            taken[a:b] = True
        found += [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text) if mixed(m[0]) and not taken[m.start() : m.end()].any()]
        for _, _, _, v in found:
            owners[v].add(owner)
            repos[v].add(row)
        parsed.append(sorted(found))
    out = []
    for found in parsed:
        spans, verdicts = [], Counter()
        for a, k, b, v in found:
            live = entropy(v) >= 3.0 if k in (1, 2) else mixed(v)
            verdict = "example" if len(owners[v]) >= 3 or len(repos[v]) >= 20 else "shared" if len(owners[v]) > 1 else "live" if live else "weak"
            if k < 3 or verdict == "live":
                spans.append(f"{['assign', 'access', 'hex', 'owned'][k]}:{a}:{b}")
                verdicts[verdict] += 1
        out.append((",".join(spans), *(verdicts[v] for v in ("example", "shared", "live", "weak"))))
    return out


def test_op8_is_brute_force(spark, small):
    docs = documents(small)
    got = {r["doc_id"]: r for r in queries.op8_secrets(spark, small).collect()}
    assert got.keys() == {d["doc_id"] for d in docs}
    for d, found in zip(docs, plain_verdicts([(d["text"], d["source"]) for d in docs]), strict=True):
        r = got[d["doc_id"]]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == plain_secrets(d["text"])[:4]
        assert (r["spans"], r["n_example"], r["n_shared"], r["n_live"], r["n_weak"]) == found


def test_op8_verdicts_are_brute_force(spark):
    rng, values = random.Random(4), ["Q7w8E9r0T1y2U3i4O5p6AbCd", "Zx1Cv2Bn3Mq4Wl5Er6Ty7Ui8", "password=samevalue1", "AKIA" + "Q3" * 8, "token: Ab1" + "xYz9" * 4, "0123456789abcdef" * 2, "f" * 30]
    values += [f"K{i}w8E9r0T1y2U3i4O5p6AbCd" for i in range(5)]
    rows = [(k, " ".join([f"{rng.choice(values)}{rng.choice(['', ',', ' '])}" for _ in range(rng.randrange(6))]), "en", rng.choice("aab")) for k in range(60)]
    rows += [(100 + k, f"key {values[7]}", "en", "z") for k in range(25)] + [(200, values[8], "en", "q"), (201, None, "en", None), (202, values[9], "en", None)]
    got = Counter((r["doc_id"], r["spans"], r["n_example"], r["n_shared"], r["n_live"], r["n_weak"]) for r in secrets.secret_scan(docs_of(spark, rows)).collect())
    assert got == Counter((r[0], *f) for r, f in zip(rows, plain_verdicts([(r[1], r[3]) for r in rows]), strict=True))


def test_op8_is_linear_in_a_text():
    def took(n):
        text, start = "password=abcdef12 " * (n // 2) + "Q7w8E9r0T1y2U3i4O5p6AbCd " * n, time.process_time()
        assert len(secrets.further_spans(text, secrets.base_spans(text))) == n
        return time.process_time() - start

    took(1000)
    assert took(64_000) < 40 * max(took(4000), 0.005)


def test_op8_odd_rows(spark):
    df = odd_docs(spark).unionByName(docs_of(spark, [(100 + i, t, "en", "s") for i, t in enumerate(NASTY)]))
    rows = secrets.secret_scan(df).collect()
    want = Counter((r["doc_id"], *plain_secrets(r["text"])[:4]) for r in df.collect())
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows) == want
    assert secrets.secret_scan(df.limit(0)).count() == 0


def test_op8_ownership(spark):
    common, own, two = "Q7w8E9r0T1y2U3i4O5p6AbCd", "Zx1Cv2Bn3Mq4Wl5Er6Ty7Ui8", "password=samevalue1"
    rows = [(i, f"key {common} here", "en", f"s{i}") for i in range(4)] + [(10, f"key {own} here {two}", "en", "s1"), (11, f"again {own} {two}", "en", "s1"), (12, two, "en", "s2")]
    got = {r["doc_id"]: r for r in secrets.secret_scan(docs_of(spark, rows)).collect()}
    assert all(got[i]["spans"] == "" for i in range(4))
    assert got[10]["spans"].startswith("owned:4:28") and [(f["kind"], f["repos"], f["owners"], f["verdict"]) for f in got[10]["findings"]] == [("owned", 2, 1, "live"), ("assign", 3, 2, "shared")]
    assert [f["verdict"] for f in got[12]["findings"]] == ["shared"]


def check_packing(rows, docs, with_ids=True):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for i, text in docs:
        want[i, np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) // 4 > 0 and r["ids_crc32"] == zlib.crc32(r["ids"])
        by_doc[r["doc_id"]].append((r["start"], r["doc_tokens"], bytes(r["ids"])))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, pieces in by_doc.items():
        whole = [x for (j, x), n in want.items() if j == i for _ in range(n)]
        assert sum(len(p[2]) for p in pieces) == sum(map(len, whole))
        for start, total, ids in pieces:
            assert any(len(x) == 4 * total and x[4 * start : 4 * start + len(ids)] == ids for x in whole)
        if len(whole) == 1:
            at = 0
            for start, _, ids in sorted(pieces):
                assert start == at
                at += len(ids) // 4
    assert by_doc.keys() == {i for i, _ in docs}
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


@pytest.mark.parametrize("piece_rows", [7, 2048])
def test_op10_pieces(spark, small, monkeypatch, piece_rows):
    monkeypatch.setattr(packing, "PIECE_ROWS", piece_rows)
    rows = packing.pack(spark.read.parquet(f"{small}/documents.parquet")).collect()
    check_packing(rows, [(d["doc_id"], d["text"]) for d in documents(small)])
    slim = queries.op10_packing(spark, small)
    assert Counter(map(tuple, slim.select("doc_id", "start", "length", "ids_crc32", "sequence_id", "offset").collect())) == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["sequence_id"], r["offset"]) for r in rows)


def test_op10_odd_rows(spark):
    df = odd_docs(spark).unionByName(docs_of(spark, [(50, "<|endoftext|> a<|startoftext|>b it's 1,000 x y é \x1c z\x85w", "en", "s"), (51, "don't   DON'T\tÉcole ﬁ ①", "en", "s")]))
    check_packing(packing.pack(df).collect(), [(r["doc_id"], r["text"]) for r in df.collect()])
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("cache", [50, 100_000])
def test_op10_tokenizer_is_the_plain_one(monkeypatch, cache):
    """The ids are those of the plain tokenizer for any signs, and stay the same when the memory is full."""
    monkeypatch.setattr(packing, "CACHE", cache)
    tok, rng = packing.ChunkTokenizer(packing.tokenizer_path()), random.Random(cache)
    signs = [*"abcXYZ019'.,!<|>-_ \t\n\v\f\r\x1c\x00\x7f\x85\xa0éßÉÀÞ×÷ÿſİıΣσςﬁ①½٣中 \u0338\u0301\u200b—\U0001f642ǅ", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "e\u0301"]
    words = ["don't", "it's", "École", "the", "Häuser", "1,000", "a.b", "x=y", "naïve", "ÜBER", "l'été"]
    texts = [f"word{i} été{i % 7}, <|endoftext|>Ab don't {i}" for i in range(200)] + ["", " "]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(4000)]
    texts += ["".join(rng.choice(words) + rng.choice(["", " ", "'", ".", "\n", "é"]) for _ in range(rng.randrange(30))) for _ in range(500)]
    got = []
    for at in range(0, len(texts), 90):
        ids, ends = tok.encode(pa.array(texts[at : at + 90]))
        got += [x.tolist() for x in np.split(ids, ends[:-1])]
        assert len(tok.known) <= cache + 1
    assert got == [[*e.ids, 1] for e in tok.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_op10_shard_scores_are_bm25():
    rng = np.random.default_rng(2)
    docs = [rng.integers(2, 40, n).astype(np.uint16) for n in (5, 30, 60, 12)]
    idf = np.linspace(0.1, 3, 1 << 16).astype(np.float32)
    mean = np.mean([len(d) for d in docs])
    shard = packing.Shard(docs, idf, mean)
    seed = 2
    used = np.zeros(4, bool)
    used[seed] = True
    scores = []
    for j, d in enumerate(docs):
        s = 0.0
        for t in shard.queries[seed]:
            tf = int((d == t).sum())
            s += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) if tf else 0.0
        scores.append((-s, j))
    want = [j for s, j in sorted(scores) if j != seed and s < 0]
    assert shard.neighbours(seed, used) == want


def test_op10_windows_hold_neighbours(spark):
    """Documents of one topic share windows more often than chance has it."""
    rows = [(i, " ".join(f"topic{i % 10}word{(i * 7 + k) % 20}" for k in range(60)), "en", "s") for i in range(200)]
    pieces = packing.pack(docs_of(spark, rows), with_ids=False).collect()
    by_seq = defaultdict(set)
    for r in pieces:
        by_seq[r["sequence_id"]].add(r["doc_id"])
    same = [(a % 10) == (b % 10) for s in by_seq.values() for a in s for b in s if a < b]
    assert np.mean(same) > 0.4
