"""Secret scans with corpus-wide ownership frequency (operator 8).

Three base patterns find candidate credentials: assignments to a telling name,
access key ids and long hexadecimal runs. Long mixed tokens outside of those
are further candidates. Every candidate value is hashed, and the hashes are
aggregated over the corpus by distinct repositories and owners. Verdicts:

* ``example``: many owners or many repositories have the value, so it is widely copied;
* ``live``: one owner has it, in few repositories, and it looks live;
* ``shared``: a few owners have it;
* ``weak``: one owner has it, but it doesn't look live.

Further candidates are reported only where they are ``live``; base findings
always stay, with their verdict.

Defined results: a null text is empty; a null owner is an owner of its own; each
row is a repository of its own unless a column names it; spans are in code
points, end exclusive, ordered by start, then kind; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

KINDS = ("assign", "access", "hex", "owned")
#: Owners, and repositories, from which on a value counts as a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 20
#: Shannon entropy, in bits a character, of a token that looks live.
MIN_ENTROPY = 3.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) of the base findings, sorted."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def looks_live(value: str, kind: int = 3) -> bool:
    """High entropy and, but for access key ids and hexadecimal runs, letters of both cases and digits."""
    if kind not in (1, 2) and not (re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= MIN_ENTROPY


def further_spans(text: str, base: list) -> list[tuple[int, int, int, str]]:
    """Live-looking tokens that overlap no base finding; ``base`` is sorted by start."""
    found, at, reach = [], 0, 0
    for m in _TOKEN.finditer(text):
        # how far the findings that begin before the token's end reach
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start() and looks_live(m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return found


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def _digest(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("h", pa.int64()), ("check", pa.int64()), ("live", pa.bool_())])


def candidates(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, owner, repo, text), with its candidates and their hashes."""

    def run(batches):
        serial = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("row", "n_assign", "n_access", "n_hex", "base_sha256", "found")}
            for text in batch.column(3).to_pylist():
                text = text or ""
                base = base_spans(text)
                kinds = [k for _, k, _, _ in base]
                rows["row"].append(serial)
                serial += 1
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    rows[name].append(kinds.count(k))
                rows["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                rows["found"].append([
                    {"start": s, "kind": k, "end": e, "h": _digest(v), "check": _digest("check" + v), "live": looks_live(v, k)} for s, k, e, v in [*base, *further_spans(text, base)]
                ])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(rows[k], pa.int64()) for k in ("row", "n_assign", "n_access", "n_hex")),
                 pa.array(rows["base_sha256"], pa.string()), pa.array(rows["found"], pa.list_(_SPAN))],
                ["doc_id", "owner", "repo", "row", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return map_arrow(
        docs,
        run,
        f"doc_id {kinds['doc_id']}, owner {kinds['owner']}, repo {kinds['repo']}, row long, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "found array<struct<start:int,kind:int,end:int,h:long,check:long,live:boolean>>",
    )


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None,
    example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS,
) -> DataFrame:
    """doc_id, counts, base_sha256, spans, n_example, n_shared, n_live, n_weak and findings of every row.

    findings: array of (kind, start, end, repos, owners, verdict).
    """
    repo = F.lit(None).cast("long") if repo_col is None else F.col(repo_col)
    scanned = cut(candidates(docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"), repo.alias("repo"), F.col(text_col).alias("text"))), "scanned")
    found = scanned.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("f")).select("row", "owner", "repo", "f.*")
    unit = F.struct("repo", F.when(F.col("repo").isNull(), F.col("row")).alias("row"))
    # a value counts once for each repository, however often it stands there
    by_repo = found.groupBy("h", "check", "owner", unit.alias("unit")).agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("h", "check", "owner").agg(F.count(F.lit(1)).alias("n"))
    held = by_owner.groupBy("h", "check").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").cast("long").alias("repos"))
    held = cut(held.withColumnsRenamed({"h": "of_h", "check": "of_check"}), "ownership")
    verdict = F.when((F.col("owners") >= example_owners) | (F.col("repos") >= example_repos), "example").when(F.col("owners") > 1, "shared")
    verdict = verdict.when(F.col("live"), "live").otherwise("weak")
    judged = (
        found.join(held, (F.col("h") == F.col("of_h")) & (F.col("check") == F.col("of_check")))
        .withColumn("verdict", verdict)
        .where((F.col("kind") < 3) | (F.col("verdict") == "live"))
        .groupBy(F.col("row").alias("of"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "repos", "owners", "verdict"))).alias("findings"))
    )
    out = scanned.drop("found").join(judged, F.col("row") == F.col("of"), "left")
    name = F.array(*[F.lit(k) for k in KINDS])
    none = F.array().cast("array<struct<start:int,kind:int,end:int,repos:long,owners:long,verdict:string>>")
    out = out.withColumn("findings", F.coalesce("findings", none))
    line = F.transform("findings", lambda f: F.concat_ws(":", F.element_at(name, f["kind"] + 1), f["start"].cast("string"), f["end"].cast("string")))
    full = F.transform("findings", lambda f: F.struct(
        F.element_at(name, f["kind"] + 1).alias("kind"), f["start"].alias("start"), f["end"].alias("end"),
        f["repos"].alias("repos"), f["owners"].alias("owners"), f["verdict"].alias("verdict"),
    ))

    def number(verdict: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["verdict"] == verdict)).cast("long").alias(f"n_{verdict}")

    counts = [number(v) for v in ("example", "shared", "live", "weak")]
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(line, ",").alias("spans"), *counts, full.alias("findings"))
