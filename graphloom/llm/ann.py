"""Approximate nearest neighbours by NN-descent and greedy graph search (operator 3).

Nearness is the largest inner product, in the graph as in the result. Equal
vectors are one node of the graph.

The graph starts from blocks of a random-hyperplane order, several times over.
Then each NN-descent round joins every node with its neighbours, in both
directions, and lets the neighbours of a node become acquainted with each
other: neighbours of neighbours are scored where they meet, and only pairs that
improve a neighbour list go on. Rounds end when few lists improve. Queries walk
the graph greedily, along its links in both directions: they expand the
unexpanded nodes among the best found until none is left.

Skew: of a node's reverse neighbours only the nearest count (``REVERSE`` in a
round, ``DEGREE`` in the search), which Spark selects on the map side first; a
hot node's forward links are spread by the skew join. These bounds, and
``POOL``, make the search approximate: ``recall`` measures it against
``exact_nearest``, which compares a set of queries, in blocks, with all rows
and may be called instead where every neighbour counts.

Defined results: vectors that are null, of another length than most (of the
shorter one if two are as common), zero, or that hold null or non-finite
components take no part; a null vec_id takes no part; of rows with the same
vec_id the one with the least vector takes part; ties go to the smaller vec_id;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, forget, map_arrow, passing, small_enough

#: Neighbours of a node, reverse neighbours that take part in a round.
DEGREE, REVERSE = 24, 16
#: Random orders that the graph starts from, rows compared with each other in one of them.
ORDERS, BLOCK = 3, 128
ROUNDS, STOP_SHARE = 6, 0.002
#: Nodes that a query keeps, fixed entry nodes.
POOL, ENTRIES = 128, 24
#: Bytes of vectors of queries up to which they are broadcast, and queries that are compared with all rows at once.
QUERY_BYTES, QUERY_BLOCK = 64 << 20, 2048
SEED = 42


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, as arrays of floats where they are, else of doubles."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return rows
    return rows.where(F.size("v") == common["n"]).groupBy("vec_id").agg(F.min("v").alias("v"))


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """(node, v, ids): a node for each distinct vector, with its smallest k + 1 ids."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("node"), "v", "ids")


def _best(order_by, of: str, k: int, edges: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(of).orderBy(*order_by))
    return edges.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def _top_pairs(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best of each row, the diagonal left out."""
    n = len(sims)
    np.fill_diagonal(sims, -np.inf)
    k = min(k, n - 1)
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    columns = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(n), k), columns.ravel()


def initial_links(points: DataFrame, width: int, degree: int) -> DataFrame:
    """(node, nbr, sim): brute force inside the blocks of several random orders."""
    rng = np.random.default_rng(SEED)
    mean = np.array([r or 0.0 for r in points.agg(*[F.avg(F.col("x")[i]) for i in range(width)]).first()], np.float32)
    out = None
    for turn in range(ORDERS):
        planes = rng.standard_normal((width, 13)).astype(np.float32)

        def code(batches, planes=planes):
            for batch in batches:
                p = (_matrix(batch.column(1)).astype(np.float32) - mean) @ planes
                bits = (p[:, :12] > 0) @ (1 << np.arange(11, -1, -1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits.astype(np.int64)), pa.array(p[:, 12].astype(np.float64))], ["node", "x", "code", "along"])

        def link(batches):
            ids, rows, held = [], [], 0
            for batch in batches:
                ids.append(batch.column(0).to_numpy())
                rows.append(_matrix(batch.column(1)).astype(np.float32))
                held += len(ids[-1])
                if held >= 16 * BLOCK:
                    yield from blocks(np.concatenate(ids), np.concatenate(rows))
                    ids, rows, held = [], [], 0
            if held:
                yield from blocks(np.concatenate(ids), np.concatenate(rows))

        def blocks(ids, rows):
            found = []
            for at in range(0, len(ids), BLOCK):
                x, own = rows[at : at + BLOCK], ids[at : at + BLOCK]
                sims = x @ x.T
                i, j = _top_pairs(sims, degree)
                found.append((own[i], own[j], sims[i, j]))
            a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float32))], ["node", "nbr", "sim"])

        ordered = map_arrow(points, code, "node long, x array<float>, code long, along double").repartitionByRange("code", "along", "node")
        links = map_arrow(ordered.sortWithinPartitions("code", "along", "node").select("node", "x"), link, "node long, nbr long, sim float")
        out = links if out is None else out.unionByName(links)
    return out


def _kept(links: DataFrame, degree: int) -> DataFrame:
    """The best neighbours of each node; a link that is found again counts once, as known before if it was."""
    once = links.groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    return _best([F.desc("sim"), "nbr"], "node", degree, once)


def neighbour_graph(points: DataFrame, width: int, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """(node, nbr, sim): approximately the nearest neighbours of every node."""
    graph = cut(_kept(initial_links(points, width, degree).withColumn("fresh", F.lit(1)), degree), "ann-graph")
    total = max(1, graph.count())

    def meet(batches):
        held = None
        for batch in batches:
            now = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(), _matrix(batch.column(4)).astype(np.float32))
            if held is not None and len(held[0]):
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True)) if len(now[0]) else held
            if not len(now[0]):
                continue
            of = now[0]
            done = int(np.searchsorted(of, of[-1]))  # a group has DEGREE + REVERSE rows at most; the last may go on
            held = tuple(x[done:] for x in now)
            yield from acquainted(*(x[:done] for x in now))
        if held is not None:
            yield from acquainted(*held)

    def acquainted(of, who, fresh, floor, x):
        if not len(of):
            return
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        found = []
        for a, b in zip(first, [*first[1:], len(of)], strict=True):
            new = fresh[a:b] > 0
            if b - a < 2 or not new.any():
                continue
            sims = x[a:b] @ x[a:b].T
            good = (sims > floor[a:b, None]) & (new[:, None] | new[None, :])
            np.fill_diagonal(good, False)
            i, j = np.nonzero(good)
            same = who[a:b][i] == who[a:b][j]
            i, j = i[~same], j[~same]
            found.append((who[a:b][i], who[a:b][j], sims[i, j]))
        if found:
            p, q, s = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(s.astype(np.float32))], ["node", "nbr", "sim"])

    for _ in range(rounds):
        # only nearer ones than a list's last can improve it
        floors = graph.groupBy("node").agg(F.when(F.count(F.lit(1)) >= degree, F.min("sim")).otherwise(F.lit(float("-inf"))).cast("float").alias("floor"))
        known = cut(points.join(floors, "node").select(F.col("node").alias("who"), "x", "floor"), "ann-points")
        back = _best([F.desc("fresh"), F.desc("sim"), "node"], "nbr", REVERSE, graph)
        around = graph.select(F.col("node").alias("of"), F.col("nbr").alias("who"), "fresh").unionByName(
            back.select(F.col("nbr").alias("of"), F.col("node").alias("who"), "fresh")
        )
        around = around.groupBy("of", "who").agg(F.max("fresh").alias("fresh"))
        around = cut(around, "ann-around").join(known, "who").select("of", "who", "fresh", "floor", "x")
        met = map_arrow(around.repartition("of").sortWithinPartitions("of", "who"), meet, "node long, nbr long, sim float")
        found = met.withColumn("fresh", F.lit(1)).unionByName(graph.withColumn("fresh", F.lit(0)))
        graph = cut(_kept(found, degree), "ann-graph")
        if (graph.agg(F.sum("fresh")).first()[0] or 0) <= STOP_SHARE * total:
            break
    return graph.select("node", "nbr", "sim")


def _score(candidates: DataFrame) -> DataFrame:
    """(query, node, score) from (query, node, qv, v): inner products in double precision."""

    def run(batches):
        for batch in batches:
            a, b = (_matrix(batch.column(i)).astype(np.float64) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.einsum("ij,ij->i", a, b))], ["query", "node", "score"])

    return map_arrow(candidates.select("query", "node", "qv", "v"), run, "query long, node long, score double")


def graph_search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, width: int, pool: int = POOL) -> DataFrame:
    """(query, node, score): the best nodes found for each of ``queries`` (query, at, qv).

    A search starts at the node ``at``, where the query has one, and at fixed
    entry nodes. It ends, as a node that left the pool can't come back.
    """
    vectors = nodes.select("node", "v")
    entries = [r["node"] for r in nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(ENTRIES).collect()]
    fixed = F.array(*[F.lit(e).cast("long") for e in entries])
    starts = queries.select("query", F.explode(F.array_distinct(F.array_compact(F.array_append(fixed, F.col("at"))))).alias("node"))
    back = _best([F.desc("sim"), "node"], "nbr", DEGREE, graph).select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))
    both = graph.select("node", "nbr").unionByName(back)
    lists = cut(both.groupBy("node").agg(F.collect_set("nbr").alias("nbrs")), "ann-lists")
    wanted = small_enough(queries.select("query", "qv"), QUERY_BYTES // (8 * width + 32))

    def scored(pairs: DataFrame) -> DataFrame:
        return _score(pairs.join(vectors, "node").join(wanted, "query"))

    found = cut(scored(starts).withColumn("open", F.lit(1)), "ann-pool")
    while found.where("open = 1").limit(1).count():
        ahead = found.where("open = 1").join(lists, "node").select("query", F.explode("nbrs").alias("node")).distinct()
        ahead = ahead.join(found.select("query", "node"), ["query", "node"], "left_anti")
        merged = found.withColumn("open", F.lit(0)).unionByName(scored(ahead).withColumn("open", F.lit(1)))
        before, found = found, cut(_best([F.desc("score"), "node"], "query", pool, merged), "ann-pool")
        forget(before)
    return found.select("query", "node", "score")


SCHEMA = "query_id long, rank int, vec_id long, score double"


def _ranked(each: DataFrame, k: int) -> DataFrame:
    """The k best of (query, vec_id, score)."""
    top = _best([F.desc("score"), "vec_id"], "query", k, each)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return top.select(F.col("query").alias("query_id"), rank.cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row whose id is divisible by ``every``."""
    with passing(vectors.sparkSession) as keep:
        rows = cut(usable(vectors, id_col, vector_col), "ann-rows")
        nodes = keep(cut(nodes_of(rows, k), "ann-nodes"))
        one = nodes.select(F.size("v").alias("n")).first()
        if one is None:
            return vectors.sparkSession.createDataFrame([], SCHEMA)
        points = cut(nodes.select("node", F.col("v").cast("array<float>").alias("x")), "ann-points")
        graph = neighbour_graph(points, one["n"])
        asked = rows.where(F.col("vec_id") % every == 0).withColumnRenamed("v", "qv")
        queries = asked.join(nodes.select("v", "node"), F.col("qv") == F.col("v")).select(F.col("vec_id").alias("query"), F.col("node").alias("at"), "qv")
        found = keep(cut(graph_search(nodes, graph, cut(queries, "ann-queries"), one["n"], max(POOL, 2 * k + 1)), "ann-found"))
    each = found.join(nodes.select("node", "ids"), "node").select("query", F.explode("ids").alias("vec_id"), "score").where("vec_id != query")
    return _ranked(each, k)


def exact_nearest(vectors: DataFrame, queries: list[int], k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The columns of ``nearest`` for some ids, by comparing blocks of them with all rows.

    A task sends the k best of its rows for each query of a block.
    """
    rows = cut(usable(vectors, id_col, vector_col), "ann-rows")
    spark, out = vectors.sparkSession, None
    for at in range(0, len(queries), QUERY_BLOCK):
        block = rows.where(F.col("vec_id").isin(queries[at : at + QUERY_BLOCK])).toArrow()
        if not block.num_rows:
            continue
        shared = spark.sparkContext.broadcast((block["vec_id"].to_numpy(), _matrix(block["v"].combine_chunks()).astype(np.float64)))

        def best(batches, shared=shared):
            ids, wanted = shared.value
            top, held = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for batch in batches:
                own = batch.column(0).to_numpy()
                for start in range(0, len(own), 512):
                    part = own[start : start + 512]
                    scores = np.einsum("ij,kj->ik", wanted, _matrix(batch.column(1).slice(start, 512)).astype(np.float64))
                    scores[ids[:, None] == part[None, :]] = -np.inf
                    scores, names = np.hstack([top, scores]), np.hstack([held, np.broadcast_to(part, scores.shape)])
                    order = np.lexsort((names, -scores), axis=1)[:, :k]
                    top, held = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
            row, column = np.nonzero(top > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(held[row, column]), pa.array(top[row, column])], ["query", "vec_id", "score"])

        found = map_arrow(rows.select("vec_id", "v"), best, "query long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else _ranked(out, k)


def recall(vectors: DataFrame, found: DataFrame, sample: int = 1000, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """The share of the true k nearest that ``found`` has, over a sample of its queries (by a hash of their ids)."""
    asked = [r["query_id"] for r in found.select("query_id").distinct().orderBy(F.xxhash64("query_id"), "query_id").limit(sample).collect()]
    truth = exact_nearest(vectors, asked, k, id_col, vector_col).select("query_id", "vec_id", F.lit(1).alias("hit"))
    hits = truth.join(found.select("query_id", "vec_id", F.lit(1).alias("got")), ["query_id", "vec_id"], "left")
    return hits.agg(F.avg(F.coalesce("got", F.lit(0)).cast("double"))).first()[0] or 1.0
