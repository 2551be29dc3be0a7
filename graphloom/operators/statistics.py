"""Statistics of a set of triples (s, p, o_v, o_t, o_st)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = {"s": ("s",), "p": ("p",), "o": ("o_v", "o_t", "o_st")}


def columns(slots: str) -> list[str]:
    return [c for x in slots for c in SLOTS[x]]


def pattern_counts(triples: DataFrame, slots: str) -> DataFrame:
    """How many triples there are for each value of some slots ("p", "so", ...): the exact cardinality of a pattern."""
    return triples.groupBy(*columns(slots)).agg(F.count(F.lit(1)).alias("count"))


def all_pattern_counts(triples: DataFrame) -> dict[str, DataFrame]:
    """Of all subsets of slots, as an index of aggregated facts keeps them."""
    return {"".join(x): pattern_counts(triples, "".join(x)) for n in (1, 2) for x in combinations("spo", n)}


def term_of(slot: str) -> list:
    """A slot as a term: subjects and predicates are IRIs."""
    if slot == "o":
        return [F.col("o_v").alias("v"), F.col("o_t").cast("tinyint").alias("t"), F.coalesce("o_st", F.lit("")).alias("st")]
    return [F.col(slot).alias("v"), F.lit(0).cast("tinyint").alias("t"), F.lit("").alias("st")]


def join_partner_counts(left: DataFrame, left_slot: str, right: DataFrame, right_slot: str) -> DataFrame:
    """(partners): the exact size of the join of two sets of triples on a slot of each, from counts of each term."""
    a = left.select(*term_of(left_slot)).groupBy("v", "t", "st").agg(F.count(F.lit(1)).alias("a"))
    b = right.select(*term_of(right_slot)).groupBy("v", "t", "st").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, ["v", "t", "st"]).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("partners"))


def join_partners(left: DataFrame, left_slot: str, right: DataFrame, right_slot: str) -> int:
    return int(join_partner_counts(left, left_slot, right, right_slot).first()[0])


def join_selectivity(left: DataFrame, left_slot: str, right: DataFrame, right_slot: str) -> float:
    """The share of the product that a join keeps."""
    whole = left.count() * right.count()
    return join_partners(left, left_slot, right, right_slot) / whole if whole else 0.0


def _by_subject(triples: DataFrame) -> DataFrame:
    """(s, p) shuffled once, to as many partitions as the session shuffles to: those that adaptive execution makes of texts are many times larger in memory."""
    return triples.select("s", "p").repartition(int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s")


def characteristic_sets(triples: DataFrame) -> DataFrame:
    """predicates, subjects and triples: how many subjects have exactly a set of predicates."""
    own = _by_subject(triples).groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"))
    sets = own.groupBy("s").agg(F.sort_array(F.collect_list("p")).alias("predicates"), F.sum("n").alias("n"))
    return sets.groupBy("predicates").agg(F.count(F.lit(1)).alias("subjects"), F.sum("n").cast("long").alias("triples"))


#: Predicates that one number has bits for.
BITS = 63


def star_counts(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """(star): how many subjects have all of the predicates; a subject is a bit for each that it has."""
    wanted = sorted(set(predicates))
    groups = [wanted[i : i + BITS] for i in range(0, len(wanted), BITS)]
    if wanted:
        triples = triples.where(F.col("p").isin(wanted))
    bits = [
        F.bit_or(F.coalesce(*[F.when(F.col("p") == p, F.lit(1 << i).cast("long")) for i, p in enumerate(g)], F.lit(0).cast("long"))).alias(f"bits_{k}")
        for k, g in enumerate(groups)
    ]
    have = _by_subject(triples).groupBy("s").agg(F.count(F.lit(1)).alias("n"), *bits)
    for k, g in enumerate(groups):
        have = have.where(F.col(f"bits_{k}") == F.lit((1 << len(g)) - 1).cast("long"))
    return have.agg(F.count(F.lit(1)).alias("star"))


def star_cardinality(triples: DataFrame, predicates: list[str]) -> int:
    return int(star_counts(triples, predicates).first()[0])
