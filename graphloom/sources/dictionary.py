"""Terms as numbers, and exports of numbered triples.

Spark's Parquet files already encode repeated strings, so nothing here is
needed for queries; it serves exchange with stores that keep numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.statistics import columns, term_of
from ..scratch import materialised
from .turtle import unescaped

#: Predicates that are sent to all tasks; where there are more, triples are shuffled to them as to any term.
FEW = 100_000
#: The six orders of a triple's slots.
ORDERS = ("spo", "sop", "ops", "osp", "pso", "pos")


def _numbered(df: DataFrame, *order) -> DataFrame:
    """Ids from 0 in an order, without bringing all rows into one task: partitions are counted first."""
    spark: SparkSession = df.sparkSession
    placed = materialised(df.orderBy(*order).withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "numbered")
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    shift, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, shift - (part << 33)))
        shift += sizes[part]
    shifts = spark.createDataFrame(rows, "part int, shift long")
    return placed.join(F.broadcast(shifts), "part").withColumn("id", F.col("nth") + F.col("shift")).drop("part", "nth", "shift")


def build_dictionary(triples: DataFrame, by_use: bool = False) -> DataFrame:
    """(id, v, t, st, is_p) of every term; predicates come first, then by text, or by falling use. Triples may repeat, save that use counts them."""
    uses = None
    for slot in "spo":
        own = triples.select(*term_of(slot), F.lit(int(slot == "p")).alias("is_p"))
        uses = own if uses is None else uses.unionAll(own)
    terms = uses.groupBy("v", "t", "st").agg(F.max("is_p").alias("is_p"), F.count(F.lit(1)).alias("uses"))
    order = [F.desc("is_p"), *([F.desc("uses")] if by_use else []), "v", "t", "st"]
    placed = _numbered(terms if by_use else terms.drop("uses"), *order)
    return placed.select("id", "v", "t", F.when(F.col("st") != "", F.col("st")).alias("st"), (F.col("is_p") == 1).alias("is_p"))


def predicates(dictionary: DataFrame) -> DataFrame:
    """The terms of a dictionary that are predicates of the triples it was built of; if they are few, joins send them to all tasks."""
    own = dictionary.where("is_p")
    return own.hint("broadcast" if own.count() <= FEW else "shuffle_hash")


def _looked_up(dictionary: DataFrame, known: DataFrame | None, slot: str) -> DataFrame:
    """What a slot is joined with. The dictionary is the side that is hashed: its keys don't repeat, and no triple is sorted."""
    return known if slot == "p" and known is not None else dictionary.hint("shuffle_hash")


def encode(triples: DataFrame, dictionary: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(s, p, o) as ids: three joins with the dictionary. known: its predicates, if it was built of these triples."""
    out = triples.select("s", "p", *[c.alias(f"o_{n}") for c, n in zip(term_of("o"), ("v", "t", "st"), strict=True)])
    for slot in "pso":
        d = _looked_up(dictionary, known, slot)
        d = d.select(F.col("id").alias(f"{slot}_id"), F.col("v").alias("d_v"), F.col("t").alias("d_t"), F.coalesce("st", F.lit("")).alias("d_st"))
        test = (F.col("o_v") == F.col("d_v")) & (F.col("o_t") == F.col("d_t")) & (F.col("o_st") == F.col("d_st")) if slot == "o" else (F.col(slot) == F.col("d_v")) & (F.col("d_t") == 0)
        out = out.join(d, test).drop("d_v", "d_t", "d_st", slot)
    return out.select(*[F.col(f"{x}_id").alias(x) for x in "spo"])


def decode(ids: DataFrame, dictionary: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The triples of ids. known: the dictionary's predicates, if it was built of these triples."""
    out = ids
    for slot in "osp":
        d = _looked_up(dictionary, known, slot).select(F.col("id").alias(f"{slot}_key"), F.struct("v", "t", "st").alias(f"{slot}_term"))
        out = out.join(d, F.col(slot) == F.col(f"{slot}_key"))
    return out.select(
        F.col("s_term.v").alias("s"), F.col("p_term.v").alias("p"), F.col("o_term.v").alias("o_v"), F.col("o_term.t").alias("o_t"), F.col("o_term.st").alias("o_st")
    )


def lookup_ids(dictionary: DataFrame, ids: list[int]) -> DataFrame:
    return dictionary.where(F.col("id").isin(ids))


def lookup_terms(dictionary: DataFrame, texts: list[str]) -> DataFrame:
    return dictionary.where(F.col("v").isin(texts))


def permutation(triples: DataFrame, order: str) -> DataFrame:
    """The triples sorted in one of the six orders."""
    if order not in ORDERS:
        raise ValueError(f"{order} is no order of s, p and o")
    return triples.orderBy(*columns(order))


def escaped(text):
    for raw, safe in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def write_raw(ids: DataFrame, dictionary: DataFrame, path: str) -> None:
    """``facts``: three ids a line; ``strings``: id, type, sub-type and escaped text a line."""
    ids.select(F.concat_ws(" ", "s", "p", "o")).write.text(f"{path}/facts")
    # a sub-type is shown by its text, as it needs no id of its own here
    dictionary.select(F.concat_ws(" ", "id", "t", F.coalesce(escaped(F.col("st")), F.lit("0")), escaped(F.col("v")))).write.text(f"{path}/strings")


def read_raw(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The ids and the dictionary that write_raw has written."""
    f = F.split("value", " ")
    ids = spark.read.text(f"{path}/facts").select(*[f[i].cast("long").alias(x) for i, x in enumerate("spo")])
    p = F.split("value", " ", 4)
    text = unescaped(p[3], (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")))
    strings = spark.read.text(f"{path}/strings").select(
        p[0].cast("long").alias("id"), text.alias("v"), p[1].cast("tinyint").alias("t"), F.when(p[2] != "0", p[2]).alias("st")
    )
    return ids, strings


#: DDL for the two-table layout that write_relational fills.
RELATIONAL_DDL = """create table facts (subject bigint not null, predicate bigint not null, object bigint not null);
create table strings (id bigint primary key, value varchar not null);
create index facts_pso on facts (predicate, subject, object);
create index facts_pos on facts (predicate, object, subject);
create index facts_spo on facts (subject, predicate, object);
"""


def write_relational(ids: DataFrame, dictionary: DataFrame, path: str) -> str:
    """CSV of ``facts`` and ``strings``; returns the DDL."""
    ids.select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object")).write.csv(f"{path}/facts", header=True)
    dictionary.select("id", F.col("v").alias("value")).write.csv(f"{path}/strings", header=True, escape='"')
    return RELATIONAL_DDL


def write_vertical(ids: DataFrame, path: str, least: int = 1000) -> None:
    """Parquet with a folder for each predicate of at least ``least`` triples, and one for the rest."""
    counts = ids.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    big = counts.where(F.col("n") >= least).select(F.col("p").alias("big"))
    named = ids.join(big, F.col("p") == F.col("big"), "left").withColumn("property", F.coalesce(F.col("big").cast("string"), F.lit("other")))
    named.select("s", "p", "o", "property").write.partitionBy("property").parquet(path)
