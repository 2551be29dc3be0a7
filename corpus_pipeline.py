"""The training-data pipeline over ``documents``: five stages, each an operator of graphloom.llm.

Each stage takes what its predecessor kept; all but the last return the columns
of ``documents``, and other ones as they are. An empty table gives an empty
result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, langid, mixing, near_texts, packing
from graphloom.llm.common import cut, eq, small_enough, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose language was told; each is judged by its own text.

    Rows with a null, empty or letterless text (``und``) go; repeated rows are
    judged alike and all stay or go; where no language could be learned all go.
    """
    return langid.told_rows(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of those with the same text, one with the largest doc_id.

    A null text counts as the empty text, a null doc_id is smaller than any
    other; of several rows with that doc_id and text one stays, rows with the
    same doc_id but different texts all stay.
    """
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    judged = exact_dedup.exact_dedup(docs).where("group_size > 1")
    # not the row that stays, or one of several rows with its doc_id and text
    other = ~eq((F.col("doc_id"), F.col("keep_id")))
    marks = judged.where(~F.col("kept")).select(F.col("doc_id").alias("of"), F.col("text_sha256").alias("of_sha"), other.alias("other")).distinct()
    marks = cut(marks, "exact-marks")
    # the rows' columns keep their names whatever they are
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), sha.alias("sha"))
    same = eq((F.col("id"), F.col("of"))) & (F.col("sha") == F.col("of_sha"))
    kept = rows.join(small_enough(marks), same, "left_anti").select("row.*")
    twins = marks.where(~F.col("other"))
    if twins.limit(1).count():
        # each task sends one row for each twin
        order = F.xxhash64(*[c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))])
        rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), sha.alias("sha"), order.alias("order"))
        one = rows.join(twins, same, "left_semi").groupBy("id", "sha").agg(F.min_by("row", "order").alias("row"))
        kept = kept.unionByName(one.select("row.*"))
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of similar texts, the one with the smallest doc_id.

    Rows are judged each on their own, whatever their doc_ids; texts without
    words are similar to each other; of rows without a doc_id one stays where
    the group has no other.
    """
    return near_texts.drop_near_texts(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents repeated and cut to their shares, with n_chars of the text as it is then.

    Texts without words have no share and go; a null source is a source of its
    own; rows equal in doc_id, source and text are taken alike.
    """
    mixed = mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences' pieces: every row on its own, a null text as its end id alone."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("language", identify_language),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("mix", mix),
    ("pack", pack),
]

#: SQL has no cross-parsing, no MinHash and no tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
