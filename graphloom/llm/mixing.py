"""Mixing sources to target weights (operator 6), DataFrame functions only.

A source's target is its weight's share of a budget, capped at a number of
epochs, with the excess of capped sources shared again by weight. Complete
epochs are taken first. What remains is an Efraimidis-Spirakis sample without
replacement: documents are ordered by the exponential key -ln(u)/quality, u
being a hash of the doc_id and the text, and taken until the prefix sum of their sizes meets
the budget; the document on the boundary is taken in part.

A hot source is not sorted in one task: keys are binned by the distribution
they follow, bins are prefix-summed on their totals, and only inside a bin are
rows sorted.

Defined results: a null text has size 0 and is taken 0 times; a null source is
a source of its own, last in order; an unlabelled document has quality 1; equal
keys are ordered by doc_id and size (nulls first); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, eq, small_enough

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MAX_EPOCHS = (3, 1, 2), 1.5, 2
#: Rows that one bin of keys shall have on average.
BIN_ROWS = 4_000
#: Weights by quality: 1, unlabelled, 0.
GOOD, PLAIN, POOR = 2.0, 1.0, 0.5


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of the id and the text: rows that share an id, or have none, differ."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return (F.conv(F.substring(F.md5(both.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size and target of each source; ``sizes`` has source and size.

    One row for each source is sorted in one task; sources, unlike documents, are few.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    # water-filling: sources are capped in the order of cap / weight while their share exceeds the cap
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumns({
        "budget": F.sum("source_size").over(all_rows) * F.lit(float(share)),
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weight_left": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    }).withColumn("rate", (F.col("budget") - F.col("cap_before")) / F.col("weight_left"))
    # from the first source whose share fits on, rates no longer rise: its rate is the largest of those that fit
    open_rate = F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.col("rate"))
    level = level.withColumn("first_open", F.max(open_rate).over(all_rows)).withColumn(
        "target", F.when(F.col("first_open").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("first_open") * F.col("weight")))
    )
    return level.select("source", "source_size", "target")


def mix_sources(
    docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """doc_id, source, tie (a hash of the text), size, source_size, target, epochs and taken of every row.

    labels: (doc_id, quality); quality 1 weighs 2, quality 0 weighs 0.5, none weighs 1.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), (-F.log(uniform(F.col(id_col), F.col(text_col)))).alias("wait"),
    )
    if labels is None:
        slim = slim.withColumn("weight", F.lit(PLAIN))
    else:
        marks = labels.groupBy(F.col("doc_id").alias("of")).agg(F.max("quality").alias("mark"))
        slim = slim.join(marks, F.col("doc_id") == F.col("of"), "left").withColumn("weight", F.when(F.col("mark") > 0, GOOD).when(F.col("mark") <= 0, POOR).otherwise(PLAIN))
    slim = cut(slim.select("doc_id", "source", "tie", "size", "weight", (F.col("wait") / F.col("weight")).alias("key")), "mix-sizes")
    # bins of a source in the order of keys; they are even, as its keys are distributed like a mixture of exponentials
    shares = slim.groupBy(F.col("source").alias("s_source")).agg(
        *[F.avg((F.col("weight") == w).cast("double")).alias(name) for name, w in (("good", GOOD), ("plain", PLAIN), ("poor", POOR))],
        F.ceil(F.count(F.lit(1)) / BIN_ROWS).cast("int").alias("bins"),
    )
    slim = slim.join(small_enough(cut(shares, "mix-shares")), eq((F.col("source"), F.col("s_source"))))
    below = sum((F.col(name) * (1 - F.exp(-F.col("key") * w)) for name, w in (("good", GOOD), ("plain", PLAIN), ("poor", POOR))), F.lit(0.0))
    slim = slim.withColumn("bin", F.least(F.col("bins") - 1, F.floor(below * F.col("bins"))).cast("int")).drop("s_source", "good", "plain", "poor", "bins", "weight")
    targets = source_targets(slim, weights, share, epochs).select(F.col("source").alias("t_source"), "source_size", "target")
    bins = slim.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        F.col("source").alias("b_source"), F.col("bin").alias("b_bin"), F.coalesce(F.sum("bin_size").over(upto), F.lit(0)).cast("long").alias("bins_before")
    ).join(targets, eq((F.col("b_source"), F.col("t_source")))).drop("t_source")
    bins = cut(bins, "mix-bins")
    inside = Window.partitionBy("source", "bin").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = slim.withColumn("upto", F.sum("size").over(inside)).join(
        bins, eq((F.col("source"), F.col("b_source"))) & (F.col("bin") == F.col("b_bin"))
    )
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("epochs", F.least(full, F.lit(epochs).cast("long"))).withColumn(
        "rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long") - F.col("bins_before") - F.col("upto") + F.col("size")
    )
    part = F.when(F.col("epochs") < epochs, F.greatest(F.lit(0).cast("long"), F.least("size", "rest"))).otherwise(F.lit(0).cast("long"))
    return placed.select("doc_id", "source", "tie", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space kept."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document once for each complete epoch, then its fraction.

    A document taken in part is cut after the words that are taken. Columns are
    those of ``docs``; a document of which nothing is taken has no row. Rows
    that are equal in id, source and text are taken alike (the largest share any
    of them got).
    """
    taken = mix_sources(docs, labels, id_col, text_col, source_col)
    taken = taken.groupBy("doc_id", "source", "tie").agg(F.max("epochs").alias("epochs"), F.max("size").alias("size"), F.max("taken").alias("taken"))
    taken = cut(taken.where("taken > 0"), "mix-taken")
    # the document's columns keep their names whatever they are
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("of_tie"))
    joined = rows.join(taken, eq((F.col("row")[id_col], F.col("doc_id")), (F.col("row")[source_col], F.col("source"))) & (F.col("of_tie") == F.col("tie")))
    part = F.col("taken") - F.col("epochs") * F.col("size")
    wanted = F.flatten(F.array(
        F.array_repeat(F.col("size"), F.col("epochs").cast("int")),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")),
    ))
    each = joined.select("row", "size", F.explode(wanted).alias("words"))
    text = F.col("row")[text_col]
    body = F.when(F.col("words") >= F.col("size"), text).otherwise(first_words(text, F.col("words")))
    return each.select(*[(body if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
