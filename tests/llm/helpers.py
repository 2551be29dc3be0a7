"""Shared by the tests of the training-data operators."""

import duckdb
import pandas as pd

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, fp string, size string, `first` int"


def docs_of(spark, rows):
    """A documents table of (doc_id, text, lang, source) rows with further columns whose names operators use themselves."""
    full = [(i, t, la, s, None if t is None else len(t), "x", "y", "z", 1) for i, t, la, s in rows]
    return spark.createDataFrame(full, DOCS)


def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"Word{i % 977} and more." for i in range(30_000))
    rows = [
        (None, None, None, None), (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, "b"), (4, long, "en", None), (5, long, "en", "a"),
        (6, "the same short text here", "en", "a"), (6, "the same short text here", "en", "a"), (7, "the same short text here", "fr", None),
        (None, "a text without an id", "en", "c"), (8, "12345 67890 !!", "de", "c"), (9, "\x00 odd   signs \U0001f600 é", "de", "c"),
        (-3, "negative id", "fr", "d"), (10, "x" * 50_000, "fr", "d"), (6, "another text with that id", "fr", "d"),
    ]
    return docs_of(spark, rows)


def same_rows(a: pd.DataFrame, b: pd.DataFrame):
    """Whether two frames hold the same rows, in any order."""
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)

    def plain(df):
        df = df[cols].astype(object)
        return sorted(map(repr, df.where(df.notna(), None).values.tolist()))

    assert plain(a) == plain(b)


def documents(small):
    return duckdb.sql(f"select * from '{small}/documents.parquet'").df().to_dict("records")


def roots_of(n, links):
    """The smallest index reachable, for each of n."""
    root = list(range(n))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]
