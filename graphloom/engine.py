"""The engine: queries over a source of triples, changes of a store, functions of one's own."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame

from .functions.expressions import ScalarFunction
from .plans.algebra import Query
from .plans.parser import TABLE_FUNCTION, QueryError, parse
from .plans.planner import Planner, Registry, TableFunctionDef
from .sources.base import Source
from .sources.triples import TripleStore
from .sources.turtle import turtle_frame
from .terms import LITERAL, NATIVE


class Engine:
    def __init__(self, source: Source, table_function: str = TABLE_FUNCTION):
        self.source, self.spark = source, source.spark
        self.registry, self.table_function = Registry(), table_function
        self._inserts = 0

    # queries

    def parse(self, text: str) -> Query:
        return parse(text, self.table_function)

    def query(self, text: str, render: str = "values") -> DataFrame:
        """The result of a select query as a DataFrame."""
        return Planner(self.source, self.registry).query(self.parse(text), render)

    def explain(self, text: str, mode: str = "formatted") -> str:
        """Spark's plan of a query."""
        jvm = self.spark.sparkContext._jvm
        return jvm.PythonSQLUtils.explainString(self.query(text)._jdf.queryExecution(), mode)

    def expand_template(self, template: str, marker: str = "@", limit: int = 10) -> list[str]:
        """Queries in which each marker stands for one of the terms that occur there most often.

        Markers are filled from the first to the last; each is counted with the
        ones before it filled, so every query has results.
        """
        parts = re.split(rf"(?<![A-Za-z0-9\"]){re.escape(marker)}(?![A-Za-z])", template)
        if len(parts) == 1:
            return [template]
        out = [parts[0]]
        for i, tail in enumerate(parts[1:]):
            grown = []
            for done in out:
                rest = "".join(f"?_hole{j}{p}" for j, p in enumerate(parts[i + 2 :], i + 1))
                body = re.search(r"where\s*(\{.*\})", done + f"?_hole{i}" + tail + rest, re.IGNORECASE | re.DOTALL)
                if body is None:
                    raise QueryError("a template needs a where clause")
                found = self.query(f"{_prefixes(template)} select count ?_hole{i} where {body[1]} order by desc(count) ?_hole{i} limit {limit}", "terms")
                grown += [done + r[0] + tail for r in found.collect()]  # at most ``limit`` rows
            out = grown
        return out

    # changes

    @property
    def store(self) -> TripleStore:
        if not isinstance(self.source, TripleStore):
            raise QueryError("this source can't be changed")
        return self.source

    def insert_data(self, turtle: str) -> None:
        """Insert the triples of a Turtle text; visible here at once, to others after commit()."""
        self._inserts += 1
        self.store.insert(turtle_frame(self.spark, turtle, blank=f"i{self._inserts}."))

    def delete_data(self, turtle: str) -> None:
        self.store.delete(turtle_frame(self.spark, turtle))

    def execute(self, text: str, render: str = "values") -> DataFrame | str | None:
        """A statement: select ..., explain select ..., insert data {...}, delete data {...}, commit or rollback."""
        head = text.strip()
        if m := re.match(r"(insert|delete)\s+data\s*\{(.*)\}\s*$", head, re.IGNORECASE | re.DOTALL):
            body = m[2] if m[2].rstrip().endswith(".") or not m[2].strip() else m[2] + " ."
            (self.insert_data if m[1].lower() == "insert" else self.delete_data)(body)
            return None
        if head.lower() in ("rollback", "commit"):
            getattr(self.store, head.lower())()
            return None
        if m := re.match(r"explain\s+(.*)$", head, re.IGNORECASE | re.DOTALL):
            return self.explain(m[1])
        return self.query(text, render)

    # functions

    def register_function(self, iri: str, build: Callable[..., Column], tag: int = LITERAL) -> None:
        """A scalar function made of Spark columns (which may wrap a pandas UDF)."""
        self.registry.scalar[iri] = ScalarFunction(lambda *cols: build(*cols).cast(NATIVE[tag]), tag)

    def register_table_function(self, name: str, fn: Callable[..., Iterable[tuple]], tags: tuple[int, ...] = (LITERAL,)) -> None:
        """A table function: called with one row's inputs, it gives rows of outputs."""
        self.registry.table[name] = TableFunctionDef(fn, tuple(tags))


def _prefixes(text: str) -> str:
    return " ".join(re.findall(r"prefix\s+\S*:\s*<[^>]*>", text, re.IGNORECASE))


__all__ = ["Engine"]
