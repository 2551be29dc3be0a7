"""Relational tables as triples, by a declarative mapping.

Every mapped column of a table is a predicate: a triple for each row whose
column isn't null. A pattern with a constant predicate becomes a scan of that
one column, patterns of one subject become one scan of their columns, and a
variable predicate becomes one scan of each table that may have a match.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.algebra import Pattern, Var
from ..terms import BOOLEAN, CUSTOM, DATE, DECIMAL, DOUBLE, INTEGER, LANGUAGE, LITERAL, NATIVE, RDF, STRING, URI, Dyn, Iri, Lit, Term
from .base import Scan, Slot, Source, Stats, Unit

_TAG_OF = {"int": INTEGER, "bigint": INTEGER, "smallint": INTEGER, "tinyint": INTEGER, "float": DOUBLE, "double": DOUBLE, "boolean": BOOLEAN, "date": DATE, "timestamp": DATE, "timestamp_ntz": DATE, "string": LITERAL}


@dataclass(frozen=True)
class Property:
    """A predicate: literals of a column, or IRIs of another table's template made from it."""

    column: str
    predicate: str | None = None  # by default the column's name
    iri: str | None = None  # a template with {}
    tag: int | None = None  # by default from the column's type
    lang: str | None = None  # a column of language tags
    distinct: bool = False  # whether subject and object may be the same in several rows


@dataclass(frozen=True)
class TableMap:
    """A table's rows as subjects. subject: a template with {}; keys: its columns, joined by "-"."""

    table: str
    subject: str
    keys: tuple[str, ...]
    properties: tuple[Property, ...] = field(default_factory=tuple)
    type: str | None = None  # an rdf:type of every subject
    distinct: bool = False  # whether a subject may have several rows


class MappedSource(Source):
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], maps: list[TableMap]):
        self.spark, self.tables, self.maps = spark, tables, maps
        self.sizes: dict[str, float] = {}
        self.counts: dict[str, float] = {}
        types = {name: dict(df.dtypes) for name, df in tables.items()}
        #: key types of templates, so that the same IRIs have the same kind everywhere
        self.key_types = {
            m.subject: "bigint" if len(m.keys) == 1 and _TAG_OF.get(types[m.table][m.keys[0]]) == INTEGER else "string" for m in maps if m.table in tables
        }

    def size(self, table: str) -> float:
        if table not in self.sizes:
            try:
                self.sizes[table] = float(self.tables[table]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
            except Exception:  # noqa: BLE001  without a JVM plan (Spark Connect) all tables count alike
                self.sizes[table] = 1.0
        return self.sizes[table]

    def count(self, table: str) -> float:
        """Rows of a table, counted once; of Parquet files only the footers are read."""
        if table not in self.counts:
            self.counts[table] = float(self.tables[table].count())
        return self.counts[table]

    def _values(self, slot: Slot, rows: float, unique: bool) -> float:
        """About how many terms a slot of a scan holds."""
        if slot.term is not None:
            return 1.0
        if unique:
            return rows
        if isinstance(slot.kind, Iri):  # as many at most as the table of such subjects has
            return min([rows, *[self.count(m.table) for m in self.maps if m.subject == slot.kind.template and not m.distinct and m.table in self.tables]])
        return rows**0.5  # literals repeat

    def statistics(self, units: list[Unit]) -> list[Stats]:
        out = []
        for unit in units:
            sizes = [sum(self.count(self.maps[x.table].table) for x in scans) for scans in unit.scans]
            rows, values = max(sizes) * self.share(unit), {}
            for pattern, scans in zip(unit.patterns, unit.scans, strict=True):
                for k, node in enumerate(pattern.nodes):
                    if isinstance(node, Var):
                        own = sum(self._values((x.s, x.p, x.o)[k], self.count(self.maps[x.table].table), k == 0 and x.unique) for x in scans)
                        values[node.name] = max(1.0, min(own, rows, values.get(node.name, own)))
            out.append(Stats(rows, values))
        return out

    def _subject(self, m: TableMap) -> Slot:
        kind = Iri(m.subject, self.key_types[m.subject])
        if len(m.keys) == 1:
            return Slot(F.col(m.keys[0]).cast(kind.key_type), kind, raw=F.col(m.keys[0]))
        return Slot(F.concat_ws("-", *[F.col(k).cast("string") for k in m.keys]), kind)

    def _object(self, m: TableMap, p: Property) -> Slot:
        col: Column = F.col(p.column)
        dtype = dict(self.tables[m.table].dtypes)[p.column]
        if p.iri is not None:
            key = self.key_types.get(p.iri, "bigint" if _TAG_OF.get(dtype) == INTEGER else "string")
            return Slot(col.cast(key), Iri(p.iri, key), raw=col)
        if p.lang is not None:
            made = F.struct(col.alias("v"), F.lit(LANGUAGE).cast("tinyint").alias("t"), F.col(p.lang).alias("st"))
            plain = F.struct(col.alias("v"), F.lit(LITERAL).cast("tinyint").alias("t"), F.lit(None).cast("string").alias("st"))
            return Slot(F.when(F.col(p.lang).isNotNull(), made).otherwise(plain), Dyn(), literal=True)
        tag = p.tag if p.tag is not None else _TAG_OF.get(dtype, DECIMAL if dtype.startswith("decimal") else LITERAL)
        if tag in (LANGUAGE, CUSTOM):
            raise ValueError("a tagged literal needs a column of tags")
        return Slot(col.cast(NATIVE[tag]), Lit(tag), raw=col)

    def scans(self, pattern: Pattern) -> list[Scan]:
        out = []
        wanted = pattern.p.v if isinstance(pattern.p, Term) and pattern.p.t == URI else None
        if isinstance(pattern.p, Term) and wanted is None:
            return out
        for n, m in enumerate(self.maps):
            if m.table not in self.tables:
                continue
            df, subject, size = self.tables[m.table], self._subject(m), self.size(m.table)
            for key in m.keys:
                df = df.where(F.col(key).isNotNull())
            if m.type is not None and wanted in (None, RDF + "type"):
                out.append(Scan(df, subject, Slot(None, Iri(), Term(RDF + "type", URI)), Slot(None, Iri(), Term(m.type, URI)), m.distinct, size, n, df, F.lit(True), not m.distinct))
            for p in m.properties:
                predicate = p.predicate or p.column
                if wanted in (None, predicate):
                    present = F.col(p.column).isNotNull()
                    out.append(Scan(df.where(present), subject, Slot(None, Iri(), Term(predicate, URI)), self._object(m, p), p.distinct or m.distinct, size, n, df, present, not m.distinct))
        return out


__all__ = ["MappedSource", "Property", "TableMap", "STRING"]
