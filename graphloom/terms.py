"""Static kinds of terms, and how terms of different kinds are compared and shown.

A term is an IRI, a literal with a datatype, or a literal with a language tag.
Where a column's kind is known when the query is planned, its values stay in
native Spark types: an IRI built from a template is its key, an integer literal
is a BIGINT. Only where kinds are mixed does a column hold the struct
``(v, t, st)``: lexical form, type tag, and language tag or datatype IRI.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type tags, which are also the rank of a type in ORDER BY.
URI, LITERAL, LANGUAGE, CUSTOM, STRING, INTEGER, DECIMAL, DOUBLE, BOOLEAN, DATE = range(10)

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
# The datatype IRI of each type tag that has one.
DATATYPES = {
    STRING: XSD + "string", INTEGER: XSD + "integer", DECIMAL: XSD + "decimal",
    DOUBLE: XSD + "double", BOOLEAN: XSD + "boolean", DATE: XSD + "dateTime",
}
TAGS = {iri: tag for tag, iri in DATATYPES.items()}
NATIVE = {LITERAL: "string", STRING: "string", INTEGER: "bigint", DECIMAL: "decimal(38,18)", DOUBLE: "double", BOOLEAN: "boolean", DATE: "timestamp_ntz"}
NUMERIC = (INTEGER, DECIMAL, DOUBLE)
TERM = "struct<v:string,t:tinyint,st:string>"
NO_TEMPLATE = "{}"


@dataclass(frozen=True)
class Iri:
    """IRIs of one template; the column holds the key. ``{}`` alone stands for whole IRIs."""

    template: str = NO_TEMPLATE
    key_type: str = "string"

    @property
    def ends(self) -> tuple[str, str]:
        before, _, after = self.template.partition("{}")
        return before, after

    def key_of(self, iri: str):
        """The key of an IRI as a Python value; None where the IRI can't be of this template."""
        before, after = self.ends
        if len(iri) < len(before) + len(after) or not iri.startswith(before) or not iri.endswith(after):
            return None
        key = iri[len(before) : len(iri) - len(after)]
        if self.key_type == "bigint":
            return int(key) if re.fullmatch(r"0|-?[1-9][0-9]{0,17}", key) else None
        return key


@dataclass(frozen=True)
class Lit:
    """Literals of one datatype, in the native Spark type."""

    tag: int = LITERAL


@dataclass(frozen=True)
class Dyn:
    """Any term, as a struct."""


Kind = Iri | Lit | Dyn


@dataclass(frozen=True)
class Term:
    """A constant: lexical form, type tag, language tag or datatype IRI."""

    v: str
    t: int = LITERAL
    st: str | None = None


def disjoint(a: Kind, b: Kind) -> bool:
    """Whether no term can be of both kinds."""
    if isinstance(a, Dyn) or isinstance(b, Dyn):
        return False
    if isinstance(a, Iri) and isinstance(b, Iri):
        if a == b:
            return False
        (p, s), (q, u) = a.ends, b.ends
        return not (p.startswith(q) or q.startswith(p)) or not (s.endswith(u) or u.endswith(s))
    return a != b


def common(a: Kind, b: Kind) -> Kind:
    """The narrowest kind that holds terms of both."""
    if a == b:
        return a
    if isinstance(a, Iri) and isinstance(b, Iri):
        return Iri()
    return Dyn()


def native_type(kind: Kind) -> str:
    if isinstance(kind, Iri):
        return kind.key_type
    return NATIVE[kind.tag] if isinstance(kind, Lit) else TERM


def iri_text(col: Column, kind: Iri) -> Column:
    before, after = kind.ends
    if kind.template == NO_TEMPLATE:
        return col
    return F.concat(F.lit(before), col.cast("string"), F.lit(after))


def lexical(col: Column, kind: Kind) -> Column:
    """The lexical form, as STR() gives it."""
    if isinstance(kind, Iri):
        return iri_text(col, kind)
    if isinstance(kind, Dyn):
        return col["v"]
    if kind.tag == DATE:
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    return col.cast("string")


def as_term(col: Column, kind: Kind) -> Column:
    """The term as a struct; null stays null."""
    if isinstance(kind, Dyn):
        return col
    tag = URI if isinstance(kind, Iri) else kind.tag
    made = F.struct(lexical(col, kind).alias("v"), F.lit(tag).cast("tinyint").alias("t"), F.lit(None).cast("string").alias("st"))
    return F.when(col.isNotNull(), made)


def convert(col: Column, kind: Kind, to: Kind) -> Column:
    if kind == to:
        return col
    if isinstance(to, Dyn):
        return as_term(col, kind)
    if isinstance(to, Iri) and isinstance(kind, Iri) and to.template == NO_TEMPLATE:
        return iri_text(col, kind)
    raise ValueError(f"{kind} can't become {to}")


def constant(term: Term) -> tuple[Column, Kind]:
    """A constant as a column of the narrowest kind."""
    if term.t == URI:
        return F.lit(term.v), Iri()
    if term.t in (LANGUAGE, CUSTOM):
        return F.struct(F.lit(term.v).alias("v"), F.lit(term.t).cast("tinyint").alias("t"), F.lit(term.st).cast("string").alias("st")), Dyn()
    if term.t == DATE:
        return F.expr("try_cast('%s' as timestamp_ntz)" % term.v.replace("'", "")), Lit(DATE)
    if term.t in (INTEGER, DECIMAL, DOUBLE, BOOLEAN):
        return F.lit(term.v).try_cast(NATIVE[term.t]), Lit(term.t)
    return F.lit(term.v), Lit(term.t)


def shown(col: Column, kind: Kind) -> Column:
    """A result column: IRIs and mixed terms as text, literals in their native type."""
    return lexical(col, kind) if isinstance(kind, Iri | Dyn) else col


_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def term_text(term: Column) -> Column:
    """A term struct in N-Triples syntax; blank nodes as they are; null as NULL."""
    body = term["v"]
    for raw, safe in _ESCAPES:
        body = F.replace(body, F.lit(raw), F.lit(safe))
    quoted = F.concat(F.lit('"'), body, F.lit('"'))
    named = F.element_at(F.create_map(*[x for tag, iri in DATATYPES.items() for x in (F.lit(tag), F.lit(iri))]), term["t"].cast("int"))
    return (
        F.when(term.isNull(), "NULL")
        .when((term["t"] == URI) & term["v"].startswith("_:"), term["v"])
        .when(term["t"] == URI, F.concat(F.lit("<"), term["v"], F.lit(">")))
        .when(term["t"] == LITERAL, quoted)
        .when(term["t"] == LANGUAGE, F.concat(quoted, F.lit("@"), term["st"]))
        .when(term["t"] == CUSTOM, F.concat(quoted, F.lit("^^<"), term["st"], F.lit(">")))
        .otherwise(F.concat(quoted, F.lit("^^<"), named, F.lit(">")))
    )
