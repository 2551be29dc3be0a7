"""Expressions of the query language as Spark columns.

Logic is three-valued: an expression that can't be evaluated is null, and a
filter keeps what is true. Two stored terms are equal when they are the same
term, or numbers of equal value; computed values compare by value or text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import Call, Var
from ..plans.parser import QueryError
from ..terms import (
    BOOLEAN, CUSTOM, DATATYPES, DATE, DECIMAL, DOUBLE, INTEGER, LANGUAGE, LITERAL, NUMERIC, STRING, URI, XSD,
    Dyn, Iri, Kind, Lit, Term, as_term, constant, lexical,
)


@dataclass
class Value:
    col: Column
    kind: Kind
    computed: bool = False
    text: str | None = None  # of a constant

    @property
    def tag(self) -> int | None:
        return self.kind.tag if isinstance(self.kind, Lit) else None


@dataclass(frozen=True)
class ScalarFunction:
    """A registered function: columns of the arguments' values to a column of the tag's native type."""

    build: Callable[..., Column]
    tag: int = LITERAL


class Compiler:
    """Compiles expressions over a scope of variables."""

    def __init__(self, scope: dict[str, Value], functions: dict[str, ScalarFunction] | None = None):
        self.scope, self.functions = scope, functions or {}

    def condition(self, expr) -> Column:
        return truth(self.value(expr))

    def value(self, expr) -> Value:
        if isinstance(expr, Var):
            found = self.scope.get(expr.name)
            return found or Value(F.lit(None).cast("string"), Lit(LITERAL))
        if isinstance(expr, Term):
            col, kind = constant(expr)
            return Value(col, kind, text=expr.v)
        if not isinstance(expr, Call):
            raise QueryError(f"{expr} is no expression")
        if expr.op.startswith("<") and expr.op.endswith(">") and len(expr.op) > 2:
            return self.own(expr.op[1:-1], [self.value(a) for a in expr.args])
        return _OPERATORS[expr.op](*[self.value(a) for a in expr.args])

    def own(self, iri: str, args: list[Value]) -> Value:
        if iri not in self.functions:
            raise QueryError(f"no function <{iri}> is registered")
        fn = self.functions[iri]
        return Value(fn.build(*[lexical(a.col, a.kind) if isinstance(a.kind, Iri | Dyn) else a.col for a in args]), Lit(fn.tag), True)


def _bool(col: Column) -> Value:
    return Value(col, Lit(BOOLEAN), True)


def truth(a: Value) -> Column:
    """The value as a condition: booleans as they are, text where it says true."""
    if a.tag == BOOLEAN:
        return a.col
    return lexical(a.col, a.kind) == "true"


def number(a: Value) -> Column:
    """As a double; null where it is none."""
    if a.tag in NUMERIC:
        return a.col.cast("double")
    if isinstance(a.kind, Iri) or a.tag in (BOOLEAN, DATE):
        return F.lit(None).cast("double")
    if isinstance(a.kind, Dyn):
        return F.when(a.col["t"] != URI, a.col["v"].try_cast("double"))
    return a.col.try_cast("double")


def moment(a: Value) -> Column:
    if a.tag == DATE:
        return a.col
    if isinstance(a.kind, Dyn):
        return F.when(a.col["t"] != URI, a.col["v"].try_cast("timestamp_ntz"))
    if a.tag in (LITERAL, STRING):
        return a.col.try_cast("timestamp_ntz")
    return F.lit(None).cast("timestamp_ntz")


def _known(a: Value, b: Value, answer: Column) -> Column:
    return F.when(a.col.isNotNull() & b.col.isNotNull(), answer)


def same_term(a: Value, b: Value) -> Value:
    """Whether both are the same term; null where one is unbound."""
    if a.kind == b.kind:
        return _bool(a.col == b.col)
    if isinstance(a.kind, Iri) and isinstance(b.kind, Iri):
        return _bool(lexical(a.col, a.kind) == lexical(b.col, b.kind))
    if isinstance(a.kind, Dyn) or isinstance(b.kind, Dyn):
        return _bool(as_term(a.col, a.kind) == as_term(b.col, b.kind))
    return _bool(_known(a, b, F.lit(False)))


def equal(a: Value, b: Value) -> Value:
    for x, y in ((a, b), (b, a)):
        # an IRI constant against IRIs of a template: the key is compared, so that the scan can use it
        if isinstance(x.kind, Iri) and isinstance(y.kind, Iri) and x.kind != y.kind:
            return _bool(lexical(x.col, x.kind) == lexical(y.col, y.kind))
    if a.tag in NUMERIC and b.tag in NUMERIC:
        return _bool(a.col == b.col)
    if a.tag == DATE and b.tag == DATE or a.tag == BOOLEAN and b.tag == BOOLEAN:
        return _bool(a.col == b.col)
    if a.tag == DATE or b.tag == DATE:
        return _bool(moment(a) == moment(b))
    if a.computed or b.computed:
        if a.tag in NUMERIC or b.tag in NUMERIC:
            return _bool(number(a) == number(b))
        return _bool(lexical(a.col, a.kind) == lexical(b.col, b.kind))
    if isinstance(a.kind, Dyn) and b.tag in NUMERIC or isinstance(b.kind, Dyn) and a.tag in NUMERIC:
        dyn, num = (a, b) if isinstance(a.kind, Dyn) else (b, a)
        return _bool(F.when(dyn.col.isNotNull() & num.col.isNotNull(), F.coalesce(F.when(dyn.col["t"].isin(*NUMERIC), number(dyn) == number(num)), F.lit(False))))
    return same_term(a, b)


def different(a: Value, b: Value) -> Value:
    return _bool(~equal(a, b).col)


def _ordered(compare: Callable[[Column, Column], Column]) -> Callable[[Value, Value], Value]:
    def run(a: Value, b: Value) -> Value:
        if a.tag == DATE or b.tag == DATE:
            return _bool(compare(moment(a), moment(b)))
        if a.tag in (INTEGER, DECIMAL, DOUBLE) and b.tag in (INTEGER, DECIMAL, DOUBLE):
            return _bool(compare(a.col, b.col))
        if isinstance(a.kind, Dyn) and isinstance(b.kind, Dyn):
            dates = F.when((a.col["t"] == DATE) & (b.col["t"] == DATE), compare(moment(a), moment(b)))
            return _bool(F.coalesce(compare(number(a), number(b)), dates))
        return _bool(compare(number(a), number(b)))

    return run


def _arithmetic(exact: Callable[[Column, Column], Column], name: str) -> Callable[[Value, Value], Value]:
    def run(a: Value, b: Value) -> Value:
        if a.tag == INTEGER and b.tag == INTEGER and name != "/":
            return Value(exact(a.col, b.col), Lit(INTEGER), True)
        return Value(exact(number(a), number(b)), Lit(DOUBLE), True)

    return run


def minus(a: Value) -> Value:
    if a.tag == INTEGER:
        return Value(F.negative(a.col), Lit(INTEGER), True)
    return Value(F.negative(number(a)), Lit(DOUBLE), True)


def lang(a: Value) -> Value:
    """The language tag; empty for other literals, null for IRIs."""
    if isinstance(a.kind, Dyn):
        out = F.when(a.col["t"] == LANGUAGE, a.col["st"]).when(a.col["t"] != URI, F.lit(""))
    elif isinstance(a.kind, Iri):
        out = F.lit(None).cast("string")
    else:
        out = F.when(a.col.isNotNull(), F.lit(""))
    return Value(out, Lit(LITERAL), True)


def lang_matches(a: Value, b: Value) -> Value:
    """Basic filtering of language ranges."""
    tag, wanted = F.lower(lexical(a.col, a.kind)), F.lower(lexical(b.col, b.kind))
    return _bool(F.when(wanted == "*", tag != "").otherwise((tag == wanted) | F.startswith(tag, F.concat(wanted, F.lit("-")))))


def datatype(a: Value) -> Value:
    """The datatype's IRI as text: xsd:string for plain and tagged literals, null for IRIs."""
    if isinstance(a.kind, Dyn):
        named = reduce(lambda c, x: c.when(a.col["t"] == x[0], F.lit(x[1])), DATATYPES.items(), F.when(a.col["t"].isin(LITERAL, LANGUAGE), F.lit(XSD + "string")))
        out = named.when(a.col["t"] == CUSTOM, a.col["st"])
    elif isinstance(a.kind, Iri):
        out = F.lit(None).cast("string")
    else:
        out = F.when(a.col.isNotNull(), F.lit(DATATYPES.get(a.kind.tag, XSD + "string")))
    return Value(out, Lit(LITERAL), True)


def _is_kind(a: Value, dyn: Callable[[Column], Column], iri: Callable[[Column], Column], lit: bool) -> Value:
    if isinstance(a.kind, Dyn):
        return _bool(dyn(a.col))
    if isinstance(a.kind, Iri):
        return _bool(F.when(a.col.isNotNull(), iri(lexical(a.col, a.kind))))
    return _bool(F.when(a.col.isNotNull(), F.lit(lit)))


def is_iri(a: Value) -> Value:
    return _is_kind(a, lambda c: c["t"] == URI, lambda t: F.lit(True), False)


def is_blank(a: Value) -> Value:
    return _is_kind(a, lambda c: (c["t"] == URI) & F.startswith(c["v"], F.lit("_:")), lambda t: F.startswith(t, F.lit("_:")), False)


def is_literal(a: Value) -> Value:
    return _is_kind(a, lambda c: c["t"] != URI, lambda t: F.lit(False), True)


def _compiles(pattern: str) -> bool:
    from pyspark.sql import SparkSession

    try:
        SparkSession.active().sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001  whatever the JVM says of it, it is no pattern
        return False
    return True


def regex(a: Value, pattern: Value, flags: Value | None = None) -> Value:
    """Whether the text has a match; flags i, s, m, x. Null where the pattern is none.

    A constant pattern is tried when the query is planned, any other in its row.
    """
    text, wanted, known = lexical(a.col, a.kind), lexical(pattern.col, pattern.kind), pattern.text
    if flags is not None:
        given = lexical(flags.col, flags.kind)
        wanted = F.when(given == "", wanted).otherwise(F.concat(F.lit("(?"), given, F.lit(")"), wanted))
        known = None if known is None or flags.text is None else f"(?{flags.text}){known}" if flags.text else known
    if known is not None:
        return _bool(F.rlike(text, F.lit(known)) if _compiles(known) else F.lit(None).cast("boolean"))
    return _bool(F.rlike(text, F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), wanted)))


def is_in(probe: Value, *values: Value) -> Value:
    return _bool(reduce(lambda x, y: x | y, (equal(probe, v).col for v in values), F.lit(False)))


_OPERATORS: dict[str, Callable[..., Value]] = {
    "||": lambda a, b: _bool(truth(a) | truth(b)),
    "&&": lambda a, b: _bool(truth(a) & truth(b)),
    "not": lambda a: _bool(~truth(a)),
    "=": equal,
    "!=": different,
    "<": _ordered(lambda a, b: a < b),
    "<=": _ordered(lambda a, b: a <= b),
    ">": _ordered(lambda a, b: a > b),
    ">=": _ordered(lambda a, b: a >= b),
    "+": _arithmetic(F.try_add, "+"),
    "-": _arithmetic(F.try_subtract, "-"),
    "*": _arithmetic(F.try_multiply, "*"),
    "/": _arithmetic(F.try_divide, "/"),
    "plus": lambda a: Value(a.col if a.tag in NUMERIC else number(a), a.kind if a.tag in NUMERIC else Lit(DOUBLE), True),
    "minus": minus,
    "str": lambda a: Value(lexical(a.col, a.kind), Lit(LITERAL), True),
    "lang": lang,
    "langmatches": lang_matches,
    "datatype": datatype,
    "bound": lambda a: _bool(a.col.isNotNull()),
    "sameterm": same_term,
    "isiri": is_iri,
    "isblank": is_blank,
    "isliteral": is_literal,
    "regex": regex,
    "in": is_in,
}
