"""Relations of bindings, and how they are joined, united and extended.

A relation is a DataFrame with a column for each variable, whose kind of terms
is known. Bags are kept: rows are never merged unless a query asks for it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import combinations, count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import Value
from ..terms import Dyn, Kind, common, convert, disjoint, native_type

_serial = count()


@dataclass(frozen=True)
class Binding:
    column: str
    kind: Kind
    nullable: bool = False


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    vars: dict[str, Binding]

    def scope(self) -> dict[str, Value]:
        return {name: Value(F.col(b.column), b.kind) for name, b in self.vars.items()}

    def where(self, condition: Column) -> Relation:
        return replace(self, df=self.df.where(condition))

    def as_nullable(self) -> Relation:
        return replace(self, vars={n: replace(b, nullable=True) for n, b in self.vars.items()})

    def project(self, names) -> Relation:
        """Only these variables, each in a column of a new name."""
        kept = {n: replace(b, column=column_name(n)) for n, b in self.vars.items() if n in names}
        return Relation(self.df.select(*[F.col(self.vars[n].column).alias(b.column) for n, b in kept.items()]), kept)

    def recast(self, kinds: dict[str, Kind]) -> Relation:
        """Variables converted to wider kinds, all columns renamed."""
        made = {n: Binding(column_name(n), kinds.get(n, b.kind), b.nullable) for n, b in self.vars.items()}
        return Relation(self.df.select(*[convert(F.col(self.vars[n].column), self.vars[n].kind, b.kind).alias(b.column) for n, b in made.items()]), made)


def column_name(var: str) -> str:
    return f"v_{var}_{next(_serial)}"


def singleton(spark: SparkSession) -> Relation:
    """One row without a column: what a group starts from."""
    return Relation(spark.range(1).select(), {})


def empty(spark: SparkSession, vars: dict[str, Kind]) -> Relation:
    """No rows; Spark drops whatever is joined with it."""
    made = {n: Binding(column_name(n), k) for n, k in vars.items()}
    cols = [F.lit(None).cast(native_type(b.kind)).alias(b.column) for b in made.values()]
    return Relation(spark.range(1).where(F.lit(False)).select(*cols), made)


def _aligned(left: Relation, right: Relation) -> tuple[Relation, Relation, list[str], bool]:
    """Both sides with shared variables of one kind, the right's columns apart; whether kinds exclude each other."""
    shared = [n for n in left.vars if n in right.vars]
    never = any(
        disjoint(left.vars[n].kind, right.vars[n].kind) and not left.vars[n].nullable and not right.vars[n].nullable for n in shared
    )
    kinds = {n: common(left.vars[n].kind, right.vars[n].kind) for n in shared}
    return left.recast(kinds), right.recast(kinds), shared, never


#: Ways to split a join by which shared variables are unbound, up to which it is split.
MOST_WAYS = 27


def _states(rel: Relation, shared: list[str]) -> list[tuple[frozenset[str], Relation]]:
    """The rows by which of the shared variables are unbound in them."""
    may = [n for n in shared if rel.vars[n].nullable]
    out = []
    for size in range(len(may) + 1):
        for unbound in combinations(may, size):
            part = rel
            for n in may:
                col = F.col(rel.vars[n].column)
                part = part.where(col.isNull() if n in unbound else col.isNotNull())
            out.append((frozenset(unbound), part))
    return out


def _fresh(rel: Relation) -> Relation:
    """The same rows in columns of other names, so that a table may meet itself."""
    return rel.recast({})


def _equal(left: Relation, right: Relation, names) -> Column | None:
    out = None
    for n in names:
        test = F.col(left.vars[n].column) == F.col(right.vars[n].column)
        out = test if out is None else out & test
    return out


def _compatible(left: Relation, right: Relation, shared: list[str]) -> Column | None:
    """Equality of the shared variables; an unbound one is compatible with anything."""
    out = None
    for n in shared:
        a, b = left.vars[n], right.vars[n]
        test = F.col(a.column) == F.col(b.column)
        if a.nullable:
            test = test | F.col(a.column).isNull()
        if b.nullable:
            test = test | F.col(b.column).isNull()
        out = test if out is None else out & test
    return out


def _merged(left: Relation, right: Relation, shared: list[str], joined: DataFrame, outer: bool) -> Relation:
    vars, cols = {}, []
    for n, b in left.vars.items():
        if n in shared and b.nullable:
            other = right.vars[n]
            name = column_name(n)
            cols.append(F.coalesce(F.col(b.column), F.col(other.column)).alias(name))
            vars[n] = Binding(name, b.kind, other.nullable or outer)
        else:
            cols.append(F.col(b.column))
            vars[n] = b
    for n, b in right.vars.items():
        if n not in shared:
            cols.append(F.col(b.column))
            vars[n] = replace(b, nullable=b.nullable or outer)
    return Relation(joined.select(*cols), vars)


def join(left: Relation, right: Relation) -> Relation:
    """Natural inner join; without a shared variable the product.

    Where shared variables may be unbound, rows are split by which of them are,
    so that every part joins on the equality of those bound on both sides.
    """
    a, b, shared, never = _aligned(left, right)
    if never:
        return empty(left.df.sparkSession, {n: x.kind for n, x in {**b.vars, **a.vars}.items()})
    ls, rs = _states(a, shared), _states(b, shared)
    if len(ls) * len(rs) > MOST_WAYS:
        return _merged(a, b, shared, a.df.join(b.df, _compatible(a, b, shared), "inner"), False)
    parts = []
    for lost, x in ls:
        for gone, y in rs:
            on = _equal(x, y, [n for n in shared if n not in lost | gone])
            parts.append(_merged(x, y, shared, x.df.join(y.df, on, "inner") if on is not None else x.df.crossJoin(y.df), False))
    return parts[0] if len(parts) == 1 else union(parts)


def left_join(left: Relation, right: Relation, condition=None) -> Relation:
    """All rows of the left, with the right's where they are compatible and the condition holds.

    condition: takes the scope of both sides and gives a column. Where shared
    variables may be unbound, rows are split as in ``join``.
    """
    a, b, shared, never = _aligned(left, right)

    def test(x: Relation, y: Relation, names) -> Column | None:
        if never:
            return F.lit(False)
        on = _equal(x, y, names)
        if condition is not None:
            extra = condition({**y.scope(), **x.scope()})
            on = extra if on is None else on & extra
        return on

    ls, rs = _states(a, shared), _states(b, shared)
    if len(ls) * len(rs) > MOST_WAYS:
        on = _compatible(a, b, shared)
        if condition is not None:
            on = on & condition({**b.scope(), **a.scope()})
        return _merged(a, b, shared, a.df.join(b.df, on, "left"), True)
    parts = []
    for lost, x in ls:
        if len(rs) == 1:
            on = test(x, b, [n for n in shared if n not in lost])
            parts.append(_merged(x, b, shared, x.df.join(b.df, F.lit(True) if on is None else on, "left"), True))
            continue
        rest = x
        for gone, y in rs:
            names = [n for n in shared if n not in lost | gone]
            on = test(x, y, names)
            parts.append(_merged(x, y, shared, x.df.join(y.df, F.lit(True) if on is None else on, "inner"), True))
            other = _fresh(y)
            on = test(rest, other, names)
            rest = replace(rest, df=rest.df.join(other.df, F.lit(True) if on is None else on, "left_anti"))
        parts.append(replace(rest, vars={n: replace(v, nullable=v.nullable or n not in a.vars) for n, v in rest.vars.items()}))
    return parts[0] if len(parts) == 1 else union(parts)


def union(parts: list[Relation]) -> Relation:
    """Bag union; variables that a part lacks are unbound there."""
    kinds: dict[str, Kind] = {}
    for p in parts:
        for n, b in p.vars.items():
            kinds[n] = common(kinds[n], b.kind) if n in kinds else b.kind
    nullable = {n: any(n not in p.vars or p.vars[n].nullable for p in parts) for n in kinds}
    names = {n: column_name(n) for n in kinds}
    out = None
    for p in parts:
        cols = [
            (convert(F.col(p.vars[n].column), p.vars[n].kind, k) if n in p.vars else F.lit(None).cast(native_type(k))).alias(names[n])
            for n, k in kinds.items()
        ]
        df = p.df.select(*cols)
        out = df if out is None else out.unionAll(df)
    return Relation(out, {n: Binding(names[n], k, nullable[n]) for n, k in kinds.items()})


def require_equal(rel: Relation, one: Binding, other: Binding) -> Relation:
    """Rows where two columns hold the same term."""
    kind = common(one.kind, other.kind)
    if disjoint(one.kind, other.kind):
        return rel.where(F.lit(False))
    return rel.where(convert(F.col(one.column), one.kind, kind) == convert(F.col(other.column), other.kind, kind))


__all__ = ["Binding", "Dyn", "Relation", "empty", "join", "left_join", "require_equal", "singleton", "union"]
