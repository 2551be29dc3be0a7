"""From a parsed query to a DataFrame.

A group is evaluated in this order: its patterns, in the order whose joins are
estimated to yield the least; unions and explicit group joins,
joined with them; table functions; optional groups in textual order; filters.
Catalyst moves filters down and picks the physical joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..functions.expressions import Compiler, ScalarFunction
from ..operators.relations import Binding, Relation, column_name, join, left_join, require_equal, singleton, union
from ..sources.base import Kinds, Source, Stats, Unit
from ..terms import LITERAL, NATIVE, Dyn, Iri, Lit, Term, as_term, constant, disjoint, lexical, native_type, shown, term_text
from .algebra import Group, Query, TableFunction, Var, variables
from .parser import QueryError


@dataclass(frozen=True)
class TableFunctionDef:
    """A registered table function: rows of output values for the input values of one row."""

    fn: Callable[..., Iterable[tuple]]
    tags: tuple[int, ...]


@dataclass
class Registry:
    scalar: dict[str, ScalarFunction] = field(default_factory=dict)
    table: dict[str, TableFunctionDef] = field(default_factory=dict)


def _known(known: Kinds | None, parts: list[Relation]) -> Kinds:
    """What is known of variables where the parts are joined as well."""
    out = dict(known or {})
    for part in parts:
        for n, b in part.vars.items():
            if not b.nullable and not isinstance(b.kind, Dyn):
                out[n] = [k for k in out[n] if not disjoint(k, b.kind)] if n in out else [b.kind]
    return out


#: Partial orders of one length that are followed further.
MOST_ORDERS = 500


def cheapest_order(stats: list[Stats]) -> list[int]:
    """Positions in the order whose joins' results have the smallest sum; what shares no variable comes only where nothing does."""
    start = sorted(range(len(stats)), key=lambda i: stats[i].rows)
    level = {frozenset([i]): (0.0, [i], stats[i]) for i in start}
    for _ in stats[1:]:
        grown: dict[frozenset[int], tuple[float, list[int], Stats]] = {}
        for have, (cost, order, made) in level.items():
            left = [i for i in start if i not in have]
            for i in [i for i in left if made.values.keys() & stats[i].values.keys()] or left:
                out = made.joined(stats[i])
                key, total = have | {i}, cost + out.rows
                if key not in grown or total < grown[key][0]:
                    grown[key] = (total, [*order, i], out)
        level = dict(sorted(grown.items(), key=lambda x: x[1][0])[:MOST_ORDERS])
    return next(iter(level.values()))[1]


class Planner:
    def __init__(self, source: Source, registry: Registry | None = None):
        self.source, self.registry = source, registry or Registry()
        self.spark = source.spark

    # groups

    def ordered(self, units: list[Unit]) -> list[Unit]:
        """The order with the smallest sum of intermediate results, by the source's statistics.

        Without them greedy: the smallest estimate first, then the smallest of those that share a variable.
        """
        if len(units) < 2:
            return units
        if len(units) > 2 and (stats := self.source.statistics(units)) is not None:
            return [units[i] for i in cheapest_order(stats)]
        cost = {id(u): self.source.estimate(u) for u in units}
        left, out, bound = list(units), [], set()
        while left:
            near = [u for u in left if bound & u.names] or left
            best = min(near, key=lambda u: cost[id(u)])
            left.remove(best)
            out.append(best)
            bound |= best.names
        return out

    def group(self, g: Group, known: Kinds | None = None) -> Relation:
        return self.filtered(self.unfiltered(g, known), g.filters)

    def filtered(self, rel: Relation, filters) -> Relation:
        for f in filters:
            rel = rel.where(Compiler(rel.scope(), self.registry.scalar).condition(f))
        return rel

    def unfiltered(self, g: Group, known: Kinds | None = None) -> Relation:
        """known: kinds of variables that the group's result is joined on, bound in every row of the other side."""
        parts = [self.source.read(u) for u in self.ordered(self.source.units(g.patterns, known))]
        inner = _known(known, parts)
        parts += [union([self.group(x, inner) for x in branch]) for branch in g.unions]
        parts += [self.gjoin(branch, inner) for branch in g.gjoins]
        rel = None
        while parts:  # connected parts first; a product only where nothing is shared
            at = next((i for i, p in enumerate(parts) if rel is not None and set(p.vars) & set(rel.vars)), 0)
            part = parts.pop(at)
            rel = part if rel is None else join(rel, part)
        rel = rel or singleton(self.spark)
        for fn in g.functions:
            rel = self.table_function(rel, fn)
        for optional in g.optionals:
            rel = self.optional(rel, optional, _known(known, [rel]))
        return rel

    def gjoin(self, groups: list[Group], known: Kinds | None = None) -> Relation:
        rel = self.group(groups[0], known)
        for g in groups[1:]:
            rel = join(rel, self.group(g, _known(known, [rel])))
        return rel

    def optional(self, rel: Relation, g: Group, known: Kinds | None = None) -> Relation:
        """Filters that need a variable of the outer group are part of the join's condition."""
        inner = self.unfiltered(g, known)
        own = [f for f in g.filters if variables(f) <= set(inner.vars)]
        inner = self.filtered(inner, own)
        outer = [f for f in g.filters if f not in own]

        def condition(scope):
            out = None
            for f in outer:
                test = Compiler(scope, self.registry.scalar).condition(f)
                out = test if out is None else out & test
            return out

        return left_join(rel, inner, condition if outer else None)

    def table_function(self, rel: Relation, call: TableFunction) -> Relation:
        """Each row with every row that the function gives for it; rows without one go."""
        known = self.registry.table.get(call.name)
        if known is None:
            raise QueryError(f"no table function {call.name} is registered")
        if len(known.tags) != len(call.outputs):
            raise QueryError(f"table function {call.name} binds {len(known.tags)} variables")
        kept = list(rel.vars.values())
        inputs = []
        for node in call.inputs:
            if isinstance(node, Term):
                col, kind = constant(node)
            elif node.name in rel.vars:
                col, kind = F.col(rel.vars[node.name].column), rel.vars[node.name].kind
            else:
                raise QueryError(f"?{node.name} is not bound before table function {call.name}")
            inputs.append(lexical(col, kind) if isinstance(kind, Iri | Dyn) else col)
        outputs = [Binding(column_name(v.name), Lit(tag), True) for v, tag in zip(call.outputs, known.tags, strict=True)]
        df = rel.df.select(*[F.col(b.column) for b in kept], *[c.alias(f"in_{i}") for i, c in enumerate(inputs)], *([] if kept or inputs else [F.lit(1).alias("in_none")]))
        n, fn, names = len(inputs), known.fn, [b.column for b in outputs]
        kinds = [to_arrow_type(_parse_datatype_string(NATIVE[tag])) for tag in known.tags]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                given = [batch.column(f"in_{i}").to_pylist() for i in range(n)]
                rows, at = [], []
                for i in range(batch.num_rows):
                    for out in fn(*[g[i] for g in given]):
                        rows.append(out)
                        at.append(i)
                held = [c for c in batch.schema.names if not c.startswith("in_")]
                again = batch.select(held).take(pa.array(at, pa.int64())) if held else None
                made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(again.columns if held else []), *made], [*held, *names])

        schema = ", ".join([*(f"`{b.column}` {native_type(b.kind)}" for b in kept), *(f"`{b.column}` {NATIVE[b.kind.tag]}" for b in outputs)])
        vars = dict(rel.vars)
        again: list[tuple[str, Binding]] = []
        for v, b in zip(call.outputs, outputs, strict=True):
            if v.name in vars:
                again.append((v.name, b))
            else:
                vars[v.name] = b
        out = Relation(df.mapInArrow(run, schema), vars)
        for name, b in again:  # an output that was bound before must be the same
            out = require_equal(out, vars[name], b)
        return Relation(out.df.select(*[F.col(b.column) for b in vars.values()]), vars)

    # whole queries

    def query(self, q: Query, render: str = "values") -> DataFrame:
        """render: ``values`` (IRIs as text, literals natively) or ``terms`` (N-Triples syntax)."""
        rel = self.group(q.group)
        names = [v.name for v in q.projection]
        if len({n.lower() for n in names} | ({"count"} if q.mode in ("count", "duplicates") else set())) < len(names) + (q.mode in ("count", "duplicates")):
            raise QueryError("names of result columns must differ in more than case")

        def col(name: str):
            b = rel.vars.get(name)
            return (F.lit(None).cast("string"), Lit(LITERAL)) if b is None else (F.col(b.column), b.kind)

        def out(name: str):
            c, kind = col(name)
            return (term_text(as_term(c, kind)) if render == "terms" else shown(c, kind)).alias(name)

        def key(name: str, descending: bool, grouped: bool):
            c, kind = col(name)
            if isinstance(kind, Dyn):
                parts = [c["t"], c["st"], c["v"]]
            else:
                parts = [lexical(c, kind) if isinstance(kind, Iri) else c]
            return [p.desc_nulls_last() if descending else p.asc_nulls_first() for p in parts]

        df = rel.df
        if q.mode in ("distinct", "reduced", "count", "duplicates"):
            # group on native keys; text is made for the groups only
            mine = [F.col(rel.vars[n].column) for n in names if n in rel.vars]
            df = df.groupBy(*mine).agg(F.count(F.lit(1)).alias("__count")) if q.mode in ("count", "duplicates") else df.select(*mine).distinct()
            if q.mode == "duplicates":
                df = df.where(F.col("__count") >= 2)
        if q.order:
            keys = []
            for name, descending in q.order:
                keys += [F.col("__count").desc() if descending else F.col("__count").asc()] if name is None else key(name, descending, False)
            df = df.orderBy(*keys)
        df = df.select(*[out(n) for n in names], *([F.col("__count").alias("count")] if q.mode in ("count", "duplicates") else []))
        return df.limit(q.limit) if q.limit is not None else df
