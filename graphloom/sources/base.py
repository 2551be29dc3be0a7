"""What the planner asks of a source of triples."""

from __future__ import annotations

from dataclasses import dataclass
from math import inf

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relations import Binding, Relation, column_name, empty, require_equal, union
from ..plans.algebra import Pattern, Var
from ..terms import URI, Dyn, Iri, Kind, Lit, Term, as_term, constant, convert, disjoint

#: Share of rows that a constant in a slot is taken to leave.
SUBJECT_SHARE, OBJECT_SHARE, PREDICATE_SHARE = 1e-6, 0.05, 0.2


@dataclass(frozen=True)
class Slot:
    """A triple's slot in a scan: a column and its kind, or a constant."""

    col: Column | None
    kind: Kind
    term: Term | None = None
    raw: Column | None = None  # for constants: the column before any cast, so that filters reach the scan
    literal: bool = False  # whether it never holds an IRI, whatever the kind says

    def matches(self, term: Term) -> Column | None:
        """The condition that the slot holds the term; None where it never does."""
        if self.term is not None:
            return F.lit(True) if self.term == term else None
        if isinstance(self.kind, Iri):
            key = self.kind.key_of(term.v) if term.t == 0 else None
            return None if key is None else (self.raw if self.raw is not None else self.col) == F.lit(key)
        if isinstance(self.kind, Dyn):
            col, kind = constant(term)
            return (self.col["v"] == F.lit(term.v)) & (self.col["t"] == term.t) & (self.col["st"] == term.st if term.st is not None else self.col["st"].isNull())
        if term.t == 0 or term.st is not None:
            return None
        numeric = (5, 6, 7)
        if term.t != self.kind.tag and not (term.t in numeric and self.kind.tag in numeric):
            return None
        return (self.raw if self.raw is not None else self.col) == constant(term)[0]


@dataclass(frozen=True)
class Scan:
    """A table in which every row is a triple."""

    df: DataFrame
    s: Slot
    p: Slot
    o: Slot
    distinct: bool = False  # whether the same triple may come more than once
    size: float = 0.0
    table: object = None  # scans with the same one read the same rows
    rows: DataFrame | None = None  # those rows; df are those of them that are triples
    present: Column | None = None  # whether one of them is a triple
    unique: bool = False  # whether no subject is in two of them


#: What kinds of terms a variable may be bound to.
Kinds = dict[str, list[Kind]]


@dataclass
class Unit:
    """Patterns that are matched together, each with the scans that may match it."""

    patterns: list[Pattern]
    scans: list[list[Scan]]

    @property
    def names(self) -> set[str]:
        return {n.name for p in self.patterns for n in p.nodes if isinstance(n, Var)}


@dataclass(frozen=True)
class Stats:
    """About how many rows a unit or a join has, and how many terms each of its variables is bound to."""

    rows: float
    values: dict[str, float]

    def joined(self, other: Stats) -> Stats:
        """Of two equal variables, each term of the smaller set is taken to be in the larger one."""
        rows = self.rows * other.rows
        for n in self.values.keys() & other.values.keys():
            rows /= max(self.values[n], other.values[n])
        values = {n: min(x.get(n, inf) for x in (self.values, other.values)) for n in {**self.values, **other.values}}
        return Stats(rows, {n: max(1.0, min(v, rows)) for n, v in values.items()})


class Source:
    """A set of triples, as scans of which each triple is in one."""

    spark: SparkSession

    def scans(self, pattern: Pattern) -> list[Scan]:
        raise NotImplementedError

    def match(self, pattern: Pattern) -> Relation:
        """The bindings of a pattern."""
        return self.read(self.units([pattern])[0])

    def units(self, patterns: list[Pattern], known: Kinds | None = None) -> list[Unit]:
        """The patterns of one group, with the scans that can take part in its result.

        A scan goes where a constant excludes it, or where one of its variables
        can't be bound by the group's other patterns, or by what is known from
        outside, to a term of the scan's kind. Patterns of one subject over the
        same rows, of which none repeats a subject, are one unit.
        """
        scans = [[x for x in self.scans(p) if all(t is not None for t in _tests(x, p))] for p in patterns]
        pruner = Pruner(known or {})
        for _ in range(4 * len(patterns)):  # far more passes than any chain of patterns needs
            if not pruner.pass_over(patterns, scans):
                break
        out: list[Unit] = []
        at: dict = {}
        for p, own in zip(patterns, scans, strict=True):
            one = own[0] if len(own) == 1 and own[0].unique and own[0].table is not None and not own[0].distinct else None
            key = None if one is None else (one.table, p.s)
            if key is not None and key in at:
                at[key].patterns.append(p)
                at[key].scans.append(own)
                continue
            out.append(Unit([p], [own]))
            if key is not None:
                at[key] = out[-1]
        return out

    def read(self, unit: Unit) -> Relation:
        """The bindings of a unit."""
        if len(unit.patterns) > 1:
            first, df = unit.scans[0][0], unit.scans[0][0].rows
            for (scan,) in unit.scans:
                df = df.where(scan.present)
            return bind_rows(df, [(scan, p) for p, (scan,) in zip(unit.patterns, unit.scans, strict=True)], first.s)
        (pattern,), (scans,) = unit.patterns, unit.scans
        parts = [r for scan in together(scans, pattern) if (r := bind(scan, pattern)) is not None]
        if not parts:
            return empty(self.spark, {n.name: Dyn() for n in pattern.nodes if isinstance(n, Var)})
        return parts[0] if len(parts) == 1 else union(parts)

    def estimate(self, unit: Unit) -> float:
        """About how much a unit yields; only the order of estimates matters."""
        return max(sum(scan.size for scan in scans) for scans in unit.scans) * self.share(unit)

    def share(self, unit: Unit) -> float:
        """The share of rows that a unit's constants are taken to leave."""
        out = 1.0
        for p in unit.patterns:
            for node, share in zip(p.nodes, (SUBJECT_SHARE, PREDICATE_SHARE, OBJECT_SHARE), strict=True):
                if isinstance(node, Term):
                    out *= share
        return out

    def statistics(self, units: list[Unit]) -> list[Stats] | None:
        """Of each unit; None where the source knows no numbers of rows."""
        return None

    def triples(self) -> DataFrame:
        """All triples as (s, p, o): text, text and a term."""
        rel = self.match(Pattern(Var("s"), Var("p"), Var("o")))
        cols = [as_term(F.col(rel.vars[n].column), rel.vars[n].kind) for n in "spo"]
        return rel.df.select(cols[0]["v"].alias("s"), cols[1]["v"].alias("p"), cols[2].alias("o"))


def _tests(scan: Scan, pattern: Pattern):
    return [slot.matches(node) for slot, node in zip((scan.s, scan.p, scan.o), pattern.nodes, strict=True) if isinstance(node, Term)]


class Pruner:
    """Kinds that variables may have, narrowed until nothing changes."""

    def __init__(self, known: Kinds):
        self.kinds: dict[str, list[Kind]] = {n: list(k) for n, k in known.items()}

    def pass_over(self, patterns: list[Pattern], scans: list[list[Scan]]) -> bool:
        changed = False
        for i, pattern in enumerate(patterns):
            slots = [(n.name, k) for k, n in enumerate(pattern.nodes) if isinstance(n, Var)]
            kept = [x for x in scans[i] if all(self._may_be(n, _slots(x)[k]) for n, k in slots)]
            changed |= len(kept) < len(scans[i])
            scans[i] = kept
            for n, k in slots:
                own = {_slots(x)[k].kind for x in kept}
                before = self.kinds.get(n)
                now = own if before is None else {_meet(b, o) for b in before for o in own if not disjoint(b, o)}
                self.kinds[n] = sorted(now, key=repr)
                changed |= before is not None and self.kinds[n] != before
        return changed

    def _may_be(self, name: str, slot: Slot) -> bool:
        return name not in self.kinds or any(_overlap(slot, k) for k in self.kinds[name])


def _meet(a: Kind, b: Kind) -> Kind:
    """The narrower of two kinds that share terms: what is of both is of it."""
    if isinstance(a, Dyn) or isinstance(b, Dyn):
        return b if isinstance(a, Dyn) else a
    return b if a == Iri() else a


def _overlap(slot: Slot, kind: Kind) -> bool:
    """Whether the slot may hold a term of the kind."""
    if slot.literal and isinstance(kind, Iri):
        return False
    if slot.term is not None and isinstance(kind, Iri):
        return slot.term.t == URI and kind.key_of(slot.term.v) is not None
    return not disjoint(slot.kind, kind)


def _slots(scan: Scan) -> tuple[Slot, Slot, Slot]:
    return scan.s, scan.p, scan.o


def together(scans: list[Scan], pattern: Pattern) -> list[Scan]:
    """Scans of the same rows as one, which makes the triples of a row where it is read."""
    groups: dict = {}
    for n, scan in enumerate(scans):
        groups.setdefault(n if scan.table is None else ("table", scan.table), []).append(scan)
    return [one[0] if len(one) == 1 else _unpivoted(one, pattern) for one in groups.values()]


def _unpivoted(scans: list[Scan], pattern: Pattern) -> Scan:
    rows, subject = scans[0].rows, scans[0].s
    if isinstance(pattern.s, Term):
        rows = rows.where(subject.matches(pattern.s))
    kinds = {constant(x.o.term)[1] if x.o.term is not None else x.o.kind for x in scans}
    kind = next(iter(kinds)) if len(kinds) == 1 else Iri() if all(isinstance(k, Iri) for k in kinds) else Dyn()
    made = []
    for x in scans:
        own, own_kind = constant(x.o.term) if x.o.term is not None else (x.o.col, x.o.kind)
        holds = x.present if x.present is not None else F.lit(True)
        if isinstance(pattern.o, Term):
            holds = holds & x.o.matches(pattern.o)
        made.append(F.when(holds, F.struct(F.lit(x.p.term.v).alias("p"), convert(own, own_kind, kind).alias("o"))))
    df = rows.select(subject.col.alias("u_s"), F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("u"))
    df = df.select("u_s", F.col("u")["p"].alias("u_p"), F.col("u")["o"].alias("u_o"))
    o = Slot(None, kind, pattern.o) if isinstance(pattern.o, Term) else Slot(F.col("u_o"), kind)
    return Scan(df, Slot(F.col("u_s"), subject.kind), Slot(F.col("u_p"), Iri()), o, any(x.distinct for x in scans))


def bind(scan: Scan, pattern: Pattern) -> Relation | None:
    """The scan's bindings of a pattern; None where a constant excludes it."""
    if any(t is None for t in _tests(scan, pattern)):
        return None
    return bind_rows(scan.df, [(scan, pattern)], scan.s, scan.distinct)


def bind_rows(df: DataFrame, pairs: list[tuple[Scan, Pattern]], subject: Slot, distinct: bool = False) -> Relation:
    """The bindings of patterns that share their subject, each a triple of the same row."""
    for scan, pattern in pairs:
        for t in _tests(scan, pattern):
            df = df.where(t)
    slots = [(subject, pairs[0][1].s)] + [x for scan, p in pairs for x in ((scan.p, p.p), (scan.o, p.o))]
    if distinct:
        # a constant slot doesn't tell rows apart, nor one that is bound to a constant
        keys = [slot.col.alias(f"d{i}") for i, (slot, node) in enumerate(slots) if slot.term is None and isinstance(node, Var)]
        df = df.select(*keys).distinct() if keys else df.limit(1).select()
    found: list[tuple[str, Column, Kind]] = []
    for i, (slot, node) in enumerate(slots):
        if not isinstance(node, Var):
            continue
        if slot.term is not None:
            col, kind = constant(slot.term)
        else:
            col, kind = F.col(f"d{i}") if distinct else slot.col, slot.kind
        found.append((node.name, col, kind))
    bindings = [(n, Binding(column_name(n), k)) for n, _, k in found]
    rel = Relation(df.select(*[c.alias(b.column) for (_, c, _), (_, b) in zip(found, bindings, strict=True)]), dict(bindings))
    first: dict[str, Binding] = {}
    for name, b in bindings:  # a variable twice
        if name in first:
            rel = require_equal(rel, first[name], b)
        else:
            first[name] = b
    return Relation(rel.df, first)


__all__ = ["Lit", "Scan", "Slot", "Source", "bind"]
