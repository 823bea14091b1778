"""Typed expressions and logical relations.

Every column has an id of its own; a relation's columns refer to ids, so that no name
is ambiguous after binding. An expression that uses an id which no relation below it
makes is correlated.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

# The types. `null` is the type of a bare NULL before it adopts another.
TYPES = ("int", "bool", "text", "enum", "date", "time", "num")


@dataclass(frozen=True)
class X:
    """A typed expression. `info` holds an id, a value, a name, or relations of a subquery."""

    op: str
    type: str
    args: tuple[X, ...] = ()
    info: Any = None

    @property
    def literal(self) -> bool:
        return self.op == "lit"


@dataclass(frozen=True)
class Col:
    id: str
    name: str
    type: str
    nullable: bool = True
    #: (qualifier, name) under which it can be addressed
    quals: tuple[tuple[str, str], ...] = ()
    #: seen by `*` and by bare names
    visible: bool = True
    domain: tuple[str, ...] = ()


@dataclass(frozen=True)
class Order:
    expr: X
    ascending: bool
    nulls_first: bool


@dataclass(eq=False)
class Rel:
    cols: list[Col]
    fds: set = field(default_factory=set)
    max_rows: float = math.inf

    def inputs(self) -> list[Rel]:
        return [x for x in (getattr(self, n, None) for n in ("input", "left", "right")) if x is not None]

    def exprs(self) -> list[X]:
        return []

    def made(self) -> set[str]:
        """Ids that this node makes itself."""
        return set()


@dataclass(eq=False)
class Unit(Rel):
    pass


@dataclass(eq=False)
class Scan(Rel):
    table: str = ""
    sources: list[str] = field(default_factory=list)

    def made(self):
        return {c.id for c in self.cols}


@dataclass(eq=False)
class Filter(Rel):
    input: Rel = None
    predicate: X = None

    def exprs(self):
        return [self.predicate]


@dataclass(eq=False)
class Project(Rel):
    input: Rel = None
    items: list[tuple[str, X]] = field(default_factory=list)

    def exprs(self):
        return [x for _, x in self.items]

    def made(self):
        return {i for i, _ in self.items}


@dataclass(eq=False)
class Join(Rel):
    kind: str = "inner"
    left: Rel = None
    right: Rel = None
    predicate: X | None = None

    def exprs(self):
        return [self.predicate] if self.predicate is not None else []


@dataclass(frozen=True)
class Agg:
    name: str
    args: tuple[X, ...]
    distinct: bool
    type: str


@dataclass(eq=False)
class Aggregate(Rel):
    input: Rel = None
    keys: list[tuple[str, X]] = field(default_factory=list)
    aggs: list[tuple[str, Agg]] = field(default_factory=list)
    #: columns read from each group's first row: (new id, input id)
    firsts: list[tuple[str, str]] = field(default_factory=list)
    grouped: bool = True

    def exprs(self):
        return [x for _, x in self.keys] + [a for _, g in self.aggs for a in g.args]

    def made(self):
        return {i for i, _ in self.keys} | {i for i, _ in self.aggs} | {i for i, _ in self.firsts}


@dataclass(frozen=True)
class Win:
    name: str
    args: tuple[X, ...]
    distinct: bool
    partition: tuple[X, ...]
    order: tuple[Order, ...]
    type: str


@dataclass(eq=False)
class Window(Rel):
    input: Rel = None
    calls: list[tuple[str, Win]] = field(default_factory=list)

    def exprs(self):
        return [x for _, w in self.calls for x in (*w.args, *w.partition, *(o.expr for o in w.order))]

    def made(self):
        return {i for i, _ in self.calls}


@dataclass(eq=False)
class Distinct(Rel):
    input: Rel = None


@dataclass(eq=False)
class SetOp(Rel):
    op: str = "union"
    every: bool = False
    left: Rel = None
    right: Rel = None
    #: ids of the two sides, column by column
    sides: tuple[list[str], list[str]] = ((), ())

    def made(self):
        return {c.id for c in self.cols}


@dataclass(eq=False)
class Sort(Rel):
    input: Rel = None
    order: list[Order] = field(default_factory=list)

    def exprs(self):
        return [o.expr for o in self.order]


@dataclass(eq=False)
class Slice(Rel):
    input: Rel = None
    limit: int | None = None
    offset: int = 0


SUBQUERIES = ("exists", "in", "scalar")


def subqueries(x: X):
    """The subquery expressions within, outermost first, not entering their relations."""
    if x.op in SUBQUERIES:
        yield x
    for a in x.args:
        yield from subqueries(a)


def refs(x: X) -> set[str]:
    """Ids that an expression uses and no relation within it makes."""
    out = {x.info} if x.op == "col" else set()
    for a in x.args:
        out |= refs(a)
    if x.op in SUBQUERIES:
        out |= free(x.info)
    return out


def made(rel: Rel) -> set[str]:
    return rel.made().union(*[made(r) for r in rel.inputs()])


def free(rel: Rel) -> set[str]:
    """Ids that a relation uses from outside."""
    used: set[str] = set()

    def walk(r: Rel):
        for x in r.exprs():
            used.update(refs(x))
        for i in r.inputs():
            walk(i)

    walk(rel)
    return used - made(rel)


def conjuncts(x: X) -> list[X]:
    return [c for a in x.args for c in conjuncts(a)] if x.op == "and" else [x]


def closure(ids: set[str], fds: set) -> set[str]:
    """All ids that `ids` determine."""
    out, before = set(ids), -1
    while len(out) != before:
        before = len(out)
        for left, right in fds:
            if left <= out:
                out |= right
    return out


_MIRRORED = {"gt": "lt", "ge": "le"}
_OPPOSITE = {"lt": "ge", "ge": "lt", "gt": "le", "le": "gt"}


def normal(x: X) -> X:
    """An expression of the same value, in three-valued logic too, with fewer ways to be said:
    no > and >=, no NOT above comparisons, AND and OR, and no nested AND or OR."""
    x = X(x.op, x.type, tuple(map(normal, x.args)), x.info)
    if x.op == "ne":
        return X("not", "bool", (X("eq", "bool", x.args),))
    if x.op == "not":
        a = x.args[0]
        if a.op == "not":
            return a.args[0]
        if a.op in _OPPOSITE:
            return normal(X(_OPPOSITE[a.op], "bool", a.args))
        if a.op in ("and", "or"):
            return normal(X("or" if a.op == "and" else "and", "bool", tuple(X("not", "bool", (b,)) for b in a.args)))
    if x.op in _MIRRORED:
        return X(_MIRRORED[x.op], "bool", x.args[::-1])
    if x.op in ("and", "or"):
        flat = [b for a in x.args for b in (a.args if a.op == x.op else (a,))]
        flat = list(dict.fromkeys(flat))
        return flat[0] if len(flat) == 1 else X(x.op, "bool", tuple(flat))
    return x


def canonical(rel: Rel) -> str:
    """A text that is equal for plans which differ only in ids, names, the order of operands that
    commute, and what `normal` settles."""
    names: dict[str, str] = {}

    def ident(i: str) -> str:
        return names.setdefault(i, f"#{len(names)}")

    def expr(x: X) -> str:
        return told(normal(x))

    def told(x: X) -> str:
        if x.op == "col":
            return ident(x.info)
        inner = node(x.info) if x.op in SUBQUERIES else repr(x.info)
        args = [told(a) for a in x.args]
        if x.op in ("and", "or", "eq", "same", "add", "mul"):
            args.sort()
        return f"{x.op}:{x.type}({','.join(args)};{inner})"

    def order(os) -> str:
        return ",".join(f"{expr(o.expr)}{o.ascending}{o.nulls_first}" for o in os)

    def node(r: Rel) -> str:
        while isinstance(r, Filter) and isinstance(r.input, Filter):
            r = Filter(r.cols, r.fds, r.max_rows, r.input.input, X("and", "bool", (r.input.predicate, r.predicate)))
        below = [node(i) for i in r.inputs()]
        if isinstance(r, Scan):
            own = r.table + ",".join(f"{ident(c.id)}={s}" for c, s in zip(r.cols, r.sources, strict=True))
        elif isinstance(r, Project):
            own = ",".join(f"{expr(x)}->{ident(i)}" for i, x in r.items)
        elif isinstance(r, Join):
            own = r.kind + (expr(r.predicate) if r.predicate is not None else "")
        elif isinstance(r, Aggregate):
            own = f"{r.grouped}" + ",".join(f"{expr(x)}->{ident(i)}" for i, x in r.keys) + "|" + ",".join(f"{g.name}{g.distinct}{[expr(a) for a in g.args]}->{ident(i)}" for i, g in r.aggs) + "|" + ",".join(f"{ident(s)}->{ident(i)}" for i, s in r.firsts)
        elif isinstance(r, Window):
            own = ",".join(f"{w.name}{w.distinct}{[expr(a) for a in w.args]}{[expr(a) for a in w.partition]}{order(w.order)}->{ident(i)}" for i, w in r.calls)
        elif isinstance(r, SetOp):
            own = f"{r.op}{r.every}{[ident(i) for s in r.sides for i in s]}{[ident(c.id) for c in r.cols]}"
        elif isinstance(r, Sort):
            own = order(r.order)
        elif isinstance(r, Slice):
            own = f"{r.limit},{r.offset}"
        else:
            own = ",".join(expr(x) for x in r.exprs())
        return f"{type(r).__name__}[{own}]({';'.join(below)})"

    text = node(rel)
    return text + "=>" + ",".join(ident(c.id) for c in rel.cols if c.visible)
