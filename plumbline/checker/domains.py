"""Which values candidate databases need.

Columns whose values two queries can compare, directly or through joins, unions, IN or
their own results, form a class. If values are only compared, the outcome depends on no
more than their order among themselves and with the literals, so that for a bounded number
of rows a class needs its literals and, in every gap between them, as many values as it has
cells. Such a search is complete. Where values are computed with, it is not, and the values
are a guess: literals, their neighbours, and some others.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field
from decimal import Decimal
from fractions import Fraction

from ..plans import logical as L
from ..plans.logical import X
from ..sources.schema import ForeignKey, Increasing, Schema, Unique
from . import exact

_COMPARED = {"eq", "ne", "lt", "le", "gt", "ge", "same"}
_LOGIC = {"and", "or", "not", "is_null", "is_bool"}
_ARITHMETIC = {"coalesce", "cast", "add", "sub", "mul", "div", "mod", "neg", "abs", "sign", "power", "floor", "ceil", "round", "truncate"}


@dataclass
class ColumnClass:
    type: str
    members: set = field(default_factory=set)  # (table, column)
    literals: set = field(default_factory=set)
    ordered: bool = False


class Classes:
    """Classes of the columns that some queries use."""

    def __init__(self, schema: Schema):
        self.schema, self.parent, self.found, self.complete = schema, {}, {}, True
        self.reason = ""

    def root(self, key):
        while self.parent.setdefault(key, key) != key:
            key = self.parent[key]
        return key

    def of(self, key, kind: str) -> ColumnClass:
        return self.found.setdefault(self.root(key), ColumnClass(kind))

    def union(self, a, b) -> None:
        p, q = self.root(a), self.root(b)
        if p == q:
            return
        self.parent[q] = p
        if q in self.found:
            other = self.found.pop(q)
            mine = self.found.setdefault(p, ColumnClass(other.type))
            mine.members |= other.members
            mine.literals |= other.literals
            mine.ordered |= other.ordered

    def incomplete(self, why: str) -> None:
        if self.complete:
            self.complete, self.reason = False, why

    def value(self, x: X) -> object:
        """The class key of an expression's values; literals join it when it is known."""
        if x.op == "col":
            return x.info
        key = ("x", id(x))
        self.parent.setdefault(key, key)
        self.kept.append(x)
        if x.op == "lit":
            if x.info is not None:
                self.of(key, x.type).literals.add(x.info)
            else:
                self.of(key, x.type)
            return key
        if x.op in ("case", "coalesce") and not self.counted(x):
            values = [*x.args[1::2], x.args[-1]] if x.op == "case" else list(x.args)
            if x.op == "case":
                for c in x.args[:-1:2]:
                    self.test(c)
            for v in values:
                self.union(key, self.value(v))
            return key
        if x.op == "cast" and x.type in ("text", "enum") or x.type == "bool":
            if x.type == "bool" and x.op != "cast":
                self.test(x)
            elif x.type == "bool":
                self.incomplete(f"{x.op} of a column")
                self.touch(x)
            else:
                self.union(key, self.value(x.args[0]))
            return key
        if x.op == "scalar":
            self.relation(x.info)
            self.union(key, next(c.id for c in x.info.cols if c.visible))
            return key
        if self.constant(x):
            try:
                found = exact.constant(x)
            except exact.OutOfRange:
                found = Fraction(1, 3)
            if isinstance(found, Fraction):  # no literal says it
                self.incomplete(f"{x.op} without a value of the type")
            elif found is not None:
                self.of(key, x.type).literals.add(found)
            return key
        if self.counted(x):
            self.tests_within(x)
            self.counts.add(key)
            return key
        self.incomplete(f"{x.op} of values")
        self.touch(x)
        return key

    @staticmethod
    def constant(x: X) -> bool:
        """Whether no column has a part in the value."""
        return not L.refs(x) and not any(True for _ in L.subqueries(x))

    def counted(self, x: X) -> bool:
        """Whether the value comes of literals and of numbers of rows alone, whatever the columns hold:
        how it is chosen may turn on tests of them."""
        if x.op == "lit":
            return True
        if x.op == "col":
            return x.info in self.counts
        if x.op == "case":
            return all(map(self.counted, [*x.args[1::2], x.args[-1]]))
        return x.type in ("int", "num") and x.op in _ARITHMETIC and all(map(self.counted, x.args))

    def tests_within(self, x: X) -> None:
        """The conditions by which a counted value is chosen."""
        for k, a in enumerate(x.args):
            if x.op == "case" and k < len(x.args) - 1 and k % 2 == 0:
                self.test(a)
            else:
                self.tests_within(a)

    kept: list = []  # expressions stay alive, since their identity is a key

    def touch(self, x: X) -> None:
        """The columns within are used; their literals are candidates."""
        for a in x.args:
            if a.op == "lit":
                self.stray.add((a.type, a.info))
            elif a.op == "col":
                self.root(a.info)
                self.computed.add(a.info)
            elif a.op in L.SUBQUERIES or a.type == "bool":
                self.test(a)
            else:
                self.touch(a)
        if isinstance(x.info, str) and x.op in ("prefix", "suffix", "contains"):
            self.stray.add(("text", x.info))

    def test(self, x: X) -> None:
        if x.op in _LOGIC:
            for a in x.args:
                self.test(a) if a.type == "bool" else self.value(a)
        elif x.op in _COMPARED:
            a, b = map(self.value, x.args)
            self.union(a, b)
            if x.op not in ("eq", "ne", "same"):
                self.of(a, x.args[0].type).ordered = True
        elif x.op == "exists":
            self.relation(x.info)
        elif x.op == "in":
            self.relation(x.info)
            for a, c in zip(x.args, [c for c in x.info.cols if c.visible], strict=True):
                self.union(self.value(a), c.id)
        elif self.constant(x):
            pass
        elif x.op in ("prefix", "suffix", "contains"):
            self.incomplete("LIKE")
            self.touch(x)
        elif x.op in ("col", "lit", "case", "coalesce", "cast", "scalar"):
            self.value(x)
        else:
            self.incomplete(x.op)
            self.touch(x)

    def relation(self, r: L.Rel) -> None:
        for i in r.inputs():
            self.relation(i)
        if isinstance(r, L.Scan):
            for c, s in zip(r.cols, r.sources, strict=True):
                self.scanned[c.id] = (r.table, s)
                self.union(("base", r.table, s), c.id)
        elif isinstance(r, (L.Filter, L.Join)):
            for x in r.exprs():
                self.test(x)
        elif isinstance(r, L.Project):
            for i, x in r.items:
                if x != X("col", x.type, (), i):
                    key = self.value(x)
                    self.union(i, key)
                    if key in self.counts:
                        self.counts.add(i)
        elif isinstance(r, L.Aggregate):
            for i, x in r.keys:
                if x != X("col", x.type, (), i):
                    self.union(i, self.value(x))
            for i, a in r.aggs:
                if a.name in ("sum", "avg") and self.counted(a.args[0]):
                    self.tests_within(a.args[0])
                    self.counts.add(i)
                    continue
                keys = [self.value(x) for x in a.args]
                if a.name in ("min", "max"):
                    self.union(i, keys[0])
                    self.of(keys[0], a.type).ordered = True
                elif a.name == "count":
                    self.counts.add(i)
                else:
                    self.incomplete(a.name.upper())
                    self.computed.update(L.refs(a.args[0]))
            for i, s in r.firsts:
                self.union(i, s)
        elif isinstance(r, L.Window):
            for i, w in r.calls:
                for o in w.order:
                    key = self.value(o.expr)
                    self.of(key, o.expr.type).ordered = True
                if w.name in ("sum", "avg") and self.counted(w.args[0]):
                    for x in w.partition:
                        self.value(x)
                    self.tests_within(w.args[0])
                    self.counts.add(i)
                    continue
                for x in (*w.args, *w.partition):
                    self.value(x)
                if w.name in ("min", "max", "first_value"):
                    self.union(i, self.value(w.args[0]))
                    if w.name != "first_value":
                        self.of(i, w.type).ordered = True
                elif w.name in ("sum", "avg"):
                    self.incomplete(w.name.upper())
                    self.computed.update(L.refs(w.args[0]))
                else:
                    self.counts.add(i)
        elif isinstance(r, L.SetOp):
            for a, b, c in zip(*r.sides, r.cols, strict=True):
                self.union(c.id, a)
                self.union(c.id, b)
        elif isinstance(r, L.Sort):
            for o in r.order:
                key = self.value(o.expr)
                self.of(key, o.expr.type).ordered = True

    def build(self, queries: list[L.Rel], predicates: list[X]) -> Classes:
        self.kept, self.scanned, self.counts, self.computed, self.stray = [], {}, set(), set(), set()
        used: set = set()
        for r in queries:
            self.relation(r)
            used |= _used(r)
        for p in predicates:
            self.test(p)
        first = [c for c in queries[0].cols if c.visible] if queries else []
        for r in queries[1:]:
            for a, c in zip(first, [c for c in r.cols if c.visible], strict=False):
                self.union(a.id, c.id)
        self.used = {self.scanned[i] for i in used if i in self.scanned}
        # columns named in CHECKs are `table.column`
        for p in predicates:
            for i in L.refs(p):
                t, c = i.split(".", 1)
                self.union(("base", t, c), i)
                self.used.add((t, c))
        self._keys()
        for i in self.counts:
            # a count that meets values of a column counts like a computed value
            if any(self.root(("base", *m)) == self.root(i) for m in self.used):
                self.incomplete("a count compared with a column")
        return self

    def _keys(self) -> None:
        """Columns of keys and sequences matter, though no query names them: how many rows there can
        be depends on their values."""
        for t in self.schema.tables:
            for key in self.schema.primary_keys(t):
                self.used |= {(t.key(), c.lower()) for c in key}
        for c in self.schema.constraints:
            if isinstance(c, Unique):
                self.used |= {(c.table.lower(), x.lower()) for x in c.columns}
            elif isinstance(c, ForeignKey):
                for x, y in zip(c.columns, c.other_columns, strict=True):
                    own, other = (c.table.lower(), x.lower()), (c.other.lower(), y.lower())
                    self.used |= {own, other}
                    self.union(("base", *own), ("base", *other))
            elif isinstance(c, Increasing):
                own = (c.table.lower(), c.column.lower())
                self.used.add(own)
                self.of(("base", *own), "int").ordered = True
        for c in self.schema.constraints:
            if isinstance(c, Increasing) and c.consecutive:
                root = self.root(("base", c.table.lower(), c.column.lower()))
                beside = [m for m in self.used if self.root(("base", *m)) == root]
                if len(beside) > 1 or self.found[root].literals:
                    self.incomplete("a consecutive column that is compared with other values")

    def class_of(self, table: str, column: str) -> ColumnClass:
        return self.of(("base", table, column), self.schema.table(table).column(column).type)


def _used(rel: L.Rel) -> set[str]:
    """Ids that matter to the result: those in expressions and among the outputs."""
    out = {c.id for c in rel.cols if c.visible}

    def expr(x: X):
        out.update(L.refs(x))
        for s in L.subqueries(x):
            out.update(_used(s.info))
            for a in s.args:
                expr(a)

    def walk(r: L.Rel):
        if isinstance(r, L.Project):
            for i, x in r.items:
                if x != X("col", x.type, (), i):
                    expr(x)
        else:
            for x in r.exprs():
                expr(x)
        if isinstance(r, L.Distinct):
            out.update(c.id for c in r.cols)
        if isinstance(r, L.Aggregate):
            out.update(s for _, s in r.firsts)
        if isinstance(r, L.SetOp):
            out.update(i for s in r.sides for i in s)
        for i in r.inputs():
            walk(i)

    walk(rel)
    return out


_EPOCH = dt.date(2000, 1, 1)
_MICROSECOND = dt.timedelta(microseconds=1)
#: Digits after the point, and before it, that candidate databases hold.
DIGITS, WHOLE = 18, 20


def _microseconds(t: dt.time) -> int:
    return ((t.hour * 60 + t.minute) * 60 + t.second) * 1_000_000 + t.microsecond


#: Of types whose values follow each other: as a number, from a number, the least and the largest,
#: and where values begin that no literal names.
_STEPPED = {
    "int": (int, int, -(2**63), 2**63 - 1, 1),
    "date": (dt.date.toordinal, dt.date.fromordinal, 1, dt.date.max.toordinal(), _EPOCH.toordinal()),
    "time": (_microseconds, lambda v: (dt.datetime.min + v * _MICROSECOND).time(), 0, 24 * 3600 * 1_000_000 - 1, 3600 * 1_000_000),
}


def _gap_values(kind: str, literals: list, cells: int, ordered: bool) -> list:
    """Literals and, in each gap between them (or anywhere, without order), up to `cells` values. A gap
    that has no more values than that gives all."""
    if kind in _STEPPED:
        to, back, least, most, base = _STEPPED[kind]
        numbers = sorted({to(v) for v in literals})
        if not numbers:
            return [back(base + k) for k in range(cells)]
        edges = [least - 1, *numbers, most + 1]
        out = set(numbers)
        if ordered:
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                n = min(cells, b - a - 1)
                out |= {a + 1 + i for i in range(n)} if k else {b - 1 - i for i in range(n)}
        else:  # any others
            value = numbers[-1]
            while len(out) < len(numbers) + cells:
                value = value + 1 if value < most else least
                out.add(value)
        return [back(v) for v in sorted(out)]
    if kind == "num":
        numbers = sorted({Decimal(v) for v in literals})
        if not numbers:
            return [Decimal(1 + k) for k in range(cells)]
        out = set(numbers) | {Decimal(math.floor(numbers[0]) - k) for k in range(1, cells + 1)} | {Decimal(math.floor(numbers[-1]) + k) for k in range(1, cells + 1)}
        for a, b in zip(numbers, numbers[1:], strict=False):
            out |= set(between(a, b, cells))
        return sorted(out)
    fresh, k = [], 0
    while len(fresh) < cells:
        name = chr(97 + k % 26) * (1 + k // 26)
        k += 1
        if name not in literals:
            fresh.append(name)
    return sorted({*literals, *fresh})


def between(a: Decimal, b: Decimal, n: int) -> list[Decimal]:
    """Up to n decimals between two, with as few digits as do."""
    for digits in range(DIGITS + 1):
        low, high = math.floor(Fraction(a) * 10**digits) + 1, math.ceil(Fraction(b) * 10**digits) - 1
        if high - low + 1 >= n:
            return [Decimal(low + k).scaleb(-digits) for k in range(n)]
    return [Decimal(low + k).scaleb(-DIGITS) for k in range(high - low + 1)]


def held(value: Decimal) -> bool:
    """Whether candidate databases can hold the number."""
    return -value.as_tuple().exponent <= DIGITS and abs(value) < Decimal(10) ** (WHOLE - 1)


def _guessed(kind: str, literals: set, strays: set, cells: int) -> list:
    """Values for columns that are computed with."""
    own = set(literals) | {v for k, v in strays if k == kind and v is not None}
    if kind == "int":
        near = {v + d for v in own if isinstance(v, int) for d in (-1, 0, 1)} | {v for v in (0, 1, -1, 2)}
        near |= {int(v) for k, v in strays if k == "num" and v is not None}
        return sorted(v for v in near if -(2**63) <= v < 2**63)
    if kind == "num":
        numbers = {Decimal(v) for v in own} | {Decimal(v) for k, v in strays if k == "int" and v is not None}
        near = {v + d for v in numbers for d in (Decimal(-1), Decimal(0), Decimal(1))} | {Decimal(0), Decimal(1), Decimal("-1.5"), Decimal("2.5"), Decimal("0.4")}
        return sorted(v for v in near if held(v))
    if kind == "date":
        days = {d.toordinal() + n for d in own or {_EPOCH} for n in (-1, 0, 1)}
        return sorted({dt.date.fromordinal(n) for n in days if 1 <= n <= dt.date.max.toordinal()} | {dt.date(2020, 2, 29), dt.date(1969, 12, 31)})
    if kind == "text":
        return sorted({*own, *(v + "x" for v in own), *("x" + v for v in own), "", "a", "A"})
    return _gap_values(kind, sorted(own), cells, True)


def domain(classes: Classes, table: str, column: str, bound: int, nullable: bool) -> list:
    """The values that a column takes in candidate databases; NULL last, where it may be."""
    c = classes.schema.table(table).column(column)
    if (table, column) not in classes.used:
        values = [None] if nullable else [False] if c.type == "bool" else [c.domain[0]] if c.type == "enum" else _gap_values(c.type, [], 1, False)
        return values
    found = classes.class_of(table, column)
    members = {(t.key(), k.key()) for t in classes.schema.tables for k in t.columns if (t.key(), k.key()) in classes.used and classes.root(("base", t.key(), k.key())) == classes.root(("base", table, column))}
    cells = bound * max(1, len(members))
    computed = {classes.root(i) for i in classes.computed}
    if c.type == "bool":
        values = [False, True]
    elif c.type == "enum":
        values = list(c.domain)
    elif classes.root(("base", table, column)) in computed:
        values = _guessed(c.type, found.literals, classes.stray, cells)
    else:
        if c.type == "text" and found.ordered and found.literals:
            classes.incomplete("an order of texts and literals")
        literals = sorted(found.literals)
        if c.type == "num":
            if any(not held(Decimal(v)) for v in literals):
                classes.incomplete("a number with more digits than databases hold")
            literals = [v for v in literals if held(Decimal(v))]
            if found.ordered and any(len(between(Decimal(a), Decimal(b), cells)) < cells for a, b in zip(literals, literals[1:], strict=False)):
                classes.incomplete("numbers too near each other")
        values = _gap_values(c.type, literals, cells, found.ordered)
    return [*values, None] if nullable else values
