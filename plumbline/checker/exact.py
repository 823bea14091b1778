"""Plain evaluation of bound queries over a few rows, with exact numbers.

Integers have 64 bits and numerics are rationals, so that nothing is rounded; a value that
does not exist in the dialect's types (an integer beyond 64 bits, a date beyond the
calendar) raises `OutOfRange`. Rows keep the order in which they are met. This is what
counterexamples are replayed with, apart from the engine that found them.
"""

from __future__ import annotations

import calendar
import datetime as dt
import functools
import math
from decimal import Decimal
from fractions import Fraction

from ..plans import logical as L
from ..plans.logical import X


class OutOfRange(Exception):
    """A value that the dialect does not have."""


def integer(value) -> int:
    if not -(2**63) <= value < 2**63:
        raise OutOfRange(f"{value} has no 64 bits")
    return int(value)


def inward(value):
    return Fraction(value) if isinstance(value, Decimal) else value


def outward(value):
    """Rationals as decimals where they have a finite expansion."""
    if not isinstance(value, Fraction):
        return value
    rest, digits = value.denominator, 0
    for p in (2, 5):
        n = 0
        while rest % p == 0:
            rest, n = rest // p, n + 1
        digits = max(digits, n)
    if rest != 1:
        return value
    whole = value * 10**digits
    return Decimal((int(whole < 0), tuple(map(int, str(abs(int(whole))))), -digits))


def _day(ordinal: int) -> dt.date:
    try:
        return dt.date.fromordinal(ordinal)
    except (ValueError, OverflowError):
        raise OutOfRange("a date beyond the calendar") from None


def _away(value: Fraction, scale: int) -> Fraction:
    """Rounded to `scale` digits, halves away from zero."""
    moved = abs(value) * Fraction(10) ** scale
    return Fraction(math.floor(moved + Fraction(1, 2))) / Fraction(10) ** scale * (1 if value >= 0 else -1)


def _cut(value: Fraction, scale: int) -> Fraction:
    return Fraction(math.trunc(value * Fraction(10) ** scale)) / Fraction(10) ** scale


def _part(text: str, start: int, length: int | None) -> str:
    first = start - 1 if start > 0 else len(text) + start if start < 0 else 0
    last = len(text) if length is None else first + length
    return text[max(first, 0) : max(last, 0)] if last > first else ""


_COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}

#: Functions of arguments that are not NULL, and of the expression.
_STRICT = {
    **{k: (lambda f: lambda x, a, b: f(a, b))(f) for k, f in _COMPARE.items()},
    "prefix": lambda x, a: a.startswith(x.info),
    "suffix": lambda x, a: a.endswith(x.info),
    "contains": lambda x, a: x.info in a,
    "add": lambda x, a, b: a + b,
    "sub": lambda x, a, b: a - b,
    "mul": lambda x, a, b: a * b,
    "div": lambda x, a, b: None if b == 0 else Fraction(a) / Fraction(b),
    "mod": lambda x, a, b: None if b == 0 else (abs(a) % abs(b)) * (1 if a >= 0 else -1),
    "neg": lambda x, a: -a,
    "abs": lambda x, a: abs(a),
    "sign": lambda x, a: (a > 0) - (a < 0),
    "power": lambda x, a: Fraction(a) ** x.info,
    "floor": lambda x, a: math.floor(a),
    "ceil": lambda x, a: math.ceil(a),
    "round": lambda x, a: _away(Fraction(a), x.info),
    "truncate": lambda x, a: _cut(Fraction(a), x.info),
    "concat": lambda x, *a: "".join(a),
    "length": lambda x, a: len(a),
    "left": lambda x, a: a[: max(x.info, 0)],
    "right": lambda x, a: a[-x.info :] if x.info > 0 else "",
    "substring": lambda x, a: _part(a, *x.info),
    "date_add": lambda x, a, b: _day(a.toordinal() + b),
    "date_sub": lambda x, a, b: _day(a.toordinal() - b),
    "date_diff": lambda x, a, b: a.toordinal() - b.toordinal(),
    "year": lambda x, a: a.year,
    "month": lambda x, a: a.month,
    "day": lambda x, a: a.day,
    "quarter": lambda x, a: (a.month + 2) // 3,
    "weekday": lambda x, a: a.weekday(),
    "dayofweek": lambda x, a: (a.weekday() + 1) % 7 + 1,
    "last_day": lambda x, a: a.replace(day=calendar.monthrange(a.year, a.month)[1]),
    "to_days": lambda x, a: a.toordinal() + 365,
}


def _typed(kind: str, value):
    if value is None:
        return None
    if kind == "int":
        return integer(value)
    return Fraction(value) if kind == "num" else value


def _cast(x: X, value):
    return value != 0 if x.type == "bool" else int(value) if x.args[0].type == "bool" else value


def _key(order: list[tuple[bool, bool]]):
    """A sort key of values for directions and places of NULL."""

    def compare(a, b):
        for (up, first), p, q in zip(order, a, b, strict=True):
            if p is None or q is None:
                if (p is None) != (q is None):
                    return -1 if (p is None) == first else 1
            elif p != q:
                return -1 if (p < q) == up else 1
        return 0

    return functools.cmp_to_key(compare)


def _total(name: str, distinct: bool, kind: str, rows: list[tuple]):
    """An aggregate of argument tuples."""
    if name == "count" and (not rows or not rows[0]):
        return len(rows)
    held = [r for r in rows if None not in r]
    if distinct:
        held = list(dict.fromkeys(held))
    if name == "count":
        return len(held)
    values = [int(r[0]) if isinstance(r[0], bool) and name in ("sum", "avg") else r[0] for r in held]
    if not values:
        return None
    if name in ("min", "max"):
        return min(values) if name == "min" else max(values)
    return _typed(kind, sum(values)) if name == "sum" else Fraction(sum(values)) / len(values)


class Evaluator:
    """tables: table -> rows, each a dict of column -> value."""

    def __init__(self, tables: dict[str, list[dict]]):
        self.tables = {t: [{c: inward(v) for c, v in r.items()} for r in rows] for t, rows in tables.items()}

    def result(self, rel: L.Rel) -> list[tuple]:
        ids = [c.id for c in rel.cols if c.visible]
        return [tuple(r[i] for i in ids) for r in self.rows(rel, {})]

    # -- expressions
    def value(self, x: X, env: dict):
        op = x.op
        if op == "col":
            return env[x.info]
        if op == "lit":
            return _typed(x.type, inward(x.info)) if x.type == "num" else x.info
        if op in ("and", "or"):
            found = [self.value(a, env) for a in x.args]
            decisive = op == "or"
            return decisive if decisive in found else None if None in found else not decisive
        if op == "case":
            *branches, other = x.args
            for test, value in zip(branches[::2], branches[1::2], strict=True):
                if self.value(test, env):
                    return _typed(x.type, self.value(value, env))
            return _typed(x.type, self.value(other, env))
        if op == "coalesce":
            return next((_typed(x.type, v) for v in (self.value(a, env) for a in x.args) if v is not None), None)
        if op == "exists":
            return bool(self.rows(x.info, env))
        if op == "scalar":
            rows = self.rows(x.info, env)
            return rows[0][next(c.id for c in x.info.cols if c.visible)] if rows else None
        found = [self.value(a, env) for a in x.args]
        if op == "in":
            ids = [c.id for c in x.info.cols if c.visible]
            tests = [self._equal(found, [r[i] for i in ids]) for r in self.rows(x.info, env)]
            return True if True in tests else None if None in tests else False
        if op == "same":
            return found[0] == found[1]
        if op == "is_null":
            return found[0] is None
        if op == "is_bool":
            return found[0] is x.info
        if None in found:
            return None
        if op == "not":
            return not found[0]
        return _typed(x.type, _cast(x, found[0]) if op == "cast" else _STRICT[op](x, *found))

    @staticmethod
    def _equal(a, b):
        tests = [None if p is None or q is None else p == q for p, q in zip(a, b, strict=True)]
        return False if False in tests else None if None in tests else True

    # -- relations: lists of dicts of ids
    def rows(self, rel: L.Rel, env: dict) -> list[dict]:
        return getattr(self, f"_{type(rel).__name__.lower()}")(rel, env)

    def _unit(self, rel, env):
        return [{}]

    def _scan(self, rel, env):
        return [{c.id: r[s] for c, s in zip(rel.cols, rel.sources, strict=True)} for r in self.tables[rel.table]]

    def _filter(self, rel, env):
        return [r for r in self.rows(rel.input, env) if self.value(rel.predicate, env | r)]

    def _project(self, rel, env):
        return [{i: self.value(x, env | r) for i, x in rel.items} for r in self.rows(rel.input, env)]

    def _join(self, rel, env):
        left, right = self.rows(rel.left, env), self.rows(rel.right, env)
        blank = [{c.id: None for c in _columns(side)} for side in (rel.left, rel.right)]
        out, met = [], set()
        for a in left:
            some = False
            for k, b in enumerate(right):
                if rel.predicate is None or self.value(rel.predicate, env | a | b):
                    out.append(a | b)
                    some = True
                    met.add(k)
            if not some and rel.kind in ("left", "full"):
                out.append(blank[1] | a)
        if rel.kind in ("right", "full"):
            out += [blank[0] | b for k, b in enumerate(right) if k not in met]
        return out

    def _aggregate(self, rel, env):
        groups: dict[tuple, list[dict]] = {}
        for r in self.rows(rel.input, env):
            groups.setdefault(tuple(self.value(x, env | r) for _, x in rel.keys), []).append(r)
        if not rel.grouped and not groups:
            groups[()] = []
        out = []
        for key, rows in groups.items():
            made = {i: v for (i, _), v in zip(rel.keys, key, strict=True)}
            made |= {i: _total(g.name, g.distinct, g.type, [tuple(self.value(a, env | r) for a in g.args) for r in rows]) for i, g in rel.aggs}
            made |= {i: rows[0][s] if rows else None for i, s in rel.firsts}
            out.append(made)
        return out

    def _window(self, rel, env):
        rows = self.rows(rel.input, env)
        out = [dict(r) for r in rows]
        for i, w in rel.calls:
            parts: dict[tuple, list[int]] = {}
            for k, r in enumerate(rows):
                parts.setdefault(tuple(self.value(x, env | r) for x in w.partition), []).append(k)
            by = [tuple(self.value(o.expr, env | r) for o in w.order) for r in rows]
            args = [tuple(self.value(a, env | r) for a in w.args) for r in rows]
            key = _key([(o.ascending, o.nulls_first) for o in w.order])
            for held in parts.values():
                held = sorted(held, key=lambda k: key(by[k]))
                for n, k in enumerate(held):
                    if w.name == "row_number":
                        out[k][i] = n + 1
                    elif w.name == "first_value":
                        out[k][i] = args[held[0]][0]
                    elif w.name in ("rank", "dense_rank"):
                        before = [by[j] for j in held if key(by[j]) < key(by[k])]
                        out[k][i] = (len(before) if w.name == "rank" else len(dict.fromkeys(before))) + 1
                    else:
                        frame = [args[j] for j in held if not w.order or not key(by[k]) < key(by[j])]
                        out[k][i] = _total(w.name, w.distinct, w.type, frame)
        return out

    def _distinct(self, rel, env):
        ids = list(dict.fromkeys(c.id for c in rel.cols))
        found = dict.fromkeys(tuple(r[i] for i in ids) for r in self.rows(rel.input, env))
        return [dict(zip(ids, r, strict=True)) for r in found]

    def _setop(self, rel, env):
        left, right = ([tuple(r[i] for i in ids) for r in self.rows(side, env)] for side, ids in zip((rel.left, rel.right), rel.sides, strict=True))
        if rel.op == "union":
            held = left + right if rel.every else list(dict.fromkeys(left + right))
        else:
            held, seen = [], {}
            for r in left:
                seen[r] = seen.get(r, 0) + 1
                n = right.count(r)
                if rel.op == "intersect":
                    good = seen[r] <= n if rel.every else seen[r] == 1 and n > 0
                else:
                    good = seen[r] > n if rel.every else seen[r] == 1 and n == 0
                if good:
                    held.append(r)
        return [{c.id: v for c, v in zip(rel.cols, r, strict=True)} for r in held]

    def _sort(self, rel, env):
        key = _key([(o.ascending, o.nulls_first) for o in rel.order])
        return sorted(self.rows(rel.input, env), key=lambda r: key(tuple(self.value(o.expr, env | r) for o in rel.order)))

    def _slice(self, rel, env):
        rows = self.rows(rel.input, env)[rel.offset :]
        return rows if rel.limit is None else rows[: rel.limit]


def _columns(rel: L.Rel) -> list[L.Col]:
    """All columns that rows of the relation have, hidden ones too."""
    return list(rel.cols)


def constant(x: X):
    """The value of an expression without columns and subqueries."""
    return outward(Evaluator({}).value(x, {}))
