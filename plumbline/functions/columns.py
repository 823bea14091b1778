"""Spark columns from typed expressions: built-in functions only.

Two number modes. Analytics holds numerics as doubles and lets integer overflow raise.
Exact holds them as DECIMAL(38,18) and turns overflow into NULL, for candidate databases
in which one row must not end the run; what it finds there is confirmed by exact
evaluation. Products take 9 digits of either side after the point; quotients 6, or 12 where both
sides are less than 10^8.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.logical import X
from ..sources.schema import spark_type

_EXACT = T.DecimalType(38, 18)


def literal(value) -> Column:
    """A constant; dates by their text, since early years lose their zeros on the way to the JVM."""
    return F.lit(value.isoformat()).cast("date") if type(value) is dt.date else F.lit(value)


class Columns:
    def __init__(self, exact: bool, lookup: Callable[[str], Column]):
        self.exact, self.lookup = exact, lookup

    def type(self, kind: str) -> T.DataType:
        return spark_type(kind, self.exact)

    def __call__(self, x: X) -> Column:
        if x.op == "col":
            return self.lookup(x.info)
        if x.op == "lit":
            return literal(x.info).cast(self.type(x.type))
        return getattr(self, f"_{x.op}")(x, *map(self, x.args))

    # -- truth values
    def _and(self, x, *a):
        return reduce(lambda p, q: p & q, a)

    def _or(self, x, *a):
        return reduce(lambda p, q: p | q, a)

    def _not(self, x, a):
        return ~a

    def _eq(self, x, a, b):
        return a == b

    def _ne(self, x, a, b):
        return a != b

    def _lt(self, x, a, b):
        return a < b

    def _le(self, x, a, b):
        return a <= b

    def _gt(self, x, a, b):
        return a > b

    def _ge(self, x, a, b):
        return a >= b

    def _same(self, x, a, b):
        return a.eqNullSafe(b)

    def _is_null(self, x, a):
        return a.isNull()

    def _is_bool(self, x, a):
        return F.coalesce(a if x.info else ~a, F.lit(False))

    def _prefix(self, x, a):
        return a.startswith(F.lit(x.info))

    def _suffix(self, x, a):
        return a.endswith(F.lit(x.info))

    def _contains(self, x, a):
        return a.contains(F.lit(x.info))

    def _case(self, x, *a):
        *branches, other = a
        out = F.when(branches[0], branches[1])
        for k in range(2, len(branches), 2):
            out = out.when(branches[k], branches[k + 1])
        return out.otherwise(other)

    def _coalesce(self, x, *a):
        return F.coalesce(*a)

    # -- numbers
    def _add(self, x, a, b):
        return self._plain(x, F.try_add(a, b) if self.exact else a + b)

    def _sub(self, x, a, b):
        return self._plain(x, F.try_subtract(a, b) if self.exact else a - b)

    def _mul(self, x, a, b):
        if self.exact and x.type == "num":
            return self._plain(x, F.try_multiply(a.try_cast("decimal(19,9)"), b.try_cast("decimal(19,9)")))
        return F.try_multiply(a, b) if self.exact else a * b

    def _div(self, x, a, b):
        if self.exact:
            return self._plain(x, self._quotient(a, b))
        return F.try_divide(a, b)

    @staticmethod
    def _quotient(a, b):
        """Of two exact numbers, whose digits after the point would else be cut to fit 38 digits."""
        near = [v.try_cast("decimal(20,12)") for v in (a, b)]
        up = [(v * F.lit(10**6)).try_cast("decimal(20,6)") for v in near]
        return F.when(near[0].isNotNull() & near[1].isNotNull(), F.try_divide(*up)).otherwise(F.try_divide(a.try_cast("decimal(20,6)"), b.try_cast("decimal(20,6)")))

    def _plain(self, x, value):
        return value.try_cast(_EXACT) if self.exact and x.type == "num" else value

    def _mod(self, x, a, b):
        return F.try_mod(a, b)

    def _neg(self, x, a):
        return F.negative(a)

    def _abs(self, x, a):
        return F.abs(a)

    def _sign(self, x, a):
        return F.signum(a).cast("bigint")

    def _power(self, x, a):
        if not x.info:
            return F.when(a.isNotNull(), F.lit(1).cast(self.type("num")))
        return reduce(lambda p, q: self._mul(x, p, q), [a] * x.info)

    def _floor(self, x, a):
        return F.floor(a).cast("bigint")

    def _ceil(self, x, a):
        return F.ceil(a).cast("bigint")

    def _round(self, x, a):
        return F.round(a, x.info).cast(self.type(x.type))

    def _truncate(self, x, a):
        scale = F.lit(x.info)
        return F.when(a >= 0, F.floor(a, scale)).otherwise(F.ceil(a, scale)).cast(self.type(x.type))

    def _cast(self, x, a):
        kind, own = x.args[0].type, x.type
        if own == "bool":
            return a != 0
        if kind == "bool" and own == "num":
            return a.cast("bigint").cast(self.type(own))
        return a.cast(self.type(own))

    # -- strings
    def _concat(self, x, *a):
        return F.concat(*a)

    def _length(self, x, a):
        return F.length(a).cast("bigint")

    def _left(self, x, a):
        return F.substring(a, 1, x.info)

    def _right(self, x, a):
        return F.right(a, F.lit(x.info))

    def _substring(self, x, a):
        start, length = x.info
        return F.substring(a, start, 2**31 - 1 if length is None else length)

    # -- dates
    def _date_add(self, x, a, b):
        return F.date_add(a, b.cast("int"))

    def _date_sub(self, x, a, b):
        return F.date_sub(a, b.cast("int"))

    def _date_diff(self, x, a, b):
        return F.datediff(a, b).cast("bigint")

    def _year(self, x, a):
        return F.year(a).cast("bigint")

    def _month(self, x, a):
        return F.month(a).cast("bigint")

    def _day(self, x, a):
        return F.dayofmonth(a).cast("bigint")

    def _quarter(self, x, a):
        return F.quarter(a).cast("bigint")

    def _weekday(self, x, a):
        return F.weekday(a).cast("bigint")

    def _dayofweek(self, x, a):
        return F.dayofweek(a).cast("bigint")

    def _last_day(self, x, a):
        return F.last_day(a)

    def _to_days(self, x, a):
        return (F.unix_date(a) + 719528).cast("bigint")

    # -- aggregates, over a group or a window
    def aggregate(self, name: str, distinct: bool, kind: str, args: tuple[X, ...]) -> Column:
        if name == "count":
            if not args:
                return F.count(F.lit(1))
            return F.count_distinct(*map(self, args)) if distinct else F.count(self(args[0]))
        value = self(args[0])
        if name in ("min", "max"):
            return getattr(F, name)(value)
        if args[0].type == "bool":
            value = value.cast("bigint")
        if name == "sum":
            return (F.sum_distinct(value) if distinct else F.sum(value)).cast(self.type(kind))
        if not self.exact:
            value = value.cast("double")
            return F.try_divide(F.sum_distinct(value), F.count_distinct(value)) if distinct else F.avg(value)
        value = value.cast(_EXACT)
        total, n = (F.sum_distinct(value), F.count_distinct(value)) if distinct else (F.sum(value), F.count(value))
        return self._quotient(total, n).try_cast(_EXACT)

    def windowed(self, name: str, distinct: bool, kind: str, args: tuple[X, ...], window) -> Column:
        """An aggregate over a window; DISTINCT by way of the set of the frame's values."""
        if not distinct or name in ("min", "max") or not args:
            if name == "avg" and self.exact:
                value = self(args[0]).cast("bigint" if args[0].type == "bool" else _EXACT).cast(_EXACT)
                return self._quotient(F.sum(value).over(window), F.count(value).over(window)).try_cast(_EXACT)
            if name == "sum":
                value = self(args[0])
                return F.sum(value.cast("bigint") if args[0].type == "bool" else value).over(window).cast(self.type(kind))
            return self.aggregate(name, False, kind, args).over(window)
        value = self(args[0])
        if args[0].type == "bool" and name != "count":
            value = value.cast("bigint")
        found = F.collect_set(value).over(window)
        if name == "count":
            return F.size(found).cast("bigint")
        zero = F.lit(0).cast(self.type("int" if args[0].type in ("int", "bool") else "num"))
        total = F.when(F.size(found) > 0, F.aggregate(found, zero, lambda p, q: (p + q).cast(self.type("int" if args[0].type in ("int", "bool") else "num"))))
        if name == "sum":
            return total.cast(self.type(kind))
        if not self.exact:
            return F.try_divide(total.cast("double"), F.size(found).cast("double"))
        return self._quotient(total, F.size(found)).try_cast(_EXACT)
