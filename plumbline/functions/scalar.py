"""The scalar functions of the dialect: how a call is typed. Building columns from the
typed calls is the business of `columns`."""

from __future__ import annotations

from ..plans.errors import type_error, unsupported
from ..plans.logical import X
from . import typing as T
from .typing import Policies


def _count(name: str, args: list[X], low: int, high: int | None = None) -> None:
    if len(args) < low or len(args) > (low if high is None else high):
        raise type_error(f"{name}() takes another number of arguments")


def _as(name: str, x: X, *kinds: str) -> X:
    """The argument in one of the types; NULL takes the first."""
    if x.type == "null":
        return T.adopt(x, kinds[0])
    if x.type in kinds:
        return x
    if x.type == "enum" and "text" in kinds:
        return X("cast", "text", (x,))
    if x.literal and x.type == "text" and kinds[0] == "date":
        return T.adopt(x, "date")
    raise type_error(f"{name}() of {x.type}")


def _whole(name: str, x: X, low: int | None = None, high: int | None = None) -> int:
    """An integer literal within bounds."""
    if not (x.literal and x.type == "int"):
        raise unsupported(f"{name}() needs a literal here")
    if low is not None and x.info < low or high is not None and x.info > high:
        raise unsupported(f"{name}() with {x.info}")
    return x.info


def _same(op: str, *kinds: str):
    def bind(name, args, policies):
        _count(name, args, 1)
        x = _as(name, args[0], *kinds)
        return X(op, x.type, (x,))

    return bind


def _to(op: str, result: str, *kinds: str):
    def bind(name, args, policies):
        _count(name, args, 1)
        return X(op, result, (_as(name, args[0], *kinds),))

    return bind


def _coalesce(name, args, policies):
    _count(name, args, 2 if name == "ifnull" else 1, 2 if name == "ifnull" else 99)
    args = T.common(args)
    return X("coalesce", args[0].type, tuple(args))


def _if(name, args, policies):
    _count(name, args, 3)
    a, b = T.common(args[1:])
    return X("case", a.type, (T.predicate(args[0], policies), a, b))


def _nullif(name, args, policies):
    _count(name, args, 2)
    same = T.compare("eq", args[0], args[1], policies)
    x = T.adopt(args[0], "text") if args[0].type == "null" else args[0]
    return X("case", x.type, (same, X("lit", x.type, (), None), x))


def _isnull(name, args, policies):
    _count(name, args, 1)
    return X("is_null", "bool", (args[0],))


def _power(name, args, policies):
    _count(name, args, 2)
    return X("power", "num", (T.numeric(_as(name, args[0], "num", "int")),), _whole(name, args[1], 0, 8))


def _mod(name, args, policies):
    _count(name, args, 2)
    return T.arithmetic("mod", args[0], args[1], policies)


def _round(name, args, policies):
    _count(name, args, 1, 2)
    x = _as(name, args[0], "num", "int")
    scale = _whole(name, args[1]) if len(args) == 2 else 0
    return x if x.type == "int" else X("round", "num", (x,), scale)


def _truncate(name, args, policies):
    _count(name, args, 2)
    x, scale = _as(name, args[0], "num", "int"), _whole(name, args[1])
    return x if x.type == "int" and scale >= 0 else X("truncate", x.type, (x,), scale)


def _concat(name, args, policies):
    _count(name, args, 1, 99)
    return X("concat", "text", tuple(_as(name, a, "text") for a in args))


def _side(name, args, policies):
    _count(name, args, 2)
    return X(name, "text", (_as(name, args[0], "text"),), _whole(name, args[1], 0))


def _substring(name, args, policies):
    _count(name, args, 2, 3)
    length = _whole(name, args[2], 0) if len(args) == 3 else None
    return X("substring", "text", (_as(name, args[0], "text"),), (_whole(name, args[1], 1), length))


def _datediff(name, args, policies):
    _count(name, args, 2)
    return X("date_diff", "int", tuple(_as(name, a, "date") for a in args))


def _shift(op: str):
    def bind(name, args, policies):
        _count(name, args, 2)
        return X(op, "date", (_as(name, args[0], "date"), _as(name, args[1], "int")))

    return bind


def _date(name, args, policies):
    _count(name, args, 1)
    return _as(name, args[0], "date")


# The formats of STR_TO_DATE, as the order of year, month and day.
_FORMATS = {"%Y-%m-%d", "%Y-%c-%e", "%Y-%m-%e", "%Y-%c-%d"}


def _str_to_date(name, args, policies):
    _count(name, args, 2)
    if not (args[0].literal and args[0].type == "text" and args[1].literal and args[1].info in _FORMATS):
        raise unsupported("STR_TO_DATE but of a literal in a year-month-day format")
    return T.from_text(args[0].info, "date")


def _date_format(name, args, policies):
    _count(name, args, 2)
    if not policies.mysql_coercion:
        raise unsupported("DATE_FORMAT")
    return _as(name, args[0], "date")


FUNCTIONS = {
    "coalesce": _coalesce, "ifnull": _coalesce, "if": _if, "nullif": _nullif, "isnull": _isnull,
    "abs": _same("abs", "num", "int"), "sign": _to("sign", "int", "num", "int"), "power": _power, "pow": _power, "mod": _mod,
    "floor": _to("floor", "int", "num", "int"), "ceil": _to("ceil", "int", "num", "int"), "ceiling": _to("ceil", "int", "num", "int"),
    "round": _round, "truncate": _truncate,
    "concat": _concat, "length": _to("length", "int", "text"), "char_length": _to("length", "int", "text"), "character_length": _to("length", "int", "text"),
    "left": _side, "right": _side, "substring": _substring,
    "year": _to("year", "int", "date"), "month": _to("month", "int", "date"), "day": _to("day", "int", "date"), "dayofmonth": _to("day", "int", "date"),
    "quarter": _to("quarter", "int", "date"), "weekday": _to("weekday", "int", "date"), "dayofweek": _to("dayofweek", "int", "date"),
    "last_day": _same("last_day", "date"), "to_days": _to("to_days", "int", "date"),
    "datediff": _datediff, "date_add": _shift("date_add"), "adddate": _shift("date_add"), "date_sub": _shift("date_sub"), "subdate": _shift("date_sub"),
    "date": _date, "str_to_date": _str_to_date, "date_format": _date_format,
}


def call(name: str, args: list[X], policies: Policies) -> X:
    if name not in FUNCTIONS:
        raise unsupported(f"{name}()")
    return FUNCTIONS[name](name, args, policies)
