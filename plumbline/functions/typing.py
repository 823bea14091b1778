"""Type rules: literals, comparisons, common types, arithmetic."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from ..plans.errors import type_error
from ..plans.logical import X

NULL = X("lit", "null", (), None)
TRUE, FALSE = X("lit", "bool", (), True), X("lit", "bool", (), False)


@dataclass(frozen=True)
class Policies:
    """How strict the dialect is. The defaults refuse; the others are MySQL's habits."""

    ignore_top_level_order: bool = False
    first_row_grouping: bool = False
    mysql_coercion: bool = False


def integer(value: int) -> X:
    if not -(2**63) <= value < 2**63:
        raise type_error("an integer beyond 64 bits")
    return X("lit", "int", (), value)


def number(text: str) -> X:
    if "." not in text:
        return integer(int(text))
    return X("lit", "num", (), Decimal(text if text != "." else "0"))


def parse_date(text: str) -> dt.date:
    m = re.fullmatch(r"\s*(\d{4})-(\d{1,2})-(\d{1,2})\s*", text)
    try:
        return dt.date(*map(int, m.groups()))
    except (AttributeError, ValueError):
        raise type_error(f"no date: {text!r}") from None


def parse_time(text: str) -> dt.time:
    m = re.fullmatch(r"\s*(\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d{1,6})0*)?\s*", text)
    try:
        return dt.time(int(m[1]), int(m[2]), int(m[3]), int((m[4] or "").ljust(6, "0")))
    except (TypeError, ValueError):
        raise type_error(f"no time: {text!r}") from None


def from_text(text: str, kind: str) -> X:
    """A string literal as a literal of another type."""
    if kind == "date":
        return X("lit", kind, (), parse_date(text))
    if kind == "time":
        return X("lit", kind, (), parse_time(text))
    if kind in ("text", "enum"):
        return X("lit", kind, (), text)
    if kind in ("int", "num"):
        try:
            value = Decimal(text.strip())
        except InvalidOperation:
            raise type_error(f"no number: {text!r}") from None
        if kind == "num":
            return X("lit", kind, (), value)
        if value == value.to_integral_value():
            return integer(int(value))
    raise type_error(f"{text!r} as {kind}")


def adopt(x: X, kind: str) -> X:
    """A literal as the type of its counterpart, where the dialect lets it be."""
    if x.type == kind or kind == "null":
        return x
    if x.type == "null":
        return X("lit", kind, (), None)
    if x.literal and x.type == "text":
        return from_text(x.info, kind)
    if x.literal and x.type == "int":
        if kind == "num":
            return X("lit", "num", (), Decimal(x.info))
        if kind == "bool" and x.info in (0, 1):
            return X("lit", "bool", (), bool(x.info))
    return x


def paired(a: X, b: X, policies: Policies) -> tuple[X, X]:
    """Two operands of a comparison in one type."""
    if a.type == "null" and b.type == "null":
        return X("lit", "text", (), None), X("lit", "text", (), None)
    a, b = adopt(a, b.type), adopt(b, a.type)
    if a.type != b.type and policies.mysql_coercion:
        a, b = (coerced(a, b.type), b) if a.literal else (a, coerced(b, a.type))
        if a.type != b.type:
            a, b = coerced(a, b.type), coerced(b, a.type)
    if a.type != b.type:
        raise type_error(f"{a.type} compared with {b.type}")
    return a, b


def coerced(x: X, kind: str) -> X:
    if x.type == "int" and kind == "num" or x.type == "bool" and kind in ("int", "num"):
        return X("cast", kind, (x,))
    if x.type == "num" and x.literal and kind == "int" and x.info == x.info.to_integral_value():
        return integer(int(x.info))
    return x


def compare(op: str, a: X, b: X, policies: Policies) -> X:
    a, b = paired(a, b, policies)
    if a.type == "bool" and op not in ("eq", "ne", "same"):
        raise type_error("booleans have no order")
    return X(op, "bool", (a, b))


def common(values: list[X]) -> list[X]:
    """Values of CASE or COALESCE in one type."""
    kinds = {v.type for v in values if v.type != "null"}
    if not kinds:
        kind = "text"
    elif len(kinds) == 1:
        kind = kinds.pop()
    elif kinds == {"int", "num"}:
        kind = "num"
    else:
        text = [v for v in values if v.type == "text"]
        rest = kinds - {"text"}
        if len(rest) == 1 and all(v.literal for v in text):
            kind = rest.pop()
        else:
            raise type_error(f"no common type of {sorted(kinds)}")
    return [X("cast", "num", (v,)) if v.type == "int" and kind == "num" and not v.literal else adopt(v, kind) for v in values]


def predicate(x: X, policies: Policies) -> X:
    """An operand where a truth value is due."""
    if x.type == "null":
        return X("lit", "bool", (), None)
    if x.literal and x.type == "int" and x.info in (0, 1):
        return X("lit", "bool", (), bool(x.info))
    if x.type in ("int", "num") and policies.mysql_coercion:
        return X("ne", "bool", (x, adopt(integer(0), x.type)))
    if x.type != "bool":
        raise type_error(f"{x.type} as a truth value")
    return x


def arithmetic(op: str, a: X, b: X, policies: Policies) -> X:
    """+ - * / %, dates and days."""
    if policies.mysql_coercion:
        a, b = (adopt(v, "num") if v.literal and v.type == "text" else X("cast", "int", (v,)) if v.type == "bool" else v for v in (a, b))
    if a.type == "date" and b.type in ("int", "null") and op in ("add", "sub"):
        return X("date_add" if op == "add" else "date_sub", "date", (a, adopt(b, "int")))
    if a.type in ("int", "null") and b.type == "date" and op == "add":
        return X("date_add", "date", (b, adopt(a, "int")))
    if a.type == "date" and b.type == "date" and op == "sub":
        return X("date_diff", "int", (a, b))
    if a.type == "null" and b.type == "null":
        raise type_error("arithmetic on NULLs of no type")
    a, b = (adopt(a, b.type) if a.type == "null" else a), (adopt(b, a.type) if b.type == "null" else b)
    if not {a.type, b.type} <= {"int", "num"}:
        raise type_error(f"{op} of {a.type} and {b.type}")
    if op == "mod":
        if {a.type, b.type} != {"int"}:
            raise type_error("MOD takes integers")
        return X("mod", "int", (a, b))
    if op == "div" or "num" in (a.type, b.type):
        a, b = numeric(a), numeric(b)
        return X(op, "num", (a, b))
    return X(op, "int", (a, b))


def numeric(x: X) -> X:
    if x.type == "num":
        return x
    return adopt(x, "num") if x.literal else X("cast", "num", (x,))


def negative(x: X) -> X:
    if x.type not in ("int", "num"):
        raise type_error(f"minus {x.type}")
    if x.literal and x.info is not None:
        return X("lit", x.type, (), -x.info)
    return X("neg", x.type, (x,))


# The spellings of types in CAST.
_SPELLINGS = {
    "int": "tinyint smallint mediumint int integer bigint int2 int4 int8 signed|signed integer|unsigned",
    "bool": "boolean bool",
    "text": "char character varchar nvarchar nchar|character varying|char varying",
    "date": "date",
    "time": "time",
    "num": "numeric decimal dec",
}
_CASTS = {s: kind for kind, spellings in _SPELLINGS.items() for part in spellings.split("|") for s in ([part] if part.startswith(("character v", "char v", "signed i")) else part.split())}
_FLOATS = {"float", "double", "real", "double precision", "float4", "float8"}


def cast(x: X, spelling: str, policies: Policies) -> X:
    words = spelling.replace(" unsigned", "")
    if words in _FLOATS and policies.mysql_coercion:
        kind = "num"
    elif words in _CASTS:
        kind = _CASTS[words]
    else:
        from ..plans.errors import unsupported

        raise unsupported(f"CAST to {spelling}")
    if x.type == "null":
        return X("lit", kind, (), None)
    if x.type == kind:
        return x
    if x.literal and x.type == "text" and kind in ("date", "time", "num", "int"):
        return from_text(x.info, kind)
    if (x.type, kind) in {("int", "num"), ("bool", "int"), ("int", "bool"), ("num", "bool"), ("text", "enum"), ("enum", "text")}:
        return numeric(x) if kind == "num" else X("cast", kind, (x,))
    raise type_error(f"CAST of {x.type} as {kind}")
