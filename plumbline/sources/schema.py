"""Declared tables and their integrity constraints."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..plans.errors import QueryError, Reason
from ..plans.logical import TYPES


def invalid(message: str) -> QueryError:
    return QueryError(Reason.INVALID_SCHEMA, message)


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    domain: tuple[str, ...] = ()

    def key(self) -> str:
        return self.name.lower()


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()

    def key(self) -> str:
        return self.name.lower()

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.key() == name.lower():
                return c
        raise invalid(f"no column {name} in {self.name}")


@dataclass(frozen=True)
class PrimaryKey:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Unique:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class ForeignKey:
    table: str
    columns: tuple[str, ...]
    other: str
    other_columns: tuple[str, ...]


@dataclass(frozen=True)
class Check:
    """A predicate in the dialect over `table.column` names; unknown passes. It ranges over all
    combinations of rows of the tables that it names."""

    predicate: str


@dataclass(frozen=True)
class Increasing:
    """Neighbouring rows strictly increase; with `consecutive`, by exactly one."""

    table: str
    column: str
    consecutive: bool = False


@dataclass(frozen=True)
class Schema:
    tables: tuple[Table, ...]
    constraints: tuple = field(default=())

    def table(self, name: str) -> Table:
        for t in self.tables:
            if t.key() == name.lower():
                return t
        raise invalid(f"no table {name}")

    def has(self, name: str) -> bool:
        return any(t.key() == name.lower() for t in self.tables)

    def primary_keys(self, table: Table) -> list[tuple[str, ...]]:
        own = [table.primary_key] if table.primary_key else []
        return own + [c.columns for c in self.constraints if isinstance(c, PrimaryKey) and c.table.lower() == table.key()]

    def keys(self, table: Table) -> list[tuple[str, ...]]:
        """Column sets that determine the row: primary keys, and unique sets that hold no NULL."""
        fixed = {c.key() for c in table.columns if not c.nullable}
        for k in self.primary_keys(table):
            fixed |= {c.lower() for c in k}
        unique = [c.columns for c in self.constraints if isinstance(c, Unique) and c.table.lower() == table.key()]
        return [tuple(c.lower() for c in k) for k in [*self.primary_keys(table), *(u for u in unique if {c.lower() for c in u} <= fixed)]]

    def nullable(self, table: Table, column: Column) -> bool:
        return column.nullable and not any(column.key() in {c.lower() for c in k} for k in self.primary_keys(table))

    def validate(self) -> Schema:
        """Raise `invalid_schema` for declarations that cannot hold."""
        if not self.tables:
            raise invalid("no tables")
        if len({t.key() for t in self.tables}) < len(self.tables):
            raise invalid("a table name occurs twice")
        for t in self.tables:
            if not t.columns:
                raise invalid(f"{t.name} has no columns")
            if len({c.key() for c in t.columns}) < len(t.columns):
                raise invalid(f"a column name occurs twice in {t.name}")
            for c in t.columns:
                if c.type not in TYPES:
                    raise invalid(f"unknown type {c.type}")
                if (c.type == "enum") != bool(c.domain) or len(set(c.domain)) < len(c.domain):
                    raise invalid(f"the domain of {t.name}.{c.name}")
            for k in t.primary_key:
                t.column(k)
            if len(set(t.primary_key)) < len(t.primary_key):
                raise invalid(f"the key of {t.name}")
            if len(self.primary_keys(t)) > 1:
                raise invalid(f"{t.name} has two primary keys")
        for c in self.constraints:
            self._validate(c)
        return self

    def _validate(self, c) -> None:
        if isinstance(c, (PrimaryKey, Unique, ForeignKey)):
            table = self.table(c.table)
            if not c.columns or len({x.lower() for x in c.columns}) < len(c.columns):
                raise invalid(f"a key of {c.table}")
            own = [table.column(x) for x in c.columns]
            if isinstance(c, ForeignKey):
                other = [self.table(c.other).column(x) for x in c.other_columns]
                if [x.type for x in own] != [x.type for x in other]:
                    raise invalid("a foreign key's types differ from its target's")
        elif isinstance(c, Increasing):
            if self.table(c.table).column(c.column).type != "int":
                raise invalid("a sequence that is not of integers")
        elif not isinstance(c, Check):
            raise invalid(f"unknown constraint {c!r}")


def spark_type(kind: str, exact: bool) -> T.DataType:
    """The Spark type that holds a type of the dialect."""
    if kind == "num":
        return T.DecimalType(38, 18) if exact else T.DoubleType()
    if kind == "time":
        return T.TimeType(6)
    return {"int": T.LongType(), "bool": T.BooleanType(), "text": T.StringType(), "enum": T.StringType(), "date": T.DateType(), "null": T.StringType()}[kind]


def dialect_type(kind: T.DataType) -> str | None:
    """The type of the dialect for a stored column, or None if it has none. Timestamps are
    read as their dates."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "num"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if type(kind).__name__ == "TimeType":
        return "time"
    return None
