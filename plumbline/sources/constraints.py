"""What violates declared constraints, as DataFrames. `keys` are columns that number
databases held side by side; a violation names the one it is in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import typing as T
from ..functions.columns import Columns
from ..plans import logical as L
from ..plans.binder import Binder, _Scope
from ..plans.errors import type_error, unsupported
from ..plans.logical import X
from ..plans.syntax import Node, Parser
from .schema import Check, Column, ForeignKey, Increasing, PrimaryKey, Schema, Table, Unique


def nulls(df: DataFrame, columns) -> DataFrame:
    """Rows with a NULL in one of the columns."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def outside_domain(df: DataFrame, column: Column) -> DataFrame:
    return df.filter(~F.col(column.key()).isin(*column.domain))


def duplicates(df: DataFrame, columns, keys=()) -> DataFrame:
    """Keys without NULLs that occur more than once."""
    columns = [c.lower() for c in columns]
    return df.dropna(subset=columns).groupBy(*keys, *columns).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")


def dangling(df: DataFrame, columns, other: DataFrame, other_columns, keys=()) -> DataFrame:
    """Rows whose reference has no NULL and no target."""
    own = [c.lower() for c in columns]
    target = other.select(*[F.col(k).alias(f"__t{k}") for k in keys], *[F.col(c.lower()).alias(f"__t{n}") for n, c in enumerate(other_columns)]).distinct()
    tests = [F.col(k) == F.col(f"__t{k}") for k in keys] + [F.col(c) == F.col(f"__t{n}") for n, c in enumerate(own)]
    return df.dropna(subset=own).join(target, reduce(lambda a, b: a & b, tests), "left_anti")


def unordered(df: DataFrame, column: str, consecutive: bool, keys=(), position: str = "__position") -> DataFrame:
    """Rows that are NULL or do not follow the row before. Rows without positions are taken as read."""
    column = column.lower()
    if position not in df.columns:
        df = df.withColumn(position, F.monotonically_increasing_id())
    before = F.lag(column).over(W.partitionBy(*keys).orderBy(position))
    wrong = F.col(column) != F.col("__before") + 1 if consecutive else F.col(column) <= F.col("__before")
    return df.withColumn("__before", before).filter(F.col(column).isNull() | F.coalesce(wrong, F.lit(False)))


_CHECKED = {"eq", "ne", "lt", "le", "gt", "ge", "in_list", "between", "and", "or", "not", "call", "name", "number", "string", "null", "bool", "typed", "neg"}


def check_predicate(schema: Schema, check: Check, policies: T.Policies | None = None) -> tuple[X, list[str]]:
    """The typed predicate, over ids `table.column`, and the tables it names. `implies(a, b)` is
    the implication."""
    parser = Parser(check.predicate)
    node = parser.expr()
    if parser.peek()[0] != "end":
        raise type_error(f"no predicate: {check.predicate}")
    named: list[str] = []

    def walk(n: Node) -> Node:
        if n.kind not in _CHECKED or n.kind == "call" and n.info != "implies":
            raise unsupported(f"{n.kind} in a CHECK")
        if n.kind == "name":
            if n.info[0] is None:
                raise unsupported("a bare name in a CHECK")
            schema.table(n.info[0]).column(n.info[1])
            if n.info[0] not in named:
                named.append(n.info[0])
        args = tuple(map(walk, n.args))
        if n.kind == "call":
            return Node("or", (Node("not", (args[0],)), args[1]))
        return Node(n.kind, args, n.info)

    node = walk(node)
    cols = [L.Col(f"{t}.{c.key()}", c.key(), c.type, c.nullable, ((t, c.key()),)) for t in named for c in schema.table(t).columns]
    binder = Binder(schema, policies)
    return binder._truth(node, [_Scope(cols)], {}, 0), named


def check_violations(frames: dict[str, DataFrame], schema: Schema, check: Check, keys=(), exact: bool = False) -> DataFrame | None:
    """Combinations of rows for which the predicate is false. A predicate without tables gives None
    if it holds, else raises `invalid_schema`."""
    predicate, named = check_predicate(schema, check)
    if not named:
        return None
    df = None
    for t in named:
        part = frames[t].select(*[F.col(k).alias(f"__{t}_{k}") for k in keys], *[F.col(c.key()).alias(f"{t}.{c.key()}") for c in schema.table(t).columns])
        if df is None:
            df = part.withColumnsRenamed({f"__{t}_{k}": k for k in keys})
        elif keys:
            df = df.join(part, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{t}_{k}") for k in keys])).drop(*[f"__{t}_{k}" for k in keys])
        else:
            df = df.crossJoin(part)
    build = Columns(exact, lambda i: F.col(f"`{i}`"))
    return df.filter(~F.coalesce(build(predicate), F.lit(True)))


def violations(frames: dict[str, DataFrame], schema: Schema, keys=(), exact: bool = False) -> list[tuple[str, DataFrame]]:
    """(what is violated, the rows or keys that do) for every declaration."""
    out = []
    for t in schema.tables:
        df = frames[t.key()]
        fixed = [c.key() for c in t.columns if not schema.nullable(t, c)]
        if fixed:
            out.append((f"not null {t.key()}", nulls(df, fixed)))
        out += [(f"enum {t.key()}.{c.key()}", outside_domain(df, c)) for c in t.columns if c.type == "enum"]
        out += [(f"primary key {t.key()}", duplicates(df, k, keys)) for k in schema.primary_keys(t)]
    for c in schema.constraints:
        if isinstance(c, Unique):
            out.append((f"unique {c.table}", duplicates(frames[c.table.lower()], c.columns, keys)))
        elif isinstance(c, ForeignKey):
            out.append((f"foreign key {c.table}", dangling(frames[c.table.lower()], c.columns, frames[c.other.lower()], c.other_columns, keys)))
        elif isinstance(c, Increasing):
            out.append((f"sequence {c.table}", unordered(frames[c.table.lower()], c.column, c.consecutive, keys)))
        elif isinstance(c, Check):
            df = check_violations(frames, schema, c, keys, exact)
            if df is not None:
                out.append((f"check {c.predicate}", df))
        else:
            assert isinstance(c, PrimaryKey)
    return out


__all__ = ["Table", "check_predicate", "check_violations", "dangling", "duplicates", "nulls", "outside_domain", "unordered", "violations"]
