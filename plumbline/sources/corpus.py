"""Records of query pairs, one JSON object per line: file, index, schema, constraint, pair.

The schema maps tables to columns to declarations; constraints are objects of one operator
over terms. `schema_of` makes a schema of them, predicates as CHECK texts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .schema import Check, Column, ForeignKey, Increasing, PrimaryKey, Schema, Table, invalid

RECORD = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("index", T.LongType()), T.StructField("schema", T.StringType()),
    T.StructField("constraint", T.StringType()), T.StructField("pair", T.ArrayType(T.StringType())),
])

# The declarations of columns, and the operators that compare two terms.
DECLARED = {"INT": "int", "BOOL": "bool", "VARCHAR": "text", "DATE": "date", "TIME": "time", "NUMERIC": "num"}
COMPARED = {"eq": "=", "neq": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The records; schema and constraint stay JSON texts, since their order counts."""
    return spark.read.schema(RECORD).json(path)


def _column(name: str, declaration: str) -> Column:
    kind = declaration.upper()
    if kind in DECLARED:
        return Column(name, DECLARED[kind])
    head, *members = kind.split(",")
    if head != "ENUM":
        raise invalid(f"the declaration {declaration}")
    return Column(name, "enum", True, tuple(m for m in members if m != "NULL"))


def _place(term) -> tuple[str, str]:
    """Table and column of a term."""
    text = term.get("value") if isinstance(term, dict) else term
    table, mark, column = str(text).partition("__")
    if not mark:
        raise invalid(f"no column: {term!r}")
    return table.lower(), column.lower()


def _term(term) -> str:
    if isinstance(term, int) and not isinstance(term, bool):
        return str(term)
    if isinstance(term, dict) and len(term) == 1:
        kind, text = next(iter(term.items()))
        if kind == "date":
            return f"DATE '{text}'"
        if kind == "literal":
            return "'" + text.replace("'", "''") + "'"
        if kind == "value":
            return ".".join(_place(term))
    if isinstance(term, str):
        return ".".join(_place(term)) if "__" in term else "'" + term.replace("'", "''") + "'"
    raise invalid(f"the term {term!r}")


def _operator(constraint) -> tuple[str, object]:
    if not isinstance(constraint, dict) or len(constraint) != 1:
        raise invalid(f"the constraint {constraint!r}")
    return next(iter(constraint.items()))


def _predicate(constraint) -> str:
    op, args = _operator(constraint)
    if op in COMPARED and len(args) == 2:
        return f"{_term(args[0])} {COMPARED[op]} {_term(args[1])}"
    if op == "between" and len(args) == 3:
        return f"{_term(args[0])} BETWEEN {_term(args[1])} AND {_term(args[2])}"
    if op == "in" and len(args) == 2 and args[1]:
        return f"{_term(args[0])} IN ({', '.join(map(_term, args[1]))})"
    if op == "imply" and len(args) == 2:
        return f"implies({_predicate(args[0])}, {_predicate(args[1])})"
    raise invalid(f"the constraint operator {op}")


def _constraint(constraint):
    op, args = _operator(constraint)
    if op == "primary":
        places = [_place(a) for a in args]
        if len({t for t, _ in places}) != 1:
            raise invalid("a primary key over several tables")
        return PrimaryKey(places[0][0], tuple(c for _, c in places))
    if op == "foreign":
        (table, column), (other, target) = map(_place, args)
        return ForeignKey(table, (column,), other, (target,))
    if op in ("inc", "consec"):
        return Increasing(*_place(args), op == "consec")
    return Check(_predicate(constraint))


def schema_of(schema_text: str, constraint_text: str | None) -> Schema:
    """The schema that a record declares; all columns may be NULL but those of primary keys."""
    tables = json.loads(schema_text)
    made = tuple(Table(t.lower(), tuple(_column(c.lower(), d) for c, d in columns.items())) for t, columns in tables.items())
    return Schema(made, tuple(map(_constraint, json.loads(constraint_text) if constraint_text else []))).validate()
