"""The engine: tables by name, and queries of the dialect as DataFrames."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.typing import Policies
from .operators.lower import Lowerer, result
from .plans.binder import Binder, Bound
from .plans.errors import QueryError, Reason, name_error
from .plans.syntax import parse
from .sources.schema import Column, Schema, Table, dialect_type, spark_type


class Engine:
    """`exact` holds numerics as DECIMAL(38,18) instead of doubles. With first-row grouping, rows
    are numbered as they are read, so that "first" has a meaning."""

    def __init__(self, spark: SparkSession, policies: Policies | None = None, exact: bool = False):
        self.spark, self.policies, self.exact = spark, policies or Policies(), exact
        self.frames: dict[str, DataFrame] = {}
        self.tables: dict[str, Table] = {}
        self.constraints: tuple = ()
        with contextlib.suppress(Exception):  # sessions of Spark before 4.1 have no TIME
            spark.conf.set("spark.sql.timeType.enabled", "true")

    def register(self, name: str, df: DataFrame, primary_key: tuple[str, ...] = (), not_null: tuple[str, ...] = (), declared: Table | None = None) -> Engine:
        """A frame as a table. Columns of types that the dialect lacks are left out; timestamps
        become dates, integers BIGINT, and other numbers the engine's numerics."""
        kept, columns = [], []
        fixed = {c.lower() for c in (*primary_key, *not_null)}
        known = {c.key(): c for c in declared.columns} if declared else {}
        for f in df.schema.fields:
            c = known.get(f.name.lower())
            kind = c.type if c else dialect_type(f.dataType)
            if kind is None or declared and c is None:
                continue
            key = f.name.lower()
            kept.append(F.col(f"`{f.name}`").cast(spark_type(kind, self.exact)).alias(key))
            columns.append(c or Column(key, kind, f.nullable and key not in fixed))
        out = df.select(*kept)
        if self.policies.first_row_grouping:
            out = out.withColumn("__position", F.monotonically_increasing_id())
        self.frames[name.lower()] = out
        self.tables[name.lower()] = declared or Table(name.lower(), tuple(columns), tuple(primary_key))
        return self

    def read_parquet(self, folder: str, keys: dict[str, tuple[str, ...]], names: list[str] | None = None) -> Engine:
        """Tables of a folder with a parquet file for each; keys: the primary key of each."""
        for name in names or list(keys):
            self.register(name, self.spark.read.parquet(f"{folder}/{name}.parquet"), keys.get(name, ()))
        return self

    @property
    def schema(self) -> Schema:
        if not self.tables:
            raise name_error("no tables are registered")
        return Schema(tuple(self.tables.values()), self.constraints)

    def bind(self, text: str) -> Bound:
        return Binder(self.schema, self.policies).bind(parse(text))

    def sql(self, text: str) -> DataFrame:
        """The result of a query, lazily."""
        try:
            bound = self.bind(text)
            lowerer = Lowerer(self.spark, self.frames, self.exact, positions=self.policies.first_row_grouping)
            return result(lowerer, bound.rel)[0].toDF(*bound.names)
        except RecursionError:
            raise QueryError(Reason.COMPLEXITY_LIMIT, "nested too deeply") from None
