"""Candidate databases side by side, as DataFrames.

A state is one content of one table. States are numbered densely after the constraints of
the table alone; a world is a state for each table, and its number spells them out. So
both are decoded from `range` by arithmetic, and no list of them is ever built.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import literal
from ..plans.errors import too_complex
from ..sources import constraints as K
from ..sources.schema import Check, ForeignKey, Increasing, Schema, Table, Unique, invalid, spark_type
from .domains import Classes, domain

WORLD = "__w"


@dataclass
class Worlds:
    frame: DataFrame  # the column __w
    tables: dict[str, DataFrame]  # __w, position, and the table's columns
    count: int
    every: int  # how many there are; more than count if these are a sample

    @property
    def partial(self) -> bool:
        return self.every > self.count_before_checks

    count_before_checks: int = 0


def _numbers(spark: SparkSession, n: int) -> DataFrame:
    """0 .. n - 1, in partitions of some thousands."""
    return spark.range(0, n, 1, max(1, min(spark.sparkContext.defaultParallelism, n // 5000)))


def _states(spark: SparkSession, schema: Schema, table: Table, domains: dict[str, list], bound: int, symmetric: bool, most: int) -> tuple[DataFrame, int]:
    """__s, position and columns of all rows of all states; and the number of states."""
    sizes = [len(domains[c.key()]) for c in table.columns]
    rows = math.prod(sizes)
    total = sum(rows**k for k in range(bound + 1))
    if total > 40 * most:
        raise too_complex(f"{total} contents of {table.name}")
    starts = [sum(rows**j for j in range(k)) for k in range(bound + 2)]
    state = F.col("__s")
    taken = reduce(lambda a, k: F.when(state >= starts[k], F.lit(k)).otherwise(a), range(1, bound + 1), F.lit(0))
    every = _numbers(spark, total).select(F.col("id").alias("__s")).withColumn("__n", taken)
    first = reduce(lambda a, k: F.when(F.col("__n") == k, F.lit(starts[k])).otherwise(a), range(1, bound + 1), F.lit(0))
    every = every.withColumn("__r", state - first)
    # position p of a state of n rows is the digit p of its number, the first the most significant
    digit = lambda p: F.floor(F.col("__r") / reduce(lambda a, k: F.when(F.col("__n") == k, F.lit(float(rows ** (k - 1 - p) if k > p else 1))).otherwise(a), range(1, bound + 1), F.lit(1.0))).cast("bigint") % rows
    every = every.withColumn("__d", F.array(*[digit(p) for p in range(bound)]))
    keyed = bool(schema.primary_keys(table))
    if symmetric and bound > 1:
        order = [F.when(F.col("__n") > p + 1, (F.col("__d")[p] < F.col("__d")[p + 1]) if keyed else (F.col("__d")[p] <= F.col("__d")[p + 1])).otherwise(True) for p in range(bound - 1)]
        every = every.filter(reduce(lambda a, b: a & b, order))
    exploded = every.select("__s", F.posexplode(F.slice("__d", 1, F.col("__n"))).alias("__position", "__row"))
    columns, step = [], 1
    for c, n in zip(table.columns, sizes, strict=True):
        kind = spark_type(c.type, True)
        at = (F.floor(F.col("__row") / step) % n).cast("int")
        values = F.array(*[literal(v).cast(kind) for v in domains[c.key()]])
        columns.append(F.get(values, at).alias(c.key()))
        step *= n
    data = exploded.select("__s", F.col("__position").cast("bigint").alias("__position"), *columns)
    local = Schema((table,), tuple(c for c in schema.constraints if _only(c, schema) == {table.key()}))
    bad = [df.select("__s") for _, df in K.violations({table.key(): data}, local, ["__s"], exact=True)]
    kept = every.select("__s", "__n")
    if bad:
        kept = kept.join(reduce(DataFrame.unionAll, bad).distinct(), "__s", "left_anti")
    numbered = kept.withColumn("__state", F.row_number().over(W.orderBy("__n", "__s")).cast("bigint") - 1).drop("__n")
    numbered = numbered.cache()
    return data.join(numbered, "__s").drop("__s").cache(), numbered.count()


def _only(constraint, schema: Schema) -> set[str]:
    """The tables that a constraint concerns."""
    if isinstance(constraint, Check):
        return set(K.check_predicate(schema, constraint)[1])
    if isinstance(constraint, ForeignKey):
        return {constraint.table.lower(), constraint.other.lower()} if constraint.table.lower() != constraint.other.lower() else {constraint.table.lower()}
    return {constraint.table.lower()}


def estimate(schema: Schema, classes: Classes, used: set[str], bound: int) -> float:
    """An upper bound on the number of databases, before constraints."""
    total = 1.0
    for t in schema.tables:
        if t.key() in used:
            rows = math.prod(len(domain(classes, t.key(), c.key(), bound, schema.nullable(t, c))) for c in t.columns)
            total *= sum(float(rows) ** k for k in range(bound + 1))
    return total


def build(spark: SparkSession, schema: Schema, classes: Classes, used: set[str], bound: int, symmetric: bool, most: int) -> Worlds:
    """All databases with at most `bound` rows in each table that the queries or constraints use; or,
    if there are more than `most`, so many of them, spread evenly over their numbers."""
    for c in schema.constraints:
        if isinstance(c, Check) and not _only(c, schema):
            from ..functions.columns import Columns

            holds = spark.range(1).select(Columns(True, F.col)(K.check_predicate(schema, c)[0]).alias("x")).first().x
            if holds is False:
                raise invalid("a CHECK that never holds")
    concerned = set(used)
    while True:
        more = set().union(*[_only(c, schema) for c in schema.constraints if _only(c, schema) & concerned], set())
        if more <= concerned:
            break
        concerned |= more
    symmetric = symmetric and not any(isinstance(c, Increasing) for c in schema.constraints)
    tables = [t for t in schema.tables if t.key() in concerned]
    states, sizes = [], []
    for t in tables:
        domains = {c.key(): domain(classes, t.key(), c.key(), bound, schema.nullable(t, c)) for c in t.columns}
        rows, n = _states(spark, schema, t, domains, bound, symmetric, most)
        states.append(rows)
        sizes.append(n)
    total = math.prod(sizes)
    if total >= 2**40:
        raise too_complex(f"{total} candidate databases")
    held = min(max(total, 1), most)
    step = int(total * 0.618) | 1
    while math.gcd(step, max(total, 1)) != 1:
        step += 2
    number = F.col("id") if total <= most else F.pmod(F.col("id") * F.lit(step), F.lit(total))
    every = _numbers(spark, held).select(number.cast("bigint").alias(WORLD))
    frames, step = {}, 1
    for t, rows, n in zip(tables, states, sizes, strict=True):
        state = (F.floor(F.col(WORLD) / step) % n).cast("bigint")
        frames[t.key()] = every.withColumn("__state", state).join(rows, "__state").drop("__state")
        step *= n
    shared = Schema(schema.tables, tuple(c for c in schema.constraints if len(_only(c, schema)) > 1 and _only(c, schema) <= concerned))
    bad = []
    for c in shared.constraints:
        if isinstance(c, ForeignKey):
            bad.append(K.dangling(frames[c.table.lower()], c.columns, frames[c.other.lower()], c.other_columns, [WORLD]).select(WORLD))
        elif isinstance(c, Check):
            bad.append(K.check_violations(frames, schema, c, [WORLD], exact=True).select(WORLD))
        else:
            assert not isinstance(c, Unique)
    if bad:
        every = every.join(reduce(DataFrame.unionAll, bad).distinct(), WORLD, "left_anti").cache()
        frames = {k: f.join(every, WORLD, "left_semi") for k, f in frames.items()}
    for t in schema.tables:  # tables that nothing concerns stay empty
        if t.key() not in frames:
            frames[t.key()] = every.select(F.col(WORLD), F.lit(0).cast("bigint").alias("__position"), *[F.lit(None).cast(spark_type(c.type, True)).alias(c.key()) for c in t.columns]).limit(0)
    return Worlds(every, frames, every.count() if bad else held if tables else total, total, held)
