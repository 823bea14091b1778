"""Bounded equivalence of two queries: search for a database that tells them apart."""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.typing import Policies
from ..operators.compare import bag_difference, list_difference
from ..operators.lower import Layer, Lowerer
from ..plans import logical as L
from ..plans.binder import Binder, Bound
from ..plans.errors import QueryError, Reason
from ..plans.syntax import parse
from ..sources.constraints import check_predicate
from ..sources.schema import Check, Schema
from . import exact
from . import worlds as Wd
from .domains import Classes, domain
from .outcome import Counterexample, Different, Equivalent, Metrics, Options, Result, Unsupported, Verdict


class Verifier:
    def __init__(self, spark: SparkSession, options: Options | None = None):
        self.spark, self.options = spark, options or Options()
        with contextlib.suppress(Exception):
            spark.conf.set("spark.sql.timeType.enabled", "true")

    def verify(self, schema: Schema, left: str, right: str) -> Verdict:
        return self.verify_with_metrics(schema, left, right)[0]

    def verify_with_metrics(self, schema: Schema, left: str, right: str) -> tuple[Verdict, Metrics]:
        metrics = Metrics()
        return Session(self.spark, schema, self.options).verify(left, right, metrics), metrics

    def verify_many(self, cases: list[tuple[Schema, str, str]], threads: int = 8) -> list[Verdict]:
        """Verdicts in the order of the cases, some at a time: small searches leave most of a cluster
        idle, so that others can run beside them."""
        with ThreadPoolExecutor(threads) as pool:
            return list(pool.map(lambda c: Session(self.spark, c[0], self.options).verify(c[1], c[2]), cases))

    def session(self, schema: Schema) -> Session:
        """For many pairs over one schema: candidate databases are kept while their domains serve."""
        return Session(self.spark, schema, self.options)

    def verify_bounds(self, schema: Schema, left: str, right: str, bounds: list[int], largest_first: bool = True) -> dict[int, Verdict]:
        """A verdict for each bound. Equivalence at a bound holds below it; a counterexample serves
        every bound that its largest table fits; what is unsupported says nothing of others."""
        if not bounds or min(bounds) <= 0:
            raise QueryError(Reason.INVALID_SCHEMA, "bounds are positive")
        todo = sorted(set(bounds), reverse=largest_first)
        out: dict[int, Verdict] = {}
        for bound in todo:
            if bound in out:
                continue
            verdict = Verifier(self.spark, replace(self.options, rows=bound)).verify(schema, left, right)
            out[bound] = verdict
            if isinstance(verdict, Equivalent):
                out |= {b: Equivalent(b, verdict.why) for b in todo if b < bound and b not in out}
            elif isinstance(verdict, Different):
                out |= {b: verdict for b in todo if b >= verdict.counterexample.size and b not in out}
        return dict(sorted(out.items()))


#: Estimated databases up to which a search is too small to be worth several partitions, adaptive
#: planning or compiled code.
SMALL = 20_000
_SMALL_CONF = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.enabled": "false", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.timeType.enabled": "true"}


def _light(spark: SparkSession) -> SparkSession:
    """A session over the same cluster whose own settings suit small data."""
    out = spark.newSession()
    for key, value in _SMALL_CONF.items():
        with contextlib.suppress(Exception):  # a setting that this Spark does not have
            out.conf.set(key, value)
    out.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return out


class Session:
    def __init__(self, spark: SparkSession, schema: Schema, options: Options):
        self.large, self.schema, self.options = spark, schema, options
        self.spark = self.light = _light(spark)
        self.kept: dict[tuple, tuple[Wd.Worlds, SparkSession]] = {}
        self.late = False

    def verify(self, left: str, right: str, metrics: Metrics | None = None) -> Verdict:
        metrics = metrics or Metrics()
        try:
            self.options.validate()
            self.schema.validate()
            return self._limited(lambda: self._verify(left, right, metrics))
        except QueryError as e:
            return Unsupported(e.reason, e.message)
        except RecursionError:
            return Unsupported(Reason.COMPLEXITY_LIMIT, "nested too deeply")
        except Exception as e:  # a verdict is due whatever fails below
            return Unsupported(Reason.INTERNAL, f"{type(e).__name__}: {str(e)[:200]}")

    def _timed(self, metrics: Metrics, name: str, work):
        began = time.perf_counter()
        out = work()
        metrics.seconds[name] = metrics.seconds.get(name, 0) + time.perf_counter() - began
        if self.late:
            raise QueryError(Reason.SOLVER, "the time is over")
        return out

    def _limited(self, work):
        """The work's result, or a refusal if its jobs take too long together."""
        sc, self.late = self.large.sparkContext, False
        group = f"verify-{uuid.uuid4()}"

        def stop():
            self.late = True
            sc.cancelJobGroup(group)

        timer = threading.Timer(self.options.timeout_seconds, stop)
        sc.setJobGroup(group, "bounded equivalence")
        timer.start()
        try:
            return work()
        except QueryError:
            raise
        except Exception:
            if self.late:
                raise QueryError(Reason.SOLVER, "the time is over") from None
            raise
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def _bind(self, text: str, bound: float, prefix: str) -> Bound:
        """Bound with ids that start with `prefix`, so that two queries share none."""
        return Binder(self.schema, self.options.policies, bound, self.options.intermediate_rows, prefix).bind(parse(text))

    def _verify(self, left: str, right: str, metrics: Metrics) -> Verdict:
        o = self.options
        a, b = (self._timed(metrics, "bind", lambda t=t, p=p: self._bind(t, o.rows, p)) for t, p in ((left, "l"), (right, "r")))
        for q in (a, b):
            metrics.add("relations", sum(1 for _ in _nodes(q.rel)))
            metrics.add("subqueries", sum(1 for n in _nodes(q.rel) for x in n.exprs() for _ in L.subqueries(x)))
            if _work(q.rel) > WORK * o.intermediate_rows:
                raise QueryError(Reason.COMPLEXITY_LIMIT, "the query's nested work is too large")
        if a.types != b.types:
            metrics.add("empty_witness")
            return Different(self._replayed({t.key(): () for t in self.schema.tables}, a, b, metrics)[1])
        if a.ordered != b.ordered:
            return Unsupported(Reason.UNSUPPORTED_SQL, "one result is a list and the other a bag")
        predicates = [check_predicate(self.schema, c)[0] for c in self.schema.constraints if isinstance(c, Check)]
        if self._timed(metrics, "plans", lambda: L.canonical(a.rel) == L.canonical(b.rel)):
            self._consistent(predicates)
            metrics.add("same_plan")
            return Equivalent(o.rows, "equal plans")
        classes = Classes(self.schema).build([a.rel, b.rel], predicates)
        symmetric = not (a.ordered or _positional(a.rel) or _positional(b.rel))
        used = _tables(a.rel) | _tables(b.rel)
        worlds = self._timed(metrics, "worlds", lambda: self._worlds(classes, used, symmetric, o.rows))
        searched = [worlds]
        if worlds.partial:  # fewer rows first, which may be searched as a whole
            searched = [self._timed(metrics, "worlds", lambda n=n: self._worlds(classes, used, symmetric, n)) for n in range(1, o.rows)] + searched
        doubtful = False
        for worlds in searched:
            metrics.add("worlds", worlds.count)
            if not worlds.count and not worlds.partial:
                return Unsupported(Reason.INVALID_SCHEMA, "no database satisfies the constraints")
            for found in self._timed(metrics, "search", lambda w=worlds: self._search(w, a, b)):
                example = self._timed(metrics, "replay", lambda w=worlds, k=found: self._example(w, k, a, b, metrics))
                if example is not None:
                    return Different(example)
                doubtful = True
        if worlds.partial:
            return Unsupported(Reason.COMPLEXITY_LIMIT, f"not refuted over {metrics.counts['worlds']} of {worlds.every} candidate databases")
        if doubtful:
            return Unsupported(Reason.SOLVER, "differences that exact evaluation does not confirm")
        if classes.complete:
            return Equivalent(o.rows, f"no difference over {worlds.count} databases")
        return Unsupported(Reason.SOLVER, f"not refuted over {worlds.count} databases, which are not all that matter ({classes.reason})")

    def _example(self, worlds: Wd.Worlds, world: int, a: Bound, b: Bound, metrics: Metrics) -> Counterexample | None:
        """The world as a counterexample; None if its exact results are equal, or if a value in it is
        beyond its type."""
        try:
            differs, example = self._replayed(self._extract(worlds, world), a, b, metrics)
        except exact.OutOfRange:
            return None
        return example if differs else None

    def _consistent(self, predicates) -> None:
        Wd.build(self.spark, Schema(self.schema.tables, tuple(c for c in self.schema.constraints if isinstance(c, Check) and not check_predicate(self.schema, c)[1])), Classes(self.schema).build([], []), set(), 1, True, 10)

    def _worlds(self, classes: Classes, used: set[str], symmetric: bool, rows: int) -> Wd.Worlds:
        key = (rows, symmetric, frozenset(used), tuple((t.key(), c.key(), repr(domain(classes, t.key(), c.key(), rows, self.schema.nullable(t, c)))) for t in self.schema.tables for c in t.columns))
        if key not in self.kept:
            spark = self.light if Wd.estimate(self.schema, classes, used, rows) <= SMALL else self.large
            self.kept[key] = (Wd.build(spark, self.schema, classes, used, rows, symmetric, self.options.worlds), spark)
        return self.kept[key][0]

    def _search(self, worlds: Wd.Worlds, a: Bound, b: Bound) -> list[int]:
        """The least numbers of databases on which the results differ, up to `WITNESSES`; they are to be
        confirmed, since this evaluation rounds."""
        sides = []
        for q in (a, b):
            root = Layer(worlds.frame, [Wd.WORLD])
            lowerer = Lowerer(worlds.frame.sparkSession, worlds.tables, True, root, True)
            low = lowerer.relation(q.rel)
            cols = [c for c in q.rel.cols if c.visible]
            sides.append((low, low.df.select(Wd.WORLD, *[F.col(c.id).alias(f"_{k}") for k, c in enumerate(cols)]), cols))
        if not a.ordered:
            differs = bag_difference(sides[0][1], sides[1][1])
        else:
            frames = []
            for low, _, cols in sides:
                order = [F.col(f"__o{k}") for k in range(len(low.order))]
                keyed = low.df.select(Wd.WORLD, *[F.col(c.id).alias(f"_{k}") for k, c in enumerate(cols)], *[F.col(n).alias(f"__o{k}") for k, (n, _, _) in enumerate(low.order)])
                keys = [(c.asc_nulls_first() if first else c.asc_nulls_last()) if up else (c.desc_nulls_first() if first else c.desc_nulls_last()) for c, (_, up, first) in zip(order, low.order, strict=True)]
                frames.append((keyed, keys))
            values = [f"_{k}" for k in range(len(sides[0][2]))]
            differs = list_difference(frames[0][0], frames[1][0], frames[0][1], frames[1][1], [Wd.WORLD], values)
        return sorted(r[0] for r in differs.select(Wd.WORLD).distinct().orderBy(Wd.WORLD).limit(WITNESSES).collect())

    def _extract(self, worlds: Wd.Worlds, world: int) -> dict[str, tuple]:
        out = {}
        for t in self.schema.tables:
            rows = worlds.tables[t.key()].filter(F.col(Wd.WORLD) == world).orderBy("__position").select(*[c.key() for c in t.columns]).collect()
            out[t.key()] = tuple(map(tuple, rows))
        return out

    def _replayed(self, tables: dict, a: Bound, b: Bound, metrics: Metrics) -> tuple[bool, Counterexample]:
        """Both queries on one database, evaluated plainly and exactly."""
        rows = {t.key(): [dict(zip([c.key() for c in t.columns], r, strict=True)) for r in tables[t.key()]] for t in self.schema.tables}
        found = [exact.Evaluator(rows).result(q.rel) for q in (a, b)]
        metrics.add("replays")
        x, y = found if a.ordered else (sorted(f, key=repr) for f in found)
        results = [Result(tuple(q.names), tuple(q.types), tuple(tuple(map(exact.outward, r)) for r in f)) for q, f in zip((a, b), found, strict=True)]
        return x != y or a.types != b.types, Counterexample(tables, *results)


def _positional(rel: L.Rel) -> bool:
    """Whether the order of rows in the tables may matter to the result."""
    if isinstance(rel, L.Slice) or isinstance(rel, L.Aggregate) and rel.firsts:
        return True
    if isinstance(rel, L.Window) and any(w.name in ("row_number", "first_value") for _, w in rel.calls):
        return True
    return any(map(_positional, rel.inputs())) or any(_positional(s.info) for x in rel.exprs() for s in L.subqueries(x))


#: Databases that one search hands to exact evaluation.
WITNESSES = 256
#: Rows of work that a query may need, for each intermediate row that it may have.
WORK = 64


def _nodes(rel: L.Rel):
    """The relation and all below it, subqueries included."""
    yield rel
    for i in rel.inputs():
        yield from _nodes(i)
    for x in rel.exprs():
        for s in L.subqueries(x):
            yield from _nodes(s.info)


def _work(rel: L.Rel) -> float:
    """Rows that evaluation makes, with subqueries once for each row that they stand at."""
    rows = max([1, *(i.max_rows for i in rel.inputs())])
    if isinstance(rel, L.Join):
        rows = max(1, rel.left.max_rows * rel.right.max_rows)
    inner = sum(_work(s.info) for x in rel.exprs() for s in L.subqueries(x))
    return rel.max_rows + rows * inner + sum(map(_work, rel.inputs()))


def _tables(rel: L.Rel) -> set[str]:
    out = {rel.table} if isinstance(rel, L.Scan) else set()
    for i in rel.inputs():
        out |= _tables(i)
    for x in rel.exprs():
        for s in L.subqueries(x):
            out |= _tables(s.info)
    return out


__all__ = ["Options", "Policies", "Session", "Verifier"]
