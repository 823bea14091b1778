"""Logical relations as DataFrames.

A relation may be lowered within a context: key columns that number the cases in which it
is evaluated side by side. Candidate databases are one such context; the distinct outer
values of a correlated subquery are another, so that subqueries at any depth become joins
on those keys. Joins then match on the keys, groups, partitions and set operations include
them, and what must yield a row on empty input starts from the list of cases. Without
context the plans are the plain ones, and Catalyst does the rest.

The order of rows is a list of sort columns that travels with a relation; it is only
applied where it matters: at a slice, at the result, and to break ties of row numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import Columns
from ..plans import logical as L
from ..plans.logical import X
from ..plans.weights import weighed


@dataclass
class Layer:
    """The cases of a context: a frame of their keys, and where outer values are found."""

    frame: DataFrame | None
    keys: list[str]
    outer: dict[str, str] = field(default_factory=dict)


@dataclass
class Lowered:
    """A frame whose columns are ids, keys of the cases it distinguishes, and hidden sort columns."""

    df: DataFrame
    keys: list[str]
    order: list[tuple[str, bool, bool]] = field(default_factory=list)
    attached: bool = False

    def sorted(self) -> list[Column]:
        return [_key(c, up, first) for c, up, first in self.order]


def _key(name, ascending: bool, nulls_first: bool) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    if ascending:
        return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()
    return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()


class Lowerer:
    """tables: a frame for each table, with a column for each of its names, the keys of `root`
    and, where row order counts, the column `__position`."""

    def __init__(self, spark: SparkSession, tables, exact: bool = False, root: Layer | None = None, positions: bool = False):
        self.spark, self.tables, self.exact = spark, tables, exact
        self.root, self.positions, self.n = root or Layer(None, []), positions, 0

    def new(self, prefix: str) -> str:
        self.n += 1
        return f"{prefix}{self.n}"

    def columns(self, layer: Layer, own: set[str]) -> Columns:
        def lookup(i: str) -> Column:
            return F.col(i) if i in own or i not in layer.outer else F.col(layer.outer[i])

        return Columns(self.exact, lookup)

    # -- relations
    def relation(self, rel: L.Rel, layer: Layer | None = None) -> Lowered:
        layer = layer or self.root
        if layer is not self.root and not (L.free(rel) & set(layer.outer)):
            return self.relation(rel, self.root)
        return getattr(self, f"_{type(rel).__name__.lower()}")(rel, layer)

    def attach(self, low: Lowered, layer: Layer) -> Lowered:
        """The relation in each case of the layer."""
        if low.attached or layer is self.root:
            return low
        return replace(low, df=_on_keys(layer.frame, low.df, low.keys), keys=layer.keys, attached=True)

    def needed(self, low: Lowered, exprs: list[X], layer: Layer) -> Lowered:
        if layer is not self.root and any(L.refs(x) & set(layer.outer) - set(low.df.columns) for x in exprs):
            return self.attach(low, layer)
        return low

    def _unit(self, rel, layer) -> Lowered:
        df = self.root.frame.select(*self.root.keys) if self.root.frame is not None else self.spark.range(1).select(F.lit(True).alias(self.new("u")))
        return Lowered(df, list(self.root.keys))

    def _scan(self, rel: L.Scan, layer) -> Lowered:
        df, position = self.tables[rel.table], self.new("p")
        kept = [F.col(s).alias(c.id) for c, s in zip(rel.cols, rel.sources, strict=True)]
        if not self.positions:
            return Lowered(df.select(*self.root.keys, *kept), list(self.root.keys))
        return Lowered(df.select(*self.root.keys, *kept, F.col("__position").alias(position)), list(self.root.keys), [(position, True, False)])

    def _filter(self, rel: L.Filter, layer) -> Lowered:
        low = self.relation(rel.input, layer)
        rest = []
        for c in L.conjuncts(rel.predicate):
            done = self._semi(low, c, layer)
            if done is None:
                rest.append(c)
            else:
                low = done
        if rest:
            low, exprs = self.prepared(low, rest, layer)
            build, before = self.columns(layer, set(low.df.columns)), low.df
            low = replace(low, df=before.filter(reduce(lambda a, b: a & b, [build(x) for x in exprs])))
        return low

    def _project(self, rel: L.Project, layer) -> Lowered:
        low = self.relation(rel.input, layer)
        low, exprs = self.prepared(low, [x for _, x in rel.items], layer)
        build = self.columns(layer, set(low.df.columns))
        ids = {i for i, _ in rel.items}
        # a sort column may be a column that this projection leaves out, or makes anew
        hidden, order = [], []
        for name, up, first in low.order:
            if name in ids and any(i == name and x == X("col", x.type, (), i) for i, x in rel.items):
                order.append((name, up, first))
            else:
                fresh = self.new("o")
                hidden.append(F.col(name).alias(fresh))
                order.append((fresh, up, first))
        out = [build(x).alias(i) for (i, _), x in zip(rel.items, exprs, strict=True)]
        return replace(low, df=low.df.select(*low.keys, *out, *hidden), order=order)

    def _join(self, rel: L.Join, layer) -> Lowered:
        left, right = self.relation(rel.left, layer), self.relation(rel.right, layer)
        exprs = [rel.predicate] if rel.predicate is not None else []
        outer = layer is not self.root and bool(set().union(*map(L.refs, exprs), set()) & set(layer.outer))
        if rel.kind == "full" and (left.attached or right.attached or outer) or outer and rel.kind != "inner":
            left, right = self.attach(left, layer), self.attach(right, layer)
        elif rel.kind == "left" and right.attached:
            left = self.attach(left, layer)
        elif rel.kind == "right" and left.attached:
            right = self.attach(right, layer)
        elif outer and not (left.attached or right.attached):
            left = self.attach(left, layer)
        attached = left.attached or right.attached
        shared = layer.keys if left.attached and right.attached else self.root.keys
        if rel.kind == "right" and right.attached and not left.attached:
            shared = self.root.keys
        rename = {k: self.new("k") for k in shared}
        rdf = right.df.withColumnsRenamed(rename) if rename else right.df
        tests = [F.col(k).eqNullSafe(F.col(v)) for k, v in rename.items()]
        df = None
        if any(True for x in exprs for _ in L.subqueries(x)):
            if rel.kind != "inner":
                from ..plans.errors import unsupported

                raise unsupported("a subquery in the ON of an outer join")
            df = left.df.join(rdf, reduce(lambda a, b: a & b, tests)) if tests else left.df.crossJoin(rdf)
            low = Lowered(df.drop(*rename.values()), layer.keys if attached else list(self.root.keys), left.order + right.order, attached)
            low, found = self.prepared(low, exprs, layer)
            return replace(low, df=low.df.filter(self.columns(layer, set(low.df.columns))(found[0])))
        own = set(left.df.columns) | set(rdf.columns)
        tests += [self.columns(layer, own)(x) for x in exprs if x != X("lit", "bool", (), True)]
        if not tests and rel.kind == "inner":
            df = left.df.crossJoin(rdf)
        else:
            df = left.df.join(rdf, reduce(lambda a, b: a & b, tests) if tests else F.lit(True), rel.kind)
        if rename and rel.kind in ("right", "full"):
            keys = left.keys if left.attached else right.keys if right.attached else left.keys
            df = df.withColumns({k: F.coalesce(F.col(k), F.col(v)) for k, v in rename.items()})
            left = replace(left, keys=keys)
        df = df.drop(*rename.values())
        return Lowered(df, layer.keys if attached else list(self.root.keys), left.order + right.order, attached)

    def _aggregate(self, rel: L.Aggregate, layer) -> Lowered:
        weight = None
        if layer is self.root and layer.frame is None and not self.positions and (found := weighed(rel, self.new, self.exact)) is not None:
            rel, weight = found[0], reduce(lambda a, b: a * b, map(F.col, found[1]))
        low = self.relation(rel.input, layer)
        exprs = [x for _, x in rel.keys] + [a for _, g in rel.aggs for a in g.args]
        low, found = self.prepared(low, exprs, layer)
        build = self.columns(layer, set(low.df.columns))
        keys, at = [], 0
        for i, _ in rel.keys:
            keys.append(build(found[at]).alias(i))
            at += 1
        aggs = []
        for i, g in rel.aggs:
            args = tuple(found[at : at + len(g.args)])
            at += len(g.args)
            if weight is not None and g.name == "count" and not g.distinct:
                rows = F.when(build(args[0]).isNotNull(), weight) if args else weight
                aggs.append(F.coalesce(F.sum(rows), F.lit(0)).alias(i))
            else:
                aggs.append(build.aggregate(g.name, g.distinct, g.type, args).alias(i))
        position, order = None, []
        if rel.firsts or low.order and self.positions:
            low, position = self._numbered(low)
        if position is not None:
            aggs += [F.min_by(F.col(s), F.col(position)).alias(i) for i, s in rel.firsts]
            first = self.new("o")
            aggs.append(F.min(position).alias(first))
            order = [(first, True, False)]
        elif rel.firsts:
            aggs += [F.first(F.col(s)).alias(i) for i, s in rel.firsts]
        if not rel.grouped and not low.keys:
            return Lowered(low.df.agg(*(aggs or [F.count(F.lit(1)).alias(self.new("u"))])), [], order, low.attached)
        pre = low.df.withColumns({f"__g{k}": c for k, c in enumerate(keys)}) if keys else low.df
        grouped = pre.groupBy(*[F.col(k) for k in low.keys], *[F.col(f"__g{k}").alias(i) for k, (i, _) in enumerate(rel.keys)])
        df = grouped.agg(*aggs) if aggs else pre.select(*low.keys, *[F.col(f"__g{k}").alias(i) for k, (i, _) in enumerate(rel.keys)]).distinct()
        if not rel.grouped:
            cases = (layer if low.attached else self.root).frame.select(*low.keys).distinct()
            df = _on_keys(cases, df, low.keys, "left")
            df = df.withColumns({i: F.coalesce(F.col(i), F.lit(0)) for i, g in rel.aggs if g.name == "count"})
        return Lowered(df, low.keys, order, low.attached)

    def _numbered(self, low: Lowered) -> tuple[Lowered, str | None]:
        """The rows with one column of their order."""
        if not low.order:
            return low, None
        if len(low.order) == 1 and low.order[0][1]:
            return low, low.order[0][0]
        name = self.new("o")
        return replace(low, df=low.df.withColumn(name, F.row_number().over(W.partitionBy(*low.keys).orderBy(*low.sorted()))), order=[(name, True, False)]), name

    def _window(self, rel: L.Window, layer) -> Lowered:
        low = self.relation(rel.input, layer)
        low, found = self.prepared(low, rel.exprs(), layer)
        build = self.columns(layer, set(low.df.columns))
        at, made = 0, {}
        for i, w in rel.calls:
            n = len(w.args) + len(w.partition) + len(w.order)
            own = found[at : at + n]
            at += n
            args, part, keys = own[: len(w.args)], own[len(w.args) : len(w.args) + len(w.partition)], own[len(w.args) + len(w.partition) :]
            by = [_key(build(x), o.ascending, o.nulls_first) for x, o in zip(keys, w.order, strict=True)]
            base = W.partitionBy(*[F.col(k) for k in low.keys], *map(build, part))
            ties = by + low.sorted()
            if w.name == "row_number":
                made[i] = F.row_number().over(base.orderBy(*(ties or [F.lit(1)]))).cast("bigint")
            elif w.name in ("rank", "dense_rank"):
                made[i] = getattr(F, w.name)().over(base.orderBy(*(by or [F.lit(1)]))).cast("bigint")
            elif w.name == "first_value":
                made[i] = F.first(build(args[0])).over(base.orderBy(*ties).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
            else:
                frame = base.orderBy(*by).rangeBetween(W.unboundedPreceding, W.currentRow) if by else base
                made[i] = build.windowed(w.name, w.distinct, w.type, tuple(args), frame)
        return replace(low, df=low.df.withColumns(made))

    def _distinct(self, rel: L.Distinct, layer) -> Lowered:
        low = self.relation(rel.input, layer)
        ids = list(dict.fromkeys(c.id for c in rel.cols))
        if not (low.order and self.positions):
            return replace(low, df=low.df.select(*low.keys, *ids).distinct(), order=[])
        low, position = self._numbered(low)
        df = low.df.groupBy(*low.keys, *ids).agg(F.min(position).alias("__first"))
        name = self.new("o")
        return replace(low, df=df.withColumnRenamed("__first", name), order=[(name, True, False)])

    def _setop(self, rel: L.SetOp, layer) -> Lowered:
        left, right = self.relation(rel.left, layer), self.relation(rel.right, layer)
        if left.attached or right.attached:
            left, right = self.attach(left, layer), self.attach(right, layer)
        keys = left.keys
        ids = [c.id for c in rel.cols]
        order = []
        if self.positions:
            left, a = self._numbered(left)
            right, b = self._numbered(right)
            name = self.new("o")
            order = [(f"{name}s", True, False), (name, True, False)]
        sides = []
        for k, (low, own) in enumerate(zip((left, right), rel.sides, strict=True)):
            extra = []
            if order:
                place = (a, b)[k]
                extra = [F.lit(k).alias(f"{name}s"), (F.col(place) if place else F.lit(0)).cast("bigint").alias(name)]
            sides.append(low.df.select(*keys, *[F.col(x).alias(i) for x, i in zip(own, ids, strict=True)], *extra))
        x, y = sides
        if not order:
            if rel.op == "union":
                df = x.unionAll(y) if rel.every else x.unionAll(y).distinct()
            elif rel.op == "intersect":
                df = x.intersectAll(y) if rel.every else x.intersect(y)
            else:
                df = x.exceptAll(y) if rel.every else x.subtract(y)
            return Lowered(df, keys, [], left.attached)
        both = x.unionAll(y)
        side, place = order[0][0], order[1][0]
        if rel.op == "union":
            if rel.every:
                return Lowered(both, keys, order, left.attached)
            df = both.groupBy(*keys, *ids).agg(F.min(F.struct(side, place)).alias("__m"))
            return Lowered(df.select(*keys, *ids, F.col("__m")[side].alias(side), F.col("__m")[place].alias(place)), keys, order, left.attached)
        # the left's rows, numbered among equals, against the number of equals on the right
        same = W.partitionBy(*keys, *ids)
        counted = both.withColumn("__r", F.sum(F.when(F.col(side) == 1, 1).otherwise(0)).over(same)).withColumn("__k", F.row_number().over(same.orderBy(side, place)))
        mine = counted.filter(F.col(side) == 0)
        if rel.op == "intersect":
            df = mine.filter(F.col("__k") <= F.col("__r")) if rel.every else mine.filter((F.col("__k") == 1) & (F.col("__r") > 0))
        else:
            # of equals the last remain
            total = counted.withColumn("__l", F.sum(F.when(F.col(side) == 0, 1).otherwise(0)).over(same)).filter(F.col(side) == 0)
            df = total.filter(F.col("__k") > F.col("__r")) if rel.every else mine.filter((F.col("__k") == 1) & (F.col("__r") == 0))
        return Lowered(df.select(*keys, *ids, side, place), keys, order, left.attached)

    def _sort(self, rel: L.Sort, layer) -> Lowered:
        low = self.relation(rel.input, layer)
        low = self.needed(low, rel.exprs(), layer)
        build = self.columns(layer, set(low.df.columns))
        names = [self.new("o") for _ in rel.order]
        df = low.df.withColumns({n: build(o.expr) for n, o in zip(names, rel.order, strict=True)})
        return replace(low, df=df, order=[(n, o.ascending, o.nulls_first) for n, o in zip(names, rel.order, strict=True)] + low.order)

    def _slice(self, rel: L.Slice, layer) -> Lowered:
        low = self.relation(rel.input, layer)
        if not low.keys:
            df = low.df.orderBy(*low.sorted()) if low.order else low.df
            if rel.offset:
                df = df.offset(rel.offset)
            return replace(low, df=df.limit(rel.limit) if rel.limit is not None else df)
        n = self.new("o")
        df = low.df.withColumn(n, F.row_number().over(W.partitionBy(*low.keys).orderBy(*(low.sorted() or [F.lit(1)]))))
        keep = F.col(n) > rel.offset
        if rel.limit is not None:
            keep &= F.col(n) <= rel.offset + rel.limit
        return replace(low, df=df.filter(keep), order=[(n, True, False)])

    # -- subqueries
    def prepared(self, low: Lowered, exprs: list[X], layer: Layer) -> tuple[Lowered, list[X]]:
        """Subqueries within the expressions become columns."""
        low = self.needed(low, exprs, layer)

        def walk(x: X) -> X:
            nonlocal low
            args = tuple(map(walk, x.args))
            if x.op in L.SUBQUERIES:
                low, name = self._value(low, replace(x, args=args), layer)
                return X("col", x.type, (), name)
            return replace(x, args=args)

        found = [walk(x) for x in exprs]
        return low, found

    def _inner(self, low: Lowered, x: X, layer: Layer):
        """The subquery's relation; and, if it is correlated, the layer of its outer values."""
        own = set(low.df.columns)
        used = sorted(L.free(x.info))
        if not used:
            return self.relation(x.info, self.root), None, {}
        values = {i: i if i in own else layer.outer[i] for i in used}
        names = {i: self.new("d") for i in used}
        keys = list(low.keys)
        frame = low.df.select(*keys, *[F.col(values[i]).alias(names[i]) for i in used]).distinct()
        inner = Layer(frame, keys + list(names.values()), names)
        return self.relation(x.info, inner), inner, {names[i]: values[i] for i in used}

    def _match(self, sub: Lowered, values: dict[str, str]) -> dict[str, str]:
        """Column of the subquery's frame -> column of the outer frame, for its keys."""
        return {k: values.get(k, k) for k in sub.keys}

    def _equated(self, where: L.Filter) -> tuple[Lowered, list[tuple[X, X]]] | None:
        """A filter that is correlated by equalities only: the relation without them, and the inner
        and outer side of each. None where that is not its form."""
        if not isinstance(where, L.Filter) or L.free(where.input):
            return None
        own, inside, pairs = L.made(where.input), [], []
        for c in L.conjuncts(where.predicate):
            if any(True for _ in L.subqueries(c)):
                return None
            if L.refs(c) <= own:
                inside.append(c)
                continue
            sides = c.args if c.op == "eq" else ()
            inner = [a for a in sides if L.refs(a) and L.refs(a) <= own]
            outer = [a for a in sides if not L.refs(a) & own]
            if len(inner) != 1 or len(outer) != 1:
                return None
            pairs.append((inner[0], outer[0]))
        if not pairs:
            return None
        core: L.Rel = where.input
        if inside:
            core = L.Filter(core.cols, set(), core.max_rows, core, inside[0] if len(inside) == 1 else X("and", "bool", tuple(inside)))
        return self.relation(core, self.root), pairs

    def _matched(self, low: Lowered, found: DataFrame, sub: Lowered, names: list[str], pairs, layer: Layer) -> DataFrame:
        """The outer rows with the columns of `found` where its keys and `names` fit."""
        rename = {k: self.new("k") for k in sub.keys}
        found = found.withColumnsRenamed(rename) if rename else found
        outside = self.columns(layer, set(low.df.columns))
        tests = [F.col(k).eqNullSafe(F.col(v)) for k, v in rename.items()] + [outside(o) == F.col(n) for n, (_, o) in zip(names, pairs, strict=True)]
        return low.df.join(found, reduce(lambda a, b: a & b, tests), "left")

    def _flagged_exists(self, low: Lowered, x: X, layer: Layer) -> tuple[Lowered, str] | None:
        """EXISTS as a column, where the inner relation is correlated by equalities only."""
        rel = x.info
        if isinstance(rel, L.Project) and not any(True for e in rel.exprs() for _ in L.subqueries(e)):
            rel = rel.input
        form = self._equated(rel)
        if form is None:
            return None
        sub, pairs = form
        build = self.columns(self.root, set(sub.df.columns))
        names, name = [self.new("g") for _ in pairs], self.new("v")
        found = sub.df.select(*sub.keys, *[build(a).alias(n) for n, (a, _) in zip(names, pairs, strict=True)]).distinct().withColumn(name, F.lit(True))
        joined = self._matched(low, found, sub, names, pairs, layer)
        return replace(low, df=joined.withColumn(name, F.coalesce(F.col(name), F.lit(False))).select(*low.df.columns, name)), name

    def _grouped_scalar(self, low: Lowered, x: X, layer: Layer) -> tuple[Lowered, str] | None:
        """A scalar aggregate that is correlated by equalities in its WHERE only: the inner relation
        grouped by its side of them, joined to the outer. None where that is not its form."""
        top = x.info
        if not (isinstance(top, L.Project) and isinstance(top.input, L.Aggregate) and isinstance(top.input.input, L.Filter)):
            return None
        agg, where = top.input, top.input.input
        if agg.grouped or agg.keys or agg.firsts or any(True for e in (*agg.exprs(), *top.exprs()) for _ in L.subqueries(e)):
            return None
        own, made = L.made(where.input), {i for i, _ in agg.aggs}
        if any(L.refs(e) - own for e in agg.exprs()) or any(L.refs(e) - made for e in top.exprs()):
            return None
        form = self._equated(where)
        if form is None:
            return None
        sub, pairs = form
        build = self.columns(self.root, set(sub.df.columns))
        names = [self.new("g") for _ in pairs]
        keyed = sub.df.withColumns({n: build(a) for n, (a, _) in zip(names, pairs, strict=True)})
        aggs = [build.aggregate(g.name, g.distinct, g.type, g.args).alias(i) for i, g in agg.aggs]
        found = keyed.groupBy(*sub.keys, *names).agg(*(aggs or [F.count(F.lit(1)).alias(self.new("u"))]))
        joined = self._matched(low, found, sub, names, pairs, layer)
        counts = {i: F.coalesce(F.col(i), F.lit(0)) for i, g in agg.aggs if g.name == "count"}
        joined = joined.withColumns(counts) if counts else joined
        name = self.new("v")
        out = next(e for (i, e) in top.items if i == next(c.id for c in top.cols if c.visible))
        value = Columns(self.exact, F.col)(out)
        return replace(low, df=joined.withColumn(name, value).select(*low.df.columns, name)), name

    def _value(self, low: Lowered, x: X, layer: Layer) -> tuple[Lowered, str]:
        direct = {"scalar": self._grouped_scalar, "exists": self._flagged_exists}.get(x.op)
        if direct and (done := direct(low, x, layer)) is not None:
            return done
        sub, _, values = self._inner(low, x, layer)
        name, match = self.new("v"), self._match(sub, values)
        if x.op == "scalar":
            out = next(c.id for c in x.info.cols if c.visible)
            one = sub.df.select(*sub.keys, F.col(out).alias(name))
            return replace(low, df=_back(low.df, one, match)), name
        if x.op == "exists":
            some = sub.df.select(*sub.keys).distinct() if sub.keys else sub.df.limit(1).select()
            joined = _back(low.df, some.withColumn(name, F.lit(True)), match)
            return replace(low, df=joined.withColumn(name, F.coalesce(F.col(name), F.lit(False)))), name
        return self._in(low, x, sub, match, name, layer)

    def _in(self, low, x, sub, match, name, layer) -> tuple[Lowered, str]:
        """IN as a column, in three-valued logic: TRUE on a match; else UNKNOWN if some comparison
        is; else FALSE."""
        build = self.columns(layer, set(low.df.columns))
        ids = [c.id for c in x.info.cols if c.visible]
        operands = [self.new("x") for _ in ids]
        df = low.df.withColumns({o: build(a) for o, a in zip(operands, x.args, strict=True)})
        listed = sub.df.select(*sub.keys, *[F.col(i).alias(f"__y{k}") for k, i in enumerate(ids)]).distinct()
        null = reduce(lambda a, b: a | b, [F.col(f"__y{k}").isNull() for k in range(len(ids))])
        hit, rows, nulls = f"{name}h", f"{name}n", f"{name}u"
        sure = listed.filter(~null).withColumn(hit, F.lit(True))
        df = _back(df, sure, match, [F.col(o) == F.col(f"__y{k}") for k, o in enumerate(operands)]).drop(*[f"__y{k}" for k in range(len(ids))])
        stats = listed.groupBy(*sub.keys).agg(F.count(F.lit(1)).alias(rows), F.count(F.when(null, 1)).alias(nulls))
        df = _back(df, stats, match)
        unknown_operand = reduce(lambda a, b: a | b, [F.col(o).isNull() for o in operands])
        if len(ids) == 1:
            unknown = (F.coalesce(F.col(rows), F.lit(0)) > 0) & unknown_operand | (F.coalesce(F.col(nulls), F.lit(0)) > 0)
        else:
            maybe = f"{name}m"
            tests = [F.col(o).isNull() | F.col(f"__y{k}").isNull() | (F.col(o) == F.col(f"__y{k}")) for k, o in enumerate(operands)]
            # distinct open operands against the list: those that no column tells apart for sure
            outer_keys = list(dict.fromkeys(match.values()))
            probe = df.filter(F.col(hit).isNull() & (unknown_operand | (F.coalesce(F.col(nulls), F.lit(0)) > 0))).select(*outer_keys, *operands).distinct()
            found = _back(probe, listed.withColumn(maybe, F.lit(True)), match, tests, "inner").select(*outer_keys, *operands, maybe).distinct()
            again = {c: f"__z{k}" for k, c in enumerate([*outer_keys, *operands])}
            found = found.withColumnsRenamed(again)
            df = df.join(found, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(z)) for c, z in again.items()]), "left").drop(*again.values())
            unknown = F.col(maybe).isNotNull()
        value = F.when(F.col(hit).isNotNull(), True).when(unknown, F.lit(None).cast("boolean")).otherwise(False)
        df = df.withColumn(name, value)
        return replace(low, df=df.select(*low.df.columns, name)), name

    def _semi(self, low: Lowered, x: X, layer: Layer) -> Lowered | None:
        """A conjunct [NOT] EXISTS or IN as a semi or anti join; None if it is no such."""
        negated = x.op == "not" and x.args[0].op == "exists"
        e = x.args[0] if negated else x
        if e.op not in ("exists", "in") or any(True for a in e.args for _ in L.subqueries(a)):
            return None
        low = self.needed(low, [e], layer)
        direct = self._direct(low, e, layer)
        if direct is not None:
            sub, tests = direct
        else:
            sub, _, values = self._inner(low, e, layer)
            match = self._match(sub, values)
            rename = {k: self.new("k") for k in match}
            sub = replace(sub, df=sub.df.withColumnsRenamed(rename))
            tests = [F.col(o).eqNullSafe(F.col(rename[k])) for k, o in match.items()]
        if e.op == "in":
            build = self.columns(layer, set(low.df.columns))
            ids = [c.id for c in e.info.cols if c.visible]
            listed = {i: self.new("y") for i in ids}
            sub = replace(sub, df=sub.df.withColumns({n: F.col(i) for i, n in listed.items()}))
            tests += [build(a) == F.col(listed[i]) for a, i in zip(e.args, ids, strict=True)]
        inner = sub.df.drop(*[c for c in sub.df.columns if c in low.df.columns])
        test = reduce(lambda a, b: a & b, tests) if tests else F.lit(True)
        return replace(low, df=low.df.join(inner, test, "left_anti" if negated else "left_semi"))

    def _direct(self, low: Lowered, e: X, layer: Layer):
        """A subquery that is correlated only in conjuncts of its WHERE: the rest of it, and those
        conjuncts as a join condition. None where that is not its form."""
        own = set(low.df.columns)
        rel, project = e.info, None
        if isinstance(rel, L.Project) and e.op == "exists":
            if any(True for y in rel.exprs() for _ in L.subqueries(y)):
                return None
            rel = rel.input
        elif isinstance(rel, L.Project):
            project, rel = rel, rel.input
            if L.free(L.Project(project.cols, set(), 1, rel, project.items)) - L.free(rel):
                return None
        if not isinstance(rel, L.Filter) or L.free(rel.input):
            return None
        outside, inside = [], []
        for c in L.conjuncts(rel.predicate):
            if any(True for _ in L.subqueries(c)):
                if L.refs(c) - L.made(rel.input):
                    return None
                inside.append(c)
            else:
                (outside if L.refs(c) - L.made(rel.input) else inside).append(c)
        if not outside:
            return None
        made = L.made(rel.input)
        if any(i not in own and i not in layer.outer for c in outside for i in L.refs(c) - made):
            return None
        if made & own:
            return None
        core: L.Rel = rel.input
        if inside:
            core = L.Filter(rel.cols, set(), rel.max_rows, core, inside[0] if len(inside) == 1 else X("and", "bool", tuple(inside)))
        sub = self.relation(core, self.root)
        if project is not None:
            build = self.columns(self.root, set(sub.df.columns))
            fresh = {i: build(x) for i, x in project.items if not (x.op == "col" and x.info == i)}
            sub = replace(sub, df=sub.df.withColumns(fresh)) if fresh else sub
        rename = {k: self.new("k") for k in sub.keys}
        sub = replace(sub, df=sub.df.withColumnsRenamed(rename)) if rename else sub
        build = Columns(self.exact, lambda i: F.col(i) if i in made or i in own else F.col(layer.outer[i]))
        return sub, [F.col(k).eqNullSafe(F.col(n)) for k, n in rename.items()] + [build(c) for c in outside]


def _on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on equal keys, which left has too."""
    if not keys:
        return left.crossJoin(right)
    rename = {k: f"__k{n}" for n, k in enumerate(keys)}
    test = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(v)) for k, v in rename.items()])
    return left.join(right.withColumnsRenamed(rename), test, how).drop(*rename.values())


def _back(outer: DataFrame, sub: DataFrame, match: dict[str, str], tests: list[Column] = (), how: str = "left") -> DataFrame:
    """The outer rows with the columns that the subquery has for their case."""
    rename = {k: f"__m{n}" for n, k in enumerate(match)}
    conditions = [F.col(o).eqNullSafe(F.col(rename[k])) for k, o in match.items()] + list(tests)
    renamed = sub.withColumnsRenamed(rename) if rename else sub
    if not conditions:
        return outer.join(renamed, F.lit(True), how)
    return outer.join(renamed, reduce(lambda a, b: a & b, conditions), how).drop(*rename.values())


def result(lowerer: Lowerer, rel: L.Rel) -> tuple[DataFrame, Lowered]:
    """The visible columns by position (with keys and sort columns), sorted where no context is."""
    low = lowerer.relation(rel)
    cols = [c for c in rel.cols if c.visible]
    df = low.df.orderBy(*low.sorted()) if low.order and not low.keys and isinstance(rel, (L.Sort, L.Slice)) else low.df
    return df.select(*low.keys, *[F.col(c.id).alias(f"_{k}") for k, c in enumerate(cols)]), low
