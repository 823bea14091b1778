"""From syntax to typed logical relations: names, types, grouping, windows, limits."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from ..functions import scalar
from ..functions import typing as T
from ..functions.typing import Policies
from . import logical as L
from . import syntax as S
from .errors import name_error, too_complex, type_error, unsupported
from .logical import Agg, Col, Order, Win, X

# How deep subqueries may nest, and the window functions.
MAX_DEPTH = 8
_RANKS = {"row_number", "rank", "dense_rank"}


@dataclass
class Bound:
    """A query: its relation, and whether its result is a list (else a bag)."""

    rel: L.Rel
    ordered: bool

    @property
    def types(self) -> list[str]:
        return [c.type for c in self.rel.cols if c.visible]

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.rel.cols if c.visible]


@dataclass
class _Scope:
    """What names mean in one SELECT."""

    cols: list[Col]
    aliases: dict = field(default_factory=dict)  # seen before columns
    aggs: list | None = None  # collects aggregates where they may stand
    windows: list | None = None


class Binder:
    """Tables come from `schema`; `bound` is the number of rows that each holds at most."""

    def __init__(self, schema, policies: Policies | None = None, bound: float = math.inf, max_rows: float = math.inf, prefix: str = "c"):
        self.schema, self.policies = schema, policies or Policies()
        self.bound, self.max_rows, self.count, self.prefix = bound, max_rows, 0, prefix

    def new(self) -> str:
        self.count += 1
        return f"{self.prefix}{self.count}"

    def bind(self, query: S.Query) -> Bound:
        if self.policies.ignore_top_level_order and query.limit is None and not query.offset:
            query = replace(query, order=())
        return Bound(self._query(query, (), {}, 0), bool(query.order) or query.limit is not None or bool(query.offset))

    # -- queries
    def _query(self, q: S.Query, outer: tuple, ctes: dict, depth: int) -> L.Rel:
        if depth > MAX_DEPTH:
            raise too_complex(f"subqueries nest deeper than {MAX_DEPTH}")
        own = dict(ctes)
        seen = set()
        for name, columns, body in q.ctes:
            if name in seen:
                raise name_error(f"{name} is defined twice")
            seen.add(name)
            before = dict(own)
            self._query(body, outer, before, depth)  # so that an unused one is checked too
            own[name] = (columns, body, before)
        rel = self._body(q.body, outer, own, depth)
        if q.order:
            rel = L.Sort(rel.cols, rel.fds, rel.max_rows, rel, self._output_order(q.order, rel))
        if q.limit is not None or q.offset:
            most = rel.max_rows if q.limit is None else min(rel.max_rows, q.limit)
            rel = L.Slice(rel.cols, rel.fds, most, rel, q.limit, q.offset)
        return rel

    def _output_order(self, keys, rel) -> list[Order]:
        visible = [c for c in rel.cols if c.visible]
        out = []
        for k in keys:
            if k.expr.kind == "number" and k.expr.info.isdigit():
                n = int(k.expr.info)
                if not 1 <= n <= len(visible):
                    raise name_error(f"ORDER BY {n}")
                x = X("col", visible[n - 1].type, (), visible[n - 1].id)
            else:
                if _has(k.expr, "agg") or _has(k.expr, "window"):
                    raise unsupported("ORDER BY an aggregate")
                if any(_has(k.expr, s) for s in ("exists", "in_query", "scalar", "quantified")):
                    raise unsupported("ORDER BY a subquery")
                x = self._expr(k.expr, [_Scope(rel.cols)], {}, 0)
            out.append(Order(x, k.ascending, k.first))
        return out

    def _body(self, body, outer, ctes, depth) -> L.Rel:
        if isinstance(body, S.Query):
            return self._query(body, outer, ctes, depth)
        if isinstance(body, S.SetQuery):
            return self._set(body, outer, ctes, depth)
        return self._select(body, outer, ctes, depth)

    def _set(self, q: S.SetQuery, outer, ctes, depth) -> L.Rel:
        left, right = self._body(q.left, outer, ctes, depth), self._body(q.right, outer, ctes, depth)
        a, b = [c for c in left.cols if c.visible], [c for c in right.cols if c.visible]
        if len(a) != len(b):
            raise type_error("the sides of a set operation have other widths")
        if [c.type for c in a] != [c.type for c in b]:
            raise type_error("the sides of a set operation have other types")
        cols = [Col(self.new(), x.name, x.type, x.nullable or y.nullable, (), True, x.domain) for x, y in zip(a, b, strict=True)]
        most = left.max_rows + right.max_rows if q.op == "union" else left.max_rows
        fds = set()
        if q.op != "union":
            to = {x.id: c.id for x, c in zip(a, cols, strict=True)}
            fds = _renamed(left.fds, to)
        rel = L.SetOp(cols, fds, self._limited(most), q.op, q.every, left, right, ([c.id for c in a], [c.id for c in b]))
        return rel

    def _limited(self, rows: float) -> float:
        if rows > self.max_rows:
            raise too_complex(f"an intermediate result of up to {rows:.0f} rows")
        return rows

    # -- tables
    def _factor(self, f, outer, ctes, depth, taken: set) -> L.Rel:
        if isinstance(f, S.JoinRef):
            return self._join(f, outer, ctes, depth, taken)
        if isinstance(f, S.Nested):
            inner = set() if f.alias else taken
            rel = self._factor(f.join, outer, ctes, depth, inner)
            if not f.alias:
                return rel
            self._take(f.alias, taken)
            return self._aliased(rel, f.alias, ())
        self._take(f.alias, taken)
        if isinstance(f, S.Derived):
            return self._aliased(self._query(f.query, outer, ctes, depth + 1), f.alias, f.columns)
        if f.name in ctes:
            columns, body, env = ctes[f.name]
            rel = self._query(body, outer, env, depth + 1)
            if columns:
                rel = self._aliased(rel, f.name, columns)
            return self._aliased(rel, f.alias, f.columns)
        if not self.schema.has(f.name):
            raise name_error(f"no table {f.name}")
        table = self.schema.table(f.name)
        cols = [Col(self.new(), c.key(), c.type, self.schema.nullable(table, c), ((f.alias, c.key()),), True, c.domain) for c in table.columns]
        ids = {c.name: c.id for c in cols}
        every = frozenset(ids.values())
        fds = {(frozenset(ids[c] for c in key), every) for key in self.schema.keys(table)}
        rel = L.Scan(cols, fds, self.bound, table.key(), [c.key() for c in table.columns])
        return self._aliased(rel, f.alias, f.columns) if f.columns else rel

    @staticmethod
    def _take(alias: str, taken: set) -> None:
        if alias in taken:
            raise name_error(f"{alias} occurs twice in FROM")
        taken.add(alias)

    @staticmethod
    def _aliased(rel: L.Rel, alias: str, names: tuple) -> L.Rel:
        """The relation under another name: a copy whose columns are addressed anew."""
        visible = [c for c in rel.cols if c.visible]
        if names and len(names) != len(visible):
            raise name_error(f"{alias} has {len(visible)} columns, not {len(names)}")
        names = names or tuple(c.name for c in visible)
        out = _copy(rel)
        out.cols = [replace(c, name=n, quals=((alias, n),)) for c, n in zip(visible, names, strict=True)]
        ids = [c.id for c in out.cols]
        return out if len(set(ids)) == len(ids) or not isinstance(rel, L.Scan) else out

    def _join(self, j: S.JoinRef, outer, ctes, depth, taken) -> L.Rel:
        left = self._factor(j.left, outer, ctes, depth, taken)
        right = self._factor(j.right, outer, ctes, depth, taken)
        rows = self._limited(left.max_rows * right.max_rows)
        cols = [replace(c, nullable=True) if j.kind in ("right", "full") else c for c in left.cols]
        cols += [replace(c, nullable=True) if j.kind in ("left", "full") else c for c in right.cols]
        using = j.using
        if j.natural:
            mine = [c.name for c in left.cols if c.visible]
            theirs = {c.name for c in right.cols if c.visible}
            using = tuple(n for n in dict.fromkeys(mine) if n in theirs)
        fds = _outer_fds(left.fds, j.kind in ("right", "full")) | _outer_fds(right.fds, j.kind in ("left", "full"))
        kind = "inner" if j.kind == "cross" else j.kind
        if kind == "left":
            rows = max(rows, left.max_rows)
        elif kind == "right":
            rows = max(rows, right.max_rows)
        elif kind == "full":
            rows = max(rows, left.max_rows + right.max_rows)
        if not using:
            predicate = None
            if j.on is not None:
                predicate = self._truth(j.on, [_Scope(left.cols + right.cols), *outer], ctes, depth)
                if kind == "inner":
                    fds |= _equalities(predicate)
            elif kind != "inner":
                predicate = T.TRUE
            return L.Join(cols, fds, rows, kind, left, right, predicate)
        pairs = [(self._one(n, left), self._one(n, right)) for n in using]
        tests = [T.compare("eq", _col(a), _col(b), self.policies) for a, b in pairs]
        predicate = tests[0] if len(tests) == 1 else X("and", "bool", tuple(tests))
        if kind == "inner":
            fds |= _equalities(predicate)
        join = L.Join(cols, fds, rows, kind, left, right, predicate)
        merged, items = [], []
        for n, (a, b) in zip(using, pairs, strict=True):
            if kind == "full":
                i = self.new()
                items.append((i, X("coalesce", a.type, (_col(a), _col(b)))))
                merged.append(Col(i, n, a.type, a.nullable or b.nullable))
            else:
                c = b if kind == "right" else a
                merged.append(Col(c.id, n, c.type, c.nullable, (), True, c.domain))
        used = {c.id for p in pairs for c in p}
        rest = [c for c in cols if c.visible and c.id not in used]
        hidden = [replace(c, visible=False) for c in cols if c.id in used or not c.visible]
        if items:
            keep = [(c.id, _col(c)) for c in {c.id: c for c in cols}.values()]
            out = L.Project([], fds, rows, join, keep + items)
        else:
            out = join
        out.cols = merged + rest + hidden
        return out

    @staticmethod
    def _one(name: str, rel: L.Rel) -> Col:
        found = [c for c in rel.cols if c.visible and c.name == name]
        if len(found) != 1:
            raise name_error(f"USING ({name})")
        return found[0]

    # -- SELECT
    def _select(self, q: S.Select, outer, ctes, depth) -> L.Rel:
        rel: L.Rel = L.Unit([], set(), 1)
        taken: set = set()
        for k, f in enumerate(q.tables):
            right = self._factor(f, outer, ctes, depth, taken)
            rel = right if k == 0 else L.Join(rel.cols + right.cols, rel.fds | right.fds, self._limited(rel.max_rows * right.max_rows), "inner", rel, right, None)
        if q.where is not None:
            if _has(q.where, "agg") or _has(q.where, "window"):
                raise unsupported("aggregates or windows in WHERE")
            predicate = self._truth(q.where, [_Scope(rel.cols), *outer], ctes, depth)
            rel = L.Filter(rel.cols, rel.fds | _equalities(predicate), rel.max_rows, rel, predicate)
        items = self._items(q.items, rel)
        grouped = bool(q.group) or q.having is not None or any(_has(e, "agg") for e, _, _ in items)
        if any(_has(e, "window") for e, _, _ in items) and grouped:
            raise unsupported("window functions with grouping")
        if q.having is not None and _has(q.having, "window"):
            raise unsupported("window functions in HAVING")
        rel, found = self._grouped(q, items, rel, outer, ctes, depth) if grouped else self._plain(items, rel, outer, ctes, depth)
        rel = self._project(items, found, rel)
        if q.distinct:
            rel = L.Distinct(rel.cols, rel.fds, rel.max_rows, rel)
        return rel

    def _items(self, items, rel):
        """(expression, name, source column) of each output."""
        out = []
        for item in items:
            if item.expr.kind != "star":
                out.append((item.expr, item.alias or _name(item.expr), None))
                continue
            q = item.expr.info
            if q is None:
                cols = [c for c in rel.cols if c.visible]
            else:
                own = [c for c in rel.cols if any(a == q for a, _ in c.quals)]
                cols = [c for c in own if c.visible] + [c for c in own if not c.visible]
            if not cols:
                raise name_error(f"{q or ''}* of nothing")
            out += [(S.Node("column", info=c), next((n for a, n in c.quals if a == q), c.name) if q else c.name, c) for c in cols]
        return out

    def _plain(self, items, rel, outer, ctes, depth):
        scope = _Scope(rel.cols, windows=[])
        found = [self._expr(e, [scope, *outer], ctes, depth) for e, _, _ in items]
        if scope.windows:
            extra = [Col(i, "", w.type, True, (), False) for i, w in scope.windows]
            fds = set(rel.fds)
            for i, w in scope.windows:  # a rank or running aggregate follows from its keys
                if w.name not in ("row_number", "first_value"):
                    used = set().union(*[L.refs(x) for x in (*w.partition, *(o.expr for o in w.order))]) if (w.partition or w.order) else set()
                    fds.add((frozenset(used), frozenset({i})))
            rel = L.Window(rel.cols + extra, fds, rel.max_rows, rel, scope.windows)
        return rel, found

    def _project(self, items, found, rel) -> L.Rel:
        out, cols, used = [], [], set()
        known = {c.id: c for c in rel.cols}
        for x, (_, name, _) in zip(found, items, strict=True):
            if x.type == "null":
                raise type_error("a NULL of no type")
            source = known.get(x.info) if x.op == "col" else None
            i = x.info if source is not None and x.info not in used else self.new()
            used.add(i)
            out.append((i, x))
            cols.append(Col(i, name, x.type, source.nullable if source else True, source.quals if source else (), True, source.domain if source else ()))
        kept: dict[str, set] = {}
        for i, x in out:
            if x.op == "col":
                kept.setdefault(x.info, set()).add(i)
        fds = set()
        for left, _ in rel.fds:
            if left <= set(kept):
                determined = L.closure(set(left), rel.fds)
                to = frozenset(i for d in determined for i in kept.get(d, ())) | {i for i, x in out if x.op != "col" and L.refs(x) <= determined}
                fds.add((frozenset(min(kept[k]) for k in left), to))
        for ids in kept.values():
            first = min(ids)
            fds |= {(frozenset({a}), frozenset(ids)) for a in ids if len(ids) > 1 or a != first}
        for i, x in out:
            used_ids = L.refs(x)
            if x.op != "col" and used_ids <= set(kept):
                fds.add((frozenset(min(kept[u]) for u in used_ids), frozenset({i})))
        return L.Project(cols, fds, rel.max_rows, rel, out)

    def _grouped(self, q: S.Select, items, rel, outer, ctes, depth):
        aliases = {}
        for e, name, source in items:
            if source is None:
                aliases.setdefault(name, e)
        keys: list[tuple[str, X]] = []
        for g in q.group:
            e = g
            if g.kind == "number" and g.info.isdigit():
                n = int(g.info)
                if not 1 <= n <= len(items):
                    raise name_error(f"GROUP BY {n}")
                e = items[n - 1][0]
            elif g.kind == "name" and g.info[0] is None and g.info[1] in aliases and not any(c.visible and c.name == g.info[1] for c in rel.cols):
                e = aliases[g.info[1]]
            if _has(e, "agg") or _has(e, "window"):
                raise unsupported("GROUP BY an aggregate or window")
            x = self._expr(e, [_Scope(rel.cols), *outer], ctes, depth)
            if x.type == "null":
                raise type_error("GROUP BY a NULL of no type")
            if not any(x == k for _, k in keys):
                keys.append((x.info if x.op == "col" and any(c.id == x.info for c in rel.cols) else self.new(), x))
        scope = _Scope(rel.cols, aggs=[])
        found = [self._expr(e, [scope, *outer], ctes, depth) for e, _, _ in items]
        having = None
        if q.having is not None:
            having = self._truth(q.having, [replace(scope, aliases=aliases), *outer], ctes, depth)
        inner = {c.id for c in rel.cols}
        plain = {x.info for _, x in keys if x.op == "col"}
        determined = L.closure(plain, rel.fds) & inner
        extras: dict[str, X] = {}
        firsts: dict[str, str] = {}
        known = {c.id: c for c in rel.cols}
        agg_ids = {i for i, _ in scope.aggs}

        def settle(i: str) -> str:
            if i in determined:
                extras.setdefault(i, _col(known[i]))
                return i
            if self.policies.first_row_grouping:
                return firsts.setdefault(i, self.new())
            raise type_error(f"{known[i].name} is neither grouped nor aggregated")

        def rewrite(x: X) -> X:
            for i, k in keys:
                if x == k:
                    return X("col", x.type, (), i)
            if x.op == "col":
                if x.info in agg_ids or x.info not in inner:
                    return x
                return X("col", x.type, (), settle(x.info))
            info = x.info
            if x.op in L.SUBQUERIES:
                changed = {i: settle(i) for i in L.free(info) & inner if i not in plain}
                info = _substituted(info, {a: b for a, b in changed.items() if a != b})
            return X(x.op, x.type, tuple(map(rewrite, x.args)), info)

        found = [rewrite(x) for x in found]
        having = rewrite(having) if having is not None else None
        every = keys + [(i, x) for i, x in extras.items() if i not in {k for k, _ in keys}]
        cols = [replace(known[i], visible=False) if i in known else Col(i, "", x.type, True, (), False) for i, x in every]
        cols += [Col(i, "", a.type, True, (), False) for i, a in scope.aggs] + [replace(known[s], id=i, nullable=True, visible=False) for s, i in firsts.items()]
        fds = {(frozenset(i for i, _ in keys), frozenset(c.id for c in cols))}
        fds |= {(a, b & {c.id for c in cols}) for a, b in rel.fds if a <= {i for i, _ in every}}
        grouped = bool(q.group)
        out: L.Rel = L.Aggregate(cols, fds, rel.max_rows if grouped else 1, rel, every, scope.aggs, [(i, s) for s, i in firsts.items()], grouped)
        if not grouped and extras:  # columns that are constant in the only group
            out.firsts += [(i, i) for i in extras]
            out.keys = []
        if having is not None:
            out = L.Filter(out.cols, out.fds, out.max_rows, out, having)
        return out, found

    # -- expressions
    def _truth(self, e, scopes, ctes, depth) -> X:
        return T.predicate(self._expr(e, scopes, ctes, depth), self.policies)

    def _lookup(self, qualifier, name, scopes, ctes, depth) -> X:
        for k, s in enumerate(scopes):
            if qualifier is None and name in s.aliases:
                return self._expr(s.aliases[name], [replace(s, aliases={}), *scopes[k + 1 :]], ctes, depth)
            if qualifier is None:
                found = [c for c in s.cols if c.visible and c.name == name]
            else:
                found = [c for c in s.cols if (qualifier, name) in c.quals]
                found = [c for c in found if c.visible] or found
            if len({c.id for c in found}) > 1:
                raise name_error(f"{name} is ambiguous")
            if found:
                return _col(found[0])
        raise name_error(f"no column {qualifier + '.' if qualifier else ''}{name}")

    def _expr(self, e: S.Node, scopes: list, ctes, depth) -> X:
        k, p = e.kind, self.policies
        go = lambda n: self._expr(n, scopes, ctes, depth)
        truth = lambda n: self._truth(n, scopes, ctes, depth)
        if k == "column":
            return _col(e.info)
        if k == "name":
            return self._lookup(*e.info, scopes, ctes, depth)
        if k == "number":
            return T.number(e.info)
        if k == "string":
            return X("lit", "text", (), e.info)
        if k == "null":
            return T.NULL
        if k == "bool":
            return X("lit", "bool", (), e.info)
        if k == "typed":
            return T.from_text(e.info[1], e.info[0])
        if k == "interval":
            return T.integer(e.info)
        if k in ("and", "or"):
            return X(k, "bool", tuple(truth(a) for a in e.args))
        if k == "not":
            return X("not", "bool", (truth(e.args[0]),))
        if k in ("eq", "ne", "lt", "le", "gt", "ge", "same"):
            if any(a.kind == "row" for a in e.args):
                return self._rows(k, e.args, go)
            return T.compare(k, go(e.args[0]), go(e.args[1]), p)
        if k == "is_null":
            x = go(e.args[0])
            if e.info == "unknown":
                x = T.predicate(x, p)
            return X("is_null", "bool", (x if x.type != "null" else X("lit", "text", (), None),))
        if k == "is_bool":
            return X("is_bool", "bool", (truth(e.args[0]),), e.info)
        if k == "between":
            x, low, high = map(go, e.args)
            return X("and", "bool", (T.compare("ge", x, low, p), T.compare("le", x, high, p)))
        if k == "in_list":
            if e.args[0].kind == "row":
                tests = [self._rows("eq", (e.args[0], b), go) for b in e.args[1:]]
            else:
                x = go(e.args[0])
                tests = [T.compare("eq", x, go(b), p) for b in e.args[1:]]
            return tests[0] if len(tests) == 1 else X("or", "bool", tuple(tests))
        if k == "like":
            return self._like(go(e.args[0]), go(e.args[1]))
        if k in ("add", "sub", "mul", "div", "mod"):
            return T.arithmetic(k, go(e.args[0]), go(e.args[1]), p)
        if k == "neg":
            return T.negative(go(e.args[0]))
        if k == "plus":
            x = go(e.args[0])
            if x.type not in ("int", "num"):
                raise type_error(f"plus {x.type}")
            return x
        if k == "case":
            *branches, other = e.args
            conditions = [truth(c) for c in branches[::2]]
            values = T.common([go(v) for v in (*branches[1::2], other)])
            args = [x for pair in zip(conditions, values[:-1], strict=True) for x in pair]
            return X("case", values[0].type, (*args, values[-1]))
        if k == "cast":
            return T.cast(go(e.args[0]), e.info, p)
        if k == "call":
            if e.info in _RANKS or e.info == "first_value":
                raise unsupported(f"{e.info}() without OVER")
            return scalar.call(e.info, [go(a) for a in e.args], p)
        if k == "agg":
            return self._aggregate(e, scopes, ctes, depth)
        if k == "window":
            return self._window(e, scopes, ctes, depth)
        if k == "exists":
            return X("exists", "bool", (), self._query(e.info, tuple(scopes), ctes, depth + 1))
        if k == "in_query":
            return self._in(e.args[0], e.info, scopes, ctes, depth)
        if k == "quantified":
            op, quantifier, query = e.info
            if (op, quantifier) == ("eq", "any"):
                return self._in(e.args[0], query, scopes, ctes, depth)
            if (op, quantifier) == ("ne", "all"):
                return X("not", "bool", (self._in(e.args[0], query, scopes, ctes, depth),))
            raise unsupported("quantified comparisons other than = ANY and <> ALL")
        if k == "scalar":
            rel = self._query(e.info, tuple(scopes), ctes, depth + 1)
            cols = [c for c in rel.cols if c.visible]
            if len(cols) != 1:
                raise type_error("a scalar subquery of several columns")
            if rel.max_rows > 1 or self._needs_one(rel):
                raise unsupported("a scalar subquery that may have several rows")
            return X("scalar", cols[0].type, (), rel)
        if k == "row":
            raise unsupported("a row value here")
        raise unsupported(k)

    def _needs_one(self, rel: L.Rel) -> bool:
        """Whether at most one row follows only from the bound of the tables."""
        if isinstance(rel, L.Slice):
            return (rel.limit is None or rel.limit > 1) and self._needs_one(rel.input)
        if isinstance(rel, L.Aggregate):
            return rel.grouped and self._needs_one(rel.input)
        if isinstance(rel, L.SetOp):
            return rel.op == "union" or self._needs_one(rel.left)
        if isinstance(rel, L.Scan):
            return True
        return any(map(self._needs_one, rel.inputs()))

    def _rows(self, op, args, go) -> X:
        a, b = args
        if a.kind != "row" or b.kind != "row" or len(a.args) != len(b.args):
            raise type_error("row values of other widths")
        if op not in ("eq", "ne"):
            raise unsupported("ordered row comparison")
        same = X("and", "bool", tuple(T.compare("eq", go(x), go(y), self.policies) for x, y in zip(a.args, b.args, strict=True)))
        return same if op == "eq" else X("not", "bool", (same,))

    def _in(self, operand, query, scopes, ctes, depth) -> X:
        rel = self._query(query, tuple(scopes), ctes, depth + 1)
        cols = [c for c in rel.cols if c.visible]
        operands = [self._expr(a, scopes, ctes, depth) for a in (operand.args if operand.kind == "row" else (operand,))]
        if len(cols) != len(operands):
            raise type_error("IN with another number of columns")
        typed = []
        for x, c in zip(operands, cols, strict=True):
            left, right = T.paired(x, _col(c), self.policies)
            if right != _col(c):
                raise type_error(f"{x.type} IN {c.type}")
            typed.append(left)
        return X("in", "bool", tuple(typed), rel)

    def _like(self, x: X, pattern: X) -> X:
        if x.type == "enum":
            x = X("cast", "text", (x,))
        x = T.adopt(x, "text")
        if x.type != "text":
            raise type_error(f"LIKE on {x.type}")
        if pattern.type == "null":
            return X("lit", "bool", (), None)
        if not pattern.literal or pattern.type != "text":
            raise unsupported("LIKE with a pattern that is no literal")
        text = pattern.info
        middle = text.removeprefix("%")
        middle = middle.removesuffix("%")
        if "_" in text or "%" in middle:
            raise unsupported(f"LIKE {text!r}")
        before, after = text.startswith("%"), text.endswith("%") and (len(text) > 1 or not text.startswith("%"))
        if text == "%":
            before = after = True
        if before and after:
            return X("contains", "bool", (x,), middle)
        if after:
            return X("prefix", "bool", (x,), middle)
        if before:
            return X("suffix", "bool", (x,), middle)
        return X("eq", "bool", (x, X("lit", "text", (), text)))

    def _agg_call(self, name, distinct, args, scopes, ctes, depth) -> Agg:
        if any(_has(a, "agg") or _has(a, "window") for a in args):
            raise unsupported("nested aggregates")
        inner = [replace(scopes[0], aggs=None, windows=None, aliases={}), *scopes[1:]]
        if len(args) == 1 and args[0].kind == "row":
            args = args[0].args
        bound = [self._expr(a, inner, ctes, depth) for a in args]
        if name == "count":
            if len(bound) > 1 and not distinct:
                raise type_error("COUNT of several columns")
            bound = [T.adopt(x, "text") if x.type == "null" else x for x in bound]
            return Agg("count", tuple(bound), distinct, "int")
        if len(bound) != 1:
            raise type_error(f"{name.upper()} takes one argument")
        x = bound[0]
        if x.literal and x.type == "text" and self.policies.mysql_coercion and name in ("sum", "avg"):
            x = T.from_text(x.info, "num")
        if x.type == "null":
            x = T.adopt(x, "int")
        if name in ("min", "max"):
            return Agg(name, (x,), distinct, x.type)
        if x.type not in ("int", "num", "bool"):
            raise type_error(f"{name.upper()} of {x.type}")
        return Agg(name, (x,), distinct, "num" if name == "avg" or x.type == "num" else "int")

    def _aggregate(self, e, scopes, ctes, depth) -> X:
        name, distinct = e.info
        if not e.args and name != "count":
            raise type_error(f"{name}(*)")
        if scopes[0].aggs is None:
            raise unsupported("an aggregate here")
        agg = self._agg_call(name, distinct, e.args, scopes, ctes, depth)
        return self._mean(agg, lambda a: self._collected(scopes[0].aggs, a))

    def _collected(self, calls: list, call) -> X:
        """The column of an aggregate or window call, which is made once however often it stands."""
        for i, known in calls:
            if known == call:
                return X("col", call.type, (), i)
        calls.append((self.new(), call))
        return X("col", call.type, (), calls[-1][0])

    @staticmethod
    def _mean(call, made) -> X:
        """The call's column; a mean is the quotient of a sum and a count."""
        if call.name != "avg":
            return made(call)
        total = made(replace(call, name="sum", type="num" if call.args[0].type == "num" else "int"))
        return X("div", "num", (T.numeric(total), T.numeric(made(replace(call, name="count", type="int")))))

    def _window(self, e, scopes, ctes, depth) -> X:
        if scopes[0].windows is None:
            raise unsupported("a window function here")
        kind, info, over = e.info
        inner = [replace(scopes[0], windows=None, aggs=None), *scopes[1:]]
        part = [self._expr(a, inner, ctes, depth) for a in over.partition]
        part = tuple(T.adopt(x, "bool") if x.type == "null" else x for x in part)
        order = []
        for key in over.order:
            x = self._expr(key.expr, inner, ctes, depth)
            order.append(Order(T.adopt(x, "int") if x.type == "null" else x, key.ascending, key.first))
        if kind == "agg":
            if info[0] == "count" and len(e.args) > 1:
                raise unsupported("COUNT of several columns over a window")
            a = self._agg_call(info[0], info[1], e.args, inner, ctes, depth)
            win = Win(a.name, a.args, a.distinct, part, tuple(order), a.type)
        elif info in _RANKS:
            if e.args:
                raise type_error(f"{info}() takes no argument")
            win = Win(info, (), False, part, tuple(order), "int")
        elif info == "first_value":
            if len(e.args) != 1:
                raise type_error("FIRST_VALUE takes one argument")
            if not order:
                raise unsupported("FIRST_VALUE without ORDER BY")
            x = self._expr(e.args[0], inner, ctes, depth)
            win = Win(info, (x,), False, part, tuple(order), x.type)
        else:
            raise unsupported(f"{info}() over a window")
        return self._mean(win, lambda w: self._collected(scopes[0].windows, w))


def _col(c: Col) -> X:
    return X("col", c.type, (), c.id)


def _copy(rel: L.Rel) -> L.Rel:
    out = object.__new__(type(rel))
    out.__dict__.update(rel.__dict__)
    if isinstance(rel, (L.Scan, L.SetOp)):  # these tell their columns by position
        return L.Project(list(rel.cols), rel.fds, rel.max_rows, rel, [(c.id, _col(c)) for c in rel.cols])
    return out


def _substituted(rel: L.Rel, to: dict[str, str]) -> L.Rel:
    """The relation with ids from outside replaced."""
    if not to:
        return rel

    def expr(x: X) -> X:
        info = to.get(x.info, x.info) if x.op == "col" else _substituted(x.info, to) if x.op in L.SUBQUERIES else x.info
        return X(x.op, x.type, tuple(map(expr, x.args)), info)

    out = object.__new__(type(rel))
    out.__dict__.update(rel.__dict__)
    for name in ("input", "left", "right"):
        if getattr(out, name, None) is not None:
            setattr(out, name, _substituted(getattr(out, name), to))
    if getattr(out, "predicate", None) is not None:
        out.predicate = expr(out.predicate)
    if isinstance(out, L.Project):
        out.items = [(i, expr(x)) for i, x in out.items]
    if isinstance(out, L.Sort):
        out.order = [replace(o, expr=expr(o.expr)) for o in out.order]
    if isinstance(out, L.Aggregate):
        out.keys = [(i, expr(x)) for i, x in out.keys]
        out.aggs = [(i, replace(a, args=tuple(map(expr, a.args)))) for i, a in out.aggs]
    if isinstance(out, L.Window):
        out.calls = [(i, replace(w, args=tuple(map(expr, w.args)), partition=tuple(map(expr, w.partition)), order=tuple(replace(o, expr=expr(o.expr)) for o in w.order))) for i, w in out.calls]
    return out


def _has(e: S.Node, kind: str) -> bool:
    """Whether a node of the kind stands in the expression, not looking into subqueries or, for
    aggregates, into windows' own calls."""
    if e.kind == kind:
        return True
    if e.kind == "window":
        over = e.info[2]
        return any(_has(a, kind) for a in (*e.args, *over.partition, *(k.expr for k in over.order)))
    return any(_has(a, kind) for a in e.args)


def _name(e: S.Node) -> str:
    if e.kind == "name":
        return e.info[1]
    if e.kind in ("agg", "call"):
        return e.info[0] if e.kind == "agg" else e.info
    return e.kind


def _equalities(predicate: X) -> set:
    """Dependencies that hold where the predicate is true."""
    out = set()
    for c in L.conjuncts(predicate):
        if c.op not in ("eq", "same"):
            continue
        a, b = c.args
        if a.op == "col" and b.op == "col":
            out |= {(frozenset({a.info}), frozenset({b.info})), (frozenset({b.info}), frozenset({a.info}))}
        elif a.op == "col" and b.literal:
            out.add((frozenset(), frozenset({a.info})))
        elif b.op == "col" and a.literal:
            out.add((frozenset(), frozenset({b.info})))
    return out


def _outer_fds(fds: set, extended: bool) -> set:
    """Dependencies of a side that may be filled with NULLs: constants are none any more."""
    return {(a, b) for a, b in fds if a} if extended else set(fds)


def _renamed(fds: set, to: dict) -> set:
    return {(frozenset(to[i] for i in a), frozenset(to[i] for i in b if i in to)) for a, b in fds if a <= set(to)}
