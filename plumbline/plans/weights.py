"""Aggregates over joins of many rows with many, by counts of equal rows.

Where an inner join matches many rows of one input with many of another, its rows grow with the
square of a key's rows. An aggregate that only needs to know how often a row occurs (COUNT, and
MIN, MAX and DISTINCT, which don't need that either) has the same result if equal rows of an
input are joined once, with their number: the numbers' product tells how often a joined row
occurs. SUM and AVG stay as they are, since a double times a number is not the sum of its
repetitions; so do joins in which all inputs but one have their keys in the join columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from .logical import Agg, Aggregate, Col, Filter, Join, Project, Rel, X, closure, conjuncts, free, refs, subqueries


def weighed(rel: Aggregate, new: Callable[[str], str], exact: bool) -> tuple[Aggregate, list[str]] | None:
    """The aggregate over inputs without equal rows, and the columns of their numbers; None where
    that is not its form, or would not help."""
    if rel.firsts or not all(g.distinct or g.name in ("count", "min", "max") for _, g in rel.aggs) or _nested(rel) or free(rel):
        return None
    leaves, tests = [], []
    tree, values = _flat(rel.input, leaves, tests)
    if len(leaves) < 2:
        return None
    own = [{c.id for c in leaf.cols} for leaf in leaves]
    local = [[t for t in tests if refs(t) and refs(t) <= ids] for ids in own]
    across = [t for t in tests if not any(t in found for found in local)]
    joined = set().union(*[refs(t) for t in across if t.op in ("eq", "same")], set())
    if sum(not _unique(leaf, joined & ids) for leaf, ids in zip(leaves, own, strict=True)) < 2:
        return None
    keys = [(i, _put(x, values)) for i, x in rel.keys]
    aggs = [(i, replace(g, args=tuple(_put(a, values) for a in g.args))) for i, g in rel.aggs]
    used: dict[str, str] = {}
    for x in (*across, *[x for _, x in keys], *[a for _, g in aggs for a in g.args]):
        _types(x, used)
    every = set().union(*own)
    if len(every) < sum(map(len, own)) or set(used) - every:
        return None  # ids that name no one column of one leaf
    weights, inputs = [], []
    for leaf, ids, found in zip(leaves, own, local, strict=True):
        leaf = _where(leaf, found)
        named = {i: kind for i, kind in used.items() if i in ids}
        # a group of doubles holds 0.0 and -0.0, which are not the same in every expression
        if not _unique(leaf, set(named)) and (exact or "num" not in named.values()):
            leaf = _counted(leaf, named, n := new("w"))
            weights.append(n)
        inputs.append(leaf)
    if not weights:
        return None
    return replace(rel, input=_tree(tree, inputs, across), keys=keys, aggs=aggs), weights


def _nested(rel: Rel) -> bool:
    return any(True for x in rel.exprs() for _ in subqueries(x))


def _flat(rel: Rel, leaves: list[Rel], tests: list[X]):
    """The inner joins as pairs of numbers of leaves, and the values of ids that projections make."""
    if isinstance(rel, Filter) and not _nested(rel):
        tree, values = _flat(rel.input, leaves, tests)
        tests += [_put(c, values) for c in conjuncts(rel.predicate)]
        return tree, values
    if isinstance(rel, Join) and rel.kind == "inner" and not _nested(rel):
        (left, a), (right, b) = _flat(rel.left, leaves, tests), _flat(rel.right, leaves, tests)
        values = a | b
        if rel.predicate is not None:
            tests += [_put(c, values) for c in conjuncts(rel.predicate)]
        return (left, right), values
    if isinstance(rel, Project) and not _nested(rel):
        tree, values = _flat(rel.input, leaves, tests)
        return tree, values | {i: _put(x, values) for i, x in rel.items}
    leaves.append(rel)
    return len(leaves) - 1, {}


def _put(x: X, values: dict[str, X]) -> X:
    if x.op == "col":
        return values.get(x.info, x)
    return replace(x, args=tuple(_put(a, values) for a in x.args))


def _types(x: X, found: dict[str, str]) -> None:
    if x.op == "col":
        found[x.info] = x.type
    for a in x.args:
        _types(a, found)


def _unique(leaf: Rel, ids: set[str]) -> bool:
    """Whether no two rows are known to be equal in all of the ids."""
    every, known = {c.id for c in leaf.cols}, closure(ids, leaf.fds)
    return leaf.max_rows <= 1 or any(a <= known and every <= b for a, b in leaf.fds)


def _where(rel: Rel, tests: list[X]) -> Rel:
    return Filter(rel.cols, rel.fds, rel.max_rows, rel, _all(tests)) if tests else rel


def _all(tests: list[X]) -> X:
    return tests[0] if len(tests) == 1 else X("and", "bool", tuple(tests))


def _counted(leaf: Rel, named: dict[str, str], weight: str) -> Rel:
    keys = [(i, X("col", kind, (), i)) for i, kind in named.items()]
    cols = [Col(i, i, kind) for i, kind in named.items()] + [Col(weight, weight, "int", False)]
    out = Aggregate(cols, set(), leaf.max_rows, leaf, keys, [(weight, Agg("count", (), False, "int"))], [], bool(keys))
    # without keys an empty input has a row too
    return out if keys else _where(out, [X("lt", "bool", (X("lit", "int", (), 0), X("col", "int", (), weight)))])


def _tree(tree, inputs: list[Rel], tests: list[X]) -> Rel:
    """The joins again, each test at the first join that has all its columns."""
    left = list(tests)

    def build(t) -> Rel:
        if isinstance(t, int):
            return inputs[t]
        a, b = build(t[0]), build(t[1])
        ids = {c.id for c in (*a.cols, *b.cols)}
        here = [x for x in left if refs(x) <= ids]
        for x in here:
            left.remove(x)
        return Join(a.cols + b.cols, set(), a.max_rows * b.max_rows, "inner", a, b, _all(here) if here else None)

    out = build(tree)
    assert not left, "a test without its columns"
    return out

