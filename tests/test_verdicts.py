"""Verdicts on pairs of queries."""

import pytest

from plumbline.checker.outcome import Different, Equivalent, Options, Unsupported
from plumbline.checker.verify import Verifier
from plumbline.functions.typing import Policies
from plumbline.plans.errors import QueryError, Reason
from plumbline.sources.schema import Check, Column, ForeignKey, Increasing, PrimaryKey, Schema, Table, Unique

C = Column
F1 = Schema((Table("items", (C("id", "int", False), C("value", "int"), C("flag", "bool"))),))
F2 = Schema((Table("items", (C("id", "int"), C("value", "int")), ("id",)),))
F3 = Schema((Table("items", (C("id", "int", False),)),))
F4 = Schema((Table("items", (C("value", "int"),)),))
F8 = Schema((Table("states", (C("id", "int", False), C("state", "enum", True, ("OPEN", "CLOSED")))),))
F9 = Schema((Table("items", (C("id", "int", False), C("value", "int"))),), (Check("items.value BETWEEN 1 AND 3"),))
F10 = Schema((Table("parents", (C("id", "int"),), ("id",)), Table("children", (C("parent_id", "int"),))), (ForeignKey("children", ("parent_id",), "parents", ("id",)),))
F14 = Schema((Table("left_items", (C("id", "int"), C("left_value", "text"))), Table("right_items", (C("id", "int"), C("right_value", "text")))))
F15 = Schema((Table("left_items", (C("id", "int"),)), Table("right_items", (C("id", "int"),))))

EQUIVALENT = [
    (F1, "SELECT id FROM items WHERE NOT (value > 5)", "SELECT id FROM items WHERE value <= 5"),
    (F2, "SELECT a.id FROM items a JOIN items b ON a.id = b.id", "SELECT id FROM items"),
    (F4, "SELECT value FROM items UNION SELECT value FROM items", "SELECT DISTINCT value FROM items"),
    (F4, "SELECT value FROM items INTERSECT ALL SELECT value FROM items", "SELECT value FROM items"),
    (F4, "SELECT value FROM items EXCEPT ALL SELECT value FROM items", "SELECT value FROM items WHERE FALSE"),
    (F8, "SELECT id FROM states WHERE state = 'OPEN' OR state = 'CLOSED'", "SELECT id FROM states WHERE state IS NOT NULL"),
    (F9, "SELECT id FROM items WHERE value >= 1 OR value IS NULL", "SELECT id FROM items"),
    (F10, "SELECT c.parent_id FROM children c JOIN parents p ON c.parent_id = p.id", "SELECT parent_id FROM children WHERE parent_id IS NOT NULL"),
    (F15, "SELECT l.id AS x, r.id AS y FROM left_items l LEFT JOIN right_items r ON FALSE", "SELECT l.id AS x, NULLIF(l.id, l.id) AS y FROM left_items l WHERE l.id IS NOT NULL UNION ALL SELECT l.id AS x, l.id AS y FROM left_items l WHERE l.id IS NULL"),
    (F15, "SELECT l.id AS x, r.id AS y FROM left_items l LEFT JOIN right_items r ON l.id = r.id", "SELECT l.id AS x, r.id AS y FROM right_items r RIGHT JOIN left_items l ON l.id = r.id"),
    (F15, "SELECT l.id AS x, r.id AS y FROM left_items l FULL JOIN right_items r ON l.id = r.id", "SELECT l.id AS x, r.id AS y FROM right_items r FULL JOIN left_items l ON r.id = l.id"),
    (F1, "SELECT value FROM items GROUP BY value HAVING COUNT(*) > 1", "SELECT DISTINCT value FROM (SELECT value, ROW_NUMBER() OVER (PARTITION BY value ORDER BY id) AS r FROM items) t WHERE r > 1"),
    (F1, "SELECT value, MIN(id) AS m FROM items GROUP BY value", "SELECT DISTINCT value, FIRST_VALUE(id) OVER (PARTITION BY value ORDER BY id) AS m FROM items"),
    (F2, "SELECT id FROM items i WHERE EXISTS (SELECT 1 AS one FROM items j WHERE j.value = i.id)", "SELECT id FROM items WHERE id = ANY (SELECT value FROM items)"),
    (F2, "SELECT id FROM items WHERE (id, value) IN (SELECT id, value FROM items)", "SELECT id FROM items WHERE value IS NOT NULL"),
    (F2, "SELECT id, (SELECT MAX(j.id) FROM items j WHERE j.id = i.id) AS m FROM items i", "SELECT id, id AS m FROM items"),
]
SAME_PLAN = [
    (F1, "SELECT AVG(value) AS a FROM items", "SELECT SUM(value) / COUNT(value) AS a FROM items"),
    (F1, "SELECT flag, AVG(DISTINCT value) AS a FROM items GROUP BY flag", "SELECT flag, SUM(DISTINCT value) / COUNT(DISTINCT value) AS a FROM items GROUP BY flag"),
    (F1, "SELECT id, AVG(value) OVER (PARTITION BY flag) AS a FROM items", "SELECT id, SUM(value) OVER (PARTITION BY flag) / COUNT(value) OVER (PARTITION BY flag) AS a FROM items"),
    (F1, "SELECT value + id AS s FROM items WHERE NOT (value + 1 > id OR flag)", "SELECT id + value AS s FROM items WHERE NOT flag AND value + 1 <= id"),
    (F1, "SELECT id FROM items WHERE value * 2 BETWEEN 1 AND 3", "SELECT i.id FROM items i WHERE i.value * 2 <= 3 AND 1 <= i.value * 2"),
]
DIFFERENT = [
    (F2, "SELECT value FROM items", "SELECT DISTINCT value FROM items"),
    (F2, "SELECT COUNT(*) AS n FROM items HAVING COUNT(*) > 0", "SELECT DISTINCT 1 AS n FROM items"),
    (F10, "SELECT COUNT(*) AS n FROM parents", "SELECT COUNT(DISTINCT parent_id) AS n FROM children"),
    (Schema((Table("t", (C("a", "int"), C("b", "int"))),), (Unique("t", ("a",)),)), "SELECT b FROM t", "SELECT DISTINCT b FROM t"),
    (Schema((Table("t", (C("a", "int"), C("b", "int"))),), (Increasing("t", "a", True),)), "SELECT b FROM t", "SELECT DISTINCT b FROM t"),
    (F1, "SELECT id FROM items WHERE flag OR NOT flag", "SELECT id FROM items"),
    (F3, "SELECT a.id FROM items a JOIN items b ON a.id = b.id", "SELECT id FROM items"),
    (F4, "SELECT value FROM items UNION ALL SELECT value FROM items", "SELECT value FROM items UNION SELECT value FROM items"),
    (F1, "SELECT COUNT(*) AS n FROM items", "SELECT COUNT(value) AS n FROM items"),
    (F1, "SELECT id FROM items ORDER BY id", "SELECT id FROM items ORDER BY id DESC"),
    (F2, "SELECT id FROM items WHERE value NOT IN (SELECT id FROM items)", "SELECT id FROM items i WHERE NOT EXISTS (SELECT 1 AS one FROM items j WHERE j.id = i.value)"),
    (F9, "SELECT id FROM items WHERE value >= 1", "SELECT id FROM items"),
    (F1, "SELECT id FROM items WHERE value + 1 > 5", "SELECT id FROM items WHERE value > 5"),
    (F1, "SELECT id FROM items", "SELECT flag FROM items"),
    (F1, "SELECT id FROM items", "SELECT id, value FROM items"),
]


@pytest.mark.parametrize("schema, left, right", EQUIVALENT)
def test_equivalent(spark, schema, left, right):
    verdict = Verifier(spark).verify(schema, left, right)
    assert isinstance(verdict, Equivalent), verdict
    assert verdict.bound == 2


@pytest.mark.parametrize("schema, left, right", SAME_PLAN)
def test_same_plan(spark, schema, left, right):
    verdict = Verifier(spark).verify(schema, left, right)
    assert isinstance(verdict, Equivalent) and verdict.why == "equal plans"


@pytest.mark.parametrize("schema, left, right", DIFFERENT)
def test_different(spark, schema, left, right):
    verdict = Verifier(spark).verify(schema, left, right)
    assert isinstance(verdict, Different), verdict
    example = verdict.counterexample
    assert example.left.types != example.right.types or example.left.rows != example.right.rows


@pytest.mark.parametrize("left, right, reason", [
    ("SELECT id FROM items ORDER BY id", "SELECT id FROM items", Reason.UNSUPPORTED_SQL),
    ("SELEC id FROM items", "SELECT id FROM items", Reason.PARSE_ERROR),
    ("SELECT nothing FROM items", "SELECT id FROM items", Reason.NAME_RESOLUTION),
    ("SELECT flag, value FROM items GROUP BY flag", "SELECT flag, value FROM items", Reason.TYPE_ERROR),
    ("SELECT SUM(value) + SUM(id) AS a FROM items WHERE value IS NOT NULL", "SELECT SUM(value + id) AS a FROM items", Reason.SOLVER),
])
def test_unsupported(spark, left, right, reason):
    verdict = Verifier(spark).verify(F1, left, right)
    assert isinstance(verdict, Unsupported) and verdict.reason == reason


def test_policies(spark):
    ignore = Options(policies=Policies(ignore_top_level_order=True))
    assert isinstance(Verifier(spark, ignore).verify(F1, "SELECT id FROM items ORDER BY id", "SELECT id FROM items"), Equivalent)
    first = Options(rows=1, policies=Policies(first_row_grouping=True))
    assert isinstance(Verifier(spark, first).verify(F1, "SELECT flag, value FROM items GROUP BY flag", "SELECT flag, value FROM items"), Equivalent)


def test_bounds(spark):
    v = Verifier(spark)
    found = v.verify_bounds(F3, "SELECT a.id FROM items a, items b WHERE a.id <> b.id", "SELECT id FROM items WHERE FALSE", [3, 1, 2])
    assert [type(found[b]) for b in (1, 2, 3)] == [Equivalent, Different, Different]
    assert found[3].counterexample.size == 2
    for b, verdict in found.items():
        alone = Verifier(spark, Options(rows=b)).verify(F3, "SELECT a.id FROM items a, items b WHERE a.id <> b.id", "SELECT id FROM items WHERE FALSE")
        assert type(alone) is type(verdict)
    with pytest.raises(QueryError):
        v.verify_bounds(F3, "SELECT id FROM items", "SELECT id FROM items", [0])


def test_session_is_order_independent(spark):
    pairs = [(a, b) for s, a, b in EQUIVALENT + DIFFERENT if s is F1][:4]
    ways = []
    for order in (pairs, pairs[::-1]):
        session = Verifier(spark).session(F1)
        ways.append({p: type(session.verify(*p)) for p in order})
    assert ways[0] == ways[1]


def test_metrics(spark):
    verdict, metrics = Verifier(spark).verify_with_metrics(F1, "SELECT id FROM items", "SELECT i.id FROM items i")
    assert isinstance(verdict, Equivalent) and verdict.why == "equal plans"
    assert metrics.counts["same_plan"] == 1 and metrics.seconds["bind"] > 0


@pytest.mark.parametrize("schema", [
    Schema(()), Schema((Table("items", (C("id", "int"),)), Table("ITEMS", (C("id", "int"),)))), Schema((Table("t", ()),)), Schema((Table("t", (C("a", "int"), C("A", "int"))),)),
    Schema((Table("t", (C("a", "enum"),)),)), Schema((Table("t", (C("a", "text"),)),), (Increasing("t", "a"),)), Schema((Table("t", (C("a", "int"),)),), (PrimaryKey("t", ("b",)),)),
    Schema((Table("t", (C("a", "int"),)), Table("u", (C("b", "text"),))), (ForeignKey("t", ("a",), "u", ("b",)),)), Schema((Table("t", (C("a", "int"),)),), (Unique("x", ("a",)),)),
])
def test_invalid_schema(spark, schema):
    verdict = Verifier(spark).verify(schema, "SELECT 1 AS one", "SELECT 1 AS one")
    assert isinstance(verdict, Unsupported) and verdict.reason == Reason.INVALID_SCHEMA


def test_inconsistent_schema(spark):
    schema = Schema((Table("items", (C("id", "int", False),)),), (Check("1 > 2"),))
    verdict = Verifier(spark).verify(schema, "SELECT id FROM items", "SELECT id FROM items")
    assert isinstance(verdict, Unsupported) and verdict.reason == Reason.INVALID_SCHEMA


def test_sequences(spark):
    schema = Schema((Table("items", (C("id", "int"),)),), (Increasing("items", "id", consecutive=True),))
    verdict = Verifier(spark).verify(schema, "SELECT a.id FROM items a JOIN items b ON b.id = a.id", "SELECT id FROM items")
    assert isinstance(verdict, Equivalent)
    verdict = Verifier(spark).verify(schema, "SELECT id FROM items", "SELECT id FROM items WHERE id <> 1")
    assert isinstance(verdict, Different)


def test_limits(spark):
    v = Verifier(spark, Options(rows=3, intermediate_rows=10)).verify(F3, "SELECT a.id FROM items a, items b, items c", "SELECT id FROM items")
    assert v.reason == Reason.COMPLEXITY_LIMIT
    v = Verifier(spark, Options(worlds=30)).verify(F1, "SELECT id, value FROM items WHERE value IN (1, 2)", "SELECT id, value FROM items WHERE value IN (2, 1) AND value < 9")
    assert v.reason == Reason.COMPLEXITY_LIMIT and "not refuted" in v.message
    assert Verifier(spark, Options(rows=0)).verify(F3, "SELECT id FROM items", "SELECT id FROM items").reason == Reason.INVALID_SCHEMA


def test_time_limit(spark):
    v = Verifier(spark, Options(timeout_seconds=0.05)).verify(F1, "SELECT id, value, flag FROM items WHERE value > 3", "SELECT id, value, flag FROM items WHERE value IN (SELECT value FROM items WHERE value > 3)")
    assert v.reason == Reason.SOLVER and v.reason.is_resource_limit


@pytest.mark.parametrize("kind, literal", [("text", "'b'"), ("date", "DATE '2020-02-29'"), ("time", "TIME '10:30:00'"), ("num", "2.5")])
def test_domains_of_all_types(spark, kind, literal):
    schema = Schema((Table("domain_values", (C("id", "int", False), C("value", kind))),))
    assert isinstance(Verifier(spark).verify(schema, f"SELECT id FROM domain_values WHERE value = {literal}", f"SELECT id FROM domain_values WHERE {literal} = value"), Equivalent)
    assert isinstance(Verifier(spark).verify(schema, f"SELECT id FROM domain_values WHERE value <> {literal}", "SELECT id FROM domain_values"), Different)
    assert isinstance(Verifier(spark).verify(schema, "SELECT MIN(value) AS m FROM domain_values", "SELECT MAX(value) AS m FROM domain_values"), Different)


def test_three_tables(spark):
    schema = Schema((
        Table("customers", (C("id", "int"), C("active", "bool")), ("id",)), Table("orders", (C("id", "int"), C("customer_id", "int"), C("total", "int")), ("id",)),
    ))
    left = "SELECT o.id FROM customers c JOIN orders o ON c.id = o.customer_id WHERE c.active"
    assert isinstance(Verifier(spark).verify(schema, left, "SELECT o.id FROM orders o JOIN customers c ON o.customer_id = c.id WHERE NOT (NOT c.active)"), Equivalent)
    assert isinstance(Verifier(spark).verify(schema, left, "SELECT o.id FROM orders o JOIN customers c ON o.customer_id = c.id"), Different)


def test_a_sample_can_refute(spark):
    schema = Schema((
        Table("customers", (C("id", "int"), C("active", "bool")), ("id",)), Table("orders", (C("id", "int"), C("customer_id", "int"), C("total", "int")), ("id",)),
        Table("payments", (C("order_id", "int"), C("sequence", "int"), C("amount", "int"), C("settled", "bool")), ("order_id", "sequence")),
    ))
    text = "SELECT o.id, p.amount FROM customers c JOIN orders o ON c.id = o.customer_id JOIN payments p ON p.order_id = o.id WHERE c.active AND NOT (p.amount <= 10)"
    verdict = Verifier(spark, Options(worlds=20_000)).verify(schema, text + " AND p.settled", text)
    assert isinstance(verdict, Different)
    verdict = Verifier(spark, Options(worlds=20_000)).verify(schema, text, text.replace("NOT (p.amount <= 10)", "p.amount > 10 AND p.amount IS NOT NULL"))
    assert verdict.reason == Reason.COMPLEXITY_LIMIT
    verdict = Verifier(spark, Options(rows=1)).verify(schema, text, text.replace("NOT (p.amount <= 10)", "p.amount > 10 AND p.amount IS NOT NULL"))
    assert isinstance(verdict, Equivalent)


def test_scalar_functions(spark):
    schema = Schema((Table("t", (C("id", "int", False), C("name", "text"), C("amount", "num"), C("day", "date"))),))
    v = Verifier(spark, Options(rows=1))
    assert isinstance(v.verify(schema, "SELECT ROUND(amount, 1) AS r FROM t", "SELECT TRUNCATE(amount, 1) AS r FROM t"), (Different, Unsupported))
    assert isinstance(v.verify(schema, "SELECT ROUND(amount) AS r FROM t", "SELECT TRUNCATE(amount, 0) AS r FROM t"), Different)
    assert isinstance(v.verify(schema, "SELECT id FROM t WHERE name LIKE 'a%'", "SELECT id FROM t WHERE name LIKE '%a'"), Different)
    assert isinstance(v.verify(schema, "SELECT id FROM t WHERE day + 1 > DATE '2020-01-01'", "SELECT id FROM t WHERE day > DATE '2020-01-01'"), Different)


def test_many_at_once(spark):
    cases = EQUIVALENT[:4] + DIFFERENT[:4]
    found = Verifier(spark).verify_many(cases, 4)
    assert [type(v) for v in found] == [Equivalent] * 4 + [Different] * 4


def test_work_limit(spark):
    text = "SELECT id FROM items WHERE EXISTS (SELECT 1 AS one FROM items j, items k WHERE EXISTS (SELECT 1 AS one FROM items l, items m WHERE l.id = j.id))"
    v = Verifier(spark, Options(rows=9, intermediate_rows=90)).verify(F3, text, "SELECT id FROM items")
    assert v.reason == Reason.COMPLEXITY_LIMIT
