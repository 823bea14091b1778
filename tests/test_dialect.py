"""What the dialect refuses, and why."""

import pytest

from plumbline.functions.typing import Policies
from plumbline.plans.binder import Binder
from plumbline.plans.errors import QueryError, Reason
from plumbline.plans.syntax import parse
from plumbline.sources.schema import Column, Schema, Table

SCHEMA = Schema((
    Table("items", (Column("id", "int", False), Column("value", "int"), Column("flag", "bool"), Column("name", "text"), Column("day", "date"), Column("amount", "num"), Column("state", "enum", True, ("OPEN", "CLOSED")))),
    Table("keyed", (Column("id", "int"), Column("value", "int")), ("id",)),
))


def reason(text, policies=None):
    with pytest.raises(QueryError) as e:
        Binder(SCHEMA, policies).bind(parse(text))
    return e.value.reason


def bind(text, policies=None):
    return Binder(SCHEMA, policies).bind(parse(text))


@pytest.mark.parametrize("text", ["SELECT", "SELECT FROM items", "SELECT id id id FROM items", "SELECT id FROM items WHERE", "SELECT 'a", "SELECT id FROM items)", "SELECT CASE END FROM items", "SELECT 1a FROM items"])
def test_parse_errors(text):
    assert reason(text) == Reason.PARSE_ERROR


@pytest.mark.parametrize("text", [
    "SELECT nothing FROM items", "SELECT x.id FROM items", "SELECT id FROM missing", "SELECT id FROM items a, items b",
    "SELECT id FROM items ORDER BY value", "SELECT id FROM items ORDER BY 2", "SELECT id FROM items GROUP BY 2", "SELECT * FROM items i, keyed i",
    "WITH a AS (SELECT 1 AS x), a AS (SELECT 2 AS x) SELECT x FROM a", "SELECT id FROM items JOIN keyed USING (nothing)", "SELECT x.* FROM items",
    "SELECT a FROM (SELECT id, value FROM items) t (a)",
])
def test_name_errors(text):
    assert reason(text) == Reason.NAME_RESOLUTION


@pytest.mark.parametrize("text", [
    "SELECT NULL", "SELECT id FROM items WHERE id", "SELECT id = name FROM items", "SELECT flag < TRUE FROM items", "SELECT flag BETWEEN FALSE AND TRUE FROM items",
    "SELECT id FROM items UNION SELECT amount FROM items", "SELECT id FROM items UNION SELECT id, value FROM items", "SELECT value FROM items GROUP BY flag",
    "SELECT name + 1 FROM items", "SELECT SUM(name) FROM items", "SELECT id, COUNT(*) FROM items", "SELECT id IN (SELECT name FROM items) FROM items",
    "SELECT id IN (SELECT id, value FROM keyed) FROM items", "SELECT (id, value) = (1, 2, 3) FROM items", "SELECT CASE WHEN flag THEN 1 ELSE 'a' END FROM items",
    "SELECT day = 'tomorrow' FROM items", "SELECT amount % 2 FROM items", "SELECT CAST(name AS INTEGER) FROM items", "SELECT id = amount FROM items",
    "SELECT LENGTH(id) FROM items", "SELECT ABS(name) FROM items", "SELECT COUNT(id, value) FROM items", "SELECT (SELECT id, value FROM keyed LIMIT 1) FROM items",
])
def test_type_errors(text):
    assert reason(text) == Reason.TYPE_ERROR


@pytest.mark.parametrize("text", [
    "INSERT INTO items VALUES (1)", "VALUES (1)", 'SELECT "id" FROM items', "SELECT id FROM main.items", "SELECT id FROM items FETCH FIRST 1 ROWS ONLY",
    "SELECT id FROM items LIMIT 1 + 1", "SELECT DISTINCT ON (id) id FROM items", "SELECT id FROM items MINUS SELECT id FROM keyed", "WITH RECURSIVE a AS (SELECT 1 AS x) SELECT x FROM a",
    "SELECT id FROM items, LATERAL (SELECT 1 AS one) t", "SELECT id FROM (SELECT id FROM items)", "SELECT id FROM items LEFT JOIN keyed", "SELECT id FROM items LEFT SEMI JOIN keyed ON TRUE",
    "SELECT id FROM items a CROSS JOIN keyed b ON a.id = b.id", "SELECT COUNT(*) FROM items GROUP BY ALL", "SELECT COUNT(*) FROM items GROUP BY ROLLUP (id)", "SELECT id FROM items GROUP BY GROUPING SETS ((id))",
    "SELECT SUM(id) FILTER (WHERE flag) FROM items", "SELECT COUNT(DISTINCT *) FROM items", "SELECT SUM(MAX(id)) FROM items", "SELECT id FROM items WHERE MAX(id) > 1", "SELECT MEDIAN(id) FROM items",
    "SELECT LAG(id) OVER (ORDER BY id) FROM items", "SELECT SUM(id) OVER (ORDER BY id ROWS 1 PRECEDING) FROM items", "SELECT SUM(id) OVER w FROM items WINDOW w AS ()", "SELECT ROW_NUMBER() FROM items",
    "SELECT RANK() OVER (ORDER BY id), COUNT(*) FROM items", "SELECT FIRST_VALUE(id) OVER () FROM items", "SELECT COUNT(DISTINCT id, value) OVER () FROM items",
    "SELECT name LIKE 'a_c' FROM items", "SELECT name LIKE 'a%c' FROM items", "SELECT name LIKE name FROM items", "SELECT name LIKE 'a' ESCAPE 'b' FROM items", "SELECT (1, 2) < (3, 4)",
    "SELECT id > ALL (SELECT id FROM keyed) FROM items", "SELECT (SELECT id FROM keyed) FROM items", "SELECT UPPER(name) FROM items", "SELECT TRY_CAST(id AS BOOLEAN) FROM items", "SELECT CAST(id AS BLOB) FROM items",
    "SELECT day + INTERVAL '1' MONTH FROM items", "SELECT TIMESTAMP '2020-01-01'", "SELECT POWER(id, 9) FROM items", "SELECT LEFT(name, id) FROM items", "SELECT EXTRACT(HOUR FROM day) FROM items",
    "SELECT id FROM items ORDER BY COUNT(*)", "SELECT DATE_FORMAT(day, '%Y') FROM items", "SELECT CAST(id AS DOUBLE) FROM items", "SELECT id FROM items ORDER BY ALL", "SELECT id FROM items FOR UPDATE", "SELECT ? FROM items",
])
def test_unsupported(text):
    assert reason(text) == Reason.UNSUPPORTED_SQL


def test_depth_limit():
    text = "SELECT 1 AS one"
    for _ in range(9):
        text = f"SELECT 1 AS one FROM items WHERE EXISTS ({text})"
    assert reason(text) == Reason.COMPLEXITY_LIMIT


def test_row_limit():
    with pytest.raises(QueryError) as e:
        Binder(SCHEMA, None, 3, 10).bind(parse("SELECT a.id FROM items a, items b, items c"))
    assert e.value.reason == Reason.COMPLEXITY_LIMIT and e.value.reason.is_resource_limit


def test_accepted():
    assert bind("SELECT id, value, COUNT(*) AS n FROM keyed GROUP BY id").types == ["int", "int", "int"]
    assert bind("SELECT k.* FROM items i JOIN keyed k USING (id)").names == ["value", "id"]
    assert bind("SELECT state = 'OPEN' AS x, day > '2020-01-01' AS y, amount = 1 AS z, id / 2 AS w FROM items").types == ["bool", "bool", "bool", "num"]
    assert bind("SELECT id AS x FROM items i ORDER BY i.id").ordered
    assert not bind("SELECT id FROM items ORDER BY id", Policies(ignore_top_level_order=True)).ordered
    assert bind("SELECT ITEMS.Id FROM Items").names == ["id"]


def test_grouping_follows_dependencies():
    bind("SELECT k.id, k.value, COUNT(*) AS n FROM keyed k JOIN items i ON k.id = i.value GROUP BY i.value")
    bind("SELECT value, COUNT(*) AS n FROM items WHERE value = 5 GROUP BY flag")
    bind("SELECT t.id, t.v FROM (SELECT id, value + 1 AS v FROM keyed) t GROUP BY t.id")
    # a constant of the side that an outer join fills with NULLs is no constant
    assert reason("SELECT t.x FROM keyed k LEFT JOIN (SELECT id, 5 AS x FROM keyed WHERE id = 1) t ON k.value = t.id GROUP BY k.value") == Reason.TYPE_ERROR
    bind("SELECT value FROM items GROUP BY flag", Policies(first_row_grouping=True))


def test_coercion_policy():
    mysql = Policies(mysql_coercion=True)
    bind("SELECT id FROM items WHERE id AND amount", mysql)
    bind("SELECT SUM('1.5') AS a, CAST(id AS DOUBLE) AS b, DATE_FORMAT(day, '%Y') AS c, id = 2.0 AS d FROM items GROUP BY id, day", mysql)
