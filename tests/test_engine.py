"""The engine's own behaviour: empty tables, odd columns, NULLs, exact numbers, constraints."""

import datetime as dt
import json

import duckdb
import pytest

from plumbline.engine import Engine
from plumbline.functions.typing import Policies
from plumbline.operators.compare import bag_difference, list_difference
from plumbline.plans.errors import QueryError
from plumbline.sources.constraints import violations
from plumbline.sources.corpus import read_pairs, schema_of
from plumbline.sources.schema import Check, Column, ForeignKey, Increasing, PrimaryKey, Schema, Table, Unique


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("values_table", spark.createDataFrame([(1, "A", 1.239, True), (2, None, -1.239, None), (3, "", 2.5, False), (4, "héé", -2.5, False)], "id long, name string, amount double, flag boolean"))
    e.register("events", spark.createDataFrame([(1, dt.date(1970, 1, 1)), (2, dt.date(1969, 12, 31)), (3, dt.date(2020, 2, 29)), (4, None)], "id long, day date"))
    e.register("items", spark.createDataFrame([(1, 10, True), (1, None, False), (2, 20, None), (3, None, True)], "id long, value long, flag boolean"))
    e.register("nothing", spark.createDataFrame([], "id long, value long"))
    return e


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rounding_and_strings(engine):
    found = rows(engine.sql("SELECT id, ROUND(amount) AS r, ROUND(amount, 1) AS s, TRUNCATE(amount, 1) AS t, SIGN(amount) AS g, LENGTH(name) AS l, name || 'x' AS c, name LIKE '%' AS k FROM values_table"))
    assert found == [(1, 1.0, 1.2, 1.2, 1, 1, "Ax", True), (2, -1.0, -1.2, -1.2, -1, None, None, None), (3, 3.0, 2.5, 2.5, 1, 0, "x", True), (4, -3.0, -2.5, -2.5, -1, 3, "hééx", True)]


def test_dates(engine):
    found = rows(engine.sql("SELECT id, WEEKDAY(day) AS w, DAYOFWEEK(day) AS d, TO_DAYS(day) AS t, LAST_DAY(day) AS l FROM events"))
    assert found[:3] == [(1, 3, 5, 719528, dt.date(1970, 1, 31)), (2, 2, 4, 719527, dt.date(1969, 12, 31)), (3, 5, 7, 737849, dt.date(2020, 2, 29))]
    assert found[3][1:] == (None,) * 4


def test_empty_tables(engine):
    assert rows(engine.sql("SELECT COUNT(*) AS n, SUM(value) AS s FROM nothing")) == [(0, None)]
    assert rows(engine.sql("SELECT id, COUNT(*) AS n FROM nothing GROUP BY id")) == []
    assert rows(engine.sql("SELECT id, (SELECT COUNT(*) FROM nothing n WHERE n.id = i.id) AS c FROM items i WHERE i.id NOT IN (SELECT id FROM nothing)")) == [(1, 0), (1, 0), (2, 0), (3, 0)]
    assert rows(engine.sql("SELECT (SELECT MAX(value) FROM nothing) AS m")) == [(None,)]


def test_nulls_group_together(engine):
    assert rows(engine.sql("SELECT value, COUNT(*) AS n FROM items GROUP BY value")) == [(10, 1), (20, 1), (None, 2)]
    assert rows(engine.sql("SELECT value FROM items UNION SELECT value FROM items")) == [(10,), (20,), (None,)]


def test_clashing_names(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, 2, [3], "x")], "`c1` long, `__k0` long, `list` array<long>, `position` string"))
    assert rows(e.sql("SELECT t.*, t.c1 + 1 AS c2 FROM t JOIN t u ON t.c1 = u.c1")) == [(1, 2, "x", 2)]
    with pytest.raises(QueryError):
        e.sql("SELECT list FROM t")


def test_first_row_grouping(spark):
    e = Engine(spark, Policies(first_row_grouping=True))
    e.register("t", spark.createDataFrame([(1, None), (1, 5), (2, 6)], "k long, v long").coalesce(1))
    assert rows(e.sql("SELECT k, v FROM t GROUP BY k")) == [(1, None), (2, 6)]


def test_exact_division(spark):
    e = Engine(spark, exact=True).register("t", spark.createDataFrame([(1, 3), (1, 0)], "a long, b long"))
    found = rows(e.sql("SELECT a / b AS q, AVG(a) OVER (PARTITION BY b) AS m FROM t"))
    assert str(found[0][0]) == "0.333333333333333333" and found[1][0] is None


def test_correlated_in_all_places(engine):
    found = rows(engine.sql("SELECT i.id, i.value IN (SELECT j.value FROM items j WHERE j.id <> i.id) AS x FROM items i"))
    assert found == [(1, None), (1, None), (2, None), (3, None)]
    text = "SELECT i.id FROM items i WHERE CASE WHEN EXISTS (SELECT 1 AS one FROM items j WHERE j.id > i.id AND (SELECT COUNT(*) FROM items k WHERE k.id = i.id AND k.id < j.id) > 1) THEN TRUE ELSE FALSE END"
    assert rows(engine.sql(text)) == [(1,), (1,)]


def test_set_operations_keep_multiplicity(engine):
    assert rows(engine.sql("SELECT value FROM items EXCEPT ALL SELECT value FROM items WHERE flag")) == [(20,), (None,)]
    assert rows(engine.sql("SELECT id FROM items INTERSECT ALL SELECT id FROM items WHERE value IS NULL")) == [(1,), (3,)]


def test_differences(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k long, s string")
    b = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k long, s string")
    assert rows(bag_difference(a, b)) == [(1, None, 1), (3, "y", -1)]
    assert rows(list_difference(a, b, [a.k.asc()], [b.k.asc()])) == [(2,), (3,)]


def test_constraints(spark):
    schema = Schema(
        (Table("p", (Column("id", "int"), Column("kind", "enum", True, ("a", "b"))), ("id",)), Table("c", (Column("pid", "int"), Column("n", "int"), Column("seq", "int")))),
        (ForeignKey("c", ("pid",), "p", ("id",)), Unique("c", ("n",)), Check("c.n > 0"), Check("implies(p.id = c.pid, c.n < 5)"), Increasing("c", "seq", True)),
    ).validate()
    frames = {
        "p": spark.createDataFrame([(1, "a"), (1, "z"), (None, None)], "id long, kind string"),
        "c": spark.createDataFrame([(1, 1, 1), (2, 1, 2), (None, -1, 4), (1, 7, 5)], "pid long, n long, seq long").coalesce(1),
    }
    found = {name: df.count() for name, df in violations(frames, schema)}
    assert found == {"not null p": 1, "enum p.kind": 1, "primary key p": 1, "foreign key c": 1, "unique c": 1, "check c.n > 0": 1, "check implies(p.id = c.pid, c.n < 5)": 2, "sequence c": 1}
    assert schema.keys(schema.table("p")) == [("id",)]
    assert PrimaryKey("p", ("id",)) != Unique("p", ("id",))


def test_corpus(spark, tmp_path):
    record = {"file": "a.sql", "index": 1, "schema": {"ITEMS": {"ID": "INT", "STATE": "ENUM,OPEN,CLOSED"}}, "constraint": [{"primary": [{"value": "ITEMS__ID"}]}], "pair": ["SELECT ID FROM ITEMS", "SELECT STATE FROM ITEMS"]}
    path = tmp_path / "pairs.jsonl"
    path.write_text(json.dumps(record) + "\n")
    found = read_pairs(spark, str(path)).collect()
    assert found[0].file == "a.sql" and found[0]["pair"] == record["pair"]
    schema = schema_of(found[0].schema, found[0].constraint)
    assert [c.type for c in schema.tables[0].columns] == ["int", "enum"] and schema.keys(schema.tables[0]) == [("id",)]


def test_corpus_constraints():
    made = schema_of(json.dumps({"T": {"A": "INT", "B": "DATE", "C": "enum,X,NULL,Y"}, "U": {"A": "INT"}}), json.dumps([
        {"foreign": [{"value": "T__A"}, {"value": "U__A"}]}, {"inc": {"value": "U__A"}}, {"consec": "U__A"}, {"gt": ["T__A", 3]}, {"between": [{"value": "T__B"}, {"date": "2020-01-01"}, {"date": "2020-02-01"}]},
        {"in": [{"value": "T__C"}, [{"literal": "X"}, "Y"]]}, {"imply": [{"eq": ["T__A", 1]}, {"neq": ["U__A", 2]}]},
    ]))
    assert made.tables[0].columns[2].domain == ("X", "Y")
    checks = [c.predicate for c in made.constraints if isinstance(c, Check)]
    assert checks == ["t.a > 3", "t.b BETWEEN DATE '2020-01-01' AND DATE '2020-02-01'", "t.c IN ('X', 'Y')", "implies(t.a = 1, u.a <> 2)"]
    assert made.constraints[:3] == (ForeignKey("t", ("a",), "u", ("a",)), Increasing("u", "a"), Increasing("u", "a", True))
    for bad in ([{"nope": []}], [{"gt": ["T__A", 1.5]}], [{}], [{"primary": ["T__A", "U__A"]}]):
        with pytest.raises(QueryError):
            schema_of(json.dumps({"T": {"A": "INT"}, "U": {"A": "INT"}}), json.dumps(bad))


def test_streams(spark, tmp_path):
    from plumbline.streaming import continuous

    spark.createDataFrame([(1, 5), (2, None)], "id long, value long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, value long").parquet(str(tmp_path / "in"))
    e = Engine(spark).register("s", stream)
    query = continuous(e, "SELECT id + 1 AS k FROM s WHERE value > 1").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("seen")) == [(2,)]
    with pytest.raises(QueryError):
        continuous(e, "SELECT COUNT(*) AS n FROM s")


MANY = {
    "SELECT a.id, COUNT(*) AS n FROM m a JOIN m b ON a.k = b.k GROUP BY a.id": "joined once",
    "SELECT COUNT(*) AS n, COUNT(a.v) AS p, COUNT(b.v) AS q, COUNT(DISTINCT a.v, b.k) AS d, MIN(a.v + b.v) AS l, MAX(b.v) AS h FROM m a, m b WHERE a.k = b.k AND b.v > 0": "joined once",
    "SELECT a.k, COUNT(b.v) AS n FROM m a JOIN m b ON a.k = b.k AND a.v < b.v GROUP BY a.k": "joined once",
    "SELECT a.k + 1 AS x, COUNT(*) AS n FROM m a JOIN (SELECT k AS j, v + 1 AS w FROM m WHERE v IS NOT NULL) b ON a.k = b.j JOIN m c ON c.k = b.j GROUP BY a.k + 1 HAVING COUNT(*) > 2": "joined once",
    "SELECT a.k, COUNT(*) AS n FROM m a, none b GROUP BY a.k": "joined once",
    "SELECT COUNT(*) AS n, MAX(a.v) AS h FROM m a, none b": "joined once",
    "SELECT a.k, SUM(b.v) AS n FROM m a JOIN m b ON a.k = b.k GROUP BY a.k": "as it is",
    "SELECT a.id, COUNT(*) AS n FROM m a JOIN m b ON a.id = b.id GROUP BY a.id": "as it is",
    "SELECT a.id, COUNT(b.k) AS n FROM m a LEFT JOIN m b ON a.k = b.k GROUP BY a.id": "as it is",
}


@pytest.mark.parametrize("text", sorted(MANY))
def test_counts_over_joins_of_many_with_many(spark, text):
    found = [(i, i % 4 if i % 5 else None, i % 3 if i % 7 else None) for i in range(40)]
    e = Engine(spark)
    e.register("m", spark.createDataFrame(found, "id long, k long, v long"), ("id",))
    e.register("none", spark.createDataFrame([], "id long"), ("id",))
    duck = duckdb.connect()
    duck.execute("CREATE TABLE m (id BIGINT, k BIGINT, v BIGINT)")
    duck.executemany("INSERT INTO m VALUES (?, ?, ?)", found)
    duck.execute("CREATE TABLE none (id BIGINT)")
    df = e.sql(text)
    same = text.replace("COUNT(DISTINCT a.v, b.k)", "COUNT(DISTINCT CASE WHEN a.v IS NOT NULL AND b.k IS NOT NULL THEN (a.v, b.k) END)")
    assert rows(df) == sorted(duck.execute(same).fetchall(), key=repr)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join ") :] if "Join " in plan else ""
    assert "Aggregate" in below or not below if MANY[text] == "joined once" else "Aggregate" not in below


def test_counts_of_large_groups(spark):
    """9 * 10**10 joined rows, far more than can be made one by one."""
    e = Engine(spark)
    e.register("big", spark.range(300_000).selectExpr("id", "0 AS k"), ("id",))
    df = e.sql("SELECT a.k, COUNT(*) AS n, COUNT(DISTINCT b.k) AS d FROM big a JOIN big b ON a.k = b.k GROUP BY a.k")
    assert "Aggregate" in df._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1]
    assert rows(df) == [(0, 90_000_000_000, 1)]
