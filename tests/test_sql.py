"""SELECT over small tables, with the rows written out."""

import datetime as dt

import pytest

from brindle import errors as E
from brindle.engine import Engine


@pytest.fixture(scope="module")
def db(spark):
    e = Engine(spark)
    e.attach("people", spark.createDataFrame([("u1", "ana", "ana@x.com", 30), ("u2", "bob", "bob@x.com", 25), ("u3", "eva", None, 41)], "id string, name string, mail string, age int"))
    e.attach("buys", spark.createDataFrame([("o1", "u1", 100, "first"), ("o2", "u1", 250, "second"), ("o3", "u2", 75, "only"), ("o4", "u9", 999, "orphan")], "id string, who string, price bigint, note string"))
    e.attach("marks", spark.createDataFrame([("o1", "gift")], "buy string, mark string"))
    deals = [("north", "ana", 100, 1.5), ("north", "bob", 200, 2.5), ("north", None, None, None), ("south", "eva", 50, 4.0), ("south", "gil", 350, None), ("west", "ana", 75, 3.0)]
    e.attach("deals", spark.createDataFrame(deals, "area string, seller string, price bigint, score double"))
    e.attach("t", spark.createDataFrame([("a", 1), ("b", 2), (None, None)], "name string, n bigint"))
    e.attach("events", spark.createDataFrame([("kickoff", dt.date(2026, 1, 5), dt.datetime(2026, 1, 5, 9)), ("review", dt.date(2026, 2, 1), dt.datetime(2026, 2, 1, 10, 30)), ("tbd", None, None)], "name string, day date, at timestamp_ntz"))
    return e


def rows(db, sql, params=None):
    return db.query(sql, params).rows


@pytest.mark.parametrize(
    "sql, want",
    [
        ("SELECT name FROM people WHERE age >= 30 ORDER BY name", [["ana"], ["eva"]]),
        ("SELECT name FROM people WHERE 30 <= age ORDER BY age DESC", [["eva"], ["ana"]]),
        ("SELECT name AS n, name FROM people WHERE id = 'u2'", [["bob", "bob"]]),
        ("SELECT name FROM people WHERE mail IS NULL", [["eva"]]),
        ("SELECT name FROM people WHERE mail = NULL", []),
        ("SELECT name FROM people WHERE NOT (age < 30 OR name = 'eva')", [["ana"]]),
        ("SELECT name FROM people WHERE age IN (25, 41) ORDER BY name", [["bob"], ["eva"]]),
        ("SELECT name FROM t WHERE n NOT IN (1, NULL)", []),
        ("SELECT name FROM t WHERE n IN (1, NULL)", [["a"]]),
        ("SELECT name FROM t WHERE n NOT IN (1)", [["b"]]),
        ("SELECT name FROM people WHERE 1 = 1 ORDER BY id LIMIT 1 OFFSET 1", [["bob"]]),
        ("SELECT n FROM t ORDER BY n", [[None], [1], [2]]),
        ("SELECT n FROM t ORDER BY n DESC", [[2], [1], [None]]),
        ("SELECT name FROM people ORDER BY age LIMIT 0", []),
        ("SELECT u.name, o.price FROM people u JOIN buys o ON o.who = u.id ORDER BY o.price", [["bob", 75], ["ana", 100], ["ana", 250]]),
        ("SELECT u.name, o.price FROM people u LEFT JOIN buys o ON u.id = o.who ORDER BY u.name, o.price", [["ana", 100], ["ana", 250], ["bob", 75], ["eva", None]]),
        ("SELECT u.name, o.price FROM people u RIGHT JOIN buys o ON u.id = o.who ORDER BY o.price", [["bob", 75], ["ana", 100], ["ana", 250], [None, 999]]),
        ("SELECT u.name, t.mark FROM people u JOIN buys o ON o.who = u.id JOIN marks t ON t.buy = o.id", [["ana", "gift"]]),
        ("SELECT a.name, b.name FROM people a JOIN people b ON a.id = b.id WHERE a.age < b.age", []),
        ("SELECT u.name FROM people u LEFT JOIN buys o ON u.id = o.who WHERE o.price > 100", [["ana"]]),
        ("SELECT count(*), count(seller), count(DISTINCT seller), sum(price), avg(score), min(seller), max(price) FROM deals", [[6, 5, 4, 775, 2.75, "ana", 350]]),
        ("SELECT area, count(*) AS n, sum(price) AS total FROM deals GROUP BY area ORDER BY total DESC", [["south", 2, 400], ["north", 3, 300], ["west", 1, 75]]),
        ("SELECT area FROM deals GROUP BY area HAVING count(*) > 1 AND sum(price) > 300", [["south"]]),
        ("SELECT seller, count(*) FROM deals GROUP BY seller ORDER BY seller LIMIT 2", [[None, 1], ["ana", 2]]),
        ("SELECT count(*) FROM deals WHERE price > 10000", [[0]]),
        ("SELECT sum(price), avg(price), min(seller) FROM deals WHERE price > 10000", [[None, None, None]]),
        ("SELECT count(*) FROM deals HAVING count(*) > 100", []),
        ("SELECT name FROM events WHERE day >= '2026-01-10'", [["review"]]),
        ("SELECT name FROM events WHERE at < '2026-01-05T10:00:00Z'", [["kickoff"]]),
        ("SELECT name FROM people WHERE age = 30.0", [["ana"]]),
    ],
)
def test_rows(db, sql, want):
    assert rows(db, sql) == want


def test_headers(db):
    assert db.query("SELECT * FROM people u JOIN marks t ON t.buy = u.id").columns == ["u.id", "u.name", "u.mail", "u.age", "t.buy", "t.mark"]
    assert db.query("SELECT count(*), sum(price), count(DISTINCT seller), max(s.score) FROM deals s").columns == ["count(*)", "sum(price)", "count(distinct seller)", "max(s.score)"]
    assert db.query("SELECT *, name FROM people").columns == ["id", "name", "mail", "age", "name"]


def test_sum_past_64_bits(spark):
    e = Engine(spark)
    top = (1 << 63) - 1
    e.attach("o", spark.createDataFrame([(top,), (top,), (-top,)], "n bigint"))
    assert rows(e, "SELECT sum(n) FROM o") == [[top]]
    with pytest.raises(Exception, match="(?i)overflow|out of range|cannot be"):
        rows(e, "SELECT sum(n) FROM o WHERE n > 0")


def test_outer_pushdown_flag(spark, db):
    e = Engine(spark, compat_outer_pushdown=True)
    e.attached = db.attached
    sql = "SELECT u.name, o.price FROM people u LEFT JOIN buys o ON u.id = o.who WHERE o.price > 100 ORDER BY u.name"
    assert rows(e, sql) == [["ana", 250], ["bob", None], ["eva", None]]
    assert rows(db, sql) == [["ana", 250]]


def test_params(db):
    assert rows(db, "SELECT name FROM people WHERE age = ? AND id = ?", [30, "u1"]) == [["ana"]]
    assert rows(db, "SELECT name FROM people WHERE age > %(a)s AND age > %(a)s LIMIT %(n)s", {"a": 30, "n": 5}) == [["eva"]]
    assert rows(db, "SELECT name FROM people WHERE name = %s", ["x' OR '1'='1"]) == []
    assert rows(db, "SELECT name FROM events WHERE day = ?", [dt.date(2026, 2, 1)]) == [["review"]]
    for sql, params, word in [
        ("SELECT name FROM people WHERE age = ?", [], "placeholders"),
        ("SELECT name FROM people WHERE age = ?", [1, 2], "no placeholder"),
        ("SELECT name FROM people WHERE age = %(a)s", {"b": 1}, "no value"),
        ("SELECT name FROM people WHERE age = %(a)s AND id = ?", {"a": 1}, "mixed"),
    ]:
        with pytest.raises(E.SqlError, match=word):
            db.query(sql, params)


@pytest.mark.parametrize(
    "sql, word",
    [
        ("SELECT * FROM people FULL OUTER JOIN buys ON o.memo = u.name", "FULL OUTER"),
        ("SELECT * FROM people CROSS JOIN buys", "CROSS JOIN"),
        ("SELECT * FROM (SELECT * FROM people)", "subqueries"),
        ("SELECT * FROM people WHERE id IN (SELECT id FROM people)", "subqueries"),
        ("WITH w AS (SELECT 2) SELECT name FROM w", "CTEs"),
        ("SELECT name FROM people WHERE COUNT(*) > 7", "HAVING"),
        ("SELECT SUM(*) FROM people", r"only COUNT accepts \*"),
        ("SELECT SUM(DISTINCT age) FROM people", "only COUNT accepts DISTINCT"),
        ("SELECT name FROM people UNION SELECT name FROM people", "UNION"),
        ("SELECT DISTINCT name FROM people", "DISTINCT"),
        ("SELECT age + 1 FROM people", "arithmetic"),
        ("SELECT name FROM people WHERE age - 2 = 28", "arithmetic"),
        ("SELECT name FROM people WHERE name LIKE '%n%'", "LIKE"),
        ("SELECT name FROM people WHERE age BETWEEN 1 AND 99", "BETWEEN"),
        ("SELECT name FROM people ORDER BY upper(mail)", "use search_vector"),
        ("SELECT CASE FROM people", "CASE"),
        ("SELECT count(*) OVER FROM people", "window"),
        ("SELECT name FROM people LIMIT 3, 4", "LIMIT count OFFSET offset"),
        ("SELECT name FROM people OFFSET 3", "OFFSET is only allowed after LIMIT"),
        ("SELECT name FROM people FOR UPDATE", "row locking"),
        ("SELECT u.* FROM people u", "qualified star"),
        ("SELECT * FROM people u JOIN buys o ON o.who = u.id AND o.price < 9", "single column equality"),
        ("SELECT name FROM people; SELECT name FROM people", "one statement"),
        ("SELECT name FROM people ORDER BY name COLLATE klingon", "unknown collation"),
        ("SELECT name, count(*) FROM people GROUP BY name ORDER BY count(*)", "alias"),
        ("REPLACE INTO people (id, age) VALUES ('k', 3)", "REPLACE INTO"),
        ("TRUNCATE TABLE people", "TRUNCATE"),
        ("BEGIN", "Txn API"),
        ("DROP VIEW v", "views"),
        ("DROP INDEX idx", r"DROP INDEX ON table \(column\)"),
        ("ALTER TABLE people", "expected ADD, DROP or RENAME"),
        ("ALTER TABLE people ALTER COLUMN age TYPE text", "not supported"),
        ("DROP TABLE people CASCADE", "CASCADE"),
        ("CREATE TABLE x (a boolean)", "use bool"),
        ("CREATE TABLE x (a int UNIQUE)", "CREATE UNIQUE INDEX"),
        ("EXPLAIN UPDATE people SET age = 1", "EXPLAIN is only supported for SELECT"),
        ("EXPLAIN ANALYZE SELECT * FROM people", "EXPLAIN ANALYZE is not supported"),
        ("SELECT name FROM people WHERE " + "(" * 70 + "age = 1" + ")" * 70, "nested deeper"),
        ("SELECT name FROM people WHERE age = 'x'", "cannot compare"),
        ("SELECT name FROM people WHERE active", "bare column"),
        ("SELECT name, age FROM people GROUP BY name", "must appear in GROUP BY"),
        ("SELECT sum(name) FROM people", "SUM needs"),
        ("SELECT name FROM people a JOIN people a ON a.id = a.id", "duplicate table alias"),
        ("SELECT id FROM people a JOIN people b ON a.id = b.id", "ambiguous"),
    ],
)
def test_refused(db, sql, word):
    with pytest.raises(E.SqlError, match=word):
        db.query(sql)


def test_unknown_names(db):
    with pytest.raises(E.TableNotFound):
        db.query("SELECT * FROM missing")
    with pytest.raises(E.ColumnNotFound, match="unknown column 'nope'"):
        db.query("SELECT nope FROM people")


def test_parser_never_breaks():
    import random

    from brindle.dialect.parser import parse

    words = "SELECT FROM WHERE a b , ( ) = 'x' 1 AND OR NOT IN JOIN ON GROUP BY count * . ORDER LIMIT ? %s INSERT INTO VALUES UPDATE SET".split()
    rnd = random.Random(5)
    for _ in range(3000):
        try:
            parse(" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 14))))
        except E.EngineError:
            pass


def test_collation(spark):
    from brindle.functions.collation import python_key

    e = Engine(spark)
    names = ["Zorro", "ñame", "árbol", "Ana", "acto", "Ñuble", "nuez", "Àb", "ab", "áb", "Ab", "", "œuvre", "straße"]
    e.attach("c", spark.createDataFrame([(n,) for n in names], "n string"))
    assert [r[0] for r in rows(e, "SELECT n FROM c ORDER BY n")] == sorted(names, key=python_key)
    known = ["acto", "Ana", "árbol", "nuez", "ñame", "Ñuble", "Zorro"]
    assert [n for n in sorted(names, key=python_key) if n in known] == known
    assert [r[0] for r in rows(e, "SELECT n FROM c ORDER BY n COLLATE binary DESC")] == sorted(names, key=str.encode, reverse=True)


def test_cursor(db):
    c = db.cursor("SELECT name, age FROM people WHERE age > ? LIMIT 2", [1])
    assert c.columns == ["name", "age"] and len(c.fetchmany(1)) == 1 and len(c.fetchall()) == 1 and c.fetchone() is None
    with pytest.raises(E.SqlError):
        db.cursor("SELECT name FROM people ORDER BY name")


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS v", "'x' AS w").write.parquet(str(tmp_path / "t.parquet"))
    e = Engine(spark).attach_parquet(str(tmp_path), "t")
    plan = e.sql("SELECT v FROM t WHERE id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,7)" in plan and "w:string" not in plan
