"""Definitions, row changes, constraints, transactions, search and files on a real root."""

import datetime as dt
import random

import pytest

from brindle import errors as E
from brindle.engine import Engine, new_id


@pytest.fixture
def db(spark, tmp_path):
    return Engine(spark, tmp_path / "db")


def rows(db, sql, params=None):
    return db.query(sql, params).rows


def test_ids_increase():
    ids = [new_id() for _ in range(1000)]
    assert ids == sorted(set(ids)) and all(len(x) == 26 for x in ids)


def test_types_round_trip(db):
    db.query("CREATE TABLE a (b bool, i int, f float64, s text NOT NULL, bl blob, ts timestamp, d date, t time, j json, v vector(3), e enum('x','y') DEFAULT 'x', c varchar(3))")
    db.query("INSERT INTO a (b,i,f,s,bl,ts,d,t,j,v,c) VALUES (TRUE,-5,2,'it''s',X'DEADBEEF','2026-01-02T03:04:05.5Z','2026-02-28','23:59:59','{\"b\": 1, \"a\": [2]}','[1,2,3]','abc')")
    got = db.query("SELECT * FROM a").rows[0][1:]
    assert got == [True, -5, 2.0, "it's", b"\xde\xad\xbe\xef", dt.datetime(2026, 1, 2, 3, 4, 5, 500000), dt.date(2026, 2, 28), dt.time(23, 59, 59), {"a": [2], "b": 1}, [1.0, 2.0, 3.0], "x", "abc"]
    assert rows(db, "SELECT s FROM a WHERE j = '{\"a\":[2],\"b\":1}'") == [["it's"]]
    assert rows(db, "SELECT s FROM a WHERE t > '12:00:00' AND bl = X'deadbeef'") == [["it's"]]
    for sql in ["INSERT INTO a (s) VALUES (NULL)", "INSERT INTO a (s, c) VALUES ('x','abcd')", "INSERT INTO a (s, e) VALUES ('x','z')", "INSERT INTO a (s, v) VALUES ('x','[1,2]')", "INSERT INTO a (s, d) VALUES ('x','2026-02-30')", "INSERT INTO a (s, i) VALUES ('x','5')", "INSERT INTO a (s, j) VALUES ('x','{')"]:
        with pytest.raises(E.SchemaViolation):
            db.query(sql)
    assert rows(db, "SELECT count(*) FROM a") == [[1]]


def test_insert_update_delete(db):
    db.query("CREATE TABLE u (name text NOT NULL, email text, age int, score float64)")
    db.query("CREATE UNIQUE INDEX ON u (email)")
    r = db.query("INSERT INTO u (name, email, age, score) VALUES ('ana','a@x',30,1.5),('bob','b@x',25,NULL),('eva',NULL,41,2)")
    assert r.count == 3 and r.to_json() == {"inserted": 3}
    with pytest.raises(E.UniqueViolation):
        db.query("INSERT INTO u (name, email) VALUES ('x','a@x')")
    assert db.query("INSERT IGNORE INTO u (name, email) VALUES ('x','a@x'),('y','y@x'),('z','y@x'),('n',NULL)").count == 2
    assert db.query("UPDATE u SET age = age + 1, score = 9 WHERE age > 25").count == 2
    assert rows(db, "SELECT name, age, score FROM u ORDER BY name LIMIT 3") == [["ana", 31, 9.0], ["bob", 25, None], ["eva", 42, 9.0]]
    assert db.query("UPDATE u SET age = age / 4 WHERE name = 'ana'").count == 1 and rows(db, "SELECT age FROM u WHERE name = 'ana'") == [[7]]
    with pytest.raises(E.SqlError, match="division by zero"):
        db.query("UPDATE u SET age = age / 0")
    with pytest.raises(E.SqlError, match="overflow"):
        db.query("UPDATE u SET age = age * 9223372036854775807 WHERE name = 'ana'")
    with pytest.raises(E.UniqueViolation):
        db.query("UPDATE u SET email = 'same'")
    assert db.query("DELETE FROM u WHERE age = NULL").count == 0
    assert db.query("DELETE FROM u WHERE age > 1").count == 3
    assert sorted(x[0] for x in rows(db, "SELECT name FROM u")) == ["n", "y"]
    id = db.insert("u", {"name": "zoe"})
    assert db.get("u", id)["name"] == "zoe" and db.update("u", id, {"age": 3}) and db.get("u", id)["age"] == 3
    assert db.delete("u", id) and not db.delete("u", id) and db.get("u", id) is None


def test_identity_and_returning(db):
    db.query("CREATE TABLE d (doc_id int AUTO_INCREMENT, title text NOT NULL)")
    assert db.query("INSERT INTO d (title) VALUES ('a'),('b')").identity == ("doc_id", [1, 2])
    r = db.query("INSERT INTO d (title) VALUES ('c') RETURNING *")
    assert r.columns == ["id", "doc_id", "title"] and r.rows[0][1:] == [3, "c"] and r.lastrowid == 3
    db.query("INSERT INTO d (doc_id, title) VALUES (10, 'd')")
    assert db.query("INSERT INTO d VALUES ('e')").lastrowid == 11
    with pytest.raises(E.SchemaViolation):
        db.query("UPDATE d SET doc_id = 5")
    with pytest.raises(E.UniqueViolation):
        db.query("INSERT INTO d (doc_id, title) VALUES (3, 'x')")
    db.query("DELETE FROM d")
    assert db.query("INSERT INTO d (title) VALUES ('f')").lastrowid == 12
    db.query("CREATE TABLE n (id int AUTO_INCREMENT PRIMARY KEY, name text)")
    assert db.query("INSERT INTO n (name) VALUES ('x') RETURNING id").rows == [[1]]
    with pytest.raises(E.SqlError):
        db.query("CREATE TABLE bad (a text AUTO_INCREMENT)")


def test_foreign_keys(db):
    db.query("CREATE TABLE p (k int AUTO_INCREMENT, label text)")
    db.query("CREATE TABLE r (p int REFERENCES p(k), label text)")
    db.query("CREATE TABLE c (k int AUTO_INCREMENT, p int REFERENCES p(k) ON DELETE CASCADE)")
    db.query("CREATE TABLE g (c int REFERENCES c(k) ON DELETE CASCADE)")
    db.query("INSERT INTO p (label) VALUES ('keep'),('go')")
    db.query("INSERT INTO r (p, label) VALUES (1, 'x'), (NULL, 'y')")
    db.query("INSERT INTO c (p) VALUES (2)")
    db.query("INSERT INTO g (c) VALUES (1)")
    with pytest.raises(E.SchemaViolation, match="lacks"):
        db.query("INSERT INTO r (p) VALUES (77)")
    with pytest.raises(E.SchemaViolation, match="referenced by r.p"):
        db.query("DELETE FROM p WHERE k = 1")
    with pytest.raises(E.SchemaViolation):
        db.query("UPDATE p SET k = 5")
    with pytest.raises(E.SchemaViolation, match="referenced"):
        db.query("DROP TABLE p")
    assert db.query("DELETE FROM p WHERE k = 2").count == 1
    assert rows(db, "SELECT count(*) FROM c") == [[0]] and rows(db, "SELECT count(*) FROM g") == [[0]]
    assert db.check_integrity() == []


def test_definitions(db):
    db.query("CREATE TABLE t (a int, b text)")
    with pytest.raises(E.TableExists):
        db.query("CREATE TABLE t (a int)")
    db.query("CREATE TABLE IF NOT EXISTS t (a int)")
    db.query("INSERT INTO t (a, b) VALUES (1, 'x')")
    db.query("ALTER TABLE t ADD COLUMN c int")
    db.query("ALTER TABLE t ADD d text NOT NULL DEFAULT 'q'")
    with pytest.raises(E.SchemaViolation):
        db.query("ALTER TABLE t ADD e text NOT NULL")
    db.query("ALTER TABLE t RENAME COLUMN b TO bb")
    assert rows(db, "SELECT a, bb, c, d FROM t") == [[1, "x", None, "q"]]
    db.query("ALTER TABLE t DROP COLUMN bb")
    db.query("ALTER TABLE t ADD bb int")
    assert rows(db, "SELECT bb FROM t") == [[None]]
    db.query("ALTER TABLE t RENAME TO t2")
    with pytest.raises(E.TableNotFound):
        db.query("SELECT * FROM t")
    db.query("CREATE INDEX ON t2 (a)")
    db.query("DROP INDEX ON t2 (a)")
    with pytest.raises(E.IndexNotFound):
        db.query("DROP INDEX ON t2 (a)")
    db.query("DROP TABLE t2")
    db.query("DROP TABLE IF EXISTS t2")
    assert db.tables() == []


def test_explain(db):
    db.query("CREATE TABLE people (name text NOT NULL, mail text, age int, town text)")
    db.query("CREATE TABLE buys (who text, price int, status text)")
    db.query("CREATE UNIQUE INDEX ON people (mail)")
    db.query("CREATE INDEX ON buys (who)")
    plan = lambda sql, v=None: [r[0] for r in rows(db, "EXPLAIN " + sql, v)]
    assert plan("SELECT * FROM people WHERE age >= 30") == ["SCAN people", "  filter: people.age >= 30"]
    assert plan("SELECT * FROM people WHERE id = 'K7'") == ["POINT LOOKUP people.id = 'K7'"]
    assert plan("SELECT name FROM people WHERE mail = ?", ["x" * 80]) == [f"INDEX LOOKUP people.mail = '{'x' * 32}...'"]
    assert plan("SELECT name FROM people WHERE town = 'lugo'") == ["SCAN people  (equality town = 'lugo', no index)"]
    assert plan("SELECT * FROM people WHERE town = NULL") == ["NO ACCESS people  (equality on NULL matches no row)"]
    assert plan("SELECT name FROM people WHERE age < 66 ORDER BY name DESC LIMIT 10 OFFSET 5") == ["LIMIT 10 OFFSET 5", "  SORT people.name DESC", "    SCAN people", "      filter: people.age < 66"]
    got = plan("SELECT p.name, b.price FROM people p JOIN buys b ON b.who = p.id WHERE p.age < 66 AND b.price > 100")
    join = "JOIN INNER (broadcast or sort-merge, by size)"
    assert got == [join, "  on: p.id = b.who", "  SCAN p", "    filter: p.age < 66", "  SCAN b", "    filter: b.price > 100"]
    assert plan("SELECT p.name FROM people p JOIN buys b ON b.status = p.town WHERE b.who = 'x'") == [join, "  on: p.town = b.status", "  SCAN p", "  INDEX LOOKUP b.who = 'x'"]
    got = plan("SELECT town, count(*), sum(age) FROM people WHERE age != 5 GROUP BY town HAVING count(*) > 2 ORDER BY town LIMIT 3")
    assert got == ["LIMIT 3", "  SORT town ASC", "    GROUP BY people.town", "      aggregates: count(*), sum(people.age)", "      having: count(*) > 2", "      SCAN people", "        filter: people.age != 5"]
    with pytest.raises(E.ColumnNotFound):
        plan("SELECT nope FROM people")


def test_snapshots_and_transactions(db):
    db.query("CREATE TABLE t (k int, v int)")
    db.query("CREATE UNIQUE INDEX ON t (k)")
    db.query("INSERT INTO t (k, v) VALUES (1, 1), (2, 2)")
    snap = db.snapshot()
    db.query("UPDATE t SET v = 10 WHERE k = 1")
    assert snap.query("SELECT v FROM t WHERE k = 1").rows == [[1]] and rows(db, "SELECT v FROM t WHERE k = 1") == [[10]]
    with pytest.raises(E.ReadOnly):
        snap.query("DELETE FROM t")
    db.compact()
    db.vacuum()
    assert snap.query("SELECT v FROM t WHERE k = 1").rows == [[1]]
    snap.close()
    tx = db.transaction()
    tx.query("INSERT INTO t (k, v) VALUES (3, 3)")
    tx.query("UPDATE t SET v = v + 1 WHERE k = 2")
    assert tx.query("SELECT k, v FROM t ORDER BY k").rows == [[1, 10], [2, 3], [3, 3]]
    assert rows(db, "SELECT count(*) FROM t") == [[2]]
    db.query("UPDATE t SET v = 11 WHERE k = 1")  # other rows of the same table
    tx.commit()
    assert rows(db, "SELECT k, v FROM t ORDER BY k") == [[1, 11], [2, 3], [3, 3]]
    a, b = db.transaction(), db.transaction()
    a.query("UPDATE t SET v = 100 WHERE k = 1")
    b.query("UPDATE t SET v = 200 WHERE k = 1")
    a.commit()
    with pytest.raises(E.Conflict):
        b.commit()
    a, b = db.transaction(), db.transaction()
    a.insert("t", {"k": 9})
    b.insert("t", {"k": 9})
    a.commit()
    with pytest.raises(E.Conflict):
        b.commit()
    with db.transaction() as tx:
        tx.query("DELETE FROM t WHERE k = 9")
        tx.rollback()
    assert rows(db, "SELECT v FROM t WHERE k = 1") == [[100]] and rows(db, "SELECT count(*) FROM t") == [[4]]
    for sql in ["SELECT count(*) FROM t", "CREATE TABLE x (a int)", "EXPLAIN SELECT * FROM t"]:
        with pytest.raises(E.SqlError):
            db.transaction().query(sql)
    assert db.run_transaction(lambda tx: tx.query("UPDATE t SET v = 0").count) == 4


def test_model(db):
    """Random changes against a dict."""
    db.query("CREATE TABLE m (v int NOT NULL)")
    model, rnd = {}, random.Random(7)
    for _ in range(25):
        what = rnd.random()
        if what < 0.45 or not model:
            v = rnd.randint(0, 9)
            model[db.insert("m", {"v": v})] = v
        elif what < 0.65:
            id, v = rnd.choice(sorted(model)), rnd.randint(0, 9)
            assert db.update("m", id, {"v": v})
            model[id] = v
        elif what < 0.8:
            id = rnd.choice(sorted(model))
            assert db.delete("m", id)
            del model[id]
        elif what < 0.9:
            v = rnd.randint(0, 9)
            assert db.query("DELETE FROM m WHERE v = ?", [v]).count == sum(x == v for x in model.values())
            model = {k: x for k, x in model.items() if x != v}
        else:
            db.compact()
            db.vacuum()
    assert {r[0]: r[1] for r in rows(db, "SELECT id, v FROM m")} == model
    assert Engine(db.spark, db.store.root).query("SELECT count(*) FROM m").rows == [[len(model)]]


def test_search(db):
    db.query("CREATE TABLE d (body text NOT NULL, ws text, emb vector(4))")
    docs = [("rust is fast and rust is safe", "w1", [1, 0, 0, 0]), ("learning rust slowly", "w2", [0.9, 0.1, 0, 0]), ("python is nice", "w1", [0, 1, 0, 0])] + [(f"filler number {i} text", "w1", [0, 0, 1, i]) for i in range(12)] + [("", None, None)]
    docs = [(b, w, v and [float(x) for x in v]) for b, w, v in docs]
    db.append("d", db.spark.createDataFrame(docs, "body string, ws string, emb array<float>"))
    with pytest.raises(E.IndexNotFound):
        db.search_text("d", "body", "rust")
    db.create_text_index("d", "body")
    db.create_vector_index("d", "emb")
    hits = db.search_text("d", "body", "Rust rust", 5)
    assert [h[2]["ws"] for h in hits] == ["w1", "w2"] and hits[0][1] > hits[1][1] > 0
    # by hand: 15 documents with tokens, 2 hold the term
    import math

    lens = [7, 3, 3] + [4 if i > 9 else 3 for i in range(12)]
    avg = sum(lens) / 15
    idf = math.log(1 + (15 - 2 + 0.5) / 2.5)
    assert hits[0][1] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 7 / avg)))
    assert [h[2]["ws"] for h in db.search_text("d", "body", "rust", 5, {"ws": "w2"})] == ["w2"]
    near = db.search_vector("d", "emb", [1, 0, 0, 0], 3)
    assert near[0][1] == pytest.approx(0) and near[1][2]["ws"] == "w2"
    hybrid = db.search_hybrid("d", ("body", "python"), ("emb", [0, 1, 0, 0]), 2)
    assert hybrid[0][2]["body"] == "python is nice" and hybrid[0][1] == pytest.approx(2 / 61)
    with pytest.raises(E.InvalidArgument):
        db.search_vector("d", "emb", [1, 0])
    assert db.vector_indexing_backlog() == 0


def test_bulk_and_files(db, spark, tmp_path):
    db.query("CREATE TABLE b (id int PRIMARY KEY, n text NOT NULL, at timestamp, tags json)")
    df = spark.range(1, 51).selectExpr("id", "concat('n', id) AS n", "timestamp_ntz'2026-01-01 00:00:00' AS at", "'{\"a\":1}' AS tags", "id AS pos")
    db.bulk_insert_sorted("b", df, "pos")
    with pytest.raises(E.InvalidArgument, match="above"):
        db.bulk_insert_sorted("b", df, "pos")
    with pytest.raises(E.InvalidArgument, match="increasing"):
        db.bulk_insert_sorted("b", df.withColumn("id", 1000 - df.id), "pos")
    with pytest.raises(E.DuplicateId):
        db.append("b", df.drop("pos").limit(3))
    assert [r["id"] for r in db.scan_batch("b", 10, 3)] == [11, 12, 13]
    assert [r["n"] for r in db.find_eq_batch("b", "n", "n7")] == ["n7"]
    out = str(tmp_path / "out")
    db.export_json("b", out)
    db.query("CREATE TABLE b2 (id int PRIMARY KEY, n text NOT NULL, at timestamp, tags json)")
    assert db.import_json("b2", out) == 50
    assert db.query("SELECT at FROM b2 WHERE id = 3").rows == [[dt.datetime(2026, 1, 1)]]
    (tmp_path / "bad.json").write_text('{"id": 99, "n": "x", "zz": 1}\n')
    with pytest.raises(Exception, match="unknown column"):
        db.import_json("b2", str(tmp_path / "bad.json"))
    db.backup(str(tmp_path / "copy"))
    other = Engine.restore(spark, str(tmp_path / "copy"), str(tmp_path / "again"))
    assert other.query("SELECT count(*) FROM b").rows == [[50]]
    ro = Engine(spark, tmp_path / "again", read_only=True)
    with pytest.raises(E.ReadOnly):
        ro.query("DELETE FROM b")
    assert other.maintenance_stats()["tables"] == 2 and other.check_integrity() == []
    (other.store.root / other._state().tables["b"]["files"][0]).unlink()
    assert other.check_integrity() and other.salvage(str(tmp_path / "saved"))["b2"] == 50


def test_append_numbers_rows(db, spark):
    db.query("CREATE TABLE i (k int AUTO_INCREMENT, v int)")
    db.append("i", spark.range(40).selectExpr("id AS v"))
    assert sorted(r[0] for r in rows(db, "SELECT k FROM i")) == list(range(1, 41))
    assert db.query("INSERT INTO i (v) VALUES (1)").lastrowid == 41


def test_append_and_import_take_defaults(db, spark, tmp_path):
    db.query("CREATE TABLE t (n int DEFAULT 7, at timestamp NOT NULL DEFAULT CURRENT_TIMESTAMP, s text)")
    before = dt.datetime.now(dt.UTC).replace(tzinfo=None) - dt.timedelta(seconds=1)
    db.append("t", spark.range(3).selectExpr("concat('a', id) AS s"))
    (tmp_path / "rows.json").write_text('{"s": "x"}\n\n{"s": "y", "n": 1, "at": {"$t": "timestamp", "v": "2020-01-01 00:00:00"}}\n{"n": null}\n')
    assert db.import_json("t", str(tmp_path / "rows.json")) == 3
    got = {r[0]: (r[1], r[2]) for r in rows(db, "SELECT s, n, at FROM t")}
    assert {k: v[0] for k, v in got.items()} == {"a0": 7, "a1": 7, "a2": 7, "x": 7, "y": 1, None: None}
    assert got["y"][1] == dt.datetime(2020, 1, 1) and all(v[1] >= before for k, v in got.items() if k != "y")
    db.query("CREATE TABLE k (k int AUTO_INCREMENT, s text)")
    assert db.import_json("k", str((tmp_path / "k.json").write_text('{"s": "x"}\n{"s": "y"}\n') and tmp_path / "k.json")) == 2
    assert sorted(r[0] for r in rows(db, "SELECT k FROM k")) == [1, 2]


def test_cascade_follows_keys_by_a_join(db, spark):
    db.query("CREATE TABLE p (id int PRIMARY KEY)")
    db.query("CREATE TABLE c (id int PRIMARY KEY, p int REFERENCES p(id) ON DELETE CASCADE)")
    db.query("CREATE TABLE g (id int PRIMARY KEY, c int REFERENCES c(id) ON DELETE CASCADE)")
    db.append("p", spark.range(2000).select("id"))
    db.append("c", spark.range(4000).selectExpr("id", "id % 2000 AS p"))
    db.append("g", spark.range(4000).selectExpr("id", "CASE WHEN id % 5 > 0 THEN id END AS c"))
    assert db.query("DELETE FROM p WHERE id < 1500").count == 1500
    assert [db.query(f"SELECT count(*) FROM {t}").rows[0][0] for t in "pcg"] == [500, 1000, 1600]
    with pytest.raises(E.DuplicateId):
        db.append("p", spark.range(1999, 2001).select("id"))
    assert db.append("p", spark.range(3).select("id")) == 3


def test_text_index_follows_its_table(db, spark, monkeypatch):
    from brindle.operators import search
    from brindle.sources import segments
    from brindle.sources.textindex import TextIndex

    monkeypatch.setattr(segments, "MOST", 3)
    db.query("CREATE TABLE d (id int PRIMARY KEY, body text, ws text)")
    texts = lambda a, b: spark.range(a, b).selectExpr("id", "concat('word', id % 7, ' common Text ', repeat('pad ', id % 5)) AS body", "concat('w', id % 2) AS ws")
    db.append("d", texts(0, 60))
    db.create_text_index("d", "body")

    def agree(filter=None):
        df = db.scan("d")
        keep = None if filter is None else df.ws == filter["ws"]
        want = {r["id"]: r["score"] for r in search.search_text(df, "id", "body", "word3 common absent", 1000, keep).collect()}
        got = {r["id"]: r["score"] for r in db.search_text_df("d", "body", "word3 common absent", 1000, filter).collect()}
        assert got == pytest.approx(want) and want
        return len(want)

    index = TextIndex(db.store, "d", db.table_schema("d").get("body").key)
    assert agree() == 60 and len(index.segments()) == 1
    for k in range(60, 120, 20):
        db.append("d", texts(k, k + 20))
        assert agree() == k + 20
    assert len(index.segments()) < 4  # merged
    db.query("UPDATE d SET body = 'word3' WHERE id < 10")
    db.query("DELETE FROM d WHERE id >= 20 AND id <= 29")
    assert agree() == 110 and agree({"ws": "w1"}) == 55
    plan = db.search_text_df("d", "body", "word3")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "word3" in plan.split("PushedFilters")[1]
    db.drop_text_index("d", "body")
    assert not index.segments()


def test_vector_index_recall(db, spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(0, 40, 2000)] + 0.6 * rng.normal(size=(2000, 32))).astype(np.float32)
    db.query("CREATE TABLE v (id int PRIMARY KEY, emb vector(32))")
    frame = lambda a, b: spark.createDataFrame([(k, x[k].tolist()) for k in range(a, b)], "id long, emb array<float>")
    db.append("v", frame(0, 1500))
    db.create_vector_index("v", "emb", metric="l2")
    db.append("v", frame(1500, 2000))
    assert db.vector_indexing_backlog() > 0
    recall = []
    for q in range(0, 2000, 250):
        want = set(np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:10].tolist())
        got = db.search_vector_df("v", "emb", x[q].tolist(), 10).collect()
        assert got[0]["id"] == q and got[0]["distance"] == pytest.approx(0)
        recall.append(len(want & {r["id"] for r in got}) / 10)
    assert np.mean(recall) >= 0.9 and db.vector_indexing_backlog() == 0
    assert [r["id"] for r in db.search_vector_df("v", "emb", x[5].tolist(), 3, exact=True).collect()][0] == 5


def test_lookups_read_only_files_that_hold_the_value(db, spark):
    db.query("CREATE TABLE t (id int PRIMARY KEY, k text, v int)")
    for n in range(0, 40, 10):
        db.append("t", spark.range(n, n + 10).selectExpr("id", "concat('k', id div 5) AS k", "id AS v"))
    db.query("CREATE INDEX ON t (k)")
    read = lambda sql: {f.rsplit("/", 1)[1] for f in db.sql(sql).inputFiles()}
    every, one = read("SELECT v FROM t WHERE v = 3"), read("SELECT v FROM t WHERE k = 'k3'")
    assert len(one) < len(every) and one < every and rows(db, "SELECT v FROM t WHERE k = 'k3' ORDER BY v") == [[v] for v in range(15, 20)]
    assert len(read("SELECT v FROM t WHERE id = 7")) < len(every) and db.get("t", 7)["k"] == "k1"
    db.query("INSERT INTO t (id, k, v) VALUES (100, 'k3', 100)")  # its file is not indexed yet, so it is read
    assert sorted(r["v"] for r in db.find_eq("t", "k", "k3").collect()) == [*range(15, 20), 100]
    db.query("UPDATE t SET k = 'moved' WHERE id = 16")
    assert sorted(r[0] for r in rows(db, "SELECT id FROM t WHERE k = 'k3'")) == [15, 17, 18, 19, 100]
    assert rows(db, "SELECT a.v FROM t a LEFT JOIN t b ON b.id = a.v WHERE b.k = 'moved'") == [[16]]
    db.compact()
    assert sorted(r[0] for r in rows(db, "SELECT id FROM t WHERE k = 'k3'")) == [15, 17, 18, 19, 100] and db.get("t", 999) is None


def test_small_files_are_merged(db, monkeypatch):
    import brindle.engine

    monkeypatch.setattr(brindle.engine, "SMALL_FILES", 4)
    db.query("CREATE TABLE s (id int PRIMARY KEY, v int)")
    snap = None
    for k in range(12):
        db.query("INSERT INTO s (id, v) VALUES (?, ?)", [k, k * k])
        assert len(db._state().tables["s"]["files"]) <= 5
        if k == 3:
            snap = db.snapshot()
    assert rows(db, "SELECT id, v FROM s ORDER BY id") == [[k, k * k] for k in range(12)]
    assert snap.query("SELECT count(*) FROM s").rows == [[4]]
    snap.close()
    with db.transaction() as tx:
        tx.query("UPDATE s SET v = 0 WHERE id = 1")
        for k in range(20, 26):
            db.query("INSERT INTO s (id, v) VALUES (?, 1)", [k])
    assert rows(db, "SELECT v FROM s WHERE id = 1") == [[0]] and rows(db, "SELECT count(*) FROM s") == [[18]]
