"""Cursor, requests, prompt and streams."""

import io
import json
import socket
import threading

import pytest

from brindle.connection import DbCursor, Server, Session, prompt, statements
from brindle.engine import Engine
from brindle.streaming.ingest import append_once, stream_into, stream_postings, windowed_counts


@pytest.fixture
def db(spark, tmp_path):
    e = Engine(spark, tmp_path / "db")
    e.query("CREATE TABLE t (name text, n int)")
    return e


def test_cursor(db):
    c = DbCursor(db)
    assert c.executemany("INSERT INTO t (n, name) VALUES (?, ?)", [[1, "a"], [2, "b"]]).rowcount == 2
    c.execute("SELECT name, n FROM t ORDER BY n")
    assert [d[0] for d in c.description] == ["name", "n"] and c.rowcount == 2
    assert c.fetchone() == ["a", 1] and c.fetchall() == [["b", 2]] and c.fetchone() is None


def test_session(db):
    s = Session(db, token="k")
    assert not s.handle({"op": "ping"})["ok"] and not s.handle({"op": "auth", "token": "x"})["ok"] and s.handle({"op": "auth", "token": "k"})["ok"]
    assert s.handle({"op": "query", "sql": "INSERT INTO t (n, name) VALUES (?, ?)", "params": [1, "a"]}) == {"ok": True, "inserted": 1}
    tx = s.handle({"op": "begin"})["tx"]
    id = s.handle({"op": "txn_insert", "tx": tx, "table": "t", "record": {"name": "b"}})["id"]
    assert s.handle({"op": "txn_get", "tx": tx, "table": "t", "id": id})["record"]["name"] == "b"
    assert s.handle({"op": "txn_update", "tx": tx, "table": "t", "id": id, "patch": {"n": 5}})["updated"]
    assert s.handle({"op": "commit", "tx": tx})["ok"] and not s.handle({"op": "commit", "tx": tx})["ok"]
    assert s.handle({"op": "query", "sql": "SELECT n FROM t WHERE n > 1"}) == {"ok": True, "columns": ["n"], "rows": [[5]]}
    assert s.handle({"op": "query", "sql": "SELECT zz FROM nope"})["code"] == 4 and s.handle({"op": "what"})["code"] == 8
    assert s.handle({"op": "create_text_index", "table": "t", "column": "name"})["ok"]
    db.insert("t", {"name": "hello there"})
    assert s.handle({"op": "search_text", "table": "t", "column": "name", "query": "hello"})["hits"][0]["record"]["name"] == "hello there"


def test_server(db):
    with Server(db) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        with socket.create_connection(server.server_address) as c, c.makefile("rw") as f:
            for line in ['{"op": "ping"}', "nonsense"]:
                f.write(line + "\n")
                f.flush()
            assert json.loads(f.readline()) == {"ok": True, "pong": True} and not json.loads(f.readline())["ok"]
        server.shutdown()


def test_statements_and_prompt(db):
    text = ["SELECT ';' -- a; b\n", "FROM x; /* ; */ SELECT\n", " 2; last"]
    assert list(statements(iter(text))) == ["SELECT ';' -- a; b\nFROM x", "/* ; */ SELECT\n 2", "last"]
    out = io.StringIO()
    prompt(db, iter(["INSERT INTO t (name) VALUES ('x');", "SELECT * FROM t; SELECT bad FROM t;"]), out)
    assert out.getvalue().splitlines() == ['{"inserted": 1}', "name\tn", "x\tNULL", "error 14: unknown column 'bad'"]


def test_streams(db, spark, tmp_path):
    spark.range(6).selectExpr("concat('word', id) AS name", "id AS n").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("name string, n bigint").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second time there is nothing new
        stream_into(db, "t", stream(), "s", str(tmp_path / "cp")).awaitTermination()
        assert db.query("SELECT count(*) FROM t").rows == [[6]]
    assert not append_once(db, "t", spark.range(1).selectExpr("'x' AS name", "id AS n"), "s", 0)
    stream_postings(stream(), "n", "name", str(tmp_path / "post"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "post")).count() == 6
    timed = stream().selectExpr("n", "timestamp_seconds(n * 400) AS at")
    q = windowed_counts(timed, "at", []).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 1, 2, 2]
