"""Three ways to talk to an engine in statements: a DB-API style cursor, JSON requests, and a prompt."""

from __future__ import annotations

import hmac
import json
import socketserver
import sys
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

from brindle.engine import Engine, Result, Transaction
from brindle.errors import EngineError, InvalidArgument
from brindle.types import from_tagged, to_tagged


class DbCursor:
    """``execute`` and ``fetch*`` as the DB-API spells them."""

    arraysize = 1

    def __init__(self, engine: Engine):
        self._engine, self._result, self._at = engine, None, 0

    def execute(self, sql: str, params: Sequence | Mapping | None = None) -> DbCursor:
        self._result, self._at = self._engine.query(sql, params), 0
        return self

    def executemany(self, sql: str, rows: Sequence) -> DbCursor:
        total = 0
        for row in rows:
            total += self.execute(sql, row)._result.count
        self._result = Result("affected", count=total)
        return self

    @property
    def description(self) -> list[tuple] | None:
        if not self._result or self._result.kind != "rows":
            return None
        return [(name, kind, None, None, None, None, None) for name, kind in zip(self._result.columns, self._result.types)]

    @property
    def rowcount(self) -> int:
        if not self._result:
            return -1
        return len(self._result.rows) if self._result.kind == "rows" else self._result.count

    @property
    def lastrowid(self) -> int | None:
        return self._result.lastrowid if self._result else None

    def fetchmany(self, n: int | None = None) -> list[list]:
        rows = self._result.rows[self._at : self._at + (n or self.arraysize)] if self._result else []
        self._at += len(rows)
        return rows

    def fetchone(self) -> list | None:
        return next(iter(self.fetchmany(1)), None)

    def fetchall(self) -> list[list]:
        return self.fetchmany(len(self._result.rows) if self._result else 1)

    def __iter__(self) -> Iterator[list]:
        while (row := self.fetchone()) is not None:
            yield row


class Session:
    """Answers requests that are JSON objects with an ``op``; values may be tagged.  One for each connection."""

    def __init__(self, engine: Engine, token: str | None = None):
        self.engine, self._token, self._trusted = engine, token, token is None
        self._transactions: dict[int, Transaction] = {}
        self._next = 1

    def handle(self, request: Mapping) -> dict:
        """The answer: ``{"ok": true, ...}`` or ``{"ok": false, "error", "code"}``."""
        try:
            op = request.get("op")
            if op == "auth":
                self._trusted = self._token is None or hmac.compare_digest(str(request.get("token", "")), self._token)
                return {"ok": True} if self._trusted else {"ok": False, "error": "wrong token", "code": InvalidArgument.code}
            if not self._trusted:
                raise InvalidArgument("authenticate first")
            method = getattr(self, f"_op_{op}", None)
            if not method:
                raise InvalidArgument(f"unknown op {op!r}")
            return {"ok": True, **(method(request) or {})}
        except EngineError as e:
            return {"ok": False, "error": str(e), "code": e.code}
        except (KeyError, TypeError, ValueError) as e:
            return {"ok": False, "error": f"bad request: {e}", "code": InvalidArgument.code}

    def close(self) -> None:
        for tx in self._transactions.values():
            tx.rollback()
        self._transactions.clear()

    @staticmethod
    def _params(request: Mapping) -> Any:
        params = request.get("params")
        if isinstance(params, Mapping):
            return {k: from_tagged(v) for k, v in params.items()}
        return None if params is None else [from_tagged(v) for v in params]

    @staticmethod
    def _record(record: Mapping | None) -> dict | None:
        return None if record is None else {k: to_tagged(v, "json" if isinstance(v, dict) else "") if not isinstance(v, dict) else {"$t": "json", "v": v} for k, v in record.items()}

    def _tx(self, request: Mapping) -> Transaction:
        tx = self._transactions.get(request["tx"])
        if tx is None:
            raise InvalidArgument(f"no open transaction {request['tx']}")
        return tx

    def _hits(self, hits: list) -> dict:
        return {"hits": [{"id": i, "score": s, "record": self._record(r)} for i, s, r in hits]}

    def _op_ping(self, _: Mapping) -> dict:
        return {"pong": True}

    def _op_query(self, r: Mapping) -> dict:
        return self.engine.query(r["sql"], self._params(r)).to_json()

    def _op_search_text(self, r: Mapping) -> dict:
        return self._hits(self.engine.search_text(r["table"], r["column"], r["query"], r.get("top_k", 10), r.get("filter")))

    def _op_search_vector(self, r: Mapping) -> dict:
        return self._hits(self.engine.search_vector(r["table"], r["column"], r["vector"], r.get("top_k", 10), r.get("filter")))

    def _op_search_hybrid(self, r: Mapping) -> dict:
        text, vector = r.get("text"), r.get("vector")
        return self._hits(self.engine.search_hybrid(r["table"], (text["column"], text["query"]) if text else None, (vector["column"], vector["vector"]) if vector else None, r.get("top_k", 10), r.get("filter")))

    def _op_create_text_index(self, r: Mapping) -> None:
        self.engine.create_text_index(r["table"], r["column"])

    def _op_create_vector_index(self, r: Mapping) -> None:
        self.engine.create_vector_index(r["table"], r["column"], **r.get("options", {}))

    def _op_begin(self, _: Mapping) -> dict:
        number, self._next = self._next, self._next + 1
        self._transactions[number] = self.engine.transaction()
        return {"tx": number}

    def _op_query_in_txn(self, r: Mapping) -> dict:
        return self._tx(r).query(r["sql"], self._params(r)).to_json()

    def _op_txn_insert(self, r: Mapping) -> dict:
        return {"id": self._tx(r).insert(r["table"], {k: from_tagged(v) for k, v in r["record"].items()})}

    def _op_txn_get(self, r: Mapping) -> dict:
        return {"record": self._record(self._tx(r).get(r["table"], r["id"]))}

    def _op_txn_update(self, r: Mapping) -> dict:
        return {"updated": self._tx(r).update(r["table"], r["id"], {k: from_tagged(v) for k, v in r["patch"].items()})}

    def _op_txn_delete(self, r: Mapping) -> dict:
        return {"deleted": self._tx(r).delete(r["table"], r["id"])}

    def _op_commit(self, r: Mapping) -> None:
        tx = self._tx(r)
        del self._transactions[r["tx"]]
        tx.commit()

    def _op_rollback(self, r: Mapping) -> None:
        tx = self._tx(r)
        del self._transactions[r["tx"]]
        tx.rollback()

    def _op_checkpoint(self, _: Mapping) -> None:
        self.engine.checkpoint()

    def _op_compact(self, _: Mapping) -> dict:
        self.engine.compact()
        return {"deleted": self.engine.vacuum()}


class Server(socketserver.ThreadingTCPServer):
    """Lines of JSON over TCP, a thread and a session for each connection."""

    allow_reuse_address = daemon_threads = True

    def __init__(self, engine: Engine, address: tuple[str, int] = ("127.0.0.1", 0), token: str | None = None):
        outer = self
        self.engine, self.token = engine, token

        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                session = Session(outer.engine, outer.token)
                try:
                    for line in self.rfile:
                        try:
                            answer = session.handle(json.loads(line))
                        except ValueError:
                            answer = {"ok": False, "error": "not JSON", "code": InvalidArgument.code}
                        self.wfile.write(json.dumps(answer).encode() + b"\n")
                finally:
                    session.close()

        super().__init__(address, Handler)


def statements(lines: Iterator[str]) -> Iterator[str]:
    """Statements that end with ``;`` outside quotes and comments; the rest at the end is one too."""
    text, quote, k = "", "", 0
    for line in lines:
        text += line
        while k < len(text):
            c = text[k]
            if quote == "/*":
                if text.startswith("*/", k):
                    quote, k = "", k + 1
            elif quote:
                quote = "" if c == quote else quote
            elif c in "'\"`":
                quote = c
            elif text.startswith("--", k):
                end = text.find("\n", k)
                k = len(text) - 1 if end < 0 else end
            elif text.startswith("/*", k):
                quote, k = "/*", k + 1
            elif c == ";":
                if text[:k].strip():
                    yield text[:k].strip()
                text, k = text[k + 1 :], -1
            k += 1
    if text.strip():
        yield text.strip()


def prompt(engine: Engine, lines: Iterator[str], out=sys.stdout) -> None:
    """Run statements and print their results; an implicit id stays hidden in ``SELECT *``."""
    for sql in statements(lines):
        try:
            result = engine.query(sql)
            if result.kind != "rows":
                print(json.dumps(result.to_json()), file=out)
                continue
            star = " ".join(sql.split()[:2]).upper() == "SELECT *" and result.columns[:1] == ["id"] and result.types[:1] == ["text"] and len(result.columns) > 1
            skip = 1 if star else 0
            print("\t".join(result.columns[skip:]), file=out)
            for row in result.rows:
                print("\t".join("NULL" if v is None else str(v) for v in row[skip:]), file=out)
        except EngineError as e:
            print(f"error {e.code}: {e}", file=out)
