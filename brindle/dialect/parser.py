"""Recursive descent over the tokens of one statement.

What lies outside the dialect is refused with a message that names it, and the way to do it if there is one.
"""

from __future__ import annotations

from brindle.dialect import ast
from brindle.dialect.lexer import Token, tokenize
from brindle.errors import SqlError
from brindle.types import Column, ForeignKey

DEPTH = 64
FUNCTIONS = ("COUNT", "SUM", "AVG", "MIN", "MAX")
TYPES = {"bool": "bool", "int": "int64", "integer": "int64", "bigint": "int64", "int64": "int64", "float64": "float64", "text": "text", "longtext": "text", "blob": "blob", "timestamp": "timestamp", "date": "date", "time": "time", "json": "json"}
INSTEAD = {"boolean": "bool", "smallint": "int", "int32": "int", "tinyint": "int", "real": "float64", "double": "float64", "float": "float64", "datetime": "timestamp", "decimal": "int in minor units", "numeric": "int in minor units", "string": "text", "char": "varchar(n)"}
REFUSED = {
    "WITH": "CTEs (WITH) are not supported",
    "REPLACE": "REPLACE INTO is not supported; use INSERT or UPDATE",
    "TRUNCATE": "TRUNCATE is not supported; use DELETE FROM",
    "BEGIN": "transactions are not SQL here; use Engine.transaction(), the Txn API",
    "START": "transactions are not SQL here; use Engine.transaction(), the Txn API",
    "COMMIT": "transactions are not SQL here; use commit() of the Txn API",
    "ROLLBACK": "transactions are not SQL here; use rollback() of the Txn API",
    "PRAGMA": "PRAGMA is not supported; use the engine's options",
    "MERGE": "MERGE is not supported; use UPDATE and INSERT",
    "VALUES": "a bare VALUES is not supported",
}
CLAUSES = set("AS CROSS EXCEPT FOR FROM FULL GROUP HAVING INNER INTERSECT JOIN LEFT LIMIT LOCK NATURAL OFFSET ON ORDER RIGHT SET UNION USING WHERE".split())


class Parser:
    def __init__(self, sql: str):
        self.tokens = tokenize(sql)
        self.i = 0
        self.depth = 0
        self.positional = 0
        self.named = 0

    # tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def next(self) -> Token:
        token = self.now
        self.i += token.kind != "end"
        return token

    def word(self, *words: str) -> bool:
        """Take these words, one after another, if they come next."""
        if all(self.ahead(k).is_word(w) for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def sign(self, sign: str) -> bool:
        if self.now.kind == "sign" and self.now.value == sign:
            self.i += 1
            return True
        return False

    def fail(self, expected: str) -> SqlError:
        token = self.now
        found = "the end" if token.kind == "end" else repr(token.value)
        return SqlError(f"expected {expected}, found {found} at position {token.at}")

    def need_word(self, word: str) -> None:
        if not self.word(word):
            raise self.fail(word)

    def need_sign(self, sign: str) -> None:
        if not self.sign(sign):
            raise self.fail(repr(sign))

    def name(self, what: str = "a name") -> str:
        if self.now.kind == "quoted" or self.now.kind == "word":
            return self.next().value
        if self.now.kind == "sign" and self.now.value == "(":
            raise SqlError("subqueries are not supported")
        raise self.fail(what)

    # statements
    def statement(self):
        token = self.now
        if token.kind == "end":
            raise SqlError("the statement is empty")
        start = token.value.upper() if token.kind == "word" else ""
        if start in REFUSED:
            raise SqlError(REFUSED[start])
        make = {"SELECT": self.select, "INSERT": self.insert, "UPDATE": self.update, "DELETE": self.delete, "CREATE": self.create, "DROP": self.drop, "ALTER": self.alter, "EXPLAIN": self.explain}.get(start)
        if not make:
            raise self.fail("a statement")
        self.next()
        out = make()
        self.sign(";")
        if self.now.kind != "end":
            if self.tokens[self.i - 1].value == ";":
                raise SqlError("only one statement is allowed in a call")
            self.refuse_tail()
            raise self.fail("the end of the statement")
        if self.positional and self.named:
            raise SqlError("positional and named parameters can't be mixed")
        return out

    def refuse_tail(self) -> None:
        for op in ("UNION", "EXCEPT", "INTERSECT"):
            if self.now.is_word(op):
                raise SqlError(f"{op} is not supported")
        if self.now.is_word("FOR", "LOCK"):
            raise SqlError("row locking (FOR UPDATE, LOCK IN SHARE MODE) is not supported; transactions are optimistic")
        if self.now.is_word("WINDOW", "QUALIFY"):
            raise SqlError("window functions are not supported")
        if self.now.kind == "sign" and self.now.value in "+-*/%":
            raise SqlError("arithmetic is only supported in UPDATE ... SET c = c op literal")

    def explain(self) -> ast.Explain:
        if self.word("ANALYZE"):
            raise SqlError("EXPLAIN ANALYZE is not supported")
        if not self.word("SELECT"):
            raise SqlError("EXPLAIN is only supported for SELECT")
        return ast.Explain(self.select())

    def select(self) -> ast.Select:
        if self.now.is_word("DISTINCT"):
            raise SqlError("SELECT DISTINCT is not supported; use GROUP BY")
        items = [self.item()]
        while self.sign(","):
            items.append(self.item())
        self.refuse_tail()
        self.need_word("FROM")
        out = ast.Select(items, self.source())
        while join := self.join():
            out.joins.append(join)
        if self.now.kind == "sign" and self.now.value == ",":
            raise SqlError("comma joins are not supported; use JOIN ... ON")
        if self.word("WHERE"):
            out.where = self.predicate()
        if self.word("GROUP", "BY"):
            out.group_by.append(self.group_key())
            while self.sign(","):
                out.group_by.append(self.group_key())
        if self.word("HAVING"):
            out.having = self.predicate(aggregates=True)
        if self.word("ORDER", "BY"):
            out.order_by.append(self.order())
            while self.sign(","):
                out.order_by.append(self.order())
        if self.word("LIMIT"):
            out.limit = self.count("LIMIT")
            if self.sign(","):
                raise SqlError("LIMIT offset, count is not supported; write LIMIT count OFFSET offset")
            if self.word("OFFSET"):
                out.offset = self.count("OFFSET")
        elif self.now.is_word("OFFSET"):
            raise SqlError("OFFSET is only allowed after LIMIT")
        self.refuse_tail()
        return out

    def group_key(self) -> ast.Ref:
        if self.now.is_word("ROLLUP", "CUBE", "GROUPING") and self.ahead().value in ("(", "SETS", "sets"):
            raise SqlError("grouping sets, ROLLUP and CUBE are not supported")
        if self.now.kind == "number":
            raise SqlError("GROUP BY takes column names, not positions")
        return self.ref()

    def count(self, what: str) -> ast.Operand:
        if self.now.kind == "param":
            return self.param()
        if self.now.kind == "number" and isinstance(self.now.value, int):
            return ast.Literal(self.next().value)
        raise SqlError(f"{what} needs a non-negative integer")

    def item(self) -> ast.Item:
        if self.sign("*"):
            return ast.Item(None)
        if self.now.is_word(*FUNCTIONS) and self.ahead().value == "(" and self.ahead().kind == "sign":
            what: ast.Ref | ast.Aggregate = self.aggregate()
        else:
            if self.now.kind not in ("word", "quoted"):
                if self.now.kind == "sign" and self.now.value == "(":
                    raise SqlError("subqueries and expressions are not supported in SELECT; name columns")
                raise SqlError("SELECT takes columns and aggregates, not literals or expressions")
            if self.now.is_word("CASE"):
                raise SqlError("CASE is not supported")
            what = self.ref(star=True)
        if self.now.is_word("OVER"):
            raise SqlError("window functions (OVER) are not supported")
        self.refuse_tail()
        if self.word("AS"):
            return ast.Item(what, self.name("an alias"))
        if self.now.kind in ("word", "quoted") and not self.now.is_word("FROM"):
            raise SqlError("a column's alias needs AS")
        return ast.Item(what)

    def aggregate(self) -> ast.Aggregate:
        function = self.next().value.lower()
        self.need_sign("(")
        if self.sign("*"):
            if function != "count":
                raise SqlError("only COUNT accepts *")
            self.need_sign(")")
            return ast.Aggregate("count", None)
        distinct = self.word("DISTINCT")
        if distinct and function != "count":
            raise SqlError("only COUNT accepts DISTINCT")
        if self.now.kind not in ("word", "quoted"):
            raise SqlError("an aggregate takes a column; expressions inside aggregates are not supported")
        argument = self.ref()
        if self.now.kind == "sign" and self.now.value in "+-*/%":
            raise SqlError("arithmetic is not supported inside aggregates")
        self.need_sign(")")
        if self.now.is_word("FILTER"):
            raise SqlError("FILTER is not supported")
        return ast.Aggregate(function, argument, distinct)

    def ref(self, star: bool = False) -> ast.Ref:
        first = self.name("a column")
        if self.now.kind == "sign" and self.now.value == "(":
            if first.upper() in FUNCTIONS:
                raise SqlError("aggregates are only allowed in SELECT and HAVING")
            raise SqlError(f"functions are not supported ({first}); for similarity use search_vector")
        if self.sign("."):
            if star and self.now.kind == "sign" and self.now.value == "*":
                raise SqlError("a qualified star (t.*) is not supported; name the columns")
            return ast.Ref(self.name("a column"), first)
        return ast.Ref(first)

    def source(self) -> ast.Source:
        table = self.name("a table")
        if self.now.kind == "sign" and self.now.value == ".":
            raise SqlError("schema-qualified tables are not supported")
        if self.word("AS"):
            return ast.Source(table, self.name("an alias"))
        lock = self.now.is_word("FOR") and self.ahead().is_word("UPDATE", "SHARE") or self.now.is_word("LOCK") and self.ahead().is_word("IN")
        if lock:
            self.refuse_tail()
        if self.now.kind == "quoted" or self.now.kind == "word" and self.now.value.upper() not in CLAUSES:
            return ast.Source(table, self.next().value)
        return ast.Source(table, table)

    def join(self) -> ast.Join | None:
        if self.now.is_word("FULL"):
            raise SqlError("FULL OUTER JOIN is not supported")
        if self.now.is_word("CROSS"):
            raise SqlError("CROSS JOIN is not supported")
        if self.now.is_word("NATURAL"):
            raise SqlError("NATURAL JOIN is not supported; use ON")
        kind = "inner"
        if self.word("LEFT"):
            kind = "left"
        elif self.word("RIGHT"):
            kind = "right"
        elif self.word("INNER"):
            self.need_word("JOIN")
            self.i -= 1
        if kind != "inner":
            self.word("OUTER")
            if self.now.is_word("SEMI", "ANTI"):
                raise SqlError("semi and anti joins are not supported")
        if not self.word("JOIN"):
            if kind == "inner":
                return None
            raise self.fail("JOIN")
        if self.now.is_word("LATERAL"):
            raise SqlError("LATERAL is not supported")
        source = self.source()
        if self.now.is_word("USING"):
            raise SqlError("USING is not supported; use ON a = b")
        self.need_word("ON")
        message = "JOIN ... ON takes a single column equality"
        wrapped = self.sign("(")
        if self.now.kind not in ("word", "quoted"):
            raise SqlError(message)
        left = self.ref()
        if not self.sign("=") or self.now.kind not in ("word", "quoted"):
            raise SqlError(message)
        right = self.ref()
        if wrapped:
            self.need_sign(")")
        if self.now.is_word("AND", "OR"):
            raise SqlError(message)
        return ast.Join(kind, source, left, right)

    def order(self) -> ast.Order:
        if self.now.is_word(*FUNCTIONS) and self.ahead().value == "(":
            raise SqlError("aggregates in ORDER BY are not supported; give the aggregate an alias and order by it")
        if self.now.kind == "number":
            raise SqlError("ORDER BY takes column names, not positions")
        out = ast.Order(self.ref())
        for _ in range(2):
            if self.word("COLLATE"):
                if out.collation:
                    raise SqlError("one COLLATE for each ORDER BY key")
                token = self.next()
                if token.kind not in ("word", "quoted", "text"):
                    raise SqlError("COLLATE needs a name")
                out.collation = str(token.value).lower()
                if out.collation not in ("unicode", "binary"):
                    raise SqlError(f"unknown collation '{token.value}'; use unicode or binary")
            elif self.word("DESC"):
                out.descending = True
            elif not self.word("ASC"):
                break
        if self.now.is_word("NULLS"):
            raise SqlError("NULLS FIRST/LAST is not supported; NULLs come first ascending and last descending")
        return out

    # predicates
    def predicate(self, aggregates: bool = False):
        self.depth += 1
        if self.depth > DEPTH:
            raise SqlError(f"the expression is nested deeper than {DEPTH}")
        parts = [self.conjunction(aggregates)]
        while self.word("OR"):
            parts.append(self.conjunction(aggregates))
        self.depth -= 1
        return parts[0] if len(parts) == 1 else ast.Logic("or", tuple(parts))

    def conjunction(self, aggregates: bool):
        parts = [self.negation(aggregates)]
        while self.word("AND"):
            parts.append(self.negation(aggregates))
        return parts[0] if len(parts) == 1 else ast.Logic("and", tuple(parts))

    def negation(self, aggregates: bool):
        if self.word("NOT"):
            if self.now.is_word("EXISTS"):
                raise SqlError("subqueries (EXISTS) are not supported")
            self.depth += 1
            if self.depth > DEPTH:
                raise SqlError(f"the expression is nested deeper than {DEPTH}")
            out = ast.Logic("not", (self.negation(aggregates),))
            self.depth -= 1
            return out
        if self.now.kind == "sign" and self.now.value == "(":
            if self.ahead().is_word("SELECT"):
                raise SqlError("subqueries are not supported")
            self.next()
            out = self.predicate(aggregates)
            self.need_sign(")")
            return out
        return self.comparison(aggregates)

    def comparison(self, aggregates: bool):
        if self.now.is_word("EXISTS"):
            raise SqlError("subqueries (EXISTS) are not supported")
        left = self.operand(aggregates)
        self.refuse_tail()
        if self.word("IS"):
            negated = self.word("NOT")
            self.need_word("NULL")
            if not isinstance(left, (ast.Ref, ast.Aggregate)):
                raise SqlError("IS NULL takes a column")
            return ast.IsNull(left, negated)
        negated = self.word("NOT")
        if self.word("IN"):
            self.need_sign("(")
            if self.now.is_word("SELECT"):
                raise SqlError("subqueries are not supported")
            values = [self.value()]
            while self.sign(","):
                values.append(self.value())
            self.need_sign(")")
            return ast.In(left, tuple(values), negated)
        if self.now.is_word("LIKE", "ILIKE", "REGEXP", "RLIKE", "SIMILAR"):
            raise SqlError(f"{self.now.value.upper()} is not supported; for text use search_text")
        if self.now.is_word("BETWEEN"):
            raise SqlError("BETWEEN is not supported; use >= and <=")
        if negated:
            raise self.fail("IN")
        if self.now.kind != "sign" or self.now.value not in ("=", "!=", "<>", "<", "<=", ">", ">="):
            raise self.fail("a comparison (a bare column is not a predicate; write c = TRUE)")
        op = self.next().value
        if self.now.is_word("ANY", "ALL", "SOME"):
            raise SqlError("subqueries (ANY, ALL) are not supported")
        right = self.operand(aggregates)
        self.refuse_tail()
        return ast.Compare(left, "!=" if op == "<>" else op, right)

    def operand(self, aggregates: bool) -> ast.Operand:
        token = self.now
        if token.kind == "word" and token.value.upper() in FUNCTIONS and self.ahead().value == "(":
            if not aggregates:
                raise SqlError("aggregates are not allowed in WHERE; use HAVING")
            return self.aggregate()
        if token.is_word("CASE"):
            raise SqlError("CASE is not supported")
        if token.kind == "sign" and token.value == "(":
            raise SqlError("subqueries are not supported" if self.ahead().is_word("SELECT") else "parentheses around operands are not supported")
        if token.kind in ("word", "quoted") and not token.is_word("TRUE", "FALSE", "NULL"):
            return self.ref()
        return self.value(clock=False)

    def value(self, clock: bool = True) -> ast.Operand:
        """A literal, a placeholder, or where allowed the statement's time."""
        token = self.now
        if token.kind == "param":
            return self.param()
        if token.kind in ("text", "blob"):
            return ast.Literal(self.next().value)
        if token.kind == "number":
            if self.next().value == 1 << 63:
                raise SqlError(f"integer {token.value} is out of range")
            return ast.Literal(token.value)
        if self.sign("-"):
            number = self.next()
            if number.kind != "number":
                raise SqlError("expected a number after '-'")
            return ast.Literal(-number.value)
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.word(word):
                return ast.Literal(value)
        if clock and self.word("CURRENT_TIMESTAMP"):
            return ast.Now()
        if clock and token.is_word("NOW") and self.ahead().value == "(" and self.ahead(2).value == ")":
            self.i += 3
            return ast.Now()
        if token.is_word("SELECT") or token.kind == "sign" and token.value == "(":
            raise SqlError("subqueries are not supported")
        raise self.fail("a literal")

    def param(self) -> ast.Param:
        token = self.next()
        if token.value is None:
            self.positional += 1
            return ast.Param(self.positional - 1)
        self.named += 1
        return ast.Param(-1, token.value)

    # rows
    def insert(self) -> ast.Insert:
        ignore = self.word("IGNORE")
        self.need_word("INTO")
        table = self.name("a table")
        columns = None
        if self.sign("("):
            columns = [self.name("a column")]
            while self.sign(","):
                columns.append(self.name("a column"))
            self.need_sign(")")
        if self.now.is_word("SELECT", "WITH"):
            raise SqlError("INSERT ... SELECT is not supported; use Engine.append with a DataFrame")
        self.need_word("VALUES")
        rows = [self.row()]
        while self.sign(","):
            rows.append(self.row())
        if self.word("ON"):
            if self.word("DUPLICATE"):
                raise SqlError("ON DUPLICATE KEY UPDATE is not supported; use UPDATE, or ON CONFLICT DO NOTHING")
            self.need_word("CONFLICT")
            if not self.word("DO", "NOTHING"):
                raise SqlError("only ON CONFLICT DO NOTHING is supported")
            ignore = True
        returning = None
        if self.word("RETURNING"):
            returning = ["*"] if self.sign("*") else [self.name("a column")]
            while returning != ["*"] and self.sign(","):
                returning.append(self.name("a column"))
        return ast.Insert(table, columns, rows, ignore, returning)

    def row(self) -> list[ast.Operand]:
        self.need_sign("(")
        out = [self.value()]
        while self.sign(","):
            out.append(self.value())
        self.need_sign(")")
        return out

    def update(self) -> ast.Update:
        table = self.name("a table")
        self.need_word("SET")
        out = ast.Update(table, [self.assignment()])
        while self.sign(","):
            out.assignments.append(self.assignment())
        self.finish_change(out)
        return out

    def assignment(self) -> ast.Assignment:
        column = self.name("a column")
        self.need_sign("=")
        token = self.now
        if token.kind in ("word", "quoted") and not token.is_word("TRUE", "FALSE", "NULL", "CURRENT_TIMESTAMP") and not (token.is_word("NOW") and self.ahead().value == "("):
            if self.name() != column:
                raise SqlError("arithmetic in SET must start with the column itself: c = c op literal")
            if self.now.kind != "sign" or self.now.value not in "+-*/":
                raise self.fail("+, -, * or /")
            op = self.next().value
            return ast.Assignment(column, self.value(clock=False), op)
        return ast.Assignment(column, self.value())

    def delete(self) -> ast.Delete:
        self.need_word("FROM")
        out = ast.Delete(self.name("a table"))
        self.finish_change(out)
        return out

    def finish_change(self, out: ast.Update | ast.Delete) -> None:
        if self.word("WHERE"):
            out.where = self.predicate()
        if self.now.is_word("RETURNING"):
            raise SqlError("RETURNING is only supported for INSERT")
        if self.now.is_word("LIMIT", "ORDER", "FROM", "JOIN", "USING"):
            raise SqlError(f"{self.now.value.upper()} is not supported in UPDATE and DELETE")

    # definitions
    def create(self):
        if self.now.is_word("VIEW", "MATERIALIZED"):
            raise SqlError("views are not supported")
        if self.now.is_word("TRIGGER"):
            raise SqlError("triggers are not supported")
        if self.now.is_word("DATABASE", "SCHEMA"):
            raise SqlError("a database is a directory; open an Engine on it")
        if self.now.is_word("TEMPORARY", "TEMP"):
            raise SqlError("temporary tables are not supported")
        unique = self.word("UNIQUE")
        if self.word("INDEX"):
            name = None if self.now.is_word("ON") else self.name("an index name")
            self.need_word("ON")
            table, column = self.index_target()
            return ast.CreateIndex(table, column, unique, name)
        if unique or not self.word("TABLE"):
            raise self.fail("TABLE or INDEX")
        quiet = self.word("IF", "NOT", "EXISTS")
        out = ast.CreateTable(self.name("a table"), [], {}, [], quiet)
        self.need_sign("(")
        while True:
            if self.now.is_word("PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "CONSTRAINT", "KEY") and self.ahead().is_word("KEY", "FOREIGN", "PRIMARY", "UNIQUE", "CHECK") or self.now.is_word("PRIMARY", "FOREIGN", "CONSTRAINT", "CHECK", "UNIQUE") and self.ahead().value == "(":
                raise SqlError("table constraints are not supported; declare them on the column")
            column, default, key = self.column()
            out.columns.append(column)
            if default is not None:
                out.defaults[column.name] = default
            if key:
                out.foreign_keys.append(key)
            if not self.sign(","):
                break
        self.need_sign(")")
        return out

    def index_target(self) -> tuple[str, str]:
        table = self.name("a table")
        self.need_sign("(")
        column = self.name("a column")
        if self.now.kind == "sign" and self.now.value == ",":
            raise SqlError("an index has one column; multi-column indexes are not supported")
        self.need_sign(")")
        return table, column

    def column(self) -> tuple[Column, ast.Operand | None, ForeignKey | None]:
        column = Column(self.name("a column"), "")
        self.type(column)
        default, key = None, None
        while True:
            if self.word("NOT", "NULL"):
                column.nullable = False
            elif self.word("NULL"):
                column.nullable = True
            elif self.word("DEFAULT"):
                default = self.value()
            elif self.word("AUTO_INCREMENT") or self.word("GENERATED", "BY", "DEFAULT", "AS", "IDENTITY"):
                if column.type != "int64":
                    raise SqlError(f"an identity column must be int, '{column.name}' is {column.type}")
                column.identity = True
            elif self.now.is_word("GENERATED"):
                raise SqlError("only GENERATED BY DEFAULT AS IDENTITY is supported")
            elif self.word("PRIMARY", "KEY"):
                if not (column.identity or column.name == "id"):
                    raise SqlError("PRIMARY KEY is only accepted on id and on identity columns; use CREATE UNIQUE INDEX")
            elif self.word("REFERENCES"):
                table, target = self.index_target()
                key = ForeignKey(column.name, table, target)
                while self.word("ON"):
                    if self.word("UPDATE"):
                        raise SqlError("ON UPDATE is not supported; referenced keys don't change")
                    self.need_word("DELETE")
                    if self.word("CASCADE"):
                        key.cascade = True
                    elif not self.word("RESTRICT"):
                        raise SqlError("ON DELETE takes RESTRICT or CASCADE")
            elif self.now.is_word("UNIQUE"):
                raise SqlError("inline UNIQUE is not supported; use CREATE UNIQUE INDEX ON t (c)")
            elif self.now.is_word("CHECK"):
                raise SqlError("CHECK is not supported")
            elif self.now.is_word("COLLATE"):
                raise SqlError("COLLATE belongs to ORDER BY, not to the column")
            else:
                break
        if column.identity and default is not None:
            raise SqlError("an identity column can't have a DEFAULT")
        return column, default, key

    def type(self, column: Column) -> None:
        name = self.name("a type").lower()
        if name in TYPES:
            column.type = TYPES[name]
        elif name == "varchar":
            column.type = "text"
            if self.sign("("):
                token = self.next()
                if token.kind != "number" or not isinstance(token.value, int) or token.value < 1:
                    raise SqlError("varchar(n) needs a positive length")
                column.max_length = token.value
                self.need_sign(")")
        elif name == "enum":
            column.type, column.enum = "text", []
            self.need_sign("(")
            while True:
                token = self.next()
                if token.kind != "text":
                    raise SqlError("enum takes quoted values")
                if token.value in column.enum:
                    raise SqlError(f"enum repeats '{token.value}'")
                column.enum.append(token.value)
                if not self.sign(","):
                    break
            self.need_sign(")")
        elif name == "vector":
            column.type = "vector"
            self.need_sign("(")
            token = self.next()
            if token.kind != "number" or not isinstance(token.value, int) or token.value < 1:
                raise SqlError("vector(n) needs a positive dimension")
            column.dim = token.value
            self.need_sign(")")
        else:
            hint = f"; use {INSTEAD[name]}" if name in INSTEAD else ""
            raise SqlError(f"unknown type '{name}'{hint}")

    def drop(self):
        if self.now.is_word("DATABASE", "SCHEMA"):
            raise SqlError("to drop a database, delete the database directory")
        if self.now.is_word("VIEW"):
            raise SqlError("views are not supported")
        if self.now.is_word("TRIGGER"):
            raise SqlError("triggers are not supported")
        if self.word("TABLE"):
            quiet = self.word("IF", "EXISTS")
            out = ast.DropTable(self.name("a table"), quiet)
            if self.now.is_word("CASCADE", "RESTRICT"):
                raise SqlError("DROP TABLE ... CASCADE is not supported; drop the referencing tables first")
            return out
        if not self.word("INDEX"):
            raise self.fail("TABLE or INDEX")
        quiet = self.word("IF", "EXISTS")
        if not self.now.is_word("ON"):
            self.name("an index name")
        if not self.word("ON"):
            raise SqlError("write DROP INDEX ON table (column)")
        return ast.DropIndex(*self.index_target(), quiet)

    def alter(self):
        if not self.word("TABLE"):
            raise SqlError("only ALTER TABLE is supported")
        table = self.name("a table")
        if self.word("ADD"):
            if self.now.is_word("CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "INDEX"):
                raise SqlError("table constraints are not supported; use CREATE UNIQUE INDEX")
            self.word("COLUMN")
            return ast.AddColumn(table, *self.column())
        if self.word("DROP"):
            self.word("COLUMN")
            quiet = self.word("IF", "EXISTS")
            return ast.DropColumn(table, self.name("a column"), quiet)
        if self.word("RENAME"):
            if self.word("TO"):
                return ast.RenameTable(table, self.name("a table"))
            self.word("COLUMN")
            column = self.name("a column")
            self.need_word("TO")
            return ast.RenameColumn(table, column, self.name("a column"))
        if self.now.is_word("ALTER", "MODIFY", "CHANGE"):
            raise SqlError(f"ALTER TABLE ... {self.now.value.upper()} is not supported")
        raise self.fail("ADD, DROP or RENAME")


def parse(sql: str):
    """The one statement of ``sql``."""
    return Parser(sql).statement()
