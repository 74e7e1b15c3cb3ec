"""The engine: SQL, records, search, snapshots and transactions over versioned tables."""

from __future__ import annotations

import datetime as dt
import itertools
import json
import os
import shutil
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle import errors as E
from brindle.dialect import ast
from brindle.dialect.binder import Binder
from brindle.dialect.compiler import Output, Predicates, Scope, SelectCompiler, conjuncts, literal
from brindle.dialect.parser import parse
from brindle.operators import dml, search
from brindle.sources import equalityindex, textindex, vectorindex
from brindle.sources.store import State, Store
from brindle.types import Column, ForeignKey, Index, Schema, check, coerce, from_tagged, kind_of, to_tagged

DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
VECTOR_OPTIONS = {"quantized": False, "metric": "cosine", "ef_construction": 200, "m": 16, "mode": "sync"}
CASCADE_DEPTH, CASCADE_ROWS = 64, 100_000
SMALL_FILES, SMALL_BYTES = 64, 8 << 20
_counter = itertools.count()
_id_lock = threading.Lock()
_last_id = 0


def new_id() -> str:
    """26 characters, increasing in the process: milliseconds and a counter in base 32."""
    global _last_id
    with _id_lock:
        _last_id = max(_last_id + 1, int(time.time() * 1000) << 80)
        value = _last_id
    out = []
    for _ in range(26):
        out.append(DIGITS[value & 31])
        value >>= 5
    return "".join(reversed(out))


class Result:
    """What a statement gave: rows (a DataFrame until they are asked for), a count, or nothing."""

    def __init__(self, kind: str, columns: list[str] | None = None, df: DataFrame | None = None, types: list[str] | None = None, count: int = 0, identity: tuple[str, list[int]] | None = None, rows: list[list] | None = None):
        self.kind, self.columns, self.df, self.types, self.count, self.identity = kind, columns or [], df, types or [], count, identity
        self._rows = rows

    @property
    def lastrowid(self) -> int | None:
        return self.identity[1][-1] if self.identity and self.identity[1] else None

    @property
    def rows(self) -> list[list]:
        if self._rows is None:
            self._rows = [list(python_row(r, self.types)) for r in self.df.collect()] if self.df is not None else []
        return self._rows

    def to_json(self) -> dict:
        if self.kind == "rows":
            return {"columns": self.columns, "rows": [[to_tagged(v) for v in r] for r in self.rows]}
        if self.kind == "inserted":
            out: dict = {"inserted": self.count}
            if self.identity:
                out |= {"identity": {"column": self.identity[0], "values": self.identity[1]}, "lastrowid": self.lastrowid}
            return out
        return {"affected": self.count} if self.kind == "affected" else {"ok": True}


def python_value(value: Any, kind: str) -> Any:
    if value is None:
        return None
    if kind == "json":
        return json.loads(value)
    if kind == "time":
        return (dt.datetime.min + dt.timedelta(microseconds=value)).time()
    if kind == "blob":
        return bytes(value)
    return value


def python_row(row: Sequence, types: list[str]) -> Iterator[Any]:
    return (python_value(v, t) for v, t in itertools.zip_longest(row, types[: len(row)], fillvalue=""))


class Cursor:
    """Rows one after another, read partition by partition; one table, without ORDER BY, joins and aggregates."""

    def __init__(self, outputs: list[Output], df: DataFrame):
        self.columns, self._types = [o.header for o in outputs], [o.type for o in outputs]
        self._rows = df.toLocalIterator(prefetchPartitions=True)

    def __iter__(self) -> Iterator[list]:
        return (list(python_row(r, self._types)) for r in self._rows)

    def fetchone(self) -> list | None:
        return next(iter(self), None)

    def fetchmany(self, n: int) -> list[list]:
        return list(itertools.islice(iter(self), n))

    def fetchall(self) -> list[list]:
        return list(self)


class Reads:
    """What can be asked of any version: SQL reads, records and search.  ``_state()`` gives the version."""

    engine: Engine

    def _state(self) -> State:
        raise NotImplementedError

    def _resolve(self, table: str) -> tuple[Schema, DataFrame]:
        attached = self.engine.attached.get(table)
        if attached:
            return attached
        state = self._state()
        if table not in state.tables:
            raise E.TableNotFound(f"table not found: {table}")
        return state.schema(table), state.frame(table)

    def _held(self, table: str, column: str, value: Any) -> DataFrame:
        """The rows of the files that may hold ``value`` in an indexed column; all rows where no index says."""
        schema, df = self._resolve(table)
        c = schema.get(column)
        if table in self.engine.attached or value is None or column != "id" and not any(i.column == column for i in schema.indexes):
            return df
        files, index = self._state().tables[table]["files"], equalityindex.EqualityIndex(self.engine.store, table, c.key)
        if not index.segments():
            return df
        return self.engine.store.read(index.files_with(files, literal(coerce(value, c, True), c.type).cast(c.field().dataType)), schema.struct())

    def _compiled(self, select: ast.Select) -> SelectCompiler:
        """A table that an indexed column is compared with a value in is read from the files that may hold it.

        The condition of WHERE holds for no other row and for no row of nulls, so that is true of outer joins too.
        """
        sources = [select.source, *(j.source for j in select.joins)]

        def resolve(table: str) -> tuple[Schema, DataFrame]:
            schema, df = self._resolve(table)
            own = [x for x in sources if x.table == table]
            for p in conjuncts(select.where):
                if not isinstance(p, ast.Compare) or p.op != "=" or len(own) > 1:
                    continue
                ref, value = (p.left, p.right) if isinstance(p.left, ast.Ref) else (p.right, p.left)
                if isinstance(ref, ast.Ref) and isinstance(value, ast.Literal) and (ref.table == own[0].alias or ref.table is None and len(sources) == 1) and schema.get(ref.name):
                    try:
                        return schema, self._held(table, ref.name, value.value)
                    except E.EngineError:  # a value of another type: the compiler says what is wrong with it
                        continue
            return schema, df

        return SelectCompiler(select, resolve, self.engine.compat_outer_pushdown)

    def _read(self, statement: ast.Select | ast.Explain) -> Result:
        if isinstance(statement, ast.Explain):
            lines = self._compiled(statement.select).explain()
            return Result("rows", ["plan"], types=["text"], rows=[[x] for x in lines])
        outputs, df = self._compiled(statement).compile()
        return Result("rows", [o.header for o in outputs], df, [o.type for o in outputs])

    def sql(self, sql: str, params: Sequence | Mapping | None = None) -> DataFrame:
        """The DataFrame of a SELECT, for further work in Spark."""
        statement = Binder(params).bind(parse(sql))
        if not isinstance(statement, ast.Select):
            raise E.SqlError("sql() takes a SELECT")
        return self._compiled(statement).compile()[1]

    def cursor(self, sql: str, params: Sequence | Mapping | None = None) -> Cursor:
        statement = Binder(params).bind(parse(sql))
        if not isinstance(statement, ast.Select) or statement.joins or statement.order_by or statement.aggregated:
            raise E.SqlError("a cursor reads one table without JOIN, ORDER BY and aggregates")
        return Cursor(*self._compiled(statement).compile())

    def _record(self, schema: Schema, row: Any) -> dict:
        return {c.name: python_value(row[c.key], c.type) for c in schema.columns}

    def _id(self, schema: Schema) -> Column:
        column = schema.get("id")
        if column is None:
            raise E.InvalidArgument("the table has no id column")
        return column

    def get(self, table: str, id: Any) -> dict | None:
        schema, _ = self._resolve(table)
        row = self._held(table, self._id(schema).name, id).where(F.col(self._id(schema).key) == F.lit(id)).first()
        return None if row is None else self._record(schema, row)

    def scan(self, table: str) -> DataFrame:
        """The table's rows under their column names."""
        schema, df = self._resolve(table)
        return df.select(*[F.col(c.key).alias(c.name) for c in schema.columns])

    def scan_batch(self, table: str, after_id: Any = None, limit: int = 1000) -> list[dict]:
        """The next rows by id, after the one given."""
        schema, df = self._resolve(table)
        key = self._id(schema).key
        if after_id is not None:
            df = df.where(F.col(key) > F.lit(after_id))
        return [self._record(schema, r) for r in df.orderBy(key).limit(limit).collect()]

    def find_eq(self, table: str, column: str, value: Any) -> DataFrame:
        schema, _ = self._resolve(table)
        c = schema.get(column)
        if c is None:
            raise E.ColumnNotFound(f"unknown column '{column}'")
        rows = self._held(table, column, value).select(*[F.col(x.key).alias(x.name) for x in schema.columns])
        return rows.where(F.col(f"`{column}`") == literal(coerce(value, c, True), c.type))

    def find_eq_batch(self, table: str, column: str, value: Any, after_id: Any = None, limit: int = 1000) -> list[dict]:
        df = self.find_eq(table, column, value)
        df = df if after_id is None else df.where(F.col("id") > F.lit(after_id))
        schema = self._resolve(table)[0]
        return [{c.name: python_value(r[c.name], c.type) for c in schema.columns} for r in df.orderBy("id").limit(limit).collect()]

    def tables(self) -> list[str]:
        return sorted({*self._state().tables, *self.engine.attached})

    def table_schema(self, table: str) -> Schema:
        return self._resolve(table)[0]

    # search
    def _keep(self, schema: Schema, wanted: Mapping | None):
        if not wanted:
            return None
        out = F.lit(True)
        for name, value in wanted.items():
            c = schema.get(name)
            if c is None:
                out = out & F.lit(value is None)  # a missing key counts as NULL, and NULL matches NULL here
            else:
                out = out & F.col(c.key).eqNullSafe(literal(coerce(value, c, True), c.type))
        return out

    def _search_column(self, table: str, column: str, kind: str) -> tuple[Schema, DataFrame, str]:
        schema, df = self._resolve(table)
        c = schema.get(column)
        if c is None:
            raise E.ColumnNotFound(f"unknown column '{column}'")
        if c.type != kind:
            raise E.InvalidArgument(f"column '{column}' is {c.type}, not {kind}")
        if table not in self.engine.attached and column not in (schema.text_indexes if kind == "text" else schema.vector_indexes):
            raise E.IndexNotFound(f"no {kind} index on {table}.{column}")
        return schema, df, c.key

    def _metric(self, schema: Schema, column: str, metric: str | None) -> str:
        return metric or schema.vector_indexes.get(column, {}).get("metric", "cosine")

    def search_text_df(self, table, column, query, top_k=10, filter=None) -> DataFrame:
        return textindex.top(self._text_scores(table, column, query, filter), top_k)

    def _text_scores(self, table: str, column: str, query: str, filter: Mapping | None) -> DataFrame:
        """(id, score) by the persisted index; by a scan where there is none (attached tables, engines opened for reading)."""
        schema, df, key = self._search_column(table, column, "text")
        id_key, keep = self._id(schema).key, self._keep(schema, filter)
        if table in self.engine.attached or self.engine.read_only:
            return search.bm25(df, id_key, key, query, keep)
        files, index = self._state().tables[table]["files"], textindex.TextIndex(self.engine.store, table, key)
        index.catch_up(files, schema.struct(), id_key, key)
        return index.search(files, query, textindex.kept(df, id_key, keep))

    def search_vector_df(self, table, column, vector, top_k=10, filter=None, metric: str | None = None, ef_search: int | None = None, exact: bool = False) -> DataFrame:
        """(id, distance), nearest first: the index proposes, the vectors decide; ``exact`` compares all vectors."""
        schema, df, key = self._search_column(table, column, "vector")
        dim = schema.get(column).dim
        if dim is not None and len(vector) != dim:
            raise E.InvalidArgument(f"column '{column}' has {dim} dimensions, not {len(vector)}")
        id_key, keep, metric, vector = self._id(schema).key, self._keep(schema, filter), self._metric(schema, column, metric), list(vector)
        quantized = schema.vector_indexes.get(column, {}).get("quantized")
        if exact or table in self.engine.attached or self.engine.read_only or dim is None:
            run = search.nearest_quantized if quantized else search.nearest
            return run(df, id_key, key, vector, top_k, metric, keep)
        files, index = self._state().tables[table]["files"], vectorindex.VectorIndex(self.engine.store, table, key)
        index.catch_up(files, schema.struct(), id_key, key)
        found = index.search(files, vector, top_k if quantized else max(4 * top_k, ef_search or 100), metric, keep=textindex.kept(df, id_key, keep))
        return found if quantized else vectorindex.rescored(df, id_key, key, found, vector, top_k, metric)

    def _hits(self, table: str, top: DataFrame, name: str, descending: bool) -> list[tuple[Any, float, dict]]:
        schema, df = self._resolve(table)
        hits = [(r["id"], r[name]) for r in top.collect()]
        key = self._id(schema).key
        records = {r[key]: self._record(schema, r) for r in df.where(F.col(key).isin([i for i, _ in hits])).collect()} if hits else {}
        return sorted(((i, s, records[i]) for i, s in hits), key=lambda x: (-x[1] if descending else x[1], x[0]))

    def search_text(self, table, column, query, top_k=10, filter=None) -> list[tuple[Any, float, dict]]:
        """(id, score, record), best first."""
        return self._hits(table, self.search_text_df(table, column, query, top_k, filter), "score", True)

    def search_vector(self, table, column, vector, top_k=10, filter=None, ef_search: int | None = None) -> list[tuple[Any, float, dict]]:
        """(id, distance, record), nearest first; ``ef_search`` is the number of candidates whose own vectors are compared."""
        return self._hits(table, self.search_vector_df(table, column, vector, top_k, filter, ef_search=ef_search), "distance", False)

    def search_hybrid(self, table: str, text: tuple[str, str] | None = None, vector: tuple[str, list[float]] | None = None, top_k: int = 10, filter: Mapping | None = None, ef_search: int | None = None) -> list[tuple[Any, float, dict]]:
        """(id, score, record) by reciprocal ranks."""
        if not text and not vector:
            raise E.InvalidArgument("hybrid search needs a text or a vector query")
        schema, df = self._resolve(table)
        t = v = None
        if text:
            t = self._text_scores(table, text[0], text[1], filter)
        if vector:
            v = (self._search_column(table, vector[0], "vector")[2], list(vector[1]), self._metric(schema, vector[0], None))
        return self._hits(table, search.search_hybrid(df, self._id(schema).key, top_k, t, v, self._keep(schema, filter)), "score", True)


class Writer:
    """Statements that change a ``State``."""

    def __init__(self, engine: Engine, state: State, reads: Reads):
        self.engine, self.state, self.reads = engine, state, reads

    def table(self, name: str) -> Schema:
        if name in self.engine.attached:
            raise E.ReadOnly(f"table {name} is attached for reading")
        if name not in self.state.tables:
            raise E.TableNotFound(f"table not found: {name}")
        return self.state.schema(name)

    def column(self, schema: Schema, name: str) -> Column:
        c = schema.get(name)
        if c is None:
            raise E.ColumnNotFound(f"unknown column '{name}'")
        return c

    # rows
    def fill(self, table: str, records: list[dict[str, Any]], converted: bool = False) -> tuple[list[dict], tuple[str, list[int]] | None]:
        """Records converted to the schema, with defaults, ids and identity numbers."""
        schema = self.table(table)
        names = {c.name for c in schema.columns}
        out, identity = [], None
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
        for record in records:
            if extra := set(record) - names:
                raise E.ColumnNotFound(f"unknown column '{sorted(extra)[0]}'")
            row = {}
            for c in schema.columns:
                if c.name in record:
                    row[c.name] = record[c.name] if converted else coerce(record[c.name], c, True)
                elif c.default_now:
                    row[c.name] = coerce(now, c, True)
                else:
                    row[c.name] = c.default if c.has_default else None
                if c.name == "id" and c.type == "text" and row["id"] is None:
                    row["id"] = new_id()
                if c.identity:
                    high = self.engine.high_water(table, c.name, self.state)
                    row[c.name] = high + 1 if row[c.name] is None else row[c.name]
                    self.engine.advance(table, c.name, self.state, row[c.name])
                    identity = identity or (c.name, [])
                    identity[1].append(row[c.name])
                check(row[c.name], c)
            out.append(row)
        return out, identity

    def frame_of(self, table: str, rows: list[dict]) -> DataFrame:
        schema = self.state.schema(table)
        return self.engine.spark.createDataFrame([tuple(r[c.name] for c in schema.columns) for r in rows], schema.struct())

    def insert(self, table: str, records: list[dict], ignore: bool = False, converted: bool = False) -> tuple[list[dict], tuple[str, list[int]] | None]:
        rows, identity = self.fill(table, records, converted)
        schema, old = self.state.schema(table), self.state.frame(table)
        for name in dict.fromkeys([*(["id"] if schema.get("id") else []), *schema.unique_columns()]):
            c = schema.get(name)
            values = {r[name] for r in rows if r[name] is not None}
            known = {r[0] for r in old.where(F.col(c.key).isin(list(values))).select(c.key).collect()} if values and self.state.tables[table]["files"] else set()
            kept = []
            for r in rows:
                if r[name] is not None and r[name] in known:
                    if not ignore:
                        raise (E.DuplicateId if name == "id" else E.UniqueViolation)(f"{table}.{name} has {r[name]!r} already")
                    continue
                known.add(r[name]) if r[name] is not None else None
                kept.append(r)
            rows = kept
        if rows:
            self.check_parents(table, {f.column for f in schema.foreign_keys}, rows)
            new = self.frame_of(table, rows)
            self.state.tables[table]["files"] += self.state.store.write(new)
            if schema.get("id"):
                self.state.note(table, new.select(schema.get("id").key))
        return rows, identity

    def append(self, table: str, df: DataFrame) -> int:
        """Insert a DataFrame's rows, and say how many; all checks are joins and aggregates."""
        schema = self.table(table)
        if extra := set(df.columns) - {c.name for c in schema.columns}:
            raise E.ColumnNotFound(f"unknown column '{sorted(extra)[0]}'")
        values, now = [], dt.datetime.now(dt.UTC).replace(tzinfo=None)
        for c in schema.columns:
            kind = T.StringType() if c.type == "json" else c.field().dataType
            if c.name in df.columns:
                values.append(F.col(f"`{c.name}`").cast(kind).alias(c.key))
            elif c.name == "id" and c.type == "text":
                stamp = int(time.time() * 1000)
                prefix = "".join(DIGITS[stamp >> (5 * k) & 31] for k in range(9, -1, -1))
                values.append(F.concat(F.lit(prefix), F.lpad(F.conv(F.monotonically_increasing_id().cast("string"), 10, 32), 16, "0")).alias(c.key))
            else:
                given = coerce(now, c, True) if c.default_now else c.default
                values.append(literal(given, c.type).cast(kind).alias(c.key))
        new = df.select(*values)
        identity = next((c for c in schema.columns if c.identity), None)
        if identity and identity.name not in df.columns:
            order = F.col(schema.get("id").key) if schema.get("id") and schema.get("id") is not identity else F.monotonically_increasing_id()
            new = dml.assign_identity(new.withColumn("_order", order), self.engine.high_water(table, identity.name, self.state), ["_order"], identity.key).drop("_order").select(*[c.key for c in schema.columns])
        files = self.state.store.write(new)
        written = self.state.store.read(files, schema.struct())
        self.check_frame(schema, written)
        before = self.state.tables[table]["files"]
        for name in dict.fromkeys([*(["id"] if schema.get("id") else []), *schema.unique_columns()]):
            key = schema.get(name).key
            self.refuse_repeats(table, name, written, key)
            # The older keys are only probed: the new ones are broadcast if they are few, and nothing is grouped again.
            old = self.state.store.read(before, schema.struct()).select(key)
            again = old.join(written.select(key), key, "left_semi").first() if before else None
            if again is not None:
                raise (E.DuplicateId if name == "id" else E.UniqueViolation)(f"{table}.{name} would hold {again[0]!r} more than once")
        for f in schema.foreign_keys:
            self.check_orphans(table, f, written)
        self.state.tables[table]["files"] = before + files
        if identity:
            top = written.agg(F.max(identity.key)).first()[0]
            if top is not None:
                self.engine.advance(table, identity.name, self.state, top)
        if schema.get("id"):
            self.state.note(table, written.select(schema.get("id").key))
        return written.count()

    def check_frame(self, schema: Schema, df: DataFrame) -> None:
        """NOT NULL, length, enumeration and dimension, in one pass."""
        tests = []
        for c in schema.columns:
            col = F.col(c.key)
            if not c.nullable:
                tests.append((f"column '{c.name}' is NOT NULL", col.isNull()))
            if c.max_length is not None:
                tests.append((f"column '{c.name}' takes at most {c.max_length} characters", F.char_length(col) > c.max_length))
            if c.enum is not None:
                tests.append((f"column '{c.name}' must be one of {', '.join(map(repr, c.enum))}", col.isNotNull() & ~col.isin(c.enum)))
            if c.dim is not None:
                tests.append((f"column '{c.name}' has {c.dim} dimensions", col.isNotNull() & (F.size(col) != c.dim)))
        if tests:
            found = df.agg(*[F.max(F.coalesce(t, F.lit(False)).cast("int")).alias(f"t{k}") for k, (_, t) in enumerate(tests)]).first()
            for (message, _), bad in zip(tests, found):
                if bad:
                    raise E.SchemaViolation(message)

    def refuse_repeats(self, table: str, name: str, df: DataFrame, key: str) -> None:
        bad = dml.unique_violations(df, key).first()
        if bad is not None:
            raise (E.DuplicateId if name == "id" else E.UniqueViolation)(f"{table}.{name} would hold {bad[0]!r} more than once")

    def check_orphans(self, table: str, f: ForeignKey, rows: DataFrame) -> None:
        schema, target = self.state.schema(table), self.state.schema(f.table)
        bad = dml.orphans(rows, schema.get(f.column).key, self.state.frame(f.table), target.get(f.target).key).first()
        if bad is not None:
            raise E.SchemaViolation(f"{table}.{f.column} refers to {bad[schema.get(f.column).key]!r}, which {f.table}.{f.target} lacks")

    def check_parents(self, table: str, columns: set[str], rows: list[dict]) -> None:
        for f in self.state.schema(table).foreign_keys:
            if f.column not in columns:
                continue
            values = {r[f.column] for r in rows if r.get(f.column) is not None}
            if f.table == table:
                values -= {r[f.target] for r in rows}
            if not values:
                continue
            key = self.state.schema(f.table).get(f.target).key
            have = {r[0] for r in self.state.frame(f.table).where(F.col(key).isin(list(values))).select(key).collect()}
            if missing := values - have:
                raise E.SchemaViolation(f"{table}.{f.column} refers to {next(iter(missing))!r}, which {f.table}.{f.target} lacks")

    def condition(self, table: str, where: ast.Predicate | None):
        """WHERE over the table's own columns."""
        schema = self.table(table)
        if where is None:
            return F.lit(True)
        scope = Scope([(ast.Source(table, table), schema)])

        def find(ref: ast.Ref):
            b = scope.find(ref)
            return F.col(b.column.key), b.type, str(b)

        return Predicates(find).compile(where)

    def rewrite(self, table: str, condition, change: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrite the files that hold matching rows."""
        state, schema = self.state, self.state.schema(table)
        files = state.tables[table]["files"]
        touched = set(state.store.files_with(state.frame(table), condition)) if files else set()
        if not touched:
            return
        kept = [f for f in files if f not in touched]
        state.tables[table]["files"] = kept + state.store.write(change(state.store.read(sorted(touched), schema.struct())))

    def update(self, table: str, assignments: list[ast.Assignment], where: ast.Predicate | None) -> int:
        schema, condition = self.table(table), self.condition(table, where)
        values, fresh = {}, {}
        referenced = {f.target for s in (self.state.schema(t) for t in self.state.tables) for f in s.foreign_keys if f.table == table}
        for a in assignments:
            c = self.column(schema, a.column)
            if a.column in fresh:
                raise E.SqlError(f"column '{a.column}' is set twice")
            if a.column == "id" or c.identity:
                raise E.SchemaViolation(f"column '{a.column}' can't be updated")
            if a.column in referenced:
                raise E.SchemaViolation(f"column '{a.column}' is referenced by a foreign key and can't be updated")
            fresh[a.column] = c
            if a.op:
                v = a.value.value
                if c.type not in ("int64", "float64") or v is None or kind_of(v) not in ("int64", "float64") or (c.type == "int64" and not isinstance(v, int)):
                    raise E.SqlError(f"arithmetic needs a number that fits column '{c.name}' ({c.type})")
                values[c.key] = dml.arithmetic(F.col(c.key), a.op, v, c.type == "int64")
            else:
                v = coerce(a.value.value, c, a.value.bound)
                check(v, c)
                values[c.key] = literal(v, c.type).cast(c.field().dataType)
        hit = F.coalesce(condition, F.lit(False))
        rows = self.state.frame(table).where(hit)
        n = rows.count()
        if not n:
            return 0
        if schema.get("id"):
            self.state.note(table, rows.select(schema.get("id").key))
        try:
            self.rewrite(table, hit, lambda df: dml.update_rows(df, hit, values))
        except Exception as e:
            text = str(e)
            for word in ("division by zero", "integer overflow", "float overflow"):
                if word in text:
                    raise E.SqlError(f"UPDATE {table}: {word}") from None
            raise
        for name in schema.unique_columns():
            if name in fresh:
                self.refuse_repeats(table, name, self.state.frame(table), schema.get(name).key)
        for f in schema.foreign_keys:
            if f.column in fresh:
                self.check_orphans(table, f, self.state.frame(table))
        return n

    def delete(self, table: str, where: ast.Predicate | None) -> int:
        hit = F.coalesce(self.condition(table, where), F.lit(False))
        return self.remove(table, hit, 0)

    def remove(self, table: str, hit: SparkColumn | None, depth: int, gone: DataFrame | None = None) -> int:
        """Delete the rows that match ``hit``, or whose key is in ``gone`` (one column), and those that refer to them if their key says so."""
        if depth > CASCADE_DEPTH:
            raise E.SchemaViolation(f"a cascade goes deeper than {CASCADE_DEPTH}")
        state, schema = self.state, self.state.schema(table)
        split = lambda df, doomed: (df.where(hit if doomed else ~hit) if gone is None else df.join(gone, gone.columns[0], "left_semi" if doomed else "left_anti")).select(*df.columns)
        doomed = split(state.frame(table), True)
        n = doomed.count()
        if not n:
            return 0
        children = [(t, f) for t in state.tables for f in state.schema(t).foreign_keys if f.table == table]
        if children and depth and n > CASCADE_ROWS:
            raise E.SchemaViolation(f"a cascade would delete more than {CASCADE_ROWS} rows")
        keys: list[tuple[str, ForeignKey, DataFrame]] = []
        for child, f in children:
            target, own = schema.get(f.target).key, state.schema(child).get(f.column).key
            keys_gone = state.store.read(state.store.write(doomed.select(target).distinct()), T.StructType([T.StructField(target, doomed.schema[target].dataType)]))
            survivors = split(state.frame(child), False) if child == table else state.frame(child)
            if not f.cascade and dml.referencing(survivors, own, keys_gone, target).first() is not None:
                raise E.SchemaViolation(f"{table}.{f.target} is referenced by {child}.{f.column}")
            if f.cascade:
                keys.append((child, f, keys_gone.select(F.col(target).alias(own))))
        if schema.get("id"):
            state.note(table, doomed.select(schema.get("id").key))
        files = state.tables[table]["files"]
        touched = set(state.store.files_of(split(state.frame(table).select("*", F.col("_metadata.file_path").alias("_file")), True), "_file"))
        state.tables[table]["files"] = [f for f in files if f not in touched] + state.store.write(split(state.store.read(sorted(touched), schema.struct()), False))
        for child, _, keys_gone in keys:
            self.remove(child, None, depth + 1, keys_gone)
        return n

    # definitions
    def fresh_key(self, table: str) -> str:
        n = self.state.tables[table]["next_key"]
        self.state.tables[table]["next_key"] = n + 1
        return f"c{n}"

    def create_table(self, s: ast.CreateTable) -> None:
        if s.table in self.state.tables or s.table in self.engine.attached:
            if s.if_not_exists:
                return
            raise E.TableExists(f"table exists: {s.table}")
        names = [c.name for c in s.columns]
        if len(set(names)) < len(names):
            raise E.SqlError("a column is declared twice")
        if sum(c.identity for c in s.columns) > 1:
            raise E.SqlError("a table has one identity column at most")
        columns = list(s.columns)
        own = next((c for c in columns if c.name == "id"), None)
        if own is None:
            columns.insert(0, Column("id", "text", nullable=False))
        elif own.type not in ("text", "int64"):
            raise E.SqlError("id must be text or int")
        self.state.tables[s.table] = {"schema": None, "files": [], "next_key": 0, "high": {}}
        for c in columns:
            c.key = self.fresh_key(s.table)
            if c.name in s.defaults:
                self.set_default(c, s.defaults[c.name])
        self.state.schemas[s.table] = schema = Schema(columns)
        for c in columns:
            if c.identity:
                schema.indexes.append(Index(c.name, True))
        for f in s.foreign_keys:
            self.add_key(s.table, f)
        self.state.save_schema(s.table)

    def set_default(self, c: Column, default: ast.Literal) -> None:
        if default.bound and isinstance(default.value, dt.datetime) and c.type in ("timestamp", "text"):
            c.default_now = True
            return
        c.default, c.has_default = coerce(default.value, c), True
        if c.default is not None:
            check(c.default, c)

    def add_key(self, table: str, f: ForeignKey) -> None:
        if f.table != table and f.table not in self.state.tables:
            raise E.TableNotFound(f"table not found: {f.table}")
        schema, other = self.state.schema(table), self.state.schema(f.table)
        target, own = other.get(f.target), schema.get(f.column)
        if target is None:
            raise E.ColumnNotFound(f"unknown column '{f.table}.{f.target}'")
        if f.target != "id" and f.target not in other.unique_columns():
            raise E.SchemaViolation(f"{f.table}.{f.target} must be unique to be referenced")
        if target.type != own.type:
            raise E.SchemaViolation(f"{table}.{f.column} is {own.type}, {f.table}.{f.target} is {target.type}")
        schema.foreign_keys.append(f)
        if not any(i.column == f.column for i in schema.indexes):
            schema.indexes.append(Index(f.column))

    def define(self, s: Any) -> None:
        if isinstance(s, ast.CreateTable):
            return self.create_table(s)
        state = self.state
        if isinstance(s, ast.DropTable):
            if s.table not in state.tables:
                if s.if_exists:
                    return None
                raise E.TableNotFound(f"table not found: {s.table}")
            for t in state.tables:
                if t != s.table and any(f.table == s.table for f in state.schema(t).foreign_keys):
                    raise E.SchemaViolation(f"table {s.table} is referenced by {t}")
            del state.tables[s.table]
            state.schemas.pop(s.table, None)
            state.redefined.add(s.table)
            return None
        schema = self.table(s.table)
        if isinstance(s, ast.CreateIndex):
            c = self.column(schema, s.column)
            if c.type == "vector":
                raise E.SqlError("a vector column takes a vector index; use create_vector_index")
            known = next((i for i in schema.indexes if i.column == s.column), None)
            if s.unique:
                self.refuse_repeats(s.table, s.column, state.frame(s.table), c.key)
            if known:
                known.unique = known.unique or s.unique
            else:
                schema.indexes.append(Index(s.column, s.unique, s.name))
        elif isinstance(s, ast.DropIndex):
            known = [i for i in schema.indexes if i.column == s.column]
            if not known:
                if s.if_exists:
                    return None
                raise E.IndexNotFound(f"no index on {s.table} ({s.column})")
            if any(f.column == s.column for f in schema.foreign_keys) or self.column(schema, s.column).identity:
                raise E.SchemaViolation(f"the index on {s.table} ({s.column}) belongs to a constraint")
            schema.indexes.remove(known[0])
        elif isinstance(s, ast.AddColumn):
            self.add_column(s, schema)
        elif isinstance(s, ast.DropColumn):
            c = schema.get(s.column)
            if c is None:
                if s.if_exists:
                    return None
                raise E.ColumnNotFound(f"unknown column '{s.column}'")
            uses = any(f.column == s.column for f in schema.foreign_keys) or any(f.table == s.table and f.target == s.column for t in state.tables for f in state.schema(t).foreign_keys)
            if uses:
                raise E.SchemaViolation(f"column '{s.column}' is part of a foreign key")
            if s.column == "id" or len(schema.columns) <= 2 and schema.columns[0].name == "id":
                raise E.SchemaViolation(f"column '{s.column}' can't be dropped: a table keeps id and another column")
            schema.columns.remove(c)
            schema.indexes = [i for i in schema.indexes if i.column != s.column]
            schema.text_indexes = [x for x in schema.text_indexes if x != s.column]
            schema.vector_indexes.pop(s.column, None)
        elif isinstance(s, ast.RenameColumn):
            c = self.column(schema, s.column)
            if s.column == "id" or s.to == "id":
                raise E.SchemaViolation("id can't be renamed")
            if schema.get(s.to):
                raise E.SchemaViolation(f"column '{s.to}' exists")
            c.name = s.to
            for x in [*schema.indexes, *schema.foreign_keys]:
                x.column = s.to if x.column == s.column else x.column
            schema.text_indexes = [s.to if x == s.column else x for x in schema.text_indexes]
            schema.vector_indexes = {s.to if k == s.column else k: v for k, v in schema.vector_indexes.items()}
            for t in state.tables:
                for f in state.schema(t).foreign_keys:
                    if f.table == s.table and f.target == s.column:
                        f.target = s.to
                        state.save_schema(t)
            high = state.tables[s.table]["high"]
            if s.column in high:
                high[s.to] = high.pop(s.column)
        elif isinstance(s, ast.RenameTable):
            if s.to in state.tables or s.to in self.engine.attached:
                raise E.TableExists(f"table exists: {s.to}")
            state.tables[s.to] = state.tables.pop(s.table)
            state.schemas[s.to] = state.schemas.pop(s.table)
            for t in state.tables:
                for f in state.schema(t).foreign_keys:
                    if f.table == s.table:
                        f.table = s.to
                        state.save_schema(t)
            state.redefined.add(s.table)
            state.save_schema(s.to)
            return None
        state.save_schema(s.table)
        return None

    def add_column(self, s: ast.AddColumn, schema: Schema) -> None:
        c, files = s.column, self.state.tables[s.table]["files"]
        if schema.get(c.name):
            raise E.SchemaViolation(f"column '{c.name}' exists")
        if c.identity:
            raise E.SqlError("an identity column can't be added to a table")
        if s.default is not None:
            self.set_default(c, s.default)
        has_rows = bool(files) and self.state.frame(s.table).first() is not None
        if has_rows and not c.nullable and not (c.has_default and c.default is not None):
            raise E.SchemaViolation(f"column '{c.name}' is NOT NULL and has no default for the rows that exist")
        c.key = self.fresh_key(s.table)
        if has_rows and c.has_default and c.default is not None:
            old = self.state.frame(s.table)
            self.state.tables[s.table]["files"] = self.state.store.write(old.withColumn(c.key, literal(c.default, c.type).cast(c.field().dataType)))
        schema.columns.append(c)
        if s.foreign_key:
            self.add_key(s.table, s.foreign_key)

    # statements
    def run(self, s: Any) -> Result:
        if isinstance(s, ast.Insert):
            return self.run_insert(s)
        if isinstance(s, ast.Update):
            return Result("affected", count=self.update(s.table, s.assignments, s.where))
        if isinstance(s, ast.Delete):
            return Result("affected", count=self.delete(s.table, s.where))
        self.define(s)
        return Result("ok")

    def run_insert(self, s: ast.Insert) -> Result:
        schema = self.table(s.table)
        declared = [c for c in schema.columns if not c.identity and not (c.name == "id" and c.type == "text" and not c.nullable)]
        names = s.columns if s.columns is not None else [c.name for c in declared]
        if len(set(names)) < len(names):
            raise E.SqlError("a column is named twice")
        for n in names:
            self.column(schema, n)
        for row in s.rows:
            if len(row) != len(names):
                what = f"{len(names)} declared columns" if s.columns is None else f"{len(names)} columns"
                raise E.SqlError(f"{s.table} has {what}, a row has {len(row)} values")
        records = [{n: coerce(v.value, schema.get(n), v.bound) for n, v in zip(names, row)} for row in s.rows]
        rows, identity = self.insert(s.table, records, s.ignore, converted=True)
        if s.returning:
            wanted = [c.name for c in schema.columns] if s.returning == ["*"] else s.returning
            kinds = [self.column(schema, n).type for n in wanted]
            return Result("rows", wanted, types=kinds, count=len(rows), identity=identity, rows=[[python_value(r[n], k) for n, k in zip(wanted, kinds)] for r in rows])
        return Result("inserted", count=len(rows), identity=identity)


class Snapshot(Reads):
    """One version of all tables, whatever is committed later."""

    def __init__(self, engine: Engine, manifest: dict):
        self.engine, self._manifest = engine, manifest
        self._fixed = State(engine.store, manifest)
        engine.pins[id(self)] = manifest["version"]

    @property
    def version(self) -> int:
        return self._manifest["version"]

    def _state(self) -> State:
        return self._fixed

    def query(self, sql: str, params: Sequence | Mapping | None = None) -> Result:
        statement = Binder(params).bind(parse(sql))
        if not isinstance(statement, (ast.Select, ast.Explain)):
            raise E.ReadOnly("a snapshot is read-only")
        return self._read(statement)

    def close(self) -> None:
        self.engine.pins.pop(id(self), None)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()


class Transaction(Snapshot):
    """A snapshot with changes of its own, published together by ``commit`` unless others changed the same rows."""

    def __init__(self, engine: Engine):
        super().__init__(engine, engine.store.current())
        self._writer, self._open = Writer(engine, self._fixed, self), True

    def _alive(self) -> Writer:
        if not self._open:
            raise E.InvalidArgument("the transaction has ended")
        return self._writer

    def query(self, sql: str, params: Sequence | Mapping | None = None) -> Result:
        writer, s = self._alive(), Binder(params).bind(parse(sql))
        if isinstance(s, ast.Select):
            if s.joins or s.aggregated:
                raise E.SqlError("JOIN and aggregates are not supported inside a transaction")
            return self._read(s)
        if isinstance(s, (ast.Insert, ast.Update, ast.Delete)):
            if isinstance(s, ast.Insert) and s.ignore:
                raise E.SqlError("INSERT IGNORE is not supported inside a transaction")
            return writer.run(s)
        raise E.SqlError("DDL and EXPLAIN are not supported inside a transaction")

    def insert(self, table: str, record: dict) -> Any:
        rows, _ = self._alive().insert(table, [record])
        return rows[0].get("id")

    def update(self, table: str, id: Any, patch: dict) -> bool:
        return _patch(self._alive(), table, id, patch)

    def delete(self, table: str, id: Any) -> bool:
        return self._alive().delete(table, ast.Compare(ast.Ref("id"), "=", ast.Literal(id, True))) > 0

    def rollback(self) -> None:
        self._open = False
        self.close()

    def commit(self) -> None:
        writer, state, store = self._alive(), self._fixed, self.engine.store
        self._open = False
        try:
            if not state.changed:
                return
            with store.lock():
                latest = store.current()
                if latest["version"] != self.version:
                    self._merge(latest)
                    for table in state.changed:
                        _validate(writer, table)
                tables = dict(latest["tables"])
                for t in state.changed:
                    tables[t] = state.tables[t]
                store.commit(tables, state.changed, latest)
        finally:
            self.close()

    def _merge(self, latest: dict) -> None:
        """Bring the changes onto a newer version; rows that both sides touched are a conflict."""
        state, store = self._fixed, self.engine.store
        theirs: dict[str, list[str]] = {}
        redefined = set()
        for v in range(self.version + 1, latest["version"] + 1):
            m = store.manifest(v)
            redefined |= set(m.get("redefined", []))
            for t, files in m["changed"].items():
                theirs.setdefault(t, []).extend(files)
        for t, files in state.changed.items():
            if t in redefined or t not in latest["tables"]:
                raise E.Conflict(f"table {t} was redefined")
            mine = state.changed_ids(files).distinct()
            if t in theirs:
                if mine.join(state.changed_ids(theirs[t]), "id", "left_semi").first() is not None:
                    raise E.Conflict(f"rows of {t} were changed by another commit")
                schema = state.schema(t)
                key = schema.get("id").key
                touched = mine.select(F.col("id").cast(schema.get("id").field().dataType).alias(key))
                other = store.read(latest["tables"][t]["files"], schema.struct()).join(touched, key, "left_anti")
                own = state.frame(t).join(touched, key, "left_semi")
                state.tables[t]["files"] = store.write(other.select(*schema.struct().names).unionAll(own.select(*schema.struct().names)))
            for c, high in latest["tables"][t]["high"].items():
                state.tables[t]["high"][c] = max(high, state.tables[t]["high"].get(c, 0))
        for t in latest["tables"]:
            if t not in state.changed:
                state.tables[t] = latest["tables"][t]
                state.schemas.pop(t, None)

    def __exit__(self, kind: Any, *_: Any) -> None:
        if self._open:
            self.rollback() if kind else self.commit()


def _validate(writer: Writer, table: str) -> None:
    """All unique columns and foreign keys that touch a merged table."""
    state, schema = writer.state, writer.state.schema(table)
    for name in ["id", *schema.unique_columns()]:
        try:
            writer.refuse_repeats(table, name, state.frame(table), schema.get(name).key)
        except E.EngineError as e:
            raise E.Conflict(str(e)) from None
    for t in state.tables:
        for f in state.schema(t).foreign_keys:
            if t == table or f.table == table:
                try:
                    writer.check_orphans(t, f, state.frame(t))
                except E.SchemaViolation as e:
                    raise E.Conflict(str(e)) from None


def _patch(writer: Writer, table: str, id: Any, patch: dict) -> bool:
    items = [ast.Assignment(k, ast.Literal(v, True)) for k, v in patch.items()]
    return writer.update(table, items, ast.Compare(ast.Ref("id"), "=", ast.Literal(id, True))) > 0


class Engine(Reads):
    """Tables below ``root`` (a folder that the executors share), and attached DataFrames.

    Without a root only attached tables can be read.  Changing calls take the store's lock one after another;
    explicit transactions are optimistic.
    """

    def __init__(self, spark: SparkSession, root: str | os.PathLike | None = None, read_only: bool = False, compat_outer_pushdown: bool = False):
        self.engine, self.spark, self.read_only, self.compat_outer_pushdown = self, spark, read_only, compat_outer_pushdown
        if root is not None and read_only and not Path(root, "CURRENT").exists():
            raise E.StorageError(f"there is no database at {root}")
        self._store = Store(spark, os.fspath(root)) if root is not None else None
        self.attached: dict[str, tuple[Schema, DataFrame]] = {}
        self.pins: dict[int, int] = {}
        self._high: dict[tuple[str, str], int] = {}

    @property
    def store(self) -> Store:
        if self._store is None:
            raise E.ReadOnly("the engine has no root; only attached tables can be read")
        return self._store

    def _state(self) -> State:
        if self._store is None:
            return State(None, {"version": 0, "tables": {}})  # type: ignore[arg-type]
        return State(self._store, self._store.current())

    # attached tables
    def attach(self, name: str, df: DataFrame, json_columns: Sequence[str] = ()) -> None:
        """Make a DataFrame readable as a table; narrow numbers widen, so that all integers are int64.

        Text columns named in ``json_columns`` are read as JSON in canonical form.
        """
        columns = []
        for f in df.schema.fields:
            kind = f.dataType
            if f.name in json_columns:
                df = df.withColumn(f.name, F.to_json(F.parse_json(f"`{f.name}`")))
                columns.append(Column(f.name, "json", f.name))
                continue
            if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
                df = df.withColumn(f.name, F.col(f"`{f.name}`").cast("bigint"))
                kind = T.LongType()
            elif isinstance(kind, T.FloatType):
                df = df.withColumn(f.name, F.col(f"`{f.name}`").cast("double"))
                kind = T.DoubleType()
            elif isinstance(kind, T.TimestampType):
                df = df.withColumn(f.name, F.col(f"`{f.name}`").cast("timestamp_ntz"))
                kind = T.TimestampNTZType()
            names = {T.BooleanType: "bool", T.LongType: "int64", T.DoubleType: "float64", T.StringType: "text", T.BinaryType: "blob", T.TimestampNTZType: "timestamp", T.DateType: "date", T.ArrayType: "vector"}
            if type(kind) not in names:
                raise E.InvalidArgument(f"column '{f.name}' of {name} has no type in the dialect ({kind.simpleString()})")
            columns.append(Column(f.name, names[type(kind)], f.name))
        self.attached[name] = (Schema(columns), df)

    def attach_parquet(self, folder: str, *names: str) -> Engine:
        for name in names:
            self.attach(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))
        return self

    # identity
    def high_water(self, table: str, column: str, state: State) -> int:
        return max(state.tables[table]["high"].get(column, 0), self._high.get((table, column), 0))

    def advance(self, table: str, column: str, state: State, value: int) -> None:
        self._high[table, column] = max(value, self.high_water(table, column, state))
        state.tables[table]["high"][column] = self._high[table, column]

    # changes
    def _change(self, work: Callable[[Writer], Any]) -> Any:
        if self.read_only:
            raise E.ReadOnly("the engine was opened for reading")
        with self.store.lock():
            base = self.store.current()
            state = State(self.store, base)
            out = work(Writer(self, state, self))
            if state.changed or state.redefined or state.tables != base["tables"]:
                manifest = {"version": base["version"] + 1, "tables": state.tables, "changed": state.changed, "redefined": sorted(state.redefined)}
                self.store._publish(manifest)
        for table in state.changed:
            self._merge_small(table)
        return out

    def _merge_small(self, table: str) -> None:
        """Put a table's small files together once there are more than ``SMALL_FILES``: rows stay as they are.

        A file is rewritten once for each time that many small ones have gathered, and large ones never are.
        """
        size = lambda f: (self.store.root / f).stat().st_size
        few = lambda files: len(files) <= SMALL_FILES or sum(1 for f in files if size(f) < SMALL_BYTES) <= SMALL_FILES
        if few(self.store.current()["tables"].get(table, {"files": []})["files"]):
            return
        with self.store.lock():
            base = self.store.current()
            state = State(self.store, base)
            if table not in state.tables or few(state.tables[table]["files"]):
                return
            small = [f for f in state.tables[table]["files"] if size(f) < SMALL_BYTES]
            rest = [f for f in state.tables[table]["files"] if f not in set(small)]
            n = max(1, sum(map(size, small)) // SMALL_BYTES)
            state.tables[table]["files"] = rest + self.store.write(self.store.read(small, state.schema(table).struct()).coalesce(n))
            self.store._publish({"version": base["version"] + 1, "tables": state.tables, "changed": {}, "redefined": []})

    def query(self, sql: str, params: Sequence | Mapping | None = None) -> Result:
        """Run one statement."""
        statement = Binder(params).bind(parse(sql))
        if isinstance(statement, (ast.Select, ast.Explain)):
            return self._read(statement)
        out = self._change(lambda w: w.run(statement))
        if isinstance(statement, ast.CreateIndex):
            self.index_files(statement.table)
        return out

    def insert(self, table: str, record: dict) -> Any:
        return self._change(lambda w: w.insert(table, [record]))[0][0].get("id")

    def update(self, table: str, id: Any, patch: dict) -> bool:
        return self._change(lambda w: _patch(w, table, id, patch))

    def delete(self, table: str, id: Any) -> bool:
        return self._change(lambda w: w.delete(table, ast.Compare(ast.Ref("id"), "=", ast.Literal(id, True)))) > 0

    def append(self, table: str, df: DataFrame) -> int:
        """Insert all rows of a DataFrame in one commit; their number."""
        n = self._change(lambda w: w.append(table, df))
        self.index_files(table)
        return n

    def index_files(self, table: str) -> None:
        """Let the equality indexes of a table cover all its files.  Files that they do not cover are always read."""
        state = self._state()
        schema, files = state.schema(table), state.tables[table]["files"]
        for name in dict.fromkeys([*(["id"] if schema.get("id") else []), *(i.column for i in schema.indexes)]):
            key = schema.get(name).key
            equalityindex.EqualityIndex(self.store, table, key).catch_up(files, schema.struct(), key)

    def bulk_insert_sorted(self, table: str, df: DataFrame, position: str) -> None:
        """Insert rows whose ids increase with ``position`` and are above all that the table has."""
        bad = dml.order_breaks(df, position, "id").first()
        if bad is not None:
            raise E.InvalidArgument(f"ids are not strictly increasing at position {bad[0]}")
        schema = self.table_schema(table)
        top = self.scan(table).agg(F.max("id")).first()[0]
        least = df.agg(F.min("id")).first()[0]
        if top is not None and least is not None and least <= top:
            raise E.InvalidArgument("the first id is not above the table's last one")
        if schema.text_indexes or schema.vector_indexes:
            raise E.InvalidArgument("sorted loading takes a table without text and vector indexes")
        self.append(table, df.drop(position).repartitionByRange("id").sortWithinPartitions("id"))

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.store.current())

    def transaction(self) -> Transaction:
        if self.read_only:
            raise E.ReadOnly("the engine was opened for reading")
        return Transaction(self)

    begin = transaction

    def run_transaction(self, work: Callable[[Transaction], Any], retry_seconds: float = 3.0) -> Any:
        """Run ``work`` in a transaction, again if it conflicts, for so many seconds."""
        until = time.monotonic() + retry_seconds
        while True:
            tx = self.transaction()
            try:
                out = work(tx)
                tx.commit()
                return out
            except E.Conflict:
                if time.monotonic() > until:
                    raise
            except BaseException:
                if tx._open:
                    tx.rollback()
                raise

    # search indexes
    def _index(self, table: str, column: str, kind: str, change: Callable[[Schema], None]) -> None:
        def work(w: Writer) -> None:
            schema = w.table(table)
            c = w.column(schema, column)
            if c.type != kind:
                raise E.InvalidArgument(f"column '{column}' is {c.type}, not {kind}")
            change(schema)
            w.state.save_schema(table)

        self._change(work)

    def create_text_index(self, table, column) -> None:
        """Write the postings of the table's texts; later rows join them at the next search."""
        self._index(table, column, "text", lambda s: s.text_indexes.append(column) if column not in s.text_indexes else None)
        schema, key = self.table_schema(table), self.table_schema(table).get(column).key
        textindex.TextIndex(self.store, table, key).catch_up(self._state().tables[table]["files"], schema.struct(), self._id(schema).key, key)

    def drop_text_index(self, table: str, column: str) -> None:
        def change(s: Schema) -> None:
            if column not in s.text_indexes:
                raise E.IndexNotFound(f"no text index on {table}.{column}")
            s.text_indexes.remove(column)

        key = self.table_schema(table).get(column)
        self._index(table, column, "text", change)
        textindex.TextIndex(self.store, table, key.key).drop()

    def create_vector_index(self, table: str, column: str, **given: Any) -> None:
        """Options: ``metric`` (cosine, dot, l2) and ``quantized`` (distances of bytes); those of a graph are kept and change nothing."""
        options = VECTOR_OPTIONS | given
        if unknown := set(given) - set(VECTOR_OPTIONS):
            raise E.InvalidArgument(f"unknown option '{sorted(unknown)[0]}'")
        if options["metric"] not in ("cosine", "dot", "l2"):
            raise E.InvalidArgument(f"unknown metric '{options['metric']}'")
        self._index(table, column, "vector", lambda s: s.vector_indexes.update({column: options}))
        if self.table_schema(table).get(column).dim is not None:
            self.wait_vector_indexing(table, column)

    def drop_vector_index(self, table: str, column: str) -> None:
        def change(s: Schema) -> None:
            if s.vector_indexes.pop(column, None) is None:
                raise E.IndexNotFound(f"no vector index on {table}.{column}")

        key = self.table_schema(table).get(column)
        self._index(table, column, "vector", change)
        vectorindex.VectorIndex(self.store, table, key.key).drop()

    def _vector_columns(self) -> list[tuple[str, str]]:
        state = self._state()
        return [(t, c) for t in state.tables for c in state.schema(t).vector_indexes if state.schema(t).get(c).dim is not None]

    def vector_indexing_backlog(self) -> int:
        """How many files wait to be indexed; a search indexes them first."""
        waiting = 0
        for t, c in self._vector_columns():
            note = vectorindex.VectorIndex(self.store, t, self.table_schema(t).get(c).key)._note()
            waiting += len(set(self._state().tables[t]["files"]) - {f for s in note["segments"].values() for f in s["files"]})
        return waiting

    def wait_vector_indexing(self, table: str | None = None, column: str | None = None) -> None:
        """Index what waits, of all vector columns or of one."""
        for t, c in self._vector_columns():
            if table in (None, t) and column in (None, c):
                schema = self.table_schema(t)
                key = schema.get(c).key
                vectorindex.VectorIndex(self.store, t, key).catch_up(self._state().tables[t]["files"], schema.struct(), self._id(schema).key, key)

    # files
    def import_json(self, table: str, path: str) -> int:
        """Insert JSON lines (tagged values allowed), typed by the schema; an unknown column is an error."""
        schema = self.table_schema(table)
        lines = self.spark.read.text(path).where(F.trim("value") != "")
        kinds = {c.name: c for c in schema.columns}
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
        defaults = {c.name: coerce(now, c, True) if c.default_now else c.default for c in schema.columns}
        # Numbers are given to the rows of a file that names none; else the column must be in each record.
        identity = [c.name for c in schema.columns if c.identity]
        unnumbered = bool(identity) and lines.where(F.get_json_object("value", f"$['{identity[0]}']").isNotNull()).isEmpty()
        text_id = schema.get("id") is not None and schema.get("id").type == "text"

        def parse_line(batches: Iterator) -> Iterator:
            import pyarrow as pa

            from brindle.engine import new_id as an_id
            from brindle.types import coerce as typed
            from brindle.types import from_tagged as untag

            for batch in batches:
                rows = []
                for text in batch.column(0).to_pylist():
                    record = json.loads(text)
                    if extra := set(record) - set(kinds):
                        raise ValueError(f"unknown column '{sorted(extra)[0]}'")
                    row = {n: typed(untag(record[n]), kinds[n], kinds[n].type != "json" or not isinstance(record[n], str)) if n in record else defaults[n] for n in kinds}
                    if text_id and row["id"] is None:
                        row["id"] = an_id()
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        struct = T.StructType([T.StructField(c.name, c.field().dataType) for c in schema.columns])
        arrow = to_arrow_schema(struct)
        rows = lines.mapInArrow(parse_line, struct).select(*[c.name for c in schema.columns if not (c.identity and unnumbered)])
        return self.append(table, rows)

    def export_json(self, table: str, path: str) -> None:
        """Write JSON lines that ``import_json`` reads."""
        schema, df = self._resolve(table)
        values = []
        for c in schema.columns:
            col = F.col(c.key)
            tag = {"blob": F.lower(F.hex(col)), "timestamp": F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "date": col.cast("string"), "time": F.concat(F.date_format(F.timestamp_micros(col), "HH:mm:ss.SSSSSS"))}
            if c.type in tag:
                col = F.when(col.isNotNull(), F.struct(F.lit(c.type).alias("$t"), tag[c.type].alias("v")))
            values.append(col.alias(c.name))
        df.select(F.to_json(F.struct(*values)).alias("value")).write.text(path)

    def backup(self, path: str) -> int:
        """Copy one version of all tables to a new root."""
        with self.snapshot() as snap:
            target = Store(self.spark, path)
            if target.current()["tables"]:
                raise E.InvalidArgument(f"{path} is not empty")
            tables = {}
            for name, entry in snap._fixed.tables.items():
                tables[name] = entry | {"files": target.write(snap._fixed.frame(name)) if entry["files"] else []}
            with target.lock():
                target.commit(tables, {}, target.current())
            return snap.version

    @staticmethod
    def restore(spark: SparkSession, backup: str, root: str) -> Engine:
        Engine(spark, backup, read_only=True).backup(root)
        return Engine(spark, root)

    def check_integrity(self) -> list[str]:
        """What is wrong with files and constraints; nothing, one hopes."""
        problems, state = [], self._state()
        writer = Writer(self, state, self)
        for name in state.tables:
            missing = [f for f in state.tables[name]["files"] if not (self.store.root / f).exists()]
            if missing:
                problems.append(f"{name}: {len(missing)} file(s) missing")
                continue
            try:
                writer.check_frame(state.schema(name), state.frame(name))
                _validate(writer, name)
            except E.EngineError as e:
                problems.append(f"{name}: {e}")
        return problems

    def salvage(self, path: str) -> dict[str, int]:
        """Copy what can be read to a new root; the rows kept by table."""
        target, state, kept = Store(self.spark, path), self._state(), {}
        tables = {}
        for name, entry in state.tables.items():
            files = [f for f in entry["files"] if (self.store.root / f).exists()]
            df = self.spark.read.option("ignoreCorruptFiles", "true").schema(state.schema(name).struct()).parquet(*[f"file://{self.store.root}/{f}" for f in files]) if files else None
            tables[name] = entry | {"files": target.write(df) if df is not None else []}
            kept[name] = target.read(tables[name]["files"], state.schema(name).struct()).count()
        with target.lock():
            target.commit(tables, {}, target.current())
        return kept

    def compact(self, table: str | None = None, cluster_by: str | None = None) -> None:
        """Rewrite tables to as few files as their size asks for, sorted within files by ``cluster_by``."""

        def work(w: Writer) -> None:
            for name in [table] if table else list(w.state.tables):
                schema, entry = w.table(name), w.state.tables[name]
                if len(entry["files"]) < 2 and not cluster_by:
                    continue
                df = w.state.frame(name)
                if cluster_by:
                    key = w.column(schema, cluster_by).key
                    df = df.repartitionByRange(key).sortWithinPartitions(key)
                else:
                    size = sum((self.store.root / f).stat().st_size for f in entry["files"])
                    df = df.repartition(max(1, size >> 27))
                entry["files"] = self.store.write(df)

        self._change(work)
        for name in [table] if table else self._state().tables:
            self.index_files(name)

    checkpoint = compact

    def vacuum(self) -> int:
        """Delete files that no open snapshot and not the current version needs."""
        return self.store.vacuum(set(self.pins.values()))

    def maintenance_stats(self) -> dict[str, int]:
        state = self._state()
        files = [f for t in state.tables.values() for f in t["files"]]
        return {"version": state.base["version"], "tables": len(state.tables), "files": len(files), "bytes": sum((self.store.root / f).stat().st_size for f in files), "pinned": len(self.pins)}

    def memory_stats(self) -> dict[str, int]:
        """Bytes that the executors' storage memory has and has left."""
        status = self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
        values = [status.apply(k) for k in [x for x in self.spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(status.keySet())]]
        return {"limit": sum(v._1() for v in values), "free": sum(v._2() for v in values)}

    def drop_database(self) -> None:
        shutil.rmtree(self.store.root)


__all__ = ["Cursor", "Engine", "Result", "Snapshot", "Transaction", "from_tagged", "new_id", "to_tagged"]
