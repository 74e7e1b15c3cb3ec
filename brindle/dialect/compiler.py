"""SELECT statements as DataFrames, and their logical plan as text.

Everything is expressed with built-in columns, so Catalyst sees the whole plan: filters and column lists
reach the scans, joins are chosen by size, and nothing is collected here.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.dialect import ast
from brindle.errors import ColumnNotFound, SqlError
from brindle.functions.collation import sort_keys
from brindle.types import SPARK, Column, Schema, canonical, coerce, format_time, format_timestamp, kind_of

Resolver = Callable[[str], tuple[Schema, DataFrame]]
_NUMBERS = ("int64", "float64")
_CLOCKS = ("timestamp", "date", "time")


@dataclass
class Bound:
    """A column of a source, under the name that it has inside the query."""

    label: str
    column: Column
    inner: str

    @property
    def type(self) -> str:
        return self.column.type

    def col(self) -> SparkColumn:
        return F.col(self.inner)

    def __str__(self) -> str:
        return f"{self.label}.{self.column.name}"


def literal(value: Any, kind: str) -> SparkColumn:
    if value is None:
        return F.lit(None).cast(SPARK[kind])
    if kind == "timestamp":
        return F.lit(format_timestamp(value)).cast(T.TimestampNTZType())
    if kind == "vector":
        return F.array(*[F.lit(x) for x in value]).cast(SPARK["vector"])
    return F.lit(value)


def show(value: Any) -> str:
    """A literal as plans print it."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return f"'{value[:32]}...'" if len(value) > 32 else f"'{value}'"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value[:16]).hex().upper()}{'...' if len(value) > 16 else ''}'"
    if isinstance(value, dt.datetime):
        return f"'{format_timestamp(value)}'"
    if isinstance(value, dt.date):
        return f"'{value.isoformat()}'"
    return str(value)


class Scope:
    """The tables of a query and what names mean among them."""

    def __init__(self, sources: list[tuple[ast.Source, Schema]]):
        self.bound: list[Bound] = []
        seen: dict[str, str] = {}
        for k, (source, schema) in enumerate(sources):
            low = source.alias.lower()
            if low in seen:
                raise SqlError(f"duplicate table alias '{source.alias}'")
            seen[low] = source.alias
            self.bound += [Bound(source.alias, c, f"s{k}_{j}") for j, c in enumerate(schema.columns)]
        self.labels = seen

    def find(self, ref: ast.Ref) -> Bound:
        if ref.table is not None:
            label = self.labels.get(ref.table.lower())
            if label is None:
                raise SqlError(f"unknown table or alias '{ref.table}'")
            found = [b for b in self.bound if b.label == label and b.column.name == ref.name]
        else:
            found = [b for b in self.bound if b.column.name == ref.name]
        if not found:
            raise ColumnNotFound(f"unknown column '{ref}'")
        if len(found) > 1:
            raise SqlError(f"ambiguous column '{ref.name}'; qualify it")
        return found[0]


class Predicates:
    """Predicates over the columns that ``find`` resolves, as Spark columns with three-valued logic."""

    def __init__(self, find: Callable[[Any], tuple[SparkColumn, str, str]]):
        self.find = find

    def compile(self, p: ast.Predicate) -> SparkColumn:
        if isinstance(p, ast.Logic):
            parts = [self.compile(x) for x in p.parts]
            if p.op == "not":
                return ~parts[0]
            out = parts[0]
            for x in parts[1:]:
                out = out & x if p.op == "and" else out | x
            return out
        if isinstance(p, ast.IsNull):
            col = self.find(p.operand)[0]
            return col.isNotNull() if p.negated else col.isNull()
        if isinstance(p, ast.In):
            out = None
            for v in p.values:
                one = self.compare(p.operand, "=", v)
                out = one if out is None else out | one
            if all(isinstance(v, ast.Literal) and v.value is not None for v in p.values) and isinstance(p.operand, (ast.Ref, ast.Aggregate)):
                col, kind, name = self.find(p.operand)
                if kind != "json":
                    out = col.isin(*[self.typed(v, kind, name)[0] for v in p.values])
            return ~out if p.negated else out
        return self.compare(p.left, p.op, p.right)

    def typed(self, value: ast.Literal, kind: str, name: str) -> tuple[SparkColumn, str]:
        """The literal for a comparison with a column of this type, and the type it has then."""
        v, own = value.value, kind_of(value.value)
        if kind in _NUMBERS and own in _NUMBERS:
            return F.lit(v), own
        if kind == "timestamp" and own in _NUMBERS:
            return F.lit(v), own
        if kind in _CLOCKS and own == "text" or kind == "timestamp" and own == "timestamp" or own == kind or kind == "time" and own == "time" or kind == "date" and own == "date" or kind in ("json", "vector") and own in ("text", "list", "json"):
            try:
                return literal(coerce(v, Column(name, kind), value.bound and kind == "json"), kind), kind
            except Exception as e:
                raise SqlError(f"cannot compare {name} with {show(v)}: {e}") from None
        if kind == "json":
            return F.lit(canonical(v)), kind
        raise SqlError(f"cannot compare {name} ({kind}) with {own}")

    def compare(self, left: ast.Operand, op: str, right: ast.Operand) -> SparkColumn:
        if isinstance(left, ast.Literal) and not isinstance(right, ast.Literal):
            return self.compare(right, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op), left)
        if isinstance(left, ast.Literal):
            return self.constant(left.value, op, right.value)
        col, kind, name = self.find(left)
        if isinstance(right, ast.Literal):
            if right.value is None:
                return F.lit(None).cast("boolean")
            other, own = self.typed(right, kind, name)
            other_name = show(right.value)
        else:
            other, own, other_name = self.find(right)
        if kind == "timestamp" and own in _NUMBERS:
            col, kind = F.unix_micros(col.cast("timestamp")), "int64"
        if own == "timestamp" and kind in _NUMBERS:
            other, own = F.unix_micros(other.cast("timestamp")), "int64"
        if kind in _NUMBERS and own in _NUMBERS:
            if kind != own:
                col, other = col.cast("double"), other.cast("double")
        elif kind != own:
            raise SqlError(f"cannot compare {name} ({kind}) with {other_name} ({own})")
        if kind in ("json", "vector") and op not in ("=", "!="):
            raise SqlError(f"{kind} values have no order; {op} is not defined for {name}")
        if kind == "vector":
            raise SqlError(f"vectors are not compared in SQL; use search_vector for {name}")
        return {"=": lambda: col == other, "!=": lambda: col != other, "<": lambda: col < other, "<=": lambda: col <= other, ">": lambda: col > other, ">=": lambda: col >= other}[op]()

    @staticmethod
    def constant(a: Any, op: str, b: Any) -> SparkColumn:
        if a is None or b is None:
            return F.lit(None).cast("boolean")
        ka, kb = kind_of(a), kind_of(b)
        if ka != kb and not (ka in _NUMBERS and kb in _NUMBERS):
            raise SqlError(f"cannot compare {ka} with {kb}")
        return F.lit({"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])


def _refs(p: Any) -> list[ast.Ref]:
    if isinstance(p, ast.Ref):
        return [p]
    if isinstance(p, ast.Logic):
        return [r for x in p.parts for r in _refs(x)]
    if isinstance(p, ast.Compare):
        return _refs(p.left) + _refs(p.right)
    if isinstance(p, (ast.IsNull, ast.In)):
        return _refs(p.operand)
    return []


def conjuncts(p: ast.Predicate | None) -> list[ast.Predicate]:
    if p is None:
        return []
    if isinstance(p, ast.Logic) and p.op == "and":
        return [x for part in p.parts for x in conjuncts(part)]
    return [p]


def _limit(value: ast.Operand | None, what: str) -> int | None:
    if value is None:
        return None
    n = value.value
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise SqlError(f"{what} needs a non-negative integer")
    return n


def sum_long(col: SparkColumn) -> SparkColumn:
    """A sum of integers that only fails if the end result leaves 64 bits."""
    return F.sum(col.cast("decimal(20,0)")).cast("bigint")


#: Bytes of files up to which a side of a join is sent to all executors by :func:`_spread`.
_SENT = 16 << 20


def _spread(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join whose rows are also compared otherwise, which may have far more pairs than rows.

    Tasks by file or by key would be few, each with a large share of the pairs.  So the rows of the larger side
    are dealt to many tasks, and the other is sent to them; if that is large too, Catalyst chooses.
    """
    sizes = [int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in (left, right)]
    if min(sizes) > _SENT:
        return left, right
    tasks = 8 * left.sparkSession.sparkContext.defaultParallelism
    return (F.broadcast(left), right.repartition(tasks)) if sizes[0] < sizes[1] else (left.repartition(tasks), F.broadcast(right))


@dataclass
class Output:
    header: str
    inner: str
    type: str


class SelectCompiler:
    """One SELECT over the tables that ``resolve`` knows.

    WHERE filters after outer joins, as standard SQL says.  With ``compat_outer_pushdown`` a conjunct over a
    single table filters that table before the join instead.
    """

    def __init__(self, select: ast.Select, resolve: Resolver, compat_outer_pushdown: bool = False):
        self.select, self.compat = select, compat_outer_pushdown
        self.sources = [select.source, *(j.source for j in select.joins)]
        self.tables = [resolve(s.table) for s in self.sources]
        self.scope = Scope([(s, t[0]) for s, t in zip(self.sources, self.tables)])
        self.check_joins()
        self.outputs: list[Output] = []
        self.aggregates: list[tuple[ast.Aggregate, str]] = []

    def check_joins(self) -> None:
        self.links: list[tuple[Bound, Bound]] = []
        known = {self.sources[0].alias}
        for join in self.select.joins:
            a, b = self.scope.find(join.left), self.scope.find(join.right)
            if b.label in known and a.label == join.source.alias:
                a, b = b, a
            if a.label not in known or b.label != join.source.alias:
                raise SqlError(f"JOIN {join.source.alias}: ON must link it to an earlier table")
            if a.type != b.type and not (a.type in _NUMBERS and b.type in _NUMBERS):
                raise SqlError(f"cannot join {a} ({a.type}) with {b} ({b.type})")
            if a.type in ("json", "vector"):
                raise SqlError(f"{a.type} columns can't be joined")
            self.links.append((a, b))
            known.add(join.source.alias)

    # names
    def column(self, operand: Any) -> tuple[SparkColumn, str, str]:
        bound = self.scope.find(operand)
        return bound.col(), bound.type, str(bound)

    def aggregate_column(self, operand: Any) -> tuple[SparkColumn, str, str]:
        """Inside HAVING: a grouped column or an aggregate."""
        if isinstance(operand, ast.Aggregate):
            inner, kind = self.add_aggregate(operand)
            return F.col(inner), kind, self.header(operand)
        bound = self.scope.find(operand)
        if bound.inner not in [g.inner for g in self.groups]:
            raise SqlError(f"column '{operand}' must appear in GROUP BY or be inside an aggregate")
        return bound.col(), bound.type, str(bound)

    def header(self, a: ast.Aggregate) -> str:
        return a.header()

    def aggregate_type(self, a: ast.Aggregate) -> str:
        if a.function == "count":
            return "int64"
        bound = self.scope.find(a.argument)
        if a.function in ("sum", "avg") and bound.type not in _NUMBERS:
            raise SqlError(f"{a.function.upper()} needs an int or float64 column; {bound} is {bound.type}")
        if a.function in ("min", "max") and bound.type in ("json", "vector"):
            raise SqlError(f"{bound.type} values have no order; {a.function.upper()}({bound}) is not defined")
        return "float64" if a.function == "avg" else bound.type

    def add_aggregate(self, a: ast.Aggregate) -> tuple[str, str]:
        kind = self.aggregate_type(a)
        key = (a.function, self.scope.find(a.argument).inner if a.argument else None, a.distinct)
        for known, inner in self.aggregates:
            if (known.function, self.scope.find(known.argument).inner if known.argument else None, known.distinct) == key:
                return inner, kind
        self.aggregates.append((a, f"a{len(self.aggregates)}"))
        return self.aggregates[-1][1], kind

    def expression(self, a: ast.Aggregate) -> SparkColumn:
        if a.argument is None:
            return F.count(F.lit(1))
        bound = self.scope.find(a.argument)
        col = bound.col()
        if a.function == "count":
            return F.count_distinct(col) if a.distinct else F.count(col)
        if a.function == "sum" and bound.type == "int64":
            return sum_long(col)
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.function](col)

    # compilation
    def joined(self) -> DataFrame:
        predicates = Predicates(self.column)
        early: dict[str, list] = {}
        late = []
        for p in conjuncts(self.select.where):
            labels = {self.scope.find(r).label for r in _refs(p)}
            if self.compat and len(labels) == 1:
                early.setdefault(labels.pop(), []).append(p)
            else:
                late.append(p)

        def source(k: int) -> DataFrame:
            schema, df = self.tables[k]
            df = df.select(*[F.col(f"`{c.key}`").alias(f"s{k}_{j}") for j, c in enumerate(schema.columns)])
            for p in early.get(self.sources[k].alias, []):
                df = df.where(predicates.compile(p))
            return df

        df = source(0)
        for k, (join, (a, b)) in enumerate(zip(self.select.joins, self.links), 1):
            left, right = a.col(), b.col()
            if a.type != b.type:
                left, right = left.cast("double"), right.cast("double")
            own = join.source.alias
            earlier = {x.alias for x in self.sources[:k]}
            compared = join.kind == "inner" and any(own in labels and labels & earlier for labels in ({self.scope.find(r).label for r in _refs(p)} for p in late))
            df, other = _spread(df, source(k)) if compared else (df, source(k))
            df = df.join(other, left == right, join.kind)
        for p in late:
            df = df.where(predicates.compile(p))
        return df

    def compile(self) -> tuple[list[Output], DataFrame]:
        s = self.select
        limit, offset = _limit(s.limit, "LIMIT"), _limit(s.offset, "OFFSET")
        df = self.joined()
        df = self.grouped(df) if s.aggregated else self.projected(df)
        if offset:
            df = df.offset(offset)
        if limit is not None:
            df = df.limit(limit)
        return self.outputs, df.select(*[F.col(o.inner).alias(o.header) for o in self.outputs])

    def sort(self, df: DataFrame, keys: list[tuple[SparkColumn, str, ast.Order]]) -> DataFrame:
        order, made = [], {}
        for col, kind, o in keys:
            if o.collation and kind != "text":
                raise SqlError(f"COLLATE is for text; {o.key} is {kind}")
            if kind == "vector":
                raise SqlError(f"vectors have no order; ORDER BY {o.key} is not defined")
            for part in sort_keys(col, o.collation or "unicode") if kind == "text" else [col]:
                # A key is made once a row, as a column; in the sort itself it would be made at every comparison.
                made[f"_order{len(made)}"] = part
                key = F.col(f"_order{len(made) - 1}")
                order.append(key.desc_nulls_last() if o.descending else key.asc_nulls_first())
        return df.withColumns(made).orderBy(*order).drop(*made) if order else df

    def projected(self, df: DataFrame) -> DataFrame:
        several = len(self.sources) > 1
        for item in self.select.items:
            if item.what is None:
                self.outputs += [Output(str(b) if several else b.column.name, b.inner, b.type) for b in self.scope.bound]
            else:
                b = self.scope.find(item.what)
                self.outputs.append(Output(item.alias or item.what.name, b.inner, b.type))
        keys = []
        for o in self.select.order_by:
            b = self.scope.find(o.key)
            keys.append((b.col(), b.type, o))
        return self.sort(df, keys)

    def grouped(self, df: DataFrame) -> DataFrame:
        s = self.select
        self.groups = [self.scope.find(g) for g in s.group_by]
        for item in s.items:
            if item.what is None:
                raise SqlError("SELECT * can't be combined with aggregation")
            if isinstance(item.what, ast.Aggregate):
                inner, kind = self.add_aggregate(item.what)
                self.outputs.append(Output(item.alias or self.header(item.what), inner, kind))
            else:
                b = self.scope.find(item.what)
                if b.inner not in [g.inner for g in self.groups]:
                    raise SqlError(f"column '{item.what}' must appear in GROUP BY or be inside an aggregate")
                self.outputs.append(Output(item.alias or item.what.name, b.inner, b.type))
        having = Predicates(self.aggregate_column).compile(s.having) if s.having is not None else None
        keys = [self.output_key(o) for o in s.order_by]
        exprs = [self.expression(a).alias(inner) for a, inner in self.aggregates]
        names = list(dict.fromkeys(g.inner for g in self.groups))
        if exprs:
            df = df.groupBy(*names).agg(*exprs) if names else df.agg(*exprs)
        elif names:
            df = df.select(*names).distinct()
        else:
            df = df.agg(F.count(F.lit(1)).alias("a0"))
        if having is not None:
            df = df.where(having)
        return self.sort(df, keys)

    def output_key(self, o: ast.Order) -> tuple[SparkColumn, str, ast.Order]:
        """ORDER BY of an aggregate query: output names only, in any case."""
        found = [x for x in self.outputs if x.header.lower() == o.key.name.lower()]
        if not found:
            raise SqlError(f"ORDER BY '{o.key}' is not a column of the aggregate's output")
        return F.col(found[0].inner), found[0].type, o

    # plan text
    def text(self, p: ast.Predicate | ast.Operand) -> str:
        if isinstance(p, ast.Ref):
            return str(self.scope.find(p))
        if isinstance(p, ast.Literal):
            return show(p.value)
        if isinstance(p, ast.Aggregate):
            return p.header(str(self.scope.find(p.argument)) if p.argument and len(self.sources) > 1 else None)
        if isinstance(p, ast.Compare):
            return f"{self.text(p.left)} {p.op} {self.text(p.right)}"
        if isinstance(p, ast.IsNull):
            return f"{self.text(p.operand)} IS {'NOT ' if p.negated else ''}NULL"
        if isinstance(p, ast.In):
            return f"{self.text(p.operand)} {'NOT ' if p.negated else ''}IN ({', '.join(map(self.text, p.values))})"
        if p.op == "not":
            return f"NOT ({self.text(p.parts[0])})"
        return f" {p.op.upper()} ".join(f"({self.text(x)})" if isinstance(x, ast.Logic) and x.op != "not" else self.text(x) for x in p.parts)

    def indexed(self, bound: Bound) -> bool:
        schema = self.tables[[s.alias for s in self.sources].index(bound.label)][0]
        return bound.column.name == "id" or any(i.column == bound.column.name for i in schema.indexes)

    def access(self, k: int, own: list[ast.Predicate]) -> list[str]:
        """The lines for one table: how it is read and what filters it.  A lookup reads only files that may hold the value."""
        alias, rest = self.sources[k].alias, list(own)
        line = f"SCAN {alias}"
        equal = [p for p in own if isinstance(p, ast.Compare) and p.op == "=" and sum(isinstance(x, ast.Ref) for x in (p.left, p.right)) == 1]
        pairs = [(p, *((p.left, p.right) if isinstance(p.left, ast.Ref) else (p.right, p.left))) for p in equal]
        rank = lambda ref: 0 if ref.name == "id" else 1 if self.indexed(self.scope.find(ref)) else 2
        if null := next((p for p, _, v in pairs if v.value is None), None):
            return [f"NO ACCESS {alias}  (equality on NULL matches no row)"] if null else []
        if pairs:
            p, ref, value = min(pairs, key=lambda x: rank(x[1]))
            rest.remove(p)
            if rank(ref) == 0:
                line = f"POINT LOOKUP {alias}.id = {show(value.value)}"
            elif rank(ref) == 1:
                line = f"INDEX LOOKUP {alias}.{ref.name} = {show(value.value)}"
            else:
                line = f"SCAN {alias}  (equality {ref.name} = {show(value.value)}, no index)"
        return [line, *(f"  filter: {self.text(p)}" for p in rest)]

    def explain(self) -> list[str]:
        """The logical plan; which physical join runs is Catalyst's choice."""
        s = self.select
        limit, offset = _limit(s.limit, "LIMIT"), _limit(s.offset, "OFFSET")
        self.compile()
        own: dict[str, list] = {x.alias: [] for x in self.sources}
        residual = []
        for p in conjuncts(s.where):
            labels = {self.scope.find(r).label for r in _refs(p)}
            (own[labels.pop()] if len(labels) == 1 else residual).append(p)
        lines = self.access(0, own[self.sources[0].alias])
        for k, (join, (a, b)) in enumerate(zip(s.joins, self.links), 1):
            right = self.access(k, own[join.source.alias])
            head = [f"JOIN {join.kind.upper()} (broadcast or sort-merge, by size)", f"  on: {a} = {b}"]
            lines = [*head, *("  " + x for x in [*lines, *right])]
        lines = [*(f"filter: {self.text(p)}" for p in residual), *lines]
        deeper = lambda xs: ["  " + x for x in xs]
        if s.aggregated:
            head = ["GROUP BY " + ", ".join(map(str, self.groups)) if self.groups else "AGGREGATE (single group)"]
            if self.aggregates:
                head.append("  aggregates: " + ", ".join(a.header(str(self.scope.find(a.argument)) if a.argument else None) for a, _ in self.aggregates))
            if s.having is not None:
                head.append(f"  having: {self.text(s.having)}")
            lines = head + deeper(lines)
        if s.order_by:
            names = [o.key.name if s.aggregated else str(self.scope.find(o.key)) for o in s.order_by]
            keys = ", ".join(f"{n} {'DESC' if o.descending else 'ASC'}" + (f" COLLATE {o.collation}" if o.collation else "") for n, o in zip(names, s.order_by))
            lines = [f"SORT {keys}", *deeper(lines)]
        if limit is not None:
            lines = [f"LIMIT {limit}" + (f" OFFSET {offset}" if offset else ""), *deeper(lines)]
        return lines
