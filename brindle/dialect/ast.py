"""Statements of the dialect as plain data."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from brindle.types import Column, ForeignKey


@dataclass(frozen=True)
class Ref:
    """A column, with its table's name or alias if the statement gave one."""

    name: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Literal:
    value: Any
    bound: bool = False


@dataclass(frozen=True)
class Param:
    """A placeholder that binding replaces."""

    index: int
    name: str | None = None


@dataclass(frozen=True)
class Now:
    """CURRENT_TIMESTAMP, one value for each statement."""


@dataclass(frozen=True)
class Aggregate:
    function: str
    argument: Ref | None  # None is *
    distinct: bool = False

    def header(self, argument: str | None = None) -> str:
        inner = "*" if self.argument is None else argument or str(self.argument)
        return f"{self.function}({'distinct ' if self.distinct else ''}{inner})"


Operand = Ref | Literal | Param | Aggregate | Now


@dataclass(frozen=True)
class Compare:
    left: Operand
    op: str
    right: Operand


@dataclass(frozen=True)
class IsNull:
    operand: Operand
    negated: bool


@dataclass(frozen=True)
class In:
    operand: Operand
    values: tuple[Operand, ...]
    negated: bool


@dataclass(frozen=True)
class Logic:
    op: str  # and, or, not
    parts: tuple


Predicate = Compare | IsNull | In | Logic


@dataclass
class Item:
    what: Ref | Aggregate | None  # None is *
    alias: str | None = None


@dataclass
class Source:
    table: str
    alias: str


@dataclass
class Join:
    kind: str
    source: Source
    left: Ref
    right: Ref


@dataclass
class Order:
    key: Ref
    descending: bool = False
    collation: str | None = None


@dataclass
class Select:
    items: list[Item]
    source: Source
    joins: list[Join] = field(default_factory=list)
    where: Predicate | None = None
    group_by: list[Ref] = field(default_factory=list)
    having: Predicate | None = None
    order_by: list[Order] = field(default_factory=list)
    limit: Operand | None = None
    offset: Operand | None = None

    @property
    def aggregated(self) -> bool:
        return bool(self.group_by) or self.having is not None or any(isinstance(i.what, Aggregate) for i in self.items)


@dataclass
class Explain:
    select: Select


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    rows: list[list[Operand]]
    ignore: bool = False
    returning: list[str] | None = None  # ["*"] is every column


@dataclass
class Assignment:
    column: str
    value: Operand
    op: str | None = None  # c = c op value


@dataclass
class Update:
    table: str
    assignments: list[Assignment]
    where: Predicate | None = None


@dataclass
class Delete:
    table: str
    where: Predicate | None = None


@dataclass
class CreateTable:
    table: str
    columns: list[Column]
    defaults: dict[str, Operand]
    foreign_keys: list[ForeignKey]
    if_not_exists: bool = False


@dataclass
class DropTable:
    table: str
    if_exists: bool = False


@dataclass
class CreateIndex:
    table: str
    column: str
    unique: bool
    name: str | None


@dataclass
class DropIndex:
    table: str
    column: str
    if_exists: bool = False


@dataclass
class AddColumn:
    table: str
    column: Column
    default: Operand | None
    foreign_key: ForeignKey | None = None


@dataclass
class DropColumn:
    table: str
    column: str
    if_exists: bool = False


@dataclass
class RenameTable:
    table: str
    to: str


@dataclass
class RenameColumn:
    table: str
    column: str
    to: str
