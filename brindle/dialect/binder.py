"""Replaces placeholders by typed literals and the statement's time by one value."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import fields, is_dataclass, replace
from typing import Any

from brindle.dialect import ast
from brindle.errors import SqlError
from brindle.types import Column, ForeignKey, kind_of


class Binder:
    def __init__(self, params: Sequence | Mapping | None):
        self.params, self.used = params, set()
        self.now = dt.datetime.now(dt.UTC).replace(tzinfo=None)

    def value(self, param: ast.Param) -> ast.Literal:
        if param.name is not None:
            if not isinstance(self.params, Mapping):
                raise SqlError(f"the statement has named parameters; pass a mapping with '{param.name}'")
            if param.name not in self.params:
                raise SqlError(f"no value for parameter '{param.name}'")
            self.used.add(param.name)
            value = self.params[param.name]
        else:
            if self.params is None or isinstance(self.params, Mapping):
                raise SqlError("the statement has positional parameters; pass a sequence")
            if param.index >= len(self.params):
                raise SqlError(f"the statement has more placeholders than the {len(self.params)} values passed")
            self.used.add(param.index)
            value = self.params[param.index]
        kind_of(value)
        return ast.Literal(value, bound=True)

    def walk(self, node: Any) -> Any:
        if isinstance(node, ast.Param):
            return self.value(node)
        if isinstance(node, ast.Now):
            return ast.Literal(self.now, bound=True)
        if isinstance(node, list):
            return [self.walk(x) for x in node]
        if isinstance(node, tuple):
            return tuple(self.walk(x) for x in node)
        if isinstance(node, dict):
            return {k: self.walk(x) for k, x in node.items()}
        if is_dataclass(node) and not isinstance(node, (Column, ForeignKey, ast.Literal, ast.Ref)):
            return replace(node, **{f.name: self.walk(getattr(node, f.name)) for f in fields(node)})
        return node

    def bind(self, statement: Any) -> Any:
        out = self.walk(statement)
        given = set(self.params) if isinstance(self.params, Mapping) else set(range(len(self.params or ())))
        if extra := given - self.used:
            raise SqlError(f"{len(extra)} parameter value(s) have no placeholder: {', '.join(map(str, sorted(extra, key=str)))}")
        return out
