"""Column types of the dialect, their Spark types, and strict conversion of values."""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import types as T

from brindle.errors import InvalidArgument, SchemaViolation

SPARK = {
    "bool": T.BooleanType(), "int64": T.LongType(), "float64": T.DoubleType(), "text": T.StringType(), "blob": T.BinaryType(),
    "timestamp": T.TimestampNTZType(), "date": T.DateType(), "time": T.LongType(), "json": T.StringType(), "vector": T.ArrayType(T.FloatType()),
}
_DATE = re.compile(r"(\d{4})-(\d{2})-(\d{2})")
_TIME = re.compile(r"(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,6}))?")
_EPOCH = dt.datetime(1970, 1, 1)


@dataclass
class Column:
    """A declared column; ``key`` is its name in the data files, which renaming leaves alone."""

    name: str
    type: str
    key: str = ""
    nullable: bool = True
    max_length: int | None = None
    enum: list[str] | None = None
    dim: int | None = None
    default: Any = None
    has_default: bool = False
    default_now: bool = False
    identity: bool = False

    def field(self) -> T.StructField:
        return T.StructField(self.key, SPARK[self.type], True, {"type": self.type})

    def to_json(self) -> dict:
        out = {k: v for k, v in asdict(self).items() if v not in (None, False)} | {"nullable": self.nullable}
        if self.has_default:
            out["default"] = to_tagged(self.default, self.type)
        return out

    @classmethod
    def from_json(cls, data: dict) -> Column:
        if data.get("has_default"):
            data = data | {"default": from_tagged(data.get("default"))}
        return cls(**data)


def parse_date(text: str) -> dt.date:
    m = _DATE.fullmatch(text)
    try:
        return dt.date(*map(int, m.groups()))
    except (AttributeError, ValueError):
        raise SchemaViolation(f"'{text}' is not a date (YYYY-MM-DD)") from None


def parse_time(text: str) -> int:
    """Microseconds since midnight."""
    m = _TIME.fullmatch(text)
    if not m or int(m[1]) > 23 or int(m[2]) > 59 or int(m[3]) > 59:
        raise SchemaViolation(f"'{text}' is not a time (HH:MM:SS[.ffffff])")
    return ((int(m[1]) * 60 + int(m[2])) * 60 + int(m[3])) * 1_000_000 + int((m[4] or "0").ljust(6, "0"))


def parse_timestamp(text: str) -> dt.datetime:
    body = text[:-1] if text.endswith("Z") else text
    day, _, clock = body.partition("T" if "T" in body else " ")
    try:
        micros = parse_time(clock) if clock else 0
        return dt.datetime.combine(parse_date(day), dt.time()) + dt.timedelta(microseconds=micros)
    except SchemaViolation:
        raise SchemaViolation(f"'{text}' is not a timestamp (YYYY-MM-DD HH:MM:SS[.ffffff])") from None


def format_time(micros: int) -> str:
    s, us = divmod(micros, 1_000_000)
    return f"{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}" + (f".{us:06}" if us else "")


def format_timestamp(value: dt.datetime) -> str:
    return value.strftime("%Y-%m-%d %H:%M:%S") + (f".{value.microsecond:06}" if value.microsecond else "")


def kind_of(value: Any) -> str:
    """The type of a literal or bound value."""
    for types, name in (((bool,), "bool"), ((int,), "int64"), ((float,), "float64"), ((str,), "text"), ((bytes, bytearray), "blob"), ((dt.datetime,), "timestamp"), ((dt.date,), "date"), ((dt.time,), "time"), ((dict,), "json"), ((list, tuple), "list")):
        if isinstance(value, types):
            return name
    if value is None:
        return "null"
    raise InvalidArgument(f"a value of type {type(value).__name__} can't be bound")


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def coerce(value: Any, column: Column, bound: bool = False) -> Any:
    """A literal (or a bound value) as the column's type, or an error that names the column."""
    if value is None:
        return None
    kind, to = kind_of(value), column.type
    wrong = SchemaViolation(f"column '{column.name}' is {to}, not {kind}")
    if to == "json":
        if kind == "text" and not bound:
            try:
                return canonical(json.loads(value))
            except ValueError:
                raise SchemaViolation(f"column '{column.name}' needs valid JSON") from None
        return canonical(value)
    if to == "vector":
        if kind == "text":
            try:
                value = json.loads(value)
            except ValueError:
                raise SchemaViolation(f"column '{column.name}' needs a JSON array of numbers") from None
        if not isinstance(value, (list, tuple)) or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in value):
            raise wrong
        if column.dim is not None and len(value) != column.dim:
            raise SchemaViolation(f"column '{column.name}' has {column.dim} dimensions, not {len(value)}")
        return [float(x) for x in value]
    if to == "float64" and kind == "int64":
        return float(value)
    if to == "int64" and kind == "int64":
        if not -(1 << 63) <= value < 1 << 63:
            raise SchemaViolation(f"column '{column.name}': integer out of range")
        return value
    if to == "timestamp":
        if kind == "text":
            return parse_timestamp(value)
        if kind == "int64":
            return _EPOCH + dt.timedelta(microseconds=value)
        if kind == "timestamp":
            return value.astimezone(dt.UTC).replace(tzinfo=None) if value.tzinfo else value
    if to == "date":
        if kind == "text":
            return parse_date(value)
        if kind == "int64":
            return dt.date(1970, 1, 1) + dt.timedelta(days=value)
    if to == "time":
        if kind == "text":
            return parse_time(value)
        if kind == "time":
            return ((value.hour * 60 + value.minute) * 60 + value.second) * 1_000_000 + value.microsecond
        if kind == "int64":
            if not 0 <= value < 86_400_000_000:
                raise SchemaViolation(f"column '{column.name}': time out of range")
            return value
    if kind != to:
        raise wrong
    return bytes(value) if to == "blob" else value


def check(value: Any, column: Column) -> None:
    """NOT NULL, length and enumeration of a converted value."""
    if value is None:
        if not column.nullable:
            raise SchemaViolation(f"column '{column.name}' is NOT NULL")
        return
    if column.max_length is not None and len(value) > column.max_length:
        raise SchemaViolation(f"column '{column.name}' takes at most {column.max_length} characters")
    if column.enum is not None and value not in column.enum:
        raise SchemaViolation(f"column '{column.name}' must be one of {', '.join(map(repr, column.enum))}")


def to_tagged(value: Any, kind: str = "") -> Any:
    """A value as JSON; types that JSON lacks carry a tag."""
    if value is None or isinstance(value, (str, float, int, bool)) and kind not in ("time", "json"):
        return value
    if kind == "time":
        return {"$t": "time", "v": format_time(value)}
    if kind == "json":
        return {"$t": "json", "v": json.loads(value)}
    if isinstance(value, (bytes, bytearray)):
        return {"$t": "blob", "v": bytes(value).hex()}
    if isinstance(value, dt.datetime):
        return {"$t": "timestamp", "v": format_timestamp(value)}
    if isinstance(value, dt.date):
        return {"$t": "date", "v": value.isoformat()}
    if isinstance(value, (list, tuple)):
        return {"$t": "vector", "v": [float(x) for x in value]}
    raise InvalidArgument(f"no JSON form for {type(value).__name__}")


def from_tagged(value: Any) -> Any:
    """The value of a tagged JSON form."""
    if not (isinstance(value, dict) and "$t" in value):
        return value
    body, tag = value.get("v"), value["$t"]
    make = {"blob": bytes.fromhex, "timestamp": parse_timestamp, "date": parse_date, "time": parse_time, "vector": list, "json": canonical}
    if tag not in make:
        raise InvalidArgument(f"unknown tag {tag!r}")
    return make[tag](body)


@dataclass
class ForeignKey:
    column: str
    table: str
    target: str
    cascade: bool = False


@dataclass
class Index:
    column: str
    unique: bool = False
    name: str | None = None


@dataclass
class Schema:
    """A table's columns in order, its indexes and foreign keys."""

    columns: list[Column]
    indexes: list[Index] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    text_indexes: list[str] = field(default_factory=list)
    vector_indexes: dict[str, dict] = field(default_factory=dict)

    def struct(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    def get(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def unique_columns(self) -> list[str]:
        return [i.column for i in self.indexes if i.unique]

    def to_json(self) -> dict:
        return {"columns": [c.to_json() for c in self.columns], "indexes": [asdict(i) for i in self.indexes], "foreign_keys": [asdict(f) for f in self.foreign_keys], "text_indexes": self.text_indexes, "vector_indexes": self.vector_indexes}

    @classmethod
    def from_json(cls, data: dict) -> Schema:
        return cls([Column.from_json(c) for c in data["columns"]], [Index(**i) for i in data["indexes"]], [ForeignKey(**f) for f in data["foreign_keys"]], list(data["text_indexes"]), dict(data["vector_indexes"]))
