"""Errors with stable codes."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all errors that the engine raises on purpose."""

    code = 0


def _error(name: str, code: int, doc: str) -> type[EngineError]:
    return type(name, (EngineError,), {"code": code, "__doc__": doc, "__module__": __name__})


StorageError = _error("StorageError", 1, "A file can't be read or written.")
CorruptError = _error("CorruptError", 2, "A manifest or a data file is damaged.")
TableExists = _error("TableExists", 3, "A table of that name exists.")
TableNotFound = _error("TableNotFound", 4, "There is no such table.")
RecordNotFound = _error("RecordNotFound", 5, "There is no such record.")
DuplicateId = _error("DuplicateId", 6, "A record of that id exists.")
SchemaViolation = _error("SchemaViolation", 7, "A value breaks the table's schema.")
InvalidArgument = _error("InvalidArgument", 8, "An argument makes no sense.")
Conflict = _error("Conflict", 9, "Another commit changed what this one wants to change.")
DatabaseLocked = _error("DatabaseLocked", 10, "Another writer holds the lock.")
UniqueViolation = _error("UniqueViolation", 11, "A unique column would hold a value twice.")
SqlError = _error("SqlError", 12, "The statement isn't part of the dialect, or makes no sense.")
ReadOnly = _error("ReadOnly", 13, "The engine was opened for reading.")
ColumnNotFound = _error("ColumnNotFound", 14, "There is no such column.")
IndexNotFound = _error("IndexNotFound", 15, "There is no such index.")
MemoryLimit = _error("MemoryLimit", 16, "A bounded result is larger than its bound.")
CommitUnknown = _error("CommitUnknown", 17, "It isn't known whether a commit was made.")
