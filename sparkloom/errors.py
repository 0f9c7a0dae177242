"""Errors with the HTTP status that the REST surface gives them."""

from __future__ import annotations


class EngineError(Exception):
    status, reason = 400, "invalidQuery"


class InvalidQuery(EngineError):
    pass


class NotFound(EngineError):
    status, reason = 404, "notFound"


class AlreadyExists(EngineError):
    status, reason = 409, "duplicate"


class Invalid(EngineError):
    status, reason = 400, "invalid"


class Unsupported(EngineError):
    status, reason = 501, "notImplemented"


class Stopped(EngineError):
    status, reason = 409, "stopped"


_NOT_FOUND = {"TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND", "VIEW_NOT_FOUND", "PATH_NOT_FOUND", "ROUTINE_NOT_FOUND"}
_EXISTS = {"TABLE_OR_VIEW_ALREADY_EXISTS", "SCHEMA_ALREADY_EXISTS", "VIEW_ALREADY_EXISTS", "ROUTINE_ALREADY_EXISTS", "LOCATION_ALREADY_EXISTS"}


def translate(e: Exception) -> Exception:
    """A Spark exception as an engine error, by its error class; others unchanged."""
    from pyspark.errors import AnalysisException, PySparkException

    if not isinstance(e, PySparkException):
        return e
    kind = (e.getCondition() or "").split(".")[0]
    text = str(e).split("\n\nJVM stacktrace")[0]
    if kind in _NOT_FOUND:
        return NotFound(text)
    if kind in _EXISTS:
        return AlreadyExists(text)
    if kind == "QUERY_EXECUTION_CANCELED" or kind == "OPERATION_CANCELED" or "cancelled" in text:
        return Stopped(text)
    return InvalidQuery(text) if isinstance(e, AnalysisException) or kind else e
