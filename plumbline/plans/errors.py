"""Why a query or a pair of queries has no answer."""

from __future__ import annotations

from enum import Enum


class Reason(Enum):
    """The eight kinds of refusal."""

    PARSE_ERROR = "parse_error"
    NAME_RESOLUTION = "name_resolution"
    TYPE_ERROR = "type_error"
    UNSUPPORTED_SQL = "unsupported_sql"
    INVALID_SCHEMA = "invalid_schema"
    COMPLEXITY_LIMIT = "complexity_limit"
    SOLVER = "solver"
    INTERNAL = "internal"

    @property
    def is_resource_limit(self) -> bool:
        return self in (Reason.COMPLEXITY_LIMIT, Reason.SOLVER)


class QueryError(Exception):
    def __init__(self, reason: Reason, message: str):
        super().__init__(f"{reason.value}: {message}")
        self.reason, self.message = reason, message


def parse_error(message: str) -> QueryError:
    return QueryError(Reason.PARSE_ERROR, message)


def name_error(message: str) -> QueryError:
    return QueryError(Reason.NAME_RESOLUTION, message)


def type_error(message: str) -> QueryError:
    return QueryError(Reason.TYPE_ERROR, message)


def unsupported(message: str) -> QueryError:
    return QueryError(Reason.UNSUPPORTED_SQL, message)


def too_complex(message: str) -> QueryError:
    return QueryError(Reason.COMPLEXITY_LIMIT, message)
