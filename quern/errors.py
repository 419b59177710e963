"""Errors that the engine raises before Spark runs anything."""


class QueryError(ValueError):
    """A malformed request: unknown column, bad range, unsupported operand."""


class NotFound(KeyError):
    """A key, index or id that does not exist."""


class Conflict(RuntimeError):
    """A write against a version that has moved on."""


class Unsupported(NotImplementedError):
    """Semantics that the operator does not define, such as a sparse result without zeros."""
