"""Errors raised by the library."""


class TesseraError(Exception):
    """Any of the errors below."""


class EmptySourceError(TesseraError):
    """A source gave no documents."""


class PathNotFoundError(TesseraError, KeyError):
    """A schema has nothing at a path."""


class CyclicReferenceError(TesseraError):
    """A document is nested deeper than is allowed."""


class SourceError(TesseraError):
    """A source cannot be read."""


class NormalizationError(TesseraError):
    """A plan does not fit a DataFrame."""


class DDLCompilationError(TesseraError):
    """A schema or a change cannot be written in a dialect."""


class PlanError(TesseraError):
    """A table expression cannot be built or written."""
