"""Errors of the engine, with the numeric codes that commands report."""

from __future__ import annotations


class DocEngineError(Exception):
    code = 1


class BadFilterError(DocEngineError):
    """A filter, stage, update or option that cannot be understood."""

    code = 2


class NotFoundError(DocEngineError):
    code = 26


class ExistsError(DocEngineError):
    code = 48


class DuplicateKeyError(DocEngineError):
    code = 11000


class ForbiddenError(DocEngineError):
    code = 13


class UnauthorizedError(ForbiddenError):
    """No session where one is needed, or one that has ended."""


class TooLargeError(DocEngineError):
    code = 10334


class ConflictError(DocEngineError):
    """Another writer was first; what was written is to be made again."""

    code = 112


class UnknownCommandError(DocEngineError):
    code = 59


class StageError(BadFilterError):
    """A pipeline stage that cannot be run; carries its own code."""

    def __init__(self, message: str, code: int = 40324):
        super().__init__(message)
        self.code = code
