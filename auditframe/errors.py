"""The one error type of the library: an operation that would have to guess refuses instead."""

from __future__ import annotations


class RefusedError(ValueError):
    """Raised when input or a specification is unsafe.

    ``status`` tells why; a refused specification also has a ``code`` and the ``fields`` it is about.
    """

    def __init__(self, message: str, status: str = "failed", code: str | None = None, fields: tuple[str, ...] = ()) -> None:
        super().__init__(message)
        self.status, self.code, self.fields = status, code, tuple(fields)
