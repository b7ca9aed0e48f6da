"""The one exception type of the library; ``code`` is stable, the message is for people."""

from __future__ import annotations


class TableError(ValueError):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def invalid_action(message: str) -> TableError:
    return TableError("invalid_action", message)


def not_applicable(message: str) -> TableError:
    return TableError("action_not_applicable", message)


def invalid_file(message: str) -> TableError:
    return TableError("invalid_file", message)
