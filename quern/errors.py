"""Errors that a script can cause."""


class ScriptError(ValueError):
    """Base of all errors in scripts."""


class SyntaxProblem(ScriptError):
    """The text isn't in the dialect; has the line and column of the first bad token."""

    def __init__(self, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{message} (line {line}, column {column})" if line else message)
        self.line, self.column = line, column


class CatalogProblem(ScriptError):
    """A table is unknown or already there, or an option is wrong."""


class SettingProblem(ScriptError):
    """An unknown setting, or a value that it doesn't take."""


class QueryProblem(ScriptError):
    """A query that parses but has no meaning."""
