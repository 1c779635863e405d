"""Errors of the engine, by the step that raises them."""


class EngineError(Exception):
    pass


class ParseError(EngineError):
    """Text that isn't a statement; says what was found and where."""

    def __init__(self, message: str, near: str = "", line: int = 0, column: int = 0):
        super().__init__(f"{message} near '{near}' at line {line}, column {column}" if line else message)
        self.near, self.line, self.column = near, line, column


class AnalysisError(EngineError):
    """Names or types that don't fit."""


class ConstraintError(EngineError):
    pass


class SerializationError(EngineError):
    def __init__(self, what: str = ""):
        super().__init__("could not serialize access due to concurrent update" + (f" on {what}" if what else ""))


class StatementTimeout(EngineError):
    pass


class AdmissionError(EngineError):
    """No place to run in came free in time."""
