"""Errors of the engine."""


class EngineError(ValueError):
    """A statement or command that the engine refuses, with the reason."""
