"""The one error type of the engine: a message with the status that a service would answer with."""

from __future__ import annotations

BAD_REQUEST, NOT_FOUND, CONFLICT, INTERNAL, UNAVAILABLE = 400, 404, 409, 500, 503


class EngineError(Exception):
    """message, status (as in HTTP), and for failures of execution a code and the stage that failed."""

    def __init__(self, message: str, status: int = BAD_REQUEST, code: str = "", stage: str = "") -> None:
        super().__init__(message)
        self.message, self.status, self.code, self.stage = message, status, code, stage
