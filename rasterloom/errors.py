"""Errors with a message and a status code."""

from __future__ import annotations


class EngineError(Exception):
    code = 500

    def __init__(self, message: str, code: int | None = None):
        super().__init__(message)
        self.message, self.code = message, code or self.code


class FileMissing(EngineError):
    code = 404


class PixelsNotLoaded(EngineError):
    code = 400


class UnsupportedFile(EngineError):
    code = 415


class InvalidInput(EngineError):
    code = 422
