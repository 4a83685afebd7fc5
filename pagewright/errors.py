"""Errors of the engine; failures of single files become columns instead (see sources)."""


class EngineError(Exception):
    """Root of all errors raised here."""


class UnsupportedFormatError(EngineError, ValueError):
    """A file's extension has no extractor."""


class MissingDependencyError(EngineError):
    """An optional package is not installed."""


class ExtractionError(EngineError):
    """A file could not be read."""


class OcrError(ExtractionError):
    """A recognition backend is unknown or failed."""


class ConfigError(EngineError):
    """A configuration file is missing or malformed."""
