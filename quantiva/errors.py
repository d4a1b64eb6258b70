"""Typed errors; each maps to one class of failure a caller can react to."""


class QuantivaError(Exception):
    """Base class."""


class ValidationError(QuantivaError):
    """Bad argument: unknown column, wrong role, limit out of range (HTTP 400 class)."""


class AnalysisError(QuantivaError):
    """The data cannot support the analysis: too few rows, groups or columns (422 class)."""


class DataProcessingError(QuantivaError):
    """Input could not be read or combined (422 class)."""


class ConfigurationError(QuantivaError):
    """The session lacks a setting that the library needs."""


class NotFoundError(QuantivaError):
    """No stored dataset or conversation at the given location (404 class)."""
