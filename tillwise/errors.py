"""Errors raised on the driver before or between Spark jobs."""


class RetailDataError(ValueError):
    """Input tables cannot be used as asked."""


class SourceError(RetailDataError):
    """A source folder or file cannot be read."""


class ConfigError(RetailDataError):
    """A caller-supplied option is not usable."""


class ReportError(RetailDataError):
    """A report folder cannot be written."""


class GateError(RetailDataError):
    """Validation results forbid the next step."""
