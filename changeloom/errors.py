"""Errors, by the part that raises them."""


class ChangeError(Exception):
    """Any error of the engine."""


class ConfigError(ChangeError):
    """A setting is missing or out of range."""


class DecodeError(ChangeError):
    """Log bytes that can't be read. Reading stops: a log record is never skipped."""


class SourceError(ChangeError):
    """A source doesn't meet its prerequisites."""


class SinkError(ChangeError):
    """A target can't take a batch."""


class SchemaError(ChangeError):
    """A schema change that can't be applied."""


class PositionGap(SourceError):
    """Changes between the stored position and the source's log are lost; a new snapshot is needed."""
