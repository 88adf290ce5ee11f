"""Typed errors of the imperative wrappers; set-based operators report the same names as column values."""


class StoreError(Exception):
    """Anything a log refuses."""


class Conflict(StoreError):
    """Another writer was first, or a run does not follow on its stream's head. Worth a retry after a reload."""


class VersionOverflow(StoreError):
    """A version would go beyond the range; never reported as a conflict."""


class DuplicateTarget(StoreError):
    """Two runs of one atomic append name the same stream."""


class InvalidEnvelope(StoreError):
    """A field breaks its limit, such as metadata that is present but empty."""


class HistoryMismatch(StoreError):
    """A position from another history of the log."""


class Expired(StoreError):
    """An export session used after its lifetime."""
