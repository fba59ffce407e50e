"""Errors that are raised before a job runs."""


class SegmentError(ValueError):
    """A request, schema or store that can't be processed."""


class CoercionError(SegmentError):
    """A column that a write job doesn't take."""
