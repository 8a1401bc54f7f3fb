"""Errors raised on the driver, before any job starts."""


class GridmarkError(ValueError):
    """Base class of all configuration and input errors."""


class InvalidSplitRatioError(GridmarkError):
    """Split ratios are negative or do not sum to one."""


class EmptyDatasetError(GridmarkError):
    """A plan that needs at least one sample got none."""


class UnknownClassError(GridmarkError):
    """A class id, name or symbol is outside the ontology."""


class InvalidCoordinateError(GridmarkError):
    """Coordinates cannot be normalised (for instance a zero image size)."""
