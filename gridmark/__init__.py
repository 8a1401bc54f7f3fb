"""Annotation data engine: labelled-image datasets as Spark DataFrames."""

from gridmark.config import AuditConfig, SanitizeConfig, ScreenWeights, SplitRatio
from gridmark.errors import (
    EmptyDatasetError,
    GridmarkError,
    InvalidCoordinateError,
    InvalidSplitRatioError,
    UnknownClassError,
)
from gridmark.vocabulary import Vocabulary

__all__ = [
    "AuditConfig",
    "EmptyDatasetError",
    "GridmarkError",
    "InvalidCoordinateError",
    "InvalidSplitRatioError",
    "SanitizeConfig",
    "ScreenWeights",
    "SplitRatio",
    "UnknownClassError",
    "Vocabulary",
]
