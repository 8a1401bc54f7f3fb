"""Validated parameters. They reach the plans as literals, so Catalyst folds them."""

from __future__ import annotations

from dataclasses import dataclass

from gridmark.errors import GridmarkError, InvalidSplitRatioError

# File extensions that count as images.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tiff")
# Text files that are never labels.
NON_LABEL_FILES = ("classes.txt", "README.txt", "urls.txt")
# The two image domains.
DIGITAL, PHYSICAL = "digital_2d", "physical_3d"
DOMAINS = (DIGITAL, PHYSICAL)
SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class SanitizeConfig:
    """Thresholds of the box clamp and of the degenerate-box test."""

    epsilon: float = 1e-5
    min_dimension: float = 0.005
    min_area: float = 0.000025
    min_visibility_ratio: float = 0.40


@dataclass(frozen=True)
class AuditConfig:
    """Thresholds of the audit rule chain."""

    num_classes: int = 12
    epsilon: float = 1e-5
    min_dimension: float = 0.005
    min_area: float = 0.000025
    image_extensions: tuple[str, ...] = IMAGE_EXTENSIONS
    strict_degenerate_as_error: bool = False
    validate_image_decoding: bool = True


@dataclass(frozen=True)
class SplitRatio:
    """Shares of train, val and test; they must sum to one within 0.001."""

    train: float = 0.70
    val: float = 0.15
    test: float = 0.15

    def __post_init__(self) -> None:
        shares = (self.train, self.val, self.test)
        if min(shares) < 0.0:
            raise InvalidSplitRatioError(f"negative split share in {shares}")
        if not 0.999 <= sum(shares) <= 1.001:
            raise InvalidSplitRatioError(f"split shares {shares} sum to {sum(shares):.4f}, not 1")


@dataclass(frozen=True)
class ScreenWeights:
    """Weights and thresholds of the statistical domain screen."""

    entropy: float = 0.35
    zero_noise: float = 0.35
    texture: float = 0.20
    lighting: float = 0.10
    noise_threshold: float = 1.0
    ambiguous_low: float = 0.25
    ambiguous_high: float = 0.75
    center_score_limit: float = 0.40

    def __post_init__(self) -> None:
        total = self.entropy + self.zero_noise + self.texture + self.lighting
        if abs(total - 1.0) > 1e-4:
            raise GridmarkError(f"feature weights must sum to 1, got {total}")
