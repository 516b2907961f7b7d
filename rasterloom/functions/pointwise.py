"""Point-wise pixel functions as Column expressions; they stay in whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, lo, hi) -> Column:
    lift = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.least(F.greatest(v, lift(lo)), lift(hi))


def absolute(v: Column) -> Column:
    return F.abs(v)


def gamma_correction(v: Column, gamma: float) -> Column:
    """(v / 4095) ^ gamma * 4095; NaN for negative pixels under a fractional gamma."""
    return F.pow(v / 4095.0, F.lit(float(gamma))) * 4095.0


def contrast_adjust(v: Column, image_max: Column, contrast: float, brightness: float) -> Column:
    """Cut to a whole number, scale and shift, clamp to 255 or 4095, whichever the image's maximum needs."""
    whole = v.cast("int").cast("double")
    bins = F.when(image_max.cast("int") <= 255, 255.0).otherwise(4095.0)
    return clamp(whole * (F.lit(float(contrast)) / (bins / 2) + 1.0) + float(brightness - contrast), 0, bins)


def normalize_12bit(v: Column, divisor: float = 4095.0) -> Column:
    return clamp(v / divisor, 0, 1)


def dicom_window(v: Column, centre: Column | float, width: Column | float) -> Column:
    c, w = (x if isinstance(x, Column) else F.lit(float(x)) for x in (centre, width))
    return clamp((v - (c - w / 2)) / w, 0, 1) * 255.0


def window_of(image_min: Column, image_max: Column, header_centre: Column | None = None, header_width: Column | None = None) -> tuple[Column, Column]:
    """Centre and width: of the header if both are there, else from the image's range (width 1 if it has none)."""
    centre, width = (image_min + image_max) / 2, F.when(image_max > image_min, image_max - image_min).otherwise(1.0)
    if header_centre is None or header_width is None:
        return centre, width
    both = header_centre.isNotNull() & header_width.isNotNull()
    return F.when(both, header_centre).otherwise(centre), F.when(both, header_width).otherwise(width)


def intensity_window(v: Column, a: Column | float, b: Column | float) -> Column:
    a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b))
    return clamp((v - a) / F.when(b - a <= 0, 1.0).otherwise(b - a), 0, 1) * 255.0


def bits_stored(image_max: Column, header_bits: Column | None = None) -> Column:
    """Bits of the header, else 8, 12 or 16 by the image's maximum."""
    seen = F.when(image_max <= 255, 8).when(image_max <= 4095, 12).otherwise(16)
    return seen if header_bits is None else F.coalesce(header_bits, seen)


def normalize_bit_depth(v: Column, bits: Column, target_max: float = 255.0) -> Column:
    return clamp(v / (F.pow(F.lit(2.0), bits.cast("double")) - 1.0), 0, 1) * float(target_max)


def apply_mask(v: Column, mask: Column) -> Column:
    return v * mask


def image_bytes(h: Column, w: Column, channels: Column | int = 1, element: int = 4) -> Column:
    """Bytes of an image's pixels; 0 if its size is unknown."""
    c = channels if isinstance(channels, Column) else F.lit(channels)
    return F.coalesce(h.cast("bigint") * w * c * element, F.lit(0).cast("bigint"))
