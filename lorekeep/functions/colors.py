"""Score as a colour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Royal blue, white smoke, and the score that gives the full blue.
FULL = (65, 105, 225)
FAINT = (245, 245, 245)
FULL_SCORE = 10.0


def _linear(channel: int) -> float:
    value = channel / 255
    return value / 12.92 if value <= 0.04045 else ((value + 0.055) / 1.055) ** 2.4


def score_color(score: Column) -> Column:
    """``#rrggbb`` between faint and full, blended in linear light; null for null."""
    share = F.least(score / FULL_SCORE, F.lit(1.0))
    channels = []
    for full, faint in zip(FULL, FAINT):
        light = share * _linear(full) + (1 - share) * _linear(faint)
        encoded = F.when(light <= 0.0031308, light * 12.92).otherwise(1.055 * F.pow(light, F.lit(1 / 2.4)) - 0.055)
        channels.append(F.lpad(F.hex(F.round(encoded * 255).cast("int")), 2, "0"))
    return F.when(score.isNotNull(), F.lower(F.concat(F.lit("#"), *channels)))
