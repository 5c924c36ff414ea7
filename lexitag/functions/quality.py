"""Quality bands of result rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper ends of the red and the yellow band, current and legacy results.
BANDS = {"current": (0.2, 0.9), "legacy": (0.7, 0.9)}


def quality_band(quality: Column, bands: str = "current") -> Column:
    """'red', 'yellow' or null; in the current bands a value over 1 is a percentage."""
    red, yellow = BANDS[bands]
    share = quality.cast("double")
    if bands == "current":
        share = F.when(share > 1, share / 100).otherwise(share)
    return F.when(share < red, "red").when(share < yellow, "yellow")
