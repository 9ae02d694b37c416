"""Human-readable sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The units; the last one takes everything above.
SIZE_UNITS = ("B", "KB", "MB", "GB")


def format_size(size_bytes: Column) -> Column:
    size = size_bytes.cast("double")
    text = F.lit(None).cast("string")
    for power, unit in reversed(list(enumerate(SIZE_UNITS))):
        # A tie goes to the even digit.
        shown = F.format_string(f"%.1f {unit}", F.bround(size / float(1024**power), 1))
        text = shown if power == len(SIZE_UNITS) - 1 else F.when(size < float(1024 ** (power + 1)), shown).otherwise(text)
    return F.when(size_bytes.isNotNull(), text)
