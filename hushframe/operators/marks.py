"""Marks of findings that somebody has reviewed as safe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.modes import PrivacyMode


def marks_of(safe: DataFrame, dataset: str, mode: PrivacyMode, place: Sequence[str]) -> DataFrame | None:
    """The marks that count for a dataset in a mode: `place`, `pii_type` and `rule`; none at all but in the Strict mode.

    `safe` holds `dataset`, `mode`, the columns of `place`, `pii_type` and `rule`. A mark of another dataset or of
    another mode, and one without either, changes nothing.
    """
    missing = {"dataset", "mode", *place, "pii_type", "rule"} - set(safe.columns)
    if missing:
        raise ValueError(f"safe marks need the columns {sorted(missing)}")
    if mode is not PrivacyMode.STRICT:
        return None
    own = (F.col("dataset") == dataset) & (F.col("mode") == mode.value)
    return safe.where(own).select(*[F.col(f"`{c}`") for c in place], "pii_type", "rule")
