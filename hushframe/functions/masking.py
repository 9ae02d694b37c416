"""Masked previews of found values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.text import strip

# Mask forms.
STARS = "***"
PHONE_MASK = "*** *** ***"
PHONE_PREFIX = "+420 "


def _head(part: Column) -> Column:
    return F.when(F.length(part) >= 2, F.concat(F.substring(part, 1, 2), F.lit(STARS))).otherwise(STARS)


def mask_email(value: Column, match_pattern: str | None = None) -> Column:
    """Two characters of the local part and of the first domain label stay readable.

    By default the whole cell is split at its first `@`, so text around the address stays visible; with
    `match_pattern` only the first match of that pattern is taken and the rest of the cell is dropped.
    """
    if match_pattern is not None:
        value = F.regexp_extract(value, match_pattern, 0)
    at = F.instr(value, "@")
    local = F.substring_index(value, "@", 1)
    domain = F.substr(value, at + 1)
    dot = F.instr(domain, ".")
    rest = F.substr(domain, dot + 1)
    masked_domain = F.when(
        dot > 0, F.concat(_head(F.substring_index(domain, ".", 1)), F.lit("."), rest)
    ).otherwise(STARS)
    return F.when(at == 0, STARS).otherwise(F.concat(_head(local), F.lit("@"), masked_domain))


def mask_phone(value: Column) -> Column:
    prefix = F.when(F.startswith(strip(value), F.lit("+")), PHONE_PREFIX).otherwise("")
    return F.when(~value.rlike("[0-9]"), STARS).otherwise(F.concat(prefix, F.lit(PHONE_MASK)))


def mask_generic(value: Column) -> Column:
    text = strip(value)
    return F.when(F.length(text) <= 2, F.repeat(F.lit("*"), F.length(text))).otherwise(
        F.concat(F.substring(text, 1, 1), F.lit(STARS), F.right(text, F.lit(1)))
    )


def mask_value(value: Column, pii_type: Column, email_pattern: str | None = None) -> Column:
    """Mask by finding type; a null value counts as an empty one."""
    text = F.coalesce(value, F.lit(""))
    kind = F.upper(pii_type)
    return (
        F.when(kind == "EMAIL", mask_email(text, email_pattern))
        .when(kind == "PHONE", mask_phone(text))
        .otherwise(mask_generic(text))
    )
