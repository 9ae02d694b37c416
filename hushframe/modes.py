"""Plan-time settings: privacy modes, context scopes and the values that hang on them."""

from __future__ import annotations

from enum import Enum


# Names of modes and scopes.
class PrivacyMode(str, Enum):
    STRICT = "Strict"
    BALANCED = "Balanced"
    RELAXED = "Relaxed"


class ContextScope(str, Enum):
    SCHEMA = "schema"
    SCHEMA_STATS = "schema+stats"
    SCHEMA_STATS_SAMPLE = "schema+stats+sample"


# Confidence of the column-name rules and sample size, per mode.
COLUMN_RULE_CONFIDENCE = {
    PrivacyMode.STRICT: 0.72,
    PrivacyMode.BALANCED: 0.62,
    PrivacyMode.RELAXED: 0.55,
}
SAMPLE_LIMIT = {
    PrivacyMode.STRICT: 100,
    PrivacyMode.BALANCED: 200,
    PrivacyMode.RELAXED: 300,
}


def parse_mode(mode: str | PrivacyMode | None) -> PrivacyMode:
    """Read a mode name, ignoring case and outer blanks; anything unknown is the safest mode."""
    if isinstance(mode, PrivacyMode):
        return mode
    by_name = {m.value.lower(): m for m in PrivacyMode}
    return by_name.get(str(mode or "").strip().lower(), PrivacyMode.STRICT)


def parse_scope(scope: str | ContextScope) -> ContextScope:
    """Read a scope name; an unknown one raises ValueError."""
    return ContextScope(scope)
