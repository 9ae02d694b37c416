"""hushframe: privacy-aware profiling and release of tables and text corpora on Spark."""

from hushframe.modes import ContextScope, PrivacyMode, parse_mode, parse_scope

__all__ = ["ContextScope", "PrivacyMode", "parse_mode", "parse_scope"]
