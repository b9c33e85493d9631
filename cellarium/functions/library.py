"""All spreadsheet functions. Importing this fills the registry."""

from cellarium.functions import library_lookup, library_math, library_stats, library_text  # noqa: F401
from cellarium.functions.registry import FUNCTIONS, call, classify

__all__ = ["FUNCTIONS", "call", "classify"]
