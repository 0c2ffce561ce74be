"""Registry parameters as typed values. Registry texts carry numbers and flags as words, callers as values."""

from __future__ import annotations

import numbers
import re

_NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*")


def number(value, default: float = 0.0) -> float:
    """``value`` as a float; ``default`` where it is absent or not a number."""
    if isinstance(value, numbers.Real):
        return float(value)
    return float(value) if isinstance(value, str) and _NUMBER.fullmatch(value) else default


def flag(value, default: bool = False) -> bool:
    """True for True and the word 'true' in any case; ``default`` where it is absent."""
    return default if value is None else str(value).strip().casefold() == "true"
