"""Checks of raw request values."""

from __future__ import annotations


def whole_number(value: object, name: str, least: int, most: int | None = None) -> int:
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a whole number") from None
    if number < least or (most is not None and number > most):
        raise ValueError(f"{name} is out of range")
    return number
