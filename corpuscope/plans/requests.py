"""Bounds of requests, checked before anything is planned."""

from __future__ import annotations


def required_text(value, name: str, maximum: int | None = None) -> str:
    """A text that is not blank, without white space around it."""
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must not be empty")
    return bounded_text(value, name, maximum).strip()


def bounded_text(value, name: str, maximum: int | None) -> str:
    if not isinstance(value, str):
        raise ValueError(f"{name} must be a text")
    if maximum is not None and len(value) > maximum:
        raise ValueError(f"{name} must not exceed {maximum} characters")
    return value


def bounded_integer(value, name: str, maximum: int, minimum: int = 1) -> int:
    """A whole number within bounds; truth values are none."""
    if isinstance(value, bool) or not isinstance(value, int) or not minimum <= value <= maximum:
        raise ValueError(f"{name} must be a whole number from {minimum} to {maximum}")
    return value
