"""Argument checks shared by the public calls."""

from __future__ import annotations


def require_bool(name: str, value) -> None:
    if not isinstance(value, bool):
        raise TypeError(f"{name} must be True or False, got {value!r}")


def require_sample_size(k: int, n: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int):
        raise TypeError(f"k must be an integer, got {k!r}")
    if not 1 <= k <= n:
        raise ValueError(f"k must lie between 1 and the {n} vertices, got {k}")
