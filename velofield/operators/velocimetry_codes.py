"""Numbers of the reasons why a vector was taken out."""

from __future__ import annotations

# What an error text starts with, and its number; others are 255.
CODES = [
    ("Correlation peak touching", 1),
    ("correl < correl_min", 2),
    ("delta2 < displacement_max2", 3),
    ("diff neighbour too large", 4),
]


def code_of(errors: str | None) -> int | None:
    if errors is None:
        return None
    return next((number for text, number in CODES if errors.startswith(text)), 255)
