"""Parameters of the scoring function and of searches, with their checks."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class BM25Params:
    """Saturation of term counts (k1 >= 0) and weight of the length norm (0 <= b <= 1)."""

    k1: float = 1.5
    b: float = 0.75

    def __post_init__(self) -> None:
        if not self.k1 >= 0 or not 0 <= self.b <= 1:
            raise ValueError(f"k1 must be at least 0 and b from 0 to 1, not {self.k1} and {self.b}")


def checked_k(k: int) -> int:
    """The number of results wanted, which must be a whole number of at least 1."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError(f"k must be a whole number of at least 1, not {k!r}")
    return k
