"""Time as integer ticks.

All alignment is done on BIGINT microseconds so that window ends and bin edges
are exact and both sides of a join agree on them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS_PER_SECOND = 1_000_000


def seconds_to_ticks(col: Column) -> Column:
    return F.round(col * F.lit(float(TICKS_PER_SECOND))).cast("bigint")


def samples_to_ticks(col: Column, sample_rate: float) -> Column:
    return F.round(col * F.lit(TICKS_PER_SECOND / float(sample_rate))).cast("bigint")


def timestamp_to_ticks(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


@dataclass(frozen=True)
class BinGrid:
    """Bins over relative time; bin k holds the ticks ``bounds[k] <= d < bounds[k+1]``.

    The window is closed at both ends, so the last bound is one past the last
    tick that counts.
    """

    bounds: tuple[int, ...]
    centers: tuple[float, ...]
    bin_seconds: float
    uniform: bool

    @property
    def n_bins(self) -> int:
        return len(self.bounds) - 1

    @property
    def lo(self) -> int:
        return self.bounds[0]

    @property
    def hi(self) -> int:
        return self.bounds[-1] - 1

    def index_of(self, rel: Column) -> Column:
        """Bin of a relative tick already known to lie inside the window."""
        width = self.bounds[1] - self.bounds[0]
        guess = F.least(
            F.floor((rel - F.lit(self.lo)) / F.lit(width)).cast("int"), F.lit(self.n_bins - 1)
        )
        if self.uniform:
            return guess
        bounds = F.array(*[F.lit(b) for b in self.bounds])
        return (
            F.when(rel < F.get(bounds, guess), guess - 1)
            .when(rel >= F.get(bounds, guess + 1), guess + 1)
            .otherwise(guess)
        )

    def center_of(self, bin_col: Column) -> Column:
        return F.get(F.array(*[F.lit(c) for c in self.centers]), bin_col)


def _first_tick(edge: float) -> int:
    """The first tick whose time in seconds, as a float, is not below ``edge``."""
    tick = math.floor(edge * TICKS_PER_SECOND) - 1
    while tick / TICKS_PER_SECOND < edge:
        tick += 1
    return tick


def bin_grid(window: tuple[float, float], bin_size: float, edges: str = "ticks") -> BinGrid:
    """Edges ``w0, w0+b, …`` up to the first one at or beyond ``w1``.

    ``edges="ticks"`` uses exact edges. ``edges="float"`` keeps the edges that
    repeated floating-point steps give, including a last edge that may fall just
    short of ``w1`` and then excludes a point lying exactly on ``w1``.
    """
    w0, w1, b = (round(v * TICKS_PER_SECOND) for v in (*window, bin_size))
    if b <= 0 or w1 <= w0:
        raise ValueError("need w1 > w0 and bin_size > 0")
    if edges == "ticks":
        n = -(-(w1 - w0) // b)
        bounds = [w0 + k * b for k in range(n)] + [w1 + 1]
        centers = [(w0 + (k + 0.5) * b) / TICKS_PER_SECOND for k in range(n)]
        return BinGrid(tuple(bounds), tuple(centers), bin_size, True)
    if edges != "float":
        raise ValueError("edges must be 'ticks' or 'float'")
    n_edges = math.ceil((window[1] + bin_size - window[0]) / bin_size)
    step = (window[0] + bin_size) - window[0]
    raw = [window[0] + k * step for k in range(n_edges)]
    first = [_first_tick(e) for e in raw]
    last = min(first[-1] if first[-1] / TICKS_PER_SECOND == raw[-1] else first[-1] - 1, w1)
    bounds = [*first[:-1], last + 1]
    centers = [(raw[k] + raw[k + 1]) / 2.0 for k in range(n_edges - 1)]
    return BinGrid(tuple(bounds), tuple(centers), bin_size, False)
