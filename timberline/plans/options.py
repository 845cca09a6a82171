"""Report options; thresholds are arguments, never globals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Options:
    """``by`` is () for one report or ("source",) for one report per source."""

    slow: float = 10.0
    critical: float = 30.0
    by: tuple[str, ...] = ()
    exclude: tuple[str, ...] = field(default_factory=tuple)


Output = Callable[[DataFrame, Options], DataFrame]
