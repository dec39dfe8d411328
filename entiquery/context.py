"""Per-frame parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FrameContext:
    """``dt`` is a float column that holds the frame's time step; ``user_data`` is the caller's."""

    delta: float = 0.0
    user_data: Any = None
    double: bool = False
    extra: dict = field(default_factory=dict)

    @property
    def dt(self) -> Column:
        return F.lit(self.delta).cast("double" if self.double else "float")
