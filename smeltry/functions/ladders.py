"""Threshold ladders: a number to a label.

A ladder is plain data, so new scales need no code. ``closed`` tells whether a
bound belongs to its own step (``value <= bound``) or to the next one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ladder:
    steps: tuple[tuple[float, str], ...]
    top: str
    closed: bool = False
    unknown: str | None = None

    def labels(self) -> list[str]:
        return [label for _, label in self.steps] + [self.top]


# --- fixed values: the delay scales in hours, and the segment scales ---------
CONSUMER_DELAY = Ladder(
    ((1, "immediate"), (6, "short"), (24, "medium"), (48, "long")), "critical", unknown="unknown"
)
MONITOR_DELAY = Ladder(
    ((0.1, "immediate"), (1, "short"), (6, "medium"), (24, "long"), (48, "very_long")),
    "critical",
    unknown="unknown",
)
BATCH_DELAY = Ladder(
    ((1, "immediate"), (6, "slightly_late"), (24, "late")), "very_late", closed=True
)
ACTIVITY_STATUS = Ladder(((30, "Active"), (90, "At Risk")), "Inactive", closed=True)
PURCHASE_DIVERSITY = Ladder(((1, "Single Category"), (2, "Focused")), "Diverse", closed=True)
# ----------------------------------------------------------------------------


def bucket(value: Column, ladder: Ladder) -> Column:
    """Label of the first step the value fits, else the top label."""
    out = None
    if ladder.unknown is not None:
        out = F.when(value.isNull(), F.lit(ladder.unknown))
    for bound, label in ladder.steps:
        hit = value <= F.lit(bound) if ladder.closed else value < F.lit(bound)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(ladder.top))
