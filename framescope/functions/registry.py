"""Named choices: metrics with their direction, planners."""

from __future__ import annotations

from pyspark.sql import functions as F

from framescope.functions import arrays as A

# name -> (1 if higher is better else -1, column over one pair of frames)
METRICS = {
    "pitch_error": (-1, lambda a, b: F.abs(A._c(a) - A._c(b))),
    "voicing_error": (-1, lambda a, b: (A._c(a) != A._c(b)).cast("double")),
    "pesq": (1, lambda a, b: A._c(b)),
}
PLANNERS: dict[str, object] = {}


def planner(name: str):
    def keep(fn):
        PLANNERS[name] = fn
        return fn
    return keep


def register_metric(name: str, direction: int, column) -> None:
    METRICS[name] = (direction, column)
