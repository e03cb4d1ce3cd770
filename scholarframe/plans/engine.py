"""A registry of metric calculators, each a function from a table to a table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Calculator = Callable[[DataFrame], DataFrame]


class MetricEngine:
    """Calculators by metric; results carry the metric's id and version."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[str, Calculator]] = {}

    def register(self, metric_id: str, version: str, calculator: Calculator) -> None:
        """A metric can be registered once."""
        if metric_id in self._known:
            raise ValueError(f"{metric_id} is registered already")
        self._known[metric_id] = version, calculator

    def calculate(self, metric_id: str, inputs: DataFrame) -> DataFrame:
        version, calculator = self._known[metric_id]
        return calculator(inputs).withColumns({"metric_id": F.lit(metric_id), "metric_version": F.lit(version)})

    def calculate_all(self, inputs: DataFrame) -> DataFrame:
        """All metrics, as the union of their rows."""
        return reduce(DataFrame.unionByName, [self.calculate(m, inputs) for m in sorted(self._known)])
