"""Operators as stages of a pyspark.ml Pipeline."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.sql import DataFrame


class Fitted(Protocol):
    def transform(self, df: DataFrame) -> DataFrame: ...


class Apply(Transformer):
    """A function of a frame as a stage: ``Apply(loo_zscore, cohort=["team"], value="pay")``."""

    def __init__(self, function: Callable[..., DataFrame], **options: object):
        super().__init__()
        self.function, self.options = function, options

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.function(dataset, **self.options)


class Learn(Estimator):
    """Anything with ``fit`` as a stage; ``fit`` gives an object with ``transform`` (or, by name, another method), which becomes the fitted stage."""

    def __init__(self, fit: Callable[[DataFrame], Fitted], method: str = "transform", **options: object):
        super().__init__()
        self.fit_, self.method, self.options = fit, method, options

    def _fit(self, dataset: DataFrame) -> Apply:
        return Apply(getattr(self.fit_(dataset), self.method), **self.options)


def chain(*stages: Transformer | Estimator) -> Pipeline:
    return Pipeline(stages=list(stages))


__all__ = ["Apply", "Fitted", "Learn", "PipelineModel", "chain"]
