"""Run a step so that a failure becomes an empty result and a warning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def attempt(spark: SparkSession, step: Callable[[], DataFrame], schema: str) -> tuple[DataFrame, str]:
    """The step's DataFrame and "", or an empty one of ``schema`` and the reason.

    Covers errors while the plan is built (missing columns, refused inputs);
    errors inside tasks are retried by Spark and then surface at the action.
    """
    try:
        return step(), ""
    except Exception as exc:
        return spark.createDataFrame([], schema), f"{type(exc).__name__}: {str(exc).splitlines()[0] if str(exc) else ''}"
