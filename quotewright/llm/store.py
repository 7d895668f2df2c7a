"""Tables and code that the operators share between jobs."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType

from pyspark import cloudpickle
from pyspark.sql import DataFrame

from quotewright.session import shared_dir

# Functions of these modules go to the Python workers along with the plan.
for _name in ("quotewright.llm", __name__):
    cloudpickle.register_pickle_by_value(sys.modules[_name])


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written below spark.checkpoint.dir and read again: its plan ends there, it is
    computed once, and it outlives the executors that computed it."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_worker(key: tuple, make: Callable):
    """``make()``, once in a Python worker process and key; for look-up tables that tasks can share.

    Code is sent to the workers by value, so that a module's own globals do not outlive a task.
    """
    kept = sys.modules.setdefault("quotewright_per_worker", ModuleType("quotewright_per_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
