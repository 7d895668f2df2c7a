"""Numbered steps that are visible once they are whole.

Step n writes to folders of its own and then a mark. Readers look for marks only, so a step that was lost half-way is
never seen, and is replaced when it is run again. Numbers rise by one from 0 or 1.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

MARK = "step long"


def is_done(spark: SparkSession, folder: str, n: int) -> bool:
    try:
        return bool(spark.read.schema(MARK).parquet(f"{folder}/done/{n}").head(1))
    except AnalysisException:  # no such folder
        return False


def mark_done(spark: SparkSession, folder: str, n: int) -> None:
    spark.range(n, n + 1, 1, 1).toDF("step").write.mode("overwrite").parquet(f"{folder}/done/{n}")


def last_done(spark: SparkSession, folder: str) -> int:
    """The last marked step from 1 on, 0 if there is none; found by probing, without a list of them."""
    step = 1
    while is_done(spark, folder, step):
        step *= 2
    low, high = step // 2, step
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if is_done(spark, folder, middle) else (low, middle)
    return low
