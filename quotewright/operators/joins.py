"""Join helpers.

No join here carries a broadcast hint. Spark broadcasts a side when its size
estimate, or under AQE its measured shuffle size, is below
``spark.sql.autoBroadcastJoinThreshold`` and sorts and merges otherwise, so a
price list that has outgrown an executor's memory changes the plan and not the
result. Oversized keys are split by AQE (see ``quotewright.session``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which NULL equals NULL; the right side's key columns are dropped."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    )
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{k}" for k in keys])
