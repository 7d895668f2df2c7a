"""Session settings and shared folders the operators rely on."""

from __future__ import annotations

import math
import re
import sys
import tempfile
import uuid
from functools import cache

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# Keys repeat unevenly: one quote or one price book may own a large part of the
# rows. AQE then splits the oversized shuffle partitions of a join; "force" keeps
# that true when the join feeds an aggregation on the same key, at the price of
# one more exchange of already partially aggregated rows.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A cart that is dealt by quote for pricing stays so for joins on quote and line.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="quotewright-")


# Rows of the largest table for each shuffle partition of a large input, and what AQE then joins into one task.
TASK_ROWS = 1 << 19
PARTITIONS, ADVISED = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
TASK_BYTES = 16 << 20
# The session's own values, while others are in force.
OWN = "quotewright.own."


def tune(spark: SparkSession, rows: int = 0) -> SparkSession:
    """Set what the operators count on.

    With the number of ``rows`` of the largest input, shuffles get so many partitions that a task's share does not grow
    with the input: both a fixed number of partitions and what AQE joins by default would let it. Inputs with less than
    ``TASK_ROWS`` rows a core leave the session's own values in force, or bring them back.
    """
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    _restore(spark)
    n = math.ceil(rows / TASK_ROWS)
    if n > spark.sparkContext.defaultParallelism:
        _replace(spark, PARTITIONS, max(n, int(spark.conf.get(PARTITIONS))))
        _replace(spark, ADVISED, min(TASK_BYTES, _bytes(spark.conf.get(ADVISED))))
    return spark


def _bytes(size: str) -> int:
    """A size as Spark writes it, such as 8m, 64MB or 67108864b."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def _replace(spark: SparkSession, key: str, value: int) -> None:
    own = spark.conf.get(key, None)
    spark.conf.set(f"{OWN}{key}", f"{value}|{own or ''}")
    spark.conf.set(key, str(value))


def _restore(spark: SparkSession) -> None:
    """Bring the session's own values back; one that was set since then stays."""
    for key in (PARTITIONS, ADVISED):
        value, _, own = (spark.conf.get(f"{OWN}{key}", None) or "").partition("|")
        if value and spark.conf.get(key) == value:
            if own:
                spark.conf.set(key, own)
            else:
                spark.conf.unset(key)
        spark.conf.unset(f"{OWN}{key}")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below ``spark.checkpoint.dir`` that every executor can reach.

    Only a local session may go without that setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = _local_dir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def ship_by_value(module_name: str) -> None:
    """Send functions of a module to the Python workers along with the plan, so that the
    workers need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
