"""Digests of many rows that do not depend on their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMBS = 4
HALF = (1 << 32) - 1


def row_hash(columns: list[str], seed: str = "") -> Column:
    """SHA-256 of a row's values, as hex text."""
    return F.sha2(F.to_json(F.struct(F.lit(seed).alias("__seed"), *[F.col(f"`{c}`") for c in sorted(columns)])), 256)


def digests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``digest`` per key of rows with their hash ``sha``: the hash of their count and of eight sums over 32-bit parts,
    which are added up before the shuffle. The parts are halves of four hashes of ``sha`` with different seeds, since
    cutting its text into numbers takes longer than making it."""
    hashes = [F.xxhash64(F.lit(i), "sha") for i in range(LIMBS)]
    parts = [p for h in hashes for p in (h.bitwiseAND(F.lit(HALF)), F.shiftrightunsigned(h, 32))]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)])
    return sums.select(*keys, F.sha2(F.concat_ws(":", "n", *[f"s{i}" for i in range(len(parts))]), 256).alias("digest"))
