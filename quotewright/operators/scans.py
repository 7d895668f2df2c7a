"""Running values over ordered rows of a key, for keys that may hold any share of the rows.

The order is a number. It is cut into ranges; the rows of a key and range are scanned in a window of
their own, what the ranges leave behind is scanned in the same way, in ranges of ranges, and carried into each
range. No window holds more than a key's rows of one range, and the last one a key's widest ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Widths, in the order's numbers, of the ranges and of the ranges of ranges.
RANGES = (1 << 12, 1 << 24)


def running(rows: DataFrame, keys: Sequence[str], order: str, *, last: Mapping[str, Column] | None = None,
            most: Mapping[str, Column] | None = None, sums: Mapping[str, Column] | None = None,
            tie: Sequence[str] = (), ranges: Sequence[int] = RANGES) -> DataFrame:
    """``rows`` with running values per key in order of ``order``, then ``tie``.

    ``last`` gives the last value that is not NULL, ``most`` the largest, ``sums`` the sum (0 at first); each under its
    name up to and with the row, and under ``<name>_before`` without it. ``order`` is a long; rows in which
    it or a key is NULL get NULLs, and the sum 0. ``rows`` is read twice: pass a stored table.
    """
    last, most, sums = last or {}, most or {}, sums or {}
    values = {**last, **most, **sums}
    width, *wider = ranges
    range_ = f"__{order}_range"
    piece = [*keys, range_]
    # Values are computed once and carried in structs, so that NULL stays apart from "none yet".
    valued = rows.withColumns({f"__{n}": v for n, v in values.items()}).withColumn(
        range_, F.floor(F.col(order) / width))
    in_order = [F.col(order), *map(F.col, tie)]

    def upto(end: int):
        return W.partitionBy(*piece).orderBy(*in_order).rowsBetween(W.unboundedPreceding, end)

    def folded(name: str, window) -> Column:
        value = F.col(f"__{name}")
        if name in last:
            return F.last(value, ignorenulls=True).over(window)
        return (F.max(value) if name in most else F.sum(value)).over(window)

    inside = valued.withColumns(
        {n: folded(n, upto(0)) for n in values} | {f"{n}_before": folded(n, upto(-1)) for n in values})
    at = F.struct(*in_order)
    left = valued.groupBy(*piece).agg(*[
        (F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), at)) if n in last
         else F.max(f"__{n}") if n in most else F.sum(f"__{n}")).alias(n) for n in values])
    own = {kind: {n: F.col(n) for n in group} for kind, group in (("last", last), ("most", most), ("sums", sums))}
    if wider:
        carried = running(left, keys, range_, **own, ranges=[w // width for w in wider]).drop(*values)
    else:
        before = W.partitionBy(*keys).orderBy(range_).rowsBetween(W.unboundedPreceding, -1)
        carried = left.select(*piece, *[
            (F.last(n, ignorenulls=True) if n in last else F.max(n) if n in most else F.sum(n)).over(before).alias(f"{n}_before")
            for n in values])
    carried = carried.withColumnsRenamed({f"{n}_before": f"__carried_{n}" for n in values})
    joined = inside.join(carried, piece, "left")

    def whole(name: str, column: str) -> Column:
        here, earlier = F.col(column), F.col(f"__carried_{name}")
        if name in last:
            return F.coalesce(here, earlier)
        if name in most:
            return F.greatest(here, earlier)
        zero = F.lit(0)
        return F.coalesce(here, zero) + F.coalesce(earlier, zero)

    results = [whole(n, c).alias(c) for n in values for c in (n, f"{n}_before")]
    return joined.select(*rows.columns, *results)
