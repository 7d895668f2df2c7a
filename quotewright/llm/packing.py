"""Packing of tokenised documents into sequences by best-two-fit.

What fits together depends on lengths only, and there are at most ``capacity`` of them. So the
packing is planned on the number of pieces per length: a bin is filled greedily with the longest
piece that fits; then its smallest piece is replaced by two unpacked ones, if these fill the
gap it leaves more tightly. A filling is repeated while its pieces last, so the plan has a bounded
number of steps at any number of pieces. Spark counts the lengths, ranks the pieces of each
length in parallel, and looks the place of each rank up in the plan.
"""

from __future__ import annotations

import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

import quotewright.llm.tokens
from quotewright.llm.store import per_worker
from quotewright.llm.text import unused
from quotewright.llm.tokens import PartTokenizer

for _module in (__name__, quotewright.llm.tokens.__name__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])

CAPACITY = 1024
END_ID = 2
PLAN = "length int, runs array<struct<first:long,last:long,sequence:long,offsets:array<int>>>"


def _pieces(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = per_worker(("parts", path), lambda: PartTokenizer(path))
        end = np.array([end_id], "<u4").tobytes()
        columns = ("_id", "piece", "start", "length", "ids")
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokenizer.encode(text.as_py() or "") + end
                n = len(ids) // 4
                starts = [0, *range(n % capacity or capacity, n, capacity), n]
                rows += ((doc_id, i, a, b - a, ids[4 * a:4 * b]) for i, (a, b) in enumerate(zip(starts, starts[1:])))
                size += len(ids)
                if size > 1 << 22:
                    yield _batch(rows, columns)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, columns)

    return cut


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """id, piece, start, length, ids (unsigned 32-bit, little-endian) of every row of ``docs``.

    A document is its ids and ``end_id``; a NULL text is empty and has that one id. A document
    longer than ``capacity`` is cut into full pieces, but for the first. Other columns are ignored.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        _pieces(tokenizer, capacity, end_id), "_id long, piece int, start long, length int, ids binary",
    ).withColumnRenamed("_id", id_col)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-two-fit on the number of pieces per length: [(lengths of a bin, number of such bins)]."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = np.arange(capacity + 1)
    bins = []
    while left.any():
        now = left.copy()
        filling: list[int] = []
        gap = capacity

        def largest(most: int) -> int:
            fits = np.flatnonzero(now[:most + 1])
            return int(fits[-1]) if len(fits) else 0

        while gap and (n := largest(gap)):
            times = min(gap // n, int(now[n]))
            filling += [n] * times
            now[n] -= times
            gap -= n * times
        while gap and len(filling) > 1:
            smallest = filling[-1]
            room = gap + smallest
            # The best partner of every length a: the largest b that is left, with a + b <= room.
            below = np.maximum.accumulate(np.where(now > 0, lengths, 0))
            a = np.flatnonzero(now[:room])
            b = below[room - a]
            b = np.where((b == a) & (now[a] < 2), below[np.maximum(a - 1, 0)], b)
            sums = np.where(b > 0, a + b, 0)
            if not len(sums) or sums.max() <= smallest:
                break
            best = int(sums.argmax())
            pair = sorted((int(a[best]), int(b[best])), reverse=True)
            filling[-1:] = pair
            now[pair[0]] -= 1
            now[pair[1]] -= 1
            now[smallest] += 1
            filling.sort(reverse=True)
            gap = capacity - sum(filling)
        used = Counter(filling)
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
        bins.append((tuple(filling), times))
    return bins


def _plan_rows(bins: list[tuple[tuple[int, ...], int]]) -> list[tuple]:
    """For every length its runs of ranks: the rank r of a run is in the bin
    ``sequence + (r - first) div size(offsets)``, at ``offsets[(r - first) mod size(offsets)]``."""
    runs = defaultdict(list)
    taken: Counter = Counter()
    sequence = 0
    for filling, times in bins:
        offsets = defaultdict(list)
        at = 0
        for n in filling:
            offsets[n].append(at)
            at += n
        for n, places in offsets.items():
            first = taken[n]
            taken[n] += len(places) * times
            runs[n].append((first, taken[n], sequence, places))
        sequence += times
    return list(runs.items())


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every sequence is gapless from 0.

    ``pieces`` needs ``length`` (1 to ``capacity``); it is read three times, so store it if it is costly.
    Equal rows are packed as often as they occur. A NULL or impossible length raises an error. Columns
    named sequence_id or offset are replaced; all others stay, whatever their names. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().limit(capacity + 2).collect()}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    plan = spark.createDataFrame(_plan_rows(plan_bins(counts, capacity)), PLAN)
    columns = pieces.columns
    salt, n, before_, own_, rank, run_, k, runs = unused(
        pieces, "_salt", "_n", "_before", "_own", "_rank", "_run", "_k", "runs")
    plan = plan.withColumnRenamed("runs", runs)
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    shares = salted.groupBy("length", salt).agg(F.count(F.lit(1)).alias(n)).select(
        "length", salt, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(before_))
    own = F.row_number().over(Window.partitionBy("length", salt).orderBy(*columns)) - 1
    run = F.filter(runs, lambda r: (r["first"] <= F.col(rank)) & (F.col(rank) < r["last"]))[0]
    ranked = (
        salted.withColumn(own_, own).join(shares, ["length", salt])
        .withColumn(rank, F.col(own_) + F.col(before_))
        .join(F.broadcast(plan), "length")  # at most one row per length
        .withColumn(run_, run)
        .withColumn(k, F.col(rank) - F.col(f"{run_}.first"))
    )
    size = F.size(f"{run_}.offsets")
    return ranked.select(
        *columns,
        (F.col(f"{run_}.sequence") + F.floor(F.col(k) / size)).cast("long").alias("sequence_id"),
        F.get(f"{run_}.offsets", (F.col(k) % size).cast("int")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences, at most ``capacity`` ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
