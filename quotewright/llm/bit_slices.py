"""Exact top-k by inner product on a bit-sliced index.

The rows are dealt into blocks. In a block every attribute is stored as slices: bitmap number b holds
bit b of the attribute, less its minimum in the block, of all rows. A query's scores are then added up
for all rows of a block at once, with bitmap arithmetic: for each bit of the query's components, from the
most significant down, the sum so far is doubled and the attributes with that bit are added by
carry-save adders. Attributes are taken in groups of four, whose 16 possible sums are computed
once a block. Scanning the slices of the total downward leaves the rows surely among the best, and
those that tie at the boundary, of which the smallest ids are taken.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotewright.llm.store import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 8192
BLOCK_QUERIES = 512
LARGEST = float(1 << 62)
GROUP = 4
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slices(values: np.ndarray, width: int, words: int) -> np.ndarray:
    """``values`` (rows, columns), not negative, as bitmaps (columns, width, words)."""
    out = np.zeros((values.shape[1], width, words * 8), np.uint8)
    for bit in range(width):
        packed = np.packbits((values >> bit & 1).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, bit, :packed.shape[1]] = packed
    return out.view("<u8")


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ripple-carry sum of two sliced numbers of equal width, one slice wider."""
    out = np.empty((len(a) + 1, a.shape[1]), a.dtype)
    carry = np.zeros(a.shape[1], a.dtype)
    for i, (x, y) in enumerate(zip(a, b)):
        half = x ^ y
        out[i] = half ^ carry
        carry = (x & y) | (half & carry)
    out[-1] = carry
    return out


class Block:
    """A block of the index, ready to be searched."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, slices: np.ndarray):
        self.ids, self.least, self.slices = ids, least, slices
        columns, width, words = slices.shape
        self.columns, self.width, self.words = columns, width + 2, words
        self.groups = []
        for first in range(0, columns, GROUP):
            sums = [np.zeros((width + 2, words), slices.dtype)]
            for column in slices[first:first + GROUP]:
                wide = np.zeros((width + 2, words), slices.dtype)
                wide[:width] = column
                sums += [_sum(s, wide)[:-1] for s in sums]  # four numbers below 2^width fit
            self.groups.append(sums)
        rows = np.zeros(words * 64, np.uint8)
        rows[:len(ids)] = 1
        self.rows = np.packbits(rows, bitorder="little").view("<u8")

    def best(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (id, score) of the block but for rows with the query's own id, exactly."""
        query = query[:self.columns]
        bits = int(max(1, np.abs(query).max(initial=0))).bit_length() + 1
        depth = bits + self.width + int(max(1, len(query))).bit_length() + 1
        total = self._scores(query, bits, depth)
        # Two's complement: with the sign turned over, slices compare as unsigned numbers.
        total[-1] ^= ONES
        sure = np.zeros(self.words, "<u8")
        open_ = self.rows.copy()
        for own in np.flatnonzero(self.ids == query_id):
            open_[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        for i in range(depth - 1, -1, -1):
            ones = open_ & total[i]
            union = sure | ones
            n = int(np.bitwise_count(union).sum())
            if n > k:
                open_ = ones
            else:
                sure, open_ = union, open_ & ~total[i]
                if n == k:
                    break
        found = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if len(found) < k:  # rows that tie; the rows of a block are sorted by id
            ties = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))
            found = np.concatenate([found, ties[:k - len(found)]])
        total[-1] ^= ONES
        digits = total[:, found >> 6] >> (found & 63).astype(np.uint64) & np.uint64(1)
        weights = [1 << i for i in range(depth - 1)] + [-(1 << depth - 1)]
        base = sum(q * low for q, low in zip(query.tolist(), self.least.tolist()))  # of any size
        return [(int(self.ids[r]), base + sum(w for w, d in zip(weights, column) if d))
                for r, column in zip(found, digits.T)]

    def _scores(self, query: np.ndarray, bits: int, depth: int) -> np.ndarray:
        """The sliced inner products, modulo 2^depth, of the block's rows with ``query``."""
        shape = depth, self.words
        s, c = np.zeros(shape, "<u8"), np.zeros(shape, "<u8")
        low = self.width
        half, both = np.empty(shape, "<u8"), np.empty(shape, "<u8")
        masks = np.zeros((bits, len(self.groups)), np.int64)
        for j, value in enumerate(query.tolist()):
            for bit in range(bits):
                masks[bit, j // GROUP] |= (value >> bit & 1) << j % GROUP
        two = np.zeros((low, self.words), "<u8")
        two[1] = ONES

        def add(number: np.ndarray) -> None:
            """One carry-save addition of a number of ``low`` slices."""
            nonlocal s, c, half, both
            np.bitwise_xor(s, c, out=half)
            np.bitwise_and(s, c, out=both)
            both[:low] |= half[:low] & number
            half[:low] ^= number
            c[0] = 0
            c[1:] = both[:-1]
            s, half = half, s

        for bit in range(bits - 1, -1, -1):
            if bit < bits - 1:
                s[1:], c[1:] = s[:-1].copy(), c[:-1].copy()
                s[0] = c[0] = 0
            for sums, mask in zip(self.groups, masks[bit].tolist()):
                if mask:
                    add(sums[mask])
            if bit == bits - 1:  # the sign bit weighs negative: -(s + c) = ~s + ~c + 2
                np.bitwise_not(s, out=s)
                np.bitwise_not(c, out=c)
                add(two)
        return _sum(s, c)[:depth]


def _matrix(vectors: pa.Array) -> np.ndarray:
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), max(1, int(lengths.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy()
    return out


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition becomes one block, numbered by the partition."""
    from pyspark import TaskContext

    rows = [b for b in batches if b.num_rows]
    if rows:
        table = pa.Table.from_batches(rows)
        ids = table.column(0).combine_chunks().to_numpy()
        values = _matrix(table.column(1).combine_chunks())
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        least = values.min(axis=0)
        values = values - least
        width = max(1, int(values.max()).bit_length())
        slices = _slices(values, width, -(-len(ids) // 64))
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([TaskContext.get().partitionId()], pa.int32()), "ids": [ids.astype("<i8").tobytes()],
            "least": [least.astype("<i8").tobytes()], "width": pa.array([width], pa.int32()), "slices": [slices.tobytes()]})


INDEX = "block int, ids binary, least binary, width int, slices binary"


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """The stored index of all rows of ``vectors`` (id long, values array<long>), and its block number bound.

    Rows are dealt round robin into blocks of about ``block_rows``, so repeated ids or vectors do no harm.
    """
    blocks = max(1, -(-vectors.count() // block_rows))
    return stored(vectors.repartition(blocks).mapInArrow(_pack_rows, INDEX), "slices"), blocks


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK_QUERIES):
            some = batch.slice(i, BLOCK_QUERIES)
            values = _matrix(pa.concat_arrays([some.column(1)]))
            yield pa.RecordBatch.from_pydict({
                "query_ids": [some.column(0).to_numpy().astype("<i8").tobytes()],
                "columns": pa.array([values.shape[1]], pa.int32()), "queries": [values.astype("<i8").tobytes()]})


def _long(score: int, query_id: int, vec_id: int) -> int:
    if not -(1 << 63) <= score < 1 << 63:
        raise ValueError(f"the score of vector {vec_id} for query {query_id} does not fit 64 bits: {score}")
    return score


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != at:
                    ids = np.frombuffer(row["ids"], "<i8")
                    least = np.frombuffer(row["least"], "<i8")
                    slices = np.frombuffer(row["slices"], "<u8").reshape(len(least), row["width"], -1)
                    at, block = row["block"], Block(ids, least, slices)
                query_ids = np.frombuffer(row["query_ids"], "<i8")
                queries = np.frombuffer(row["queries"], "<i8").reshape(-1, row["columns"])
                found = [(q, i, _long(score, q, i)) for q, v in zip(query_ids.tolist(), queries) for i, score in block.best(q, v, k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], []))],
                    ["query_id", "vec_id", "score"])

    return run


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """id and floor(scale * component) of the vectors that have only finite components.

    NULL vectors, NULL ids and vectors with NULL, NaN or infinite components are left out. Components
    must stay below 2^62 / scale in size; a larger one raises an error that names the row.
    """
    def number(x: Column) -> Column:
        scaled = x.cast("double") * scale
        message = F.concat(F.lit("vector "), F.col("id").cast("string"), F.lit(": a component is too large"))
        return F.when(F.abs(scaled) < LARGEST, F.floor(scaled)).otherwise(F.raise_error(message))

    values = F.transform(F.col(vector_col), number)
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col))
    return rows.where(F.col("id").isNotNull() & finite).select("id", values.alias("values"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of ``vectors`` with the largest inner product.

    Both tables have id (long) and values (array<long>). Ties go to the smaller id; rows with the query's
    own id are no candidates. Where lengths differ the missing components count as 0. Repeated rows
    are candidates each; a repeated query id is answered once, for the smallest of its vectors. Scores are exact; one
    beyond 64 bits raises an error that names both rows. Empty tables give an empty result.
    """
    index, blocks = build_index(vectors, block_rows)
    asked = queries.groupBy("id").agg(F.min("values").alias("values")).mapInArrow(_pack_queries, "query_ids binary, columns int, queries binary")
    dealt = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Blocks are few bytes and much work: Spark is told how many tasks there are to be.
    pairs = index.repartition(blocks, "block").join(dealt.repartition(blocks, "block"), "block")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
