"""Near duplicates by SimHash fingerprints, joined on a grid of segment popcounts.

A fingerprint of 64 bits is mapped to the bit counts of its 32 segments of two bits, which sit in
place in a 64-bit number. The Manhattan distance of two such points is never above the number of
differing bits. The 32 dimensions form two halves; points at most three apart are at most one apart
in one half. So each fingerprint goes to its cell of either half and looks into that cell and the
cells one step up, 34 rows in all; the joined pairs are verified by their differing bits. Equal
fingerprints are joined as one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotewright.llm.components import smallest_reachable
from quotewright.llm.store import stored
from quotewright.llm.text import unused

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
MOST_BITS = 3  # two halves at most one apart each: the grid is built for this distance
HALF = (1 << 32) - 1
ODD_BITS = 0x55555555
SHINGLES_AT_ONCE = 1 << 15


def fingerprint(text: str, words: int = 3) -> int:
    """The SimHash of the shingles of ``words`` lower-cased (A-Z) words, as a signed 64-bit number.

    Shingles count as often as they occur. A text with fewer words is one shingle, a text without
    words has fingerprint 0.
    """
    from xxhash import xxh64_intdigest

    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = iter([b" ".join(tokens)])
        total = 1
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words))))
        total = len(tokens) - words + 1
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, total, SHINGLES_AT_ONCE):
        n = min(SHINGLES_AT_ONCE, total - start)
        hashes = np.fromiter((xxh64_intdigest(s, SEED) for s, _ in zip(shingles, range(n))), dtype=">u8", count=n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total).view(">i8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py() or "", words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["_id", "_print"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(_id, _print) of every row; a NULL text counts as empty."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        _fingerprints(words), "_id long, _print long")


def near_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): the pairs of different numbers of ``prints`` (one column) at most three bits apart.

    A pair found in both halves comes twice.
    """
    values = prints.toDF("_print").distinct()
    half = F.posexplode(F.array(
        F.col("_print").bitwiseAND(F.lit(HALF)), F.shiftrightunsigned("_print", 32))).alias("half", "bits")
    twos = F.col("bits").bitwiseAND(F.lit(ODD_BITS)) + F.shiftright("bits", 1).bitwiseAND(F.lit(ODD_BITS))
    halves = values.select("_print", half).select("_print", "half", twos.alias("cell"))
    up = F.expr("""
        concat(array(cell), transform(
            filter(sequence(0, 30, 2), i -> (shiftright(cell, i) & 3) < 2),
            i -> cell + shiftleft(1L, i)))""")
    home = halves.select(F.col("_print").alias("a"), "half", "cell")
    look = halves.select(
        F.col("_print").alias("b"), "half", F.col("cell").alias("own"), F.explode(up).alias("cell"))
    found = (home["half"] == look["half"]) & (home["cell"] == look["cell"])
    once = (look["own"] != look["cell"]) | (home["a"] < look["b"])
    near = F.bit_count(home["a"].bitwiseXOR(look["b"])) <= MOST_BITS
    return home.join(look, found & once & near).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hexadecimal digits), component_id.

    Fingerprints at most three bits apart are linked; component_id is the smallest id that can be
    reached over links. Equal fingerprints always share a component, also those of empty texts.
    A NULL id gets the component of its fingerprint, NULL if no id is known there. Repeated rows are
    repeated in the result. Other columns are ignored; an empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    first = rows.groupBy("_print").agg(F.min("_id").alias("_first")).where("_first IS NOT NULL")
    first = stored(first, "classes")
    pairs = near_pairs(first.select("_print"))
    links = (
        pairs.join(first.toDF("a", "u"), "a").join(first.toDF("b", "v"), "b").select("u", "v")
    )
    component = smallest_reachable(links)
    classes = first.join(component, F.col("_first") == F.col("node"), "left").select(
        "_print", F.coalesce("component", "_first").alias("component_id"))
    return rows.join(classes, "_print", "left").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of their component.

    A repeated id is one document, which stays if one of its rows does. Rows without id stay. All
    columns stay, whatever their names.
    """
    own, = unused(docs, "_dropped")
    found = near_duplicates(docs.select(id_col, text_col), id_col, text_col, words).where(F.col(id_col).isNotNull())
    dropped = found.groupBy(F.col(id_col).alias(own)).agg(
        F.bool_and(F.col(id_col) != F.col("component_id")).alias("_all")).where("_all")
    return docs.join(dropped, F.col(id_col) == F.col(own), "left_anti")
