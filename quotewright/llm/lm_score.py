"""Cross-entropy difference (Moore and Lewis, 2010) under bigram models.

Two models of one order, one vocabulary and one smoothing are counted, on target documents and on the
background, all others. A document's score is the mean over its words of the target's loss minus the
background's: the lower, the more it reads like the target.

Words are lower-cased runs of letters, digits and underscores. The vocabulary is every word of the
corpus, unless the caller asks for the most frequent ones; then every other word is one unknown word.

Nothing of the vocabulary's size reaches the driver or a task. The corpus is stored as blocks of coded
documents. A block sends each of its distinct n-grams once, however often it has it, to the bucket of the
n-gram's hash; buckets add the counts of all blocks and send the sums back. So frequent n-grams cost a
bucket one row a block, and both blocks and buckets grow in number, not in size. N-grams are told apart
by 64 bits: of 10^9 distinct ones, 0.03 pairs are expected to be counted as one.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotewright.llm.store import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PRIOR = 50.0  # how many words the unigram model counts for against a bigram context
MOST_COUNTED = 200_000  # distinct words counted in a task before it passes them on
BLOCK = 1 << 20  # words and documents after which a block ends
BUCKET = 1 << 21  # words of the corpus for which there is a bucket
LEAST_BUCKETS = 64
WORD = re.compile(r"\w+")
BEGIN, UNKNOWN = " begin", " unknown"  # no words
BLOCKS = "block long, ids array<long>, lengths array<long>, target array<boolean>, words binary, hashes binary"


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def passed_on() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(words(text.as_py()))
            if len(counts) > MOST_COUNTED:
                yield passed_on()
                counts.clear()
    yield passed_on()


def vocabulary(docs: DataFrame, text_col: str, size: int) -> list[str]:
    """The ``size`` most frequent words of the corpus; ties go to the smaller word."""
    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(_count_words, "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(size)
    return [r["word"] for r in top.collect()]


def _packed(numbers: np.ndarray) -> bytes:
    """The numbers' first bytes, their second bytes and so on, as the high ones are mostly zero; compressed."""
    planes = numbers.view(np.uint8).reshape(numbers.size, numbers.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    planes = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, len(planes) // width).T).view(kind).ravel()


def _encode(known: list[str] | None, block: int):
    """(id, text, target) -> blocks of documents, their words as numbers of the block's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        first, n, kept = TaskContext.get().partitionId() << 32, 0, known and frozenset(known)

        def ended() -> pa.RecordBatch:
            hashes = np.array([xxh64_intdigest(w) for w in numbers] + [xxh64_intdigest(BEGIN)], np.uint64)
            columns = [first + n, ids, lengths, target, _packed(np.concatenate(coded)), hashes.tobytes()]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([c], k) for c, k in zip(columns, kinds)], ["block", "ids", "lengths", "target", "words", "hashes"])

        def empty():
            return [], [], [], [], defaultdict(count().__next__), 0

        ids, lengths, target, coded, numbers, total = empty()
        for batch in batches:
            for i, text, good in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                said = words(text.as_py())
                if known is not None:
                    said = [w if w in kept else UNKNOWN for w in said]
                ids.append(i)
                lengths.append(len(said))
                target.append(good)
                coded.append(np.fromiter(map(numbers.__getitem__, said), np.uint32, len(said)))
                total += len(said) + 1
                if total >= block:
                    yield ended()
                    ids, lengths, target, coded, numbers, total = empty()
                    n += 1
        if ids:
            yield ended()

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """The n-grams of a block: its pairs of neighbouring words, its words, and the words before others.

    A text begins after the word ``BEGIN``.
    """

    def __init__(self, lengths: np.ndarray, packed: bytes, hashes: bytes):
        hashed = np.frombuffer(hashes, np.uint64)
        self.width, self.lengths = len(hashed), lengths
        self.ids = _unpacked(packed, np.uint32).astype(np.int64)
        self.before = np.concatenate([[0], self.ids])[:-1]
        starts = np.cumsum(lengths) - lengths
        self.before[starts[lengths > 0]] = self.width - 1
        pairs, self.pair = np.unique(self.before * self.width + self.ids, return_inverse=True)
        self.n_pairs = len(pairs)
        self.keys = np.concatenate([
            _mixed(_mixed(hashed[pairs // self.width] + np.uint64(1)) ^ hashed[pairs % self.width]),
            _mixed(hashed + np.uint64(2)), _mixed(hashed + np.uint64(3))])
        self.order = np.argsort(self.keys)

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often the chosen texts have each n-gram."""
        some = np.repeat(chosen, self.lengths)
        return np.concatenate([
            np.bincount(self.pair[some], minlength=self.n_pairs),
            np.bincount(self.ids[some], minlength=self.width), np.bincount(self.before[some], minlength=self.width)])

    def losses(self, sums: np.ndarray, n_words: int, types: int, prior: float = PRIOR) -> np.ndarray:
        """-ln p(word | word before) of every word, from the corpus's counts of the block's n-grams.

        The bigram model backs off to the unigrams, with ``prior`` pseudo-counts, and these to one
        pseudo-count for each of ``types`` words.
        """
        pairs, words_, befores = np.split(sums.astype(np.float64), [self.n_pairs, self.n_pairs + self.width])
        share = (words_ + 1) / (n_words + types)
        return -np.log((pairs[self.pair] + prior * share[self.ids]) / (befores[self.before] + prior))


def _blocks(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[dict, Block]]:
    rows = rows.select(["block", "lengths", "target", "words", "hashes"])
    for i in range(rows.num_rows):
        row, = rows.slice(i, 1).to_pylist()
        yield row, Block(np.array(row["lengths"], np.int64), row["words"], row["hashes"])


def _send(buckets: int):
    """Blocks -> (bucket, block, distinct n-grams with their counts in target and background)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block in _blocks(batch):
                target = np.array(row["target"], bool)
                keys, counts = block.keys[block.order], [block.counts(x)[block.order] for x in (target, ~target)]
                bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                some, starts = np.unique(bucket, return_index=True)
                parts = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(keys)])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(some.astype(np.int64)), pa.array([row["block"]] * len(some), pa.int64()),
                    pa.array([_packed(np.concatenate([np.diff(keys[p], prepend=np.uint64(0)).view(np.int64), *(c[p] for c in counts)]))
                              for p in parts], pa.binary()),
                ], ["bucket", "block", "counts"])

    return run


def _add(rows: pa.Table) -> pa.Table:
    """One bucket's counts -> for each block the corpus's counts of the same n-grams, in the same order."""
    sent = [_unpacked(c, np.int64).reshape(3, -1) for c in rows.column("counts").to_pylist()]
    keys = np.concatenate([np.cumsum(x[0].view(np.uint64), dtype=np.uint64) for x in sent])
    each, ends = np.unique(keys, return_inverse=True)[1], np.cumsum([x.shape[1] for x in sent])[:-1]
    sums = np.stack([
        np.bincount(each, np.concatenate([x[i] for x in sent])).astype(np.int64)[each] for i in (1, 2)])
    parts = pa.array([_packed(np.ascontiguousarray(x).ravel()) for x in np.split(sums, ends, axis=1)], pa.binary())
    return pa.table([rows.column("bucket"), rows.column("block"), parts], ["bucket", "block", "counts"])


def _score(types: int, n_words: tuple[int, int]):
    def run(blocks: pa.Table, sums: pa.Table) -> pa.Table:
        (_, block), = _blocks(blocks)
        sums = np.concatenate([
            _unpacked(c, np.int64).reshape(2, -1) for c in sums.sort_by("bucket").column("counts").to_pylist()], axis=1)
        doc, n, means = np.repeat(np.arange(len(block.lengths)), block.lengths), block.lengths, []
        for added, of in zip(sums, n_words):
            counts = np.empty(len(block.keys), np.int64)
            counts[block.order] = added
            total = np.bincount(doc, block.losses(counts, of, types), len(n))
            means.append(pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0))
        ids = blocks.column("ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(n, pa.int64()), *means], ["_id", "n_words", "target_loss", "background_loss"])

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for hashes in batch.column(0).to_pylist():  # without BEGIN
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashes, np.int64)[:-1])], ["hash"])


def score(docs: DataFrame, target_col: str, id_col: str = "doc_id", text_col: str = "text", size: int | None = None,
          block: int = BLOCK) -> DataFrame:
    """id, n_words, target_loss, background_loss and their difference ``score`` of every row.

    ``target_col`` says which rows are the target; NULL counts as background. A text without words has
    NULL losses. Either corpus may be empty: its model is then uniform. Ids may be NULL or repeat.
    The texts are read once, and once more to find the ``size`` most frequent words if it is given.
    """
    known = None if size is None else vocabulary(docs, text_col, size)
    blocks = stored(
        docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.coalesce(F.col(target_col), F.lit(False)))
        .mapInArrow(_encode(known, block), BLOCKS), "lm_blocks")
    said = F.transform(F.arrays_zip("lengths", "target"), lambda d: F.when(d["target"], d["lengths"]).otherwise(0))
    whole, target = (F.coalesce(F.sum(F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)), F.lit(0)) for x in (F.col("lengths"), said))
    n_words, n_target = blocks.agg(whole, target).first()
    distinct = len(known) if known is not None else blocks.select("hashes").mapInArrow(_hashes, "hash long").distinct().count()
    sent = blocks.mapInArrow(
        _send(max(LEAST_BUCKETS, -(-n_words // BUCKET))), "bucket long, block long, counts binary")
    sums = sent.groupBy("bucket").applyInArrow(_add, "bucket long, block long, counts binary")
    scored = blocks.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(
        _score(distinct + 2, (n_target, n_words - n_target)),
        "_id long, n_words long, target_loss double, background_loss double")
    return scored.withColumnRenamed("_id", id_col).withColumn("score", F.col("target_loss") - F.col("background_loss"))
