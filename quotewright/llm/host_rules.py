"""Quality rules that judge a document by its own text and by its host.

Each rule's failures are counted per host. A host's failure rate is shrunk with a beta prior that is
fitted to all hosts by the method of moments, so that a host of few documents is not judged by chance;
a host is rejected if the shrunken rate of one rule is above a limit, and then its documents go.
Everything is DataFrame expressions; texts are read once and never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.llm.heavy import look_up
from quotewright.llm.store import stored
from quotewright.llm.text import let, whole, words

LEAST_WORDS = 10
REPEAT_PERCENT = 20
SYMBOL_PERCENT = 10
LINE_PERCENT = 30
WINDOW = 5
MOST_FAILING = 0.5  # shrunken rate above which a host is rejected
STRONGEST = 1e12  # weight of the prior, in documents, where hosts differ no more than by chance
RULES = ("few_words", "repeated_words", "symbols", "repeated_lines")


def _neighbours_agree(pairs: Column) -> Column:
    """``at`` of those entries of an array sorted by ``key`` that share the key with a neighbour."""
    n = F.size(pairs)
    same = F.zip_with(F.slice(pairs, 1, n - 1), F.slice(pairs, 2, n - 1), lambda a, b: a["key"] == b["key"])

    def either(same: Column) -> Column:
        no = F.array(F.lit(False))
        return F.zip_with(F.concat(same, no), F.concat(no, same), lambda a, b: a | b)

    flagged = F.zip_with(pairs, let(same, either), lambda p, yes: F.when(yes, p["at"]))
    return F.array_compact(flagged)


def _covered(starts: Column, width: int) -> Column:
    """How many places the windows of ``width`` that begin at the sorted ``starts`` cover."""
    n = F.size(starts)
    steps = F.zip_with(F.slice(starts, 1, n - 1), F.slice(starts, 2, n - 1), lambda a, b: F.least(b - a, F.lit(width)))
    return F.when(n == 0, 0).otherwise(F.aggregate(steps, F.lit(width), lambda total, x: total + x))


def words_in_repeats(found: Column, width: int = WINDOW) -> Column:
    """How many of the words are in a window of ``width`` words that occurs twice or more.

    Windows are compared by hash first; where hashes repeat, by their words. Time grows with
    n log n in the number of words.
    """
    n = F.size(found)
    places = F.sequence(F.lit(0), n - width)

    def hashed(at: Column) -> Column:
        return F.xxhash64(*[F.get(found, at + i) for i in range(width)])

    def spelled(at: Column) -> Column:
        return F.struct(F.array_join(F.slice(found, at + 1, width), " ").alias("key"), at.alias("at"))

    def exact(candidates: Column) -> Column:
        return let(F.array_sort(F.transform(candidates, spelled)), lambda pairs: F.when(
            F.size(pairs) > 0, let(F.array_sort(_neighbours_agree(pairs)), lambda starts: _covered(starts, width))).otherwise(0))

    def by_hash(hashes: Column) -> Column:
        pairs = F.array_sort(F.zip_with(hashes, places, lambda h, at: F.struct(h.alias("key"), at.alias("at"))))
        repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeated, let(let(pairs, _neighbours_agree), exact)).otherwise(0)

    return F.when(n > width, let(F.transform(places, hashed), by_hash)).otherwise(0).cast("long")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, host, the counts, and a flag per rule. A NULL text has no words; a NULL host gets the empty
    name, others begin with ``=``."""
    base = docs.select(
        F.col(id_col).alias("_id"), whole(F.col(text_col)).alias("_text"),
        F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("_host"))
    text = F.col("_text")
    by_words = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        words_in_repeats(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    by_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long")
    counts = base.select("_id", "_host", by_words.alias("_words"), by_lines.alias("_lines"), symbols.alias("n_symbols")).select(
        "_id", "_host", "_words.n_words", "_words.word_chars", "n_symbols", "_lines.n_dup_lines", "_words.n_repeat_words", "_lines.n_lines")
    flags = {
        "few_words": F.col("n_words") < LEAST_WORDS,
        "repeated_words": F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT,
        "symbols": F.col("n_symbols") * 100 > F.col("n_words") * SYMBOL_PERCENT,
        "repeated_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * LINE_PERCENT,
    }
    return counts.withColumns(flags).drop("n_lines").withColumnRenamed("_id", id_col)


def beta_prior(hosts: int, documents: int, failures: int, squares: float, size_squares: float) -> tuple[float, float]:
    """The prior's mean and its weight in documents, by the method of moments.

    ``squares`` is the sum of failures^2 / documents over hosts, ``size_squares`` that of documents^2.
    """
    if not documents:
        return 0.0, STRONGEST
    mean = failures / documents
    spread = squares - failures * mean
    effective = documents - size_squares / documents
    between = (spread - mean * (1 - mean) * (hosts - 1)) / effective if effective > 0 else 0.0
    if between <= 0:
        return mean, STRONGEST
    return mean, min(STRONGEST, max(mean * (1 - mean) / between - 1, 0.0))


def host_rates(rows: DataFrame, rules: tuple[str, ...] = RULES, most: float = MOST_FAILING) -> DataFrame:
    """Per host: documents, failures and the shrunken rate of each rule, and whether the host is rejected.

    ``rows`` has ``_host`` and a flag per rule. The driver gets one row of sums over all hosts.
    """
    hosts = stored(rows.groupBy("_host").agg(
        F.count(F.lit(1)).alias("documents"), *[F.count_if(r).alias(r) for r in rules]), "hosts")
    sums = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("documents").alias("documents"),
        F.sum(F.col("documents").cast("double") * F.col("documents")).alias("size_squares"),
        *[F.sum(r).alias(r) for r in rules],
        *[F.sum(F.col(r).cast("double") * F.col(r) / F.col("documents")).alias(f"{r}_squares") for r in rules]).first()
    rates = {}
    for r in rules:
        mean, weight = beta_prior(sums["hosts"], sums["documents"] or 0, sums[r] or 0, sums[f"{r}_squares"] or 0.0,
                                  sums["size_squares"] or 0.0)
        rates[f"{r}_rate"] = (F.col(r) + mean * weight) / (F.col("documents") + weight)
    # A share of exactly the limit must not be lost to rounding in one of two engines.
    above = F.greatest(*[F.round(rate, 9) for rate in rates.values()], F.lit(-math.inf)) > most
    return hosts.withColumns(rates).withColumn("rejected", above)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          most: float = MOST_FAILING) -> DataFrame:
    """One row per document: id, the counts, a flag per rule, base_failed, kept.

    ``base_failed`` is the document's own failure (too few words, or too many in repeated windows); a
    document is kept unless it failed or its host is rejected. Documents with a NULL host form one host.
    Ids may be NULL or repeat: rows are judged one by one. Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = stored(counted(docs, id_col, text_col, host_col), "rule-failures")
    verdicts = host_rates(rows, most=most).select("_host", "documents", "rejected")
    failed = F.col("few_words") | F.col("repeated_words")
    joined = look_up(rows, verdicts, "_host", "documents", rows.count())
    return joined.withColumns({"base_failed": failed, "kept": ~failed & ~F.col("rejected")}).drop(
        "_host", "documents", "rejected")
