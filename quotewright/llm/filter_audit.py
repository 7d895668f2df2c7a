"""What each filter of a chain removes, in every order of the filters.

One relation of failing ids is stored per filter. Whether a filter removes a document depends only on
which filters came before, not on their order, so instead of all orders the sets of earlier filters
(prefixes) are walked. ``removals`` starts with each filter's own relation and the empty prefix; a round
per filter ``g`` adds, by a left-anti join with the relation of ``g``, the failures that are left once
``g`` came before as well. The left-semi join of the same round gives what ``g`` made redundant.
Documents that pass every filter take no part; a failing one has at most 16 rows for five filters.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.llm.heavy import look_up
from quotewright.llm.store import stored
from quotewright.llm.text import let, whole, words
from quotewright.session import shared_dir

# The filters' limits.
FEW_WORDS = 50
DISTINCT_PERCENT = 65
CAPITALS_PERCENT = 5
SYMBOLS = "[#$%&*|]"
REPEATS = "E"


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides; ``text`` is not NULL."""
    def by_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"))

    counts = let(words(text), by_words)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {
        "A": counts["n"] < FEW_WORDS,
        "B": counts["distinct"].cast("long") * 100 < counts["n"].cast("long") * DISTINCT_PERCENT,
        "C": capitals * 100 > F.char_length(text).cast("long") * CAPITALS_PERCENT,
        "D": F.rlike(text, F.lit(SYMBOLS)),
    }


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One stored narrow row per document: row, id, part, the filters it fails by itself, a digest of its text."""
    base = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        whole(F.col(text_col)).alias("text"))
    failed = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in conditions(F.col("text")).items()]))
    return stored(base.select(
        F.monotonically_increasing_id().alias("row"), "id", "part", failed.alias("failed"),
        F.unhex(F.sha2("text", 256)).alias("digest")), "judged")


def repeating(rows: DataFrame, total: int) -> DataFrame:
    """The rows whose text a row with a smaller id has as well."""
    groups = stored(
        rows.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1"),
        "copies")
    return look_up(rows, groups, "digest", "copies", total).where("id > least").select(*rows.columns)


def failing_ids(rows: DataFrame, labels: DataFrame, total: int, id_col: str = "doc_id") -> DataFrame:
    """The relations of failing ids, stored in one folder per filter: row, part, good, toxic."""
    known = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    alone = rows.select("row", "id", "part", F.explode("failed").alias("filter"))
    copies = repeating(rows, total).select("row", "id", "part", F.lit(REPEATS).alias("filter"))
    fails = alone.unionByName(copies).join(known, "id", "left").select(
        "row", "part", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"), "filter")
    path = shared_dir(rows.sparkSession, "failing-ids")
    fails.write.partitionBy("filter").parquet(path)
    return rows.sparkSession.read.schema(fails.schema).parquet(path)


def removals(fails: DataFrame, filters: str) -> tuple[DataFrame, DataFrame]:
    """What is removed, and what newly becomes redundant, by filter and prefix (a set as bits).

    The first has (row, part, good, toxic, filter, prefix): the filter removes the row if exactly the filters
    of the prefix came before. The second has (part, filter, prefix, by, n): failures that filter ``by``,
    coming right after the prefix, made redundant.
    """
    removed = [fails.select("*", F.lit(0).alias("prefix"))]
    redundant = []
    for i, by in enumerate(filters):
        left = reduce(DataFrame.unionByName, removed).where(F.col("filter") != by)
        own = fails.where(F.col("filter") == by).select("row")
        redundant.append(
            left.join(own, "row", "left_semi").groupBy("part", "filter", "prefix")
            .agg(F.count(F.lit(1)).alias("n")).withColumn("by", F.lit(i)))
        remaining = left.join(own, "row", "left_anti")
        removed.append(stored(remaining.withColumn("prefix", F.col("prefix") + (1 << i)), "removals"))
    return reduce(DataFrame.unionByName, removed), reduce(DataFrame.unionByName, redundant)


def _orders(filters: str) -> Column:
    """All orders and steps as an array of structs; ``before`` is the prefix as bits."""
    steps = []
    for order in permutations(range(len(filters))):
        name = "".join(filters[i] for i in order)
        steps += [(name, step, own, sum(1 << i for i in order[:step - 1])) for step, own in enumerate(order, 1)]
    names, numbers, owns, before = zip(*steps)
    return F.arrays_zip(
        F.lit(list(names)).alias("filter_order"), F.lit(list(numbers)).alias("step"),
        F.lit(list(owns)).alias("own"), F.lit(list(before)).alias("before"))


def audit(docs: DataFrame, labels: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """A row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.

    A NULL text is empty, a NULL source the part with the empty name. Rows count one by one where ids
    repeat; labels of a repeated id count if one of them does. A NULL id never repeats a text
    and has no labels. Other columns are ignored; an empty table gives an empty result.
    """
    rows = judged(docs)
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    fails = failing_ids(rows, labels, rows.count())
    removed, redundant = removals(fails, filters)
    own = sum([F.when(F.col("filter") == f, i).otherwise(0) for i, f in enumerate(filters)], F.lit(0))
    sets = 1 << len(filters)
    # Per part at most 80 and 75 entries, gathered into maps by filter, prefix and filter ``by``.
    removed = removed.groupBy("part", (own * sets + F.col("prefix")).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    ).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("n", "good", "toxic")))).alias("removals"))
    redundant = redundant.select("part", ((own * sets + F.col("prefix")) * len(filters) + F.col("by")).alias("key"), "n").groupBy(
        "part").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("losses"))
    counts = totals.join(removed, "part", "left").join(redundant, "part", "left")
    zero = F.lit(0).cast("long")

    def entry(filter_: Column, prefix: Column, field: str) -> Column:
        return F.coalesce(F.try_element_at("removals", (filter_ * sets + prefix).cast("int"))[field], zero)

    def over(bits: Column, term) -> Column:
        """The sum of a term of (filter, the filters of ``bits`` below it) for each filter of ``bits``."""
        def one(total: Column, g: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1), g)
            return total + F.when(bits.bitwiseAND(bit) != 0, term(g, bits.bitwiseAND(bit - 1))).otherwise(zero)

        return F.aggregate(F.sequence(F.lit(0), F.lit(len(filters) - 1)), zero, one)

    weights = F.lit([factorial(i) * factorial(len(filters) - 1 - i) for i in range(len(filters))])

    def state(key: Column) -> Column:
        """What one filter (key / sets) does after the filters of one prefix (key % sets)."""
        own, before = (key / sets).cast("int"), key % sets
        bit = F.call_function("shiftleft", F.lit(1), own)
        return F.struct(
            (F.col("total") - over(before.bitwiseOR(bit), lambda g, below: entry(g, below, "n"))).alias("kept"),
            entry(own, before, "n").alias("removed"),
            over(before, lambda g, below: F.coalesce(F.try_element_at(
                "losses", ((own * sets + below) * len(filters) + g).cast("int")), zero)).alias("redundant"),
            entry(own, F.lit(sets - 1) - bit, "n").alias("unique_fails"),
            entry(own, before, "good").alias("good_lost"), entry(own, before, "toxic").alias("toxic_lost"))

    def shapley(own: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), own)

        def weighed(total: Column, prefix: Column) -> Column:
            weight = F.element_at(weights, F.bit_count(prefix) + 1).cast("long")
            return total + F.when(prefix.bitwiseAND(bit) == 0, weight * entry(own, prefix, "n")).otherwise(zero)

        return F.aggregate(F.sequence(F.lit(0), F.lit(sets - 1)), zero, weighed)

    states = F.transform(F.sequence(F.lit(0), F.lit(len(filters) * sets - 1)), state)
    shares = F.transform(F.sequence(F.lit(0), F.lit(len(filters) - 1)), shapley)
    steps = counts.select("part", states.alias("states"), shares.alias("shares")).select("*", F.inline(_orders(filters)))
    return steps.select(
        "part", "filter_order", "step", F.get("states", F.col("own") * sets + F.col("before")).alias("state"),
        F.get("shares", "own").alias("shapley")).select("part", "filter_order", "step", "state.*", "shapley")
