"""Secret scans through an inverted index of trigrams.

From every rule's regular expression a Boolean query over trigrams is derived: an OR of ANDs that
any match must satisfy. The index has a posting (trigram, id) for each trigram of these queries;
postings are intersected per document, and the expression itself runs on the candidates only.
A rule without mandatory trigrams runs on every text. Trigrams are taken from text with A-Z in
lower case, so the index serves rules of either kind.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.llm.text import ascii_lower, unused, whole

MOST_STRINGS = 64  # alternatives that are spelled out; beyond that a part counts as "anything"
MASK = "[secret]"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# Runs of one class are maximal, so {12,} and {32,} find what + and a later test of length would.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)


def _product(left: set[str] | None, right: set[str] | None) -> set[str] | None:
    if left is None or right is None or len(left) * len(right) > MOST_STRINGS:
        return None
    return {a + b for a in left for b in right}


def _strings(node) -> set[str] | None:
    """All strings that one parsed item can match, or None if they are not few."""
    op, value = str(node[0]), node[1]
    if op == "LITERAL":
        return {chr(value)}
    if op == "IN":
        items = [x for x in value if str(x[0]) == "LITERAL"]
        return {chr(x[1]) for x in items} if len(items) == len(value) else None
    if op == "BRANCH":
        parts = [reduce(_product, map(_strings, x), {""}) for x in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op == "SUBPATTERN":
        return reduce(_product, map(_strings, value[3]), {""})
    if op == "MAX_REPEAT" and value[1] != regex_parser.MAXREPEAT and value[1] <= 4:
        once = reduce(_product, map(_strings, value[2]), {""})
        powers = [reduce(_product, [once] * n, {""}) for n in range(value[0], value[1] + 1)]
        return None if any(p is None for p in powers) else set().union(*powers)
    return None


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that every match satisfies; empty: no restriction.

    Runs of parts with few strings are spelled out; each run gives one OR of ANDs, and the most
    selective run (fewest, longest conjunctions) is used.
    """
    runs, now = [], {""}
    for node in regex_parser.parse(pattern):
        grown = _product(now, _strings(node))
        if grown is None:
            runs.append(now)
            now = _strings(node) or {""}
        else:
            now = grown
    queries = []
    for strings in [*runs, now]:
        low = {re.sub("[A-Z]", lambda m: m[0].lower(), s) for s in strings}
        ands = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in low}
        if frozenset() not in ands:
            queries.append([a for a in ands if not any(b < a for b in ands)])
    best = min(queries, key=lambda q: (-min(map(len, q)), len(q)), default=[])
    return sorted(best, key=sorted)


def trigram_postings(docs: DataFrame, trigrams: list[str], id_col: str, text_col: str) -> DataFrame:
    """The index: (trigram, id) for each of ``trigrams`` that a document holds."""
    low = docs.select(F.col(id_col).alias("_id"), ascii_lower(whole(F.col(text_col))).alias("_low"))
    found = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("_id", F.explode(found).alias("trigram"))


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(id, kinds): the rules whose trigram query the postings of a document satisfy."""
    def holds(query: list[frozenset[str]]) -> Column:
        return reduce(Column.__or__, [
            reduce(Column.__and__, [F.array_contains("_found", t) for t in sorted(a)]) for a in query])

    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]))
    return (
        postings.groupBy("_id").agg(F.collect_set("trigram").alias("_found"))
        .select("_id", kinds.alias("_kinds")).where(F.size("_kinds") > 0)
    )


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Leftmost matches that do not overlap, as array<struct<start, rank, kind, end>>.

    What lies between the matches gives their places; code points, end exclusive.
    """
    between = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    matched = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.char_length)
    counted = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.char_length)
    steps = F.filter(F.arrays_zip(between.alias("gap"), matched.alias("size"), counted.alias("part")),
                     lambda x: x["size"].isNotNull())
    kind = "array<struct<start:int,rank:int,kind:string,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        spans = F.when(x["part"] >= rule.least, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.when(F.rlike(text, F.lit(rule.pattern)), F.aggregate(steps, zero, step, lambda s: s["spans"]))


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every row of ``docs`` with ``spans``: array<struct<start, rank, kind, end>>, sorted.

    NULL texts have no spans. Ids may be NULL or repeat: the index then yields the candidates of all
    rows with the id, and each is verified on its own text. Input columns named ``spans`` are replaced;
    all others stay, whatever their names.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    rows = docs.drop("spans")
    own_id, own_kinds = unused(rows, "_id", "_kinds")
    if indexed:
        trigrams = sorted({t for q in indexed.values() for a in q for t in a})
        found = candidates(trigram_postings(docs, trigrams, id_col, text_col), indexed)
        found = found.select(F.col("_id").alias(own_id), F.col("_kinds").alias(own_kinds))
        rows = rows.join(found, F.col(id_col).eqNullSafe(F.col(own_id)), "left").drop(own_id)
    text = F.col(text_col)
    parts = []
    for rank, rule in enumerate(rules):
        spans = _spans(text, rule, rank)
        if rule.kind in indexed:
            spans = F.when(F.array_contains(own_kinds, rule.kind), spans)
        parts.append(F.coalesce(spans, F.array()))
    return rows.withColumn("spans", F.sort_array(F.concat(*parts))).drop(own_kinds)


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                 text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every secret replaced; spans that overlap or touch become one mask.

    NULL texts stay NULL. All columns stay, whatever their names.
    """
    own, = unused(docs, "_spans")
    clashing = [c for c in docs.columns if c.lower() == "spans"]
    found = find_secrets(docs.withColumnsRenamed({c: own for c in clashing}), rules, id_col, text_col)
    text = F.col(text_col)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        clear = F.when((s["start"] > state["at"]) | (state["out"] == ""), F.concat(
            F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mask))).otherwise("")
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], clear).alias("out"))

    masked = F.aggregate("spans", zero, step, lambda s: F.concat(
        s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
    return found.withColumn(text_col, F.when(F.size("spans") > 0, masked).otherwise(text)).drop("spans").withColumnsRenamed(
        {own: c for c in clashing}).select(*docs.columns)
