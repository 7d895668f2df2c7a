"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from itertools import permutations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH low AS (SELECT doc_id, {_LOW} AS low FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(low) AS text_sha256
FROM low WINDOW g AS (PARTITION BY low)
"""

CHAT = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -1, n, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)
), near AS (
    SELECT *, lag(role) OVER w AS before,
           regexp_replace(text, '<(\\\\*)[|]', '<\\\\\\1|', 'g') AS escaped
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(escaped) + CASE WHEN before IS NOT DISTINCT FROM role THEN 10
           ELSE length(role) + 12 + 1 + 11 END) AS BIGINT) AS formatted_chars
FROM near GROUP BY conv_id
"""

SECRETS = r"""
WITH rules(rank, kind, least) AS (VALUES (0, 'assign', 8), (1, 'access', 16), (2, 'hex', 32)
), texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (
    SELECT doc_id, rank, kind, least,
           regexp_extract_all(text, CASE rank WHEN 0 THEN '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'
               WHEN 1 THEN 'AKIA[A-Z0-9]+' ELSE '[0-9a-f]{32,}' END) AS found,
           string_split_regex(text, CASE rank WHEN 0 THEN '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'
               WHEN 1 THEN 'AKIA[A-Z0-9]+' ELSE '[0-9a-f]{32,}' END) AS gaps
    FROM texts, rules
), each AS (
    SELECT doc_id, rank, kind, least, found, gaps, unnest(range(1, len(found) + 1)) AS i FROM cut WHERE len(found) > 0
), placed AS (
    SELECT doc_id, rank, kind, found[i] AS match,
           CASE rank WHEN 0 THEN length(regexp_extract(found[i], '(?i)^(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1))
               ELSE length(found[i]) END AS size, least,
           list_sum(list_transform(gaps[1:i], lambda g: length(g)))
               + coalesce(list_sum(list_transform(found[1:i - 1], lambda f: length(f))), 0) AS start
    FROM each
), spans AS (
    SELECT doc_id, rank, kind, CAST(start AS BIGINT) AS start, CAST(start + length(match) AS BIGINT) AS stop
    FROM placed WHERE size >= least
), listed AS (
    SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
           count(*) FILTER (WHERE kind = 'hex') AS n_hex,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans
    FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (doc_id)
"""

TOP_K = """
WITH parts AS (
    SELECT vec_id, i, embedding[i] AS x
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id IS NOT NULL)
), bad AS (SELECT DISTINCT vec_id FROM parts WHERE x IS NULL OR NOT isfinite(x)),
numbers AS (
    SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM parts ANTI JOIN bad USING (vec_id)
), scores AS (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(sum(q.x * v.x) AS BIGINT) AS score
    FROM numbers q JOIN numbers v ON q.i = v.i AND q.vec_id <> v.vec_id
    WHERE q.vec_id % 50 = 0 GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""


_STEPS = ", ".join(
    f"('{''.join(order)}', {i + 1}, {1 << 'ABCDE'.index(f)}, {sum(1 << 'ABCDE'.index(b) for b in order[:i])})"
    for order in permutations("ABCDE") for i, f in enumerate(order))

FILTER_AUDIT = rf"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), judged AS (
    SELECT part, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
           doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic,
           CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
               + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
               + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
               + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
               + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS fails
    FROM texts
), classes AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM judged GROUP BY part, fails
), steps(filter_order, step, own, before) AS (VALUES {_STEPS}),
counted AS (
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
           sum(CASE WHEN fails & (before | own) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN fails & own <> 0 AND fails & before <> 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN fails & own <> 0 AND fails & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM classes, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""


def _shrunken(rule: str) -> str:
    """A host's failure rate drawn towards the mean of all hosts; ``s`` are the sums over hosts."""
    return f"""CASE WHEN {rule}_between <= 0 OR {rule}_between IS NULL
        THEN ({rule} + {rule}_mean * 1e12) / (documents + 1e12)
        ELSE ({rule} + {rule}_mean * least(1e12, greatest({rule}_mean * (1 - {rule}_mean) / {rule}_between - 1, 0)))
            / (documents + least(1e12, greatest({rule}_mean * (1 - {rule}_mean) / {rule}_between - 1, 0))) END"""


_RULES = ("few_words", "repeated_words", "symbols", "repeated_lines")
_MEANS = ", ".join(f"sum({r})::DOUBLE / sum(documents) AS {r}_mean" for r in _RULES)
_BETWEEN = ", ".join(
    f"(sum({r}::DOUBLE * {r} / documents) - sum({r}) * (sum({r})::DOUBLE / sum(documents))"
    f" - sum({r})::DOUBLE / sum(documents) * (1 - sum({r})::DOUBLE / sum(documents)) * (count(*) - 1))"
    f" / nullif(sum(documents) - sum(documents::DOUBLE * documents) / sum(documents), 0) AS {r}_between" for r in _RULES)

HOST_RULES = rf"""
WITH texts AS (
    SELECT doc_id, source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS w
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM texts)
), repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, range(5) r(k) GROUP BY doc_id
), counts AS (
    SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
           coalesce(covered.n, 0)::BIGINT AS n_repeat_words
    FROM texts LEFT JOIN covered USING (doc_id)
), flags AS (
    SELECT *, n_words < 10 AS few_words, 100 * n_repeat_words > 20 * n_words AS repeated_words,
           100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS repeated_lines
    FROM counts
), hosts AS (
    SELECT source, count(*) AS documents, {", ".join(f"count(*) FILTER ({r}) AS {r}" for r in _RULES)}
    FROM flags GROUP BY source
), sums AS (SELECT {_MEANS}, {_BETWEEN} FROM hosts
), verdicts AS (
    SELECT source, greatest({", ".join(f"round({_shrunken(r)}, 9)" for r in _RULES)}) > 0.5 AS rejected FROM hosts, sums
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few_words OR repeated_words AS base_failed,
       NOT (few_words OR repeated_words) AND NOT rejected AS kept
FROM flags JOIN verdicts ON flags.source IS NOT DISTINCT FROM verdicts.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": CHAT, "op6_exact_dedup": EXACT_DEDUP, "op7_secrets": SECRETS, "op9_top_k": TOP_K,
            "op11_filter_audit": FILTER_AUDIT, "op12_host_rules": HOST_RULES}
