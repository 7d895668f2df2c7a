"""Exact duplicates, secret scans and chat formatting."""

import brute
import pytest
from conftest import rows
from pyspark.sql import functions as F

from quotewright.llm import chat, packing, secrets, simhash, toxicity
from quotewright.llm.exact_dedup import deduplicate, exact_groups

SCHEMA = "doc_id long, text string, kept string"


def documents(spark, docs):
    return spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_groups_equal_brute_force(spark):
    long = "Word " * 50_000
    docs = [(1, "A b"), (2, "a B"), (3, "a b "), (4, None), (5, ""), (6, "É a"), (7, "é a"), (8, "É A"),
            (9, long), (10, long.lower()), (11, long[:-1] + "x"), (12, "zz"), (13, "yy")]
    got = exact_groups(documents(spark, docs), digest=True)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.exact_groups(docs)
    assert "Python" not in plan_of(got) and "Arrow" not in plan_of(got)


@pytest.mark.parametrize("bits", [1, 64, 1 << 20])
def test_full_filters_only_cost_hashes(spark, bits):
    docs = [(i, f"text {i % 7} {'A' if i % 2 else 'a'}") for i in range(60)]
    got = exact_groups(documents(spark, docs), digest=True, filter_bits=bits, prefix_chars=3)
    assert rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == brute.exact_groups(docs)


def test_deduplicate_keeps_rows_whole(spark):
    docs = documents(spark, [(1, "a"), (2, "A"), (3, "b"), (None, "b"), (3, "b"), (None, "c")])
    assert rows(deduplicate(docs)) == [(None, "c", "x"), (2, "A", "x"), (3, "b", "x"), (3, "b", "x")]
    assert exact_groups(docs.limit(0)).count() == 0 and deduplicate(docs.limit(0)).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query("[0-9a-f]{32,}") == []
    assert secrets.trigram_query("(foo|bars?)x*") == [frozenset({"bar"}), frozenset({"foo"})]
    assert secrets.trigram_query("a.*b") == []


SECRETS = [
    (1, 'Password: "abcdefgh1" and token=short secret = ' + "0123456789abcdef" * 3),
    (2, "token: secret: abcdefghij"),  # the first match takes the second keyword
    (3, "AKIAABCDEFGHIJKL AKIAAKIAAKIA1 xAKIAZZZZZZZZZZZZ9"),
    (4, None), (5, ""), (6, "é𝒳 api_key='abc.def-ghi/jkl=' é " + "f" * 31 + " " + "e" * 40),
    (7, "passwd=" + "x" * 100_000), (8, "pass word ord tok ken"), (9, "APIKEY:aaaaaaaa,apikey:bbbbbbbb"),
]


def test_spans_equal_brute_force(spark):
    found = secrets.find_secrets(documents(spark, SECRETS))
    assert "Python" not in plan_of(found) and "Arrow" not in plan_of(found)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found.collect()}
    assert got == {i: brute.secret_spans(t) for i, t in SECRETS}
    assert found.columns == ["doc_id", "text", "kept", "spans"]


def test_masks(spark):
    docs = documents(spark, SECRETS)
    assert {r["doc_id"]: r["text"] for r in secrets.mask_secrets(docs).collect()} == {
        i: t if t is None else brute.masked(t) for i, t in SECRETS}
    assert secrets.mask_secrets(docs).columns == docs.columns


def test_repeated_and_missing_ids(spark):
    docs = documents(spark, [(1, "token=abcdefgh"), (1, "clean"), (None, "token=abcdefgh"), (None, "clean")])
    assert sorted(len(r["spans"]) for r in secrets.find_secrets(docs).collect()) == [0, 0, 1, 1]
    assert secrets.find_secrets(docs.limit(0)).count() == 0


TURNS = [
    (1, 2, "user", "b"), (1, 1, "user", "a\n<|im_sep|>"), (1, 3, "assistant", "<|im_end|><\\|x<\\\\|<|"),
    (1, 4, "assistant", None), (1, 5, "system\nrole", "é𝒳"), (1, 6, None, ""), (2, 1, "assistant", "x" * 200_000),
    (3, 1, "user", ""), (None, 1, "user", "q"), (4, 1, "b", "2"), (4, 1, "a", "1"), (4, None, "z", "0"), (4, 1, "a", "1"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame([(*t, 0) for t in TURNS], "conv_id long, turn long, role string, text string, formatted int")
    formatted = chat.format_conversations(turns)
    got = {r["conv_id"]: r for r in formatted.select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_texts(F.col("formatted"), F.col("loss_runs")).alias("loss")).collect()}
    assert len(got) == len({t[0] for t in TURNS})
    for conv, row in got.items():
        own = sorted(((t[1] is not None, t[1], t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        assert [tuple(t) for t in row["turns"]] == [t[2:] for t in own]
        assert row["loss"] == [t[3] for t in own if t[2] == "assistant"]
    # Adjacent turns of one role share a block, and no text holds a control string.
    assert got[1]["formatted"].count("<|im_start|>") == 4 and got[1]["formatted"].count("<|im_sep|>") == 2
    assert "Python" not in plan_of(formatted)
    assert chat.format_conversations(turns.limit(0)).count() == 0


HELPERS = ["_id", "_kinds", "_found", "_low", "_spans", "spans", "Spans", "_dropped", "_sha256", "_all", "_key", "_label", "_text",
           "_print", "_first", "_salt", "_n", "_before", "_own", "_rank", "_run", "_k", "runs", "sequence", "count", "_bucket",
           "_bitmap", "_position", "_byte", "_rows", "_full", "_length", "keep_id", "group_size", "component_id", "node", "word",
           "n", "row", "id", "p_quality", "ids", "piece", "start", "salt", "u", "v", "m"]
CLASHING = [(1, "password = abcdefgh1 and more words than that"), (2, "PASSWORD = abcdefgh1 and more words than that"), (3, None),
            (4, ""), (5, "other words here"), (5, "other words here"), (None, "nothing to see")]


@pytest.mark.parametrize("names", [HELPERS[i::4] for i in range(4)])
def test_columns_with_the_names_of_helpers_stay(spark, names):
    extra = {n: F.lit(f"own {n}") for n in names if n.lower() not in {m.lower() for m in names[:names.index(n)]}}
    plain = spark.createDataFrame(CLASHING, "doc_id long, text string")
    docs = plain.withColumns(extra)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")

    def same(kept, other, columns=("doc_id", "text")):
        assert set(docs.columns) <= set(kept.columns) and rows(kept, *columns) == rows(other, *columns)
        for n in extra:
            assert {r[0] for r in kept.select(f"`{n}`").distinct().collect()} <= {f"own {n}"}

    same(secrets.mask_secrets(docs), secrets.mask_secrets(plain))
    found = secrets.find_secrets(docs)
    assert rows(found, "doc_id", "spans") == rows(secrets.find_secrets(plain), "doc_id", "spans")
    same(deduplicate(docs), deduplicate(plain))
    same(simhash.drop_near_duplicates(docs), simhash.drop_near_duplicates(plain))
    chain = toxicity.train(docs, labels.withColumns({k: v for k, v in extra.items()}), ("quality", "toxic"))
    assert chain.words == toxicity.train(plain, labels, ("quality", "toxic")).words
    assert rows(toxicity.drop_toxic(docs.drop("p_quality"), chain, "toxic"), "doc_id") == rows(
        toxicity.drop_toxic(plain, chain, "toxic"), "doc_id")
    pieces = docs.drop("sequence_id", "offset").withColumn("length", F.coalesce(F.char_length("text"), F.lit(0)) + 1)
    packed = packing.pack(pieces)
    assert set(pieces.columns) <= set(packed.columns) and packed.count() == len(CLASHING)
    assert rows(packed.groupBy("sequence_id").agg(F.sum("length").alias("x")), "x") == rows(
        packing.pack(pieces.select("doc_id", "length")).groupBy("sequence_id").agg(F.sum("length").alias("x")), "x")


def test_labelled_documents_without_words_count(spark):
    docs = spark.createDataFrame([(i, "bad words" if i % 2 else None) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)], "doc_id long, toxic int")
    chain = toxicity.train(docs, labels, ("toxic",))
    p = {r["doc_id"]: r["p_toxic"] for r in toxicity.predict(docs, chain).collect()}
    assert all((p[i] > 0.5) == bool(i % 2) for i in p)
