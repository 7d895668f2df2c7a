"""Part-wise tokenising, packing, token files and the BPE transducer."""

import random

import brute
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import zstandard
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F

from quotewright.llm import bpe, packing, token_files
from quotewright.llm.queries import pack_documents
from quotewright.llm.tokens import PartTokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
PARTS = PartTokenizer(PATH)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXT = st.lists(st.sampled_from(
    list("abethnrs'll 1.,!\n\t\x1c\x85\xa0　é中😀<|>") + ["\ua7ce", "\ua7dd", "\U00010ec5", "\u0558", "\U00011de3", "7","  ", " the", "ing", "<|endoftext|>"]), max_size=60).map("".join)
DOCS = [(1, "Hello  world.\n a"), (2, None), (3, ""), (4, "x" * 30_000), (5, "tokens and words " * 900), (6, " "), (7, "é中😀")]


def documents(spark, docs=DOCS):
    return spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, length int")


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_parts_encode_as_whole_texts(texts):
    tokenizer = PARTS
    expected = brute.token_ids(list(enumerate(texts)))
    assert [tokenizer.encode(t) for t in texts] == [brute.little_endian(expected[i][:-1]) for i in range(len(texts))]


def test_a_small_memory_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr("quotewright.llm.tokens.CACHED_PARTS", 3)
    tokenizer = PartTokenizer(PATH)
    texts = [" ".join(random.Random(i).choices(["ab", "the,", "x1", "zebra"], k=9)) for i in range(30)]
    expected = brute.token_ids(list(enumerate(texts)))
    assert [tokenizer.encode(t) for t in texts] == [brute.little_endian(expected[i][:-1]) for i in range(30)]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        PartTokenizer(public_tokenizers.path("word_bpe_49k.json"))


def test_packing_holds_every_id(spark):
    rng = random.Random(5)
    docs = DOCS + [(i, "word " * rng.randint(0, 700)) for i in range(10, 90)]
    total = sum(map(len, brute.token_ids(docs).values()))
    assert brute.check_packing(docs, pack_documents(documents(spark, docs)).collect()) <= -(-total // 1024) + 3
    assert pack_documents(documents(spark).limit(0)).count() == 0


def test_sequences_are_the_packed_ids(spark):
    pieces = packing.token_pieces(documents(spark), PATH, capacity=50)
    got = packing.sequences(packing.pack(pieces.withColumn("offset", F.lit("x")), 50)).collect()
    ids = brute.token_ids(DOCS)
    assert sum(len(r["ids"]) // 4 for r in got) == sum(map(len, ids.values()))
    assert max(len(r["ids"]) for r in got) <= 200


def test_two_replace_the_smallest():
    # Greedy alone: 6 3 and nothing for the gap of 1. Two of 2 fill what 3 leaves exactly.
    assert packing.plan_bins({6: 1, 3: 1, 2: 2}, 10) == [((6, 2, 2), 1), ((3,), 1)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), max_size=15))
def test_plans_pack_every_piece_once(counts):
    used = {}
    for filling, times in packing.plan_bins(counts, 40):
        assert sum(filling) <= 40 and times > 0
        for n in filling:
            used[n] = used.get(n, 0) + times
    assert used == counts


def test_a_hot_length_and_repeated_rows(spark):
    pieces = spark.range(3000).select(F.lit(7).alias("doc_id"), F.when(F.col("id") < 2900, 300).otherwise(100).alias("length"))
    packed = packing.pack(pieces)
    by_sequence = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("k"), F.count("*").alias("c"))
    assert packed.count() == 3000 and by_sequence.where("n > 1024 or k <> c").count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.sql("SELECT 1025 AS length"))


def test_token_files_round_trip(spark, tmp_path):
    docs = DOCS + [(i, f"document {i} " * (i % 50)) for i in range(100, 400)]
    folder = str(tmp_path / "tokens")
    token_files.write_token_files(documents(spark, docs), folder, PATH, frame_bytes=1 << 10)
    read = token_files.read_token_files(spark, folder)
    assert rows(read.select("doc_id", "start", "n_tokens", F.crc32("ids"))) == brute.token_files(docs)
    wanted = spark.createDataFrame([(4,), (150,), (999,)], "doc_id long")
    some = token_files.read_token_files(spark, folder, wanted).select("doc_id", "start", "n_tokens", F.crc32("ids"))
    assert rows(some) == [r for r in brute.token_files(docs) if r[0] in (4, 150)]
    # Any reader of the format can decode a file from its frames alone.
    whole = b""
    for info in sorted(fs.LocalFileSystem().get_file_info(fs.FileSelector(folder)), key=lambda f: f.path):
        if info.path.endswith(".zst"):
            with open(info.path, "rb") as file:
                whole += zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    ids = brute.token_ids(docs)
    assert whole == b"".join(brute.little_endian(ids[i]) for i in sorted(ids))


def test_damaged_frames_are_noticed(spark, tmp_path):
    folder = str(tmp_path / "tokens")
    token_files.write_token_files(documents(spark, [(1, "some words " * 50)]), folder, PATH)
    file = next(p for p in (tmp_path / "tokens").iterdir() if p.suffix == ".zst")
    data = bytearray(file.read_bytes())
    footer = len(data) - 9
    data[footer - 4] ^= 1  # the checksum of the only frame
    file.write_bytes(data)
    with pytest.raises(Exception, match="wrong checksum"):
        token_files.read_token_files(spark, folder).collect()


def test_token_files_of_odd_tables(spark, tmp_path):
    rows_ = [(None, "a"), (3, "b"), (3, "b"), (3, None)]
    token_files.write_token_files(documents(spark, rows_), str(tmp_path / "odd"), PATH)
    read = token_files.read_token_files(spark, str(tmp_path / "odd")).orderBy("start").collect()
    assert [r["doc_id"] for r in read] == [None, 3, 3, 3] and [r["n_tokens"] for r in read] == [2, 1, 2, 2]
    token_files.write_token_files(documents(spark).limit(0), str(tmp_path / "none"), PATH)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_transducer_encodes_like_tiktoken(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == TIKTOKEN.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["th", "er", "on", "ing", "a", "e", "s", "t", "é", "\x00", "中"]), min_size=1, max_size=12))
def test_transducer_equals_merging(parts):
    data = "".join(parts).encode()
    expected = [RANKS[t] for t in bpe.merge(data, RANKS)]
    assert ENCODER.transducer.encode(data) == expected


@pytest.mark.parametrize("most_moves, at_once", [(5, 1 << 16), (300_000, 7), (11, 64), (1, 1)])
def test_a_full_table_goes_on(monkeypatch, most_moves, at_once):
    monkeypatch.setattr(bpe, "AT_ONCE", at_once)
    monkeypatch.setattr(bpe, "CACHED_PARTS", 2)
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    encoder.transducer.most_moves = most_moves
    text = "unbelievable thinkings of extraordinary xyzzyqq " * 3 + "z" * 5000
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == TIKTOKEN.encode_ordinary(text)


def test_long_input_is_emitted_as_it_settles(monkeypatch):
    monkeypatch.setattr(bpe, "AT_ONCE", 20)
    rng, transducer, waiting = random.Random(8), bpe.Transducer(RANKS), []
    settled = transducer._settled
    transducer._settled = lambda ended, state: (waiting.append(len(ended) - settled(ended, state)), settled(ended, state))[1]
    data = "".join(rng.choices(["th", "er", "ing", "a", "zz", "é", "==", "\n"], k=700)).encode()
    assert [transducer.tokens[t] for t in transducer.encode(data)] == bpe.merge(data, RANKS)
    assert len(waiting) > 50 and max(waiting) <= max(map(len, RANKS))


def test_nearly_all_input_finds_its_states_made():
    """Of the bytes that reach the transducer, few need a state or move that no earlier byte has made."""
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()
    encoder, fed = bpe.Encoder(RANKS, public_tokenizers.PATTERN), 0
    encode = encoder.transducer.encode

    def counted(data):
        nonlocal fed
        fed += len(data)
        return encode(data)

    encoder.transducer.encode = counted
    for text in docs:
        encoder.encode(text or "")
    assert fed > 4_000_000 and encoder.transducer.computed < 0.05 * fed


def test_pairs_stay_apart_as_by_merging():
    transducer, rng = ENCODER.transducer, random.Random(2)
    tokens = rng.sample(sorted(transducer.tokens), 400)
    for left, right in zip(tokens, tokens[::-1]):
        pair = [transducer.tokens[left], transducer.tokens[right]]
        if bpe.merge(pair[0], RANKS) == pair[:1]:
            assert transducer.may_follow(left, right) == (bpe.merge(b"".join(pair), RANKS) == pair)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=20) | st.text(max_size=8).map(str.encode), st.lists(st.integers(0, 20), max_size=4))
def test_utf8_in_pieces(data, cuts):
    machine, state, out, at = bpe.Utf8Machine(), b"", "", 0
    for cut in [*sorted(cuts), len(data)]:
        text, state = machine.feed(state, data[at:cut])
        out, at = out + text, max(at, cut)
    assert out + machine.end(state) == data.decode("utf-8", "replace")


def test_bpe_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_texts(documents(spark), path, public_tokenizers.PATTERN)
    expected = {i: TIKTOKEN.encode_ordinary(t or "") for i, t in DOCS}
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in encoded.collect()} == expected
    assert rows(bpe.decode_texts(encoded, path)) == [(i, t or "") for i, t in DOCS]
    assert rows(bpe.token_digests(encoded, path)) == [
        (i, len(expected[i]), brute.sha(brute.little_endian(expected[i])), brute.sha(t or "")) for i, t in DOCS]
    assert bpe.encode_texts(documents(spark).limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_remembered_parts_leave_room_for_other_stages():
    """Two generations of parts, of 165 bytes each on average, in each of an executor's Python workers."""
    from quotewright.llm import tokens
    assert 2 * tokens.CACHED_PARTS * 165 <= 100e6
