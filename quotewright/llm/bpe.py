"""Byte-level BPE as a finite-state transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes if and only if that holds for each pair of
neighbours (Berglund and van der Merwe, "Formalizing BPE tokenization", 2023). So the merges compile
to a nondeterministic transducer: its configurations are a position in the trie of tokens and the
tokens passed so far; a token may follow another if the two alone encode to just themselves. Both the
pair relation and the transducer are built lazily: a state is the set of configurations that the bytes
read so far allow, and is made when it is first reached. Tokens that all configurations of a state
agree on are settled and can be emitted; the others wait for at most as many bytes as the longest token has.
The table of states is bounded: when it is full a new one is begun, so all input runs through determinised states.

Decoding feeds tokens to a UTF-8 state machine that carries an unfinished character and yields complete ones.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import quotewright.llm.tokens
from quotewright.llm.store import per_worker
from quotewright.llm.tokens import Pieces

for _module in (__name__, quotewright.llm.tokens.__name__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])

MOST_MOVES = 300_000  # of one table of states
FEW_TOKENS = 16  # so many tokens below a node are told apart by which may follow
MOST_PAIRS = 300_000
TOKEN_BITS = 24
TOKEN_MASK = (1 << TOKEN_BITS) - 1
AT_ONCE = 1 << 16  # bytes after which settled tokens are emitted
BAD = "\N{REPLACEMENT CHARACTER}"
CACHED_PARTS = 200_000  # of one generation
DECODED_AT_ONCE = 1 << 16
SPACE_RUN = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S) ")


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, from a file of lines ``base64 rank``."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge(data: bytes, ranks: dict[bytes, int], but: bytes = b"") -> list[bytes]:
    """The encoding by definition: the leftmost pair of least rank is merged until none is left.

    Nothing is merged to the token ``but``.
    """
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        merged = [a + b for a, b in zip(parts, parts[1:])]
        best = min(range(len(merged)), key=lambda i: sys.maxsize if merged[i] == but else ranks.get(merged[i], sys.maxsize))
        if merged[best] == but or merged[best] not in ranks:
            break
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return parts


# A state is a dictionary of moves by byte: (next state, the token that ends there in the encoding of the bytes so
# far, or -1). Under CONFIGURATIONS it has its pairs (what is known of the token before, trie node).
CONFIGURATIONS = -1


class Transducer:
    """The transducer of the merges, determinised as far as input has needed it.

    A configuration is a trie node that the bytes since some token's end lead to, with what is known of that
    token: the token itself, or, where few tokens are below the node, which of them may follow it (none: the
    configuration is dropped). Past ``most_moves`` moves the table of states is emptied, and the state in hand is the first
    of a new one.
    """

    def __init__(self, ranks: dict[bytes, int], most_moves: int = MOST_MOVES):
        self.ranks, self.most_moves = ranks, most_moves
        self.tokens = {r: t for t, r in ranks.items()}
        self.lengths = [0] * (max(ranks.values(), default=-1) + 1)
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.depth: list[int] = [0]
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
            node = 0
            for byte in token:
                below = self.children[node].get(byte)
                if below is None:
                    below = self.children[node][byte] = len(self.ends)
                    self.children.append({})
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = below
            self.ends[node] = rank
        # The tokens below each node that has few.
        self.below: list[frozenset[int] | None] = [None] * len(self.ends)
        for node in range(len(self.ends) - 1, -1, -1):
            parts = [(self.ends[c], self.below[c]) for c in self.children[node].values()]
            if all(few is not None for _, few in parts) and sum(len(few) + 1 for _, few in parts) <= FEW_TOKENS:
                self.below[node] = frozenset(t for own, few in parts for t in (own, *few) if t >= 0)
        self.follows: dict[int, bool] = {}  # by (left + 1) << 32 | right
        self.split: dict[int, tuple[int, int] | None] = {}
        self.allowed: dict[tuple[int, int], frozenset[int]] = {}
        self.computed = 0  # moves made so far, in all tables
        self._empty(((-1, 0),))

    def _empty(self, state: tuple) -> dict:
        """Begins a table with the start and the state of these configurations."""
        self.states: dict[tuple, dict] = {}
        self.sets: dict[frozenset[int], frozenset[int]] = {}
        self.made = 0
        self.start = self._state(((-1, 0),))
        return self._state(state)

    def _state(self, configurations: tuple) -> dict:
        known = self.states.get(configurations)
        if known is None:
            known = self.states[configurations] = {CONFIGURATIONS: configurations}
        return known

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; itself twice for a byte, None if merging its
        bytes never makes it."""
        known = self.split.get(token, ())
        if known == ():
            data = self.tokens[token]
            if len(data) == 1:
                known = token, token
            else:
                parts = merge(data, self.ranks, data)
                known = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
            self.split[token] = known
        return known

    def may_follow(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: begin the input)."""
        pair = left + 1 << 32 | right
        known = self.follows.get(pair)
        if known is None:
            if len(self.follows) > MOST_PAIRS:
                self.follows.clear()
            known = self._halves(right) is not None and (left < 0 or self._stay_apart(left, right))
            self.follows[pair] = known
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both never merges across their border.

        Their merges are undone from the last to the first. While x and y face each other at the
        border, they merge if that comes before the merge (of rank ``until``) that takes one of them
        in; of equal ranks the one further left comes first. Ranks are the order of merges, which
        needs every token to rank above its halves.
        """
        ranks, tokens = self.ranks, self.tokens
        x, y, until = left, right, sys.maxsize
        while True:
            if ranks.get(tokens[x] + tokens[y], sys.maxsize) < until:
                return False
            x_bytes, y_bytes = len(tokens[x]) == 1, len(tokens[y]) == 1
            if x_bytes and y_bytes:
                return True
            if y_bytes or not x_bytes and x > y:
                x, until = self._halves(x)[1], x
            else:
                y, until = self._halves(y)[0], y + 1

    def _context(self, before: int | frozenset[int], node: int) -> frozenset[int]:
        """Which of the few tokens below ``node`` may follow the token before it."""
        few = self.below[node]
        if type(before) is not int:
            known = before & few
        else:
            known = self.allowed.get((before, node))
            if known is None:
                if len(self.allowed) > MOST_PAIRS:
                    self.allowed.clear()
                known = frozenset([t for t in few if self.may_follow(before, t)])
                known = self.allowed[before, node] = self.sets.setdefault(known, known)
        return self.sets.setdefault(known, known)

    def _step(self, state: dict, byte: int) -> tuple[dict, int]:
        """Makes the move from a state by a byte that it has none for."""
        if self.made >= self.most_moves:
            state = self._empty(state[CONFIGURATIONS])
        self.computed += 1
        self.made += 1
        children, ends, few = self.children, self.ends, self.below
        grown, ended = [], -1
        for before, node in state[CONFIGURATIONS]:
            below = children[node].get(byte)
            if below is None:
                continue
            token = ends[below]
            if token >= 0 and ended < 0 and (
                    self.may_follow(before, token) if type(before) is int else token in before):
                ended = token  # the encoding of a prefix is unique
            if few[below] is None:
                grown.append((before, below))
            elif few[below]:
                context = self._context(before, below)
                if context:
                    grown.append((context, below))
        grown.append((ended, 0))
        move = state[byte] = self._state(tuple(grown)), ended
        return move

    def _settled(self, ended: list[int], state: dict) -> int:
        """The last place up to which all configurations agree on the tokens."""
        open_ = {len(ended) - self.depth[node] for _, node in state[CONFIGURATIONS]}
        while len(open_) > 1:
            latest = max(open_)
            open_.remove(latest)
            open_.add(latest - self.lengths[ended[latest - 1]])
        return open_.pop()

    def _emitted(self, ended: list[int], at: int) -> list[int]:
        out, lengths = [], self.lengths
        while at:
            token = ended[at - 1]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out

    def _read(self, data: bytes, state: dict, ended: list[int]) -> dict:
        """Follows the moves of ``data`` and appends the tokens that end at each byte."""
        add = ended.append
        for byte in data:
            try:
                state, token = state[byte]
            except KeyError:
                state, token = self._step(state, byte)
            add(token)
        return state

    def encode(self, data: bytes) -> list[int]:
        """The ranks of the encoding. Of long input, tokens are emitted as soon as they are settled."""
        ended: list[int] = []
        if len(data) <= AT_ONCE:
            self._read(data, self.start, ended)
            return self._emitted(ended, len(ended))
        out, state = [], self.start
        for first in range(0, len(data), AT_ONCE):
            state = self._read(data[first:first + AT_ONCE], state, ended)
            settled = self._settled(ended, state)
            out += self._emitted(ended, settled)
            del ended[:settled]
        return out + self._emitted(ended, len(ended))


def _tiktoken_pieces(pattern: str, text: str) -> int:
    """Into how many pieces the tiktoken library cuts the two characters of ``text``."""
    def make():
        import tiktoken

        single = {bytes([b]): b for b in range(256)}
        # An ASCII character and any first byte after it are one token, if they are in one piece.
        pairs = [c + bytes([b]) for c in (b"a", b"1") for b in range(0xC2, 0xF5)]
        return tiktoken.Encoding("pieces", pat_str=pattern, special_tokens={},
                                 mergeable_ranks=single | {p: 256 + i for i, p in enumerate(pairs)})

    return 1 if per_worker(("pieces", pattern), make).encode_ordinary(text)[0] >= 256 else 2


class Encoder:
    """Encodes whole texts: matches of the pattern one by one, those that are tokens as such.

    No match goes on from a character that is not white space to a space. A text may so be cut
    there, and the ids of a part that repeats are looked up.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.transducer = ranks, Transducer(ranks)
        self.matches = Pieces(pattern, lambda text: _tiktoken_pieces(pattern, text))
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _match(self, match: str) -> list[int]:
        data = match.encode()
        rank = self.ranks.get(data)
        return self.transducer.encode(data) if rank is None else [rank]

    def _ids(self, text: str) -> bytes:
        return array("I", [i for m in self.matches(text) for i in self._match(m)]).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            word = part[:-1]
            if part.isalpha():
                ids = array("I", self._match(" " + part)).tobytes()
            elif part[-1:] in {",", "."} and word.isalpha():
                ids = (self.new.get(word) or self._part(word)) + array("I", self._match(part[-1])).tobytes()
            else:
                ids = self._ids(" " + part)
        self.new[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        parts = CUT.split(text) if SPACE_RUN.search(text) else text.split(" ")
        if len(self.new) > CACHED_PARTS:
            self.new, self.old = {}, self.new
        known, compute = self.new.get, self._part
        head = self._ids(parts[0])
        del parts[0]
        return head + b"".join([known(p) or compute(p) for p in parts])


class Utf8Machine:
    """Characters from bytes that come in pieces; what is no UTF-8 becomes U+FFFD, as Python decodes it.

    The machine's state are the bytes of an unfinished character, at most three; a byte completes it, goes on with it,
    or ends it as no character and begins the next. What a piece does from a state is remembered.
    """

    def __init__(self) -> None:
        self.known: dict[tuple[bytes, bytes], tuple[str, bytes]] = {}

    @staticmethod
    def step(state: bytes, byte: int) -> tuple[str, bytes]:
        """The characters that a byte completes, and the next state."""
        if state:
            lead = state[0]
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80) if len(state) == 1 else 0x80
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF) if len(state) == 1 else 0xBF
            if not low <= byte <= high:
                out, state = Utf8Machine.step(b"", byte)
                return BAD + out, state
            state += bytes([byte])
            need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            return (state.decode(), b"") if len(state) == need else ("", state)
        if byte < 0x80:
            return chr(byte), b""
        return ("", bytes([byte])) if 0xC2 <= byte < 0xF5 else (BAD, b"")

    def feed(self, state: bytes, piece: bytes) -> tuple[str, bytes]:
        key = state, piece
        known = self.known.get(key)
        if known is None:
            out = []
            for byte in piece:
                text, state = self.step(state, byte)
                out.append(text)
            if len(self.known) > MOST_PAIRS:
                self.known.clear()
            known = self.known[key] = "".join(out), state
        return known

    def end(self, state: bytes) -> str:
        return BAD if state else ""


class Decoder:
    """Texts from ids, token by token; what tokens do between characters is looked up by id."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.machine = tokens, Utf8Machine()
        self.whole: list[str | None] = [None] * len(tokens)  # of tokens that end between characters, fed there

    def stream(self, ids: np.ndarray) -> Iterator[str]:
        """The text of ``ids`` piece by piece."""
        state, whole, tokens, feed = b"", self.whole, self.tokens, self.machine.feed
        for i in range(0, len(ids), DECODED_AT_ONCE):
            out = []
            for token in ids[i:i + DECODED_AT_ONCE].tolist():
                text = None if state else whole[token]
                if text is None:
                    before = state
                    text, state = feed(state, tokens[token])
                    if not before and not state:
                        whole[token] = text
                out.append(text)
            yield "".join(out)
        yield self.machine.end(state)


def _token_list(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("bpe", path, pattern), lambda: Encoder(read_ranks(path), pattern))
        for batch in batches:
            first, ids, size = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                ids.append(encoder.encode(text.as_py() or ""))
                size += len(ids[-1])
                if size > 1 << 22 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, len(ids)), pa.array(ids, pa.binary())], ["_id", "ids"])
                    first, ids, size = i + 1, [], 0

    return run


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (unsigned 32-bit, little-endian) of every row; no special tokens.

    A NULL text is empty and has no ids. Ids may be NULL or repeat; other columns are ignored.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        _encode(ranks_path, pattern), "_id long, ids binary").withColumnRenamed("_id", id_col)


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = per_worker(("decoder", path), lambda: Decoder(_token_list(read_ranks(path))))
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for row in batch.column(1):
                data = row.as_py()
                text = hashlib.sha256()
                for piece in decoder.stream(np.frombuffer(data, "<u4")):
                    text.update(piece.encode())
                counts.append(len(data) // 4)
                encoded.append(hashlib.sha256(data).hexdigest())
                decoded.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def token_digests(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, SHA-256 of the ids, and SHA-256 of the text decoded from them as a stream."""
    return encoded.select(id_col, "ids").mapInArrow(
        _digest(ranks_path), "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    ).withColumnRenamed("_id", id_col)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = per_worker(("decoder", path), lambda: Decoder(_token_list(read_ranks(path))))
        for batch in batches:
            texts = ["".join(decoder.stream(np.frombuffer(x.as_py(), "<u4"))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_id", "text"])

    return run


def decode_texts(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """id and text of every row of ``encoded`` (id, ids)."""
    return encoded.select(id_col, "ids").mapInArrow(_decode(ranks_path), "_id long, text string").withColumnRenamed("_id", id_col)
