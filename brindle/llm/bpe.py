"""Byte-level BPE by a finite-state transducer, and decoding by an incremental UTF-8 state machine.

Encoding. A sequence of tokens is the encoding of its bytes just when each token encodes itself and each two
neighbours do (Berglund, Martens and van der Merwe, "Constructing a BPE Tokenization DFA", 2024). So a
nondeterministic transducer reads bytes, walks the trie of tokens, and at the end of a token may tell it and start
another that the last one may stand beside. It is determinised lazily by subsets (Mohri, 1997): a state is the set of
(last token, place in the trie, tokens told later than the state's own), and a transition tells what all of its
hypotheses agree on. Hypotheses that no token continues drop out, so a token is told after a bounded lookahead. Where few
tokens are to come, a hypothesis that none of them fits is dropped at once, and one that all fit forgets its last token, so
states are few. States and transitions are made when first met and forgotten together beyond a limit.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import batched, held, sliced, table, tidy

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Transitions and neighbour verdicts kept in a worker; beyond, they are forgotten and made again. Of pieces, so many and as many of the time before.
MOST_TRANSITIONS, MOST_PAIRS, MOST_PIECES = 320_000, 250_000, 150_000


#: Steps of tokens over the UTF-8 machine kept in a worker; beyond, they are forgotten and made again.
MOST_STEPS = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token to rank from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The encoding by its definition: join the neighbours of lowest rank, leftmost first, while any joins."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 40:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


#: Of a place in the trie with up to this many tokens to come, hypotheses are looked at ahead.
FEW = 8


#: A transition is one integer: 256 x the next state in the lower bits, the number of what it tells above them.
TOLD = 40
STATE = (1 << TOLD) - 1


def _pack(state: tuple) -> bytes:
    """A state in a third of the memory that its tuples take."""
    return array("i", [x for last, node, owed in state for x in (last, node, len(owed), *owed)]).tobytes()


def _unpack(packed: bytes) -> tuple:
    flat, state, i = array("i", packed).tolist(), [], 0
    while i < len(flat):
        end = i + 3 + flat[i + 2]
        state.append((flat[i], flat[i + 1], tuple(flat[i + 3 : end])))
        i = end
    return tuple(state)


def _number(numbers: dict[bytes, int], all_: list[bytes], x: bytes) -> int:
    """The place of x in all_, where it is put if it is new."""
    n = numbers.get(x)
    if n is None:
        n = numbers[x] = len(all_)
        all_.append(x)
    return n


class Transducer:
    """The encoder of single pieces for a vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], most: int = MOST_TRANSITIONS):
        self.ranks, self.most = ranks, most
        self.token = {i: t for t, i in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]  # the token that ends at a node, -1: none
        for t, i in ranks.items():
            if len(t) > 1 and merge_by_rank(t, ranks) != [i]:
                continue  # merges never make it, so only a whole piece can be it
            at = 0
            for b in t:
                nxt = self.trie[at].get(b)
                if nxt is None:
                    nxt = self.trie[at][b] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(-1)
                at = nxt
            self.ends[at] = i
        self.below: list[tuple[int, ...] | None] = [None] * len(self.trie)  # the tokens that end at a node or beneath, if few
        for at in range(len(self.trie) - 1, -1, -1):  # children have larger numbers
            own = (self.ends[at],) if self.ends[at] >= 0 else ()
            under = [self.below[c] for c in self.trie[at].values()]
            if None not in under and len(found := sum(under, own)) <= FEW:
                self.below[at] = found
        self.halves: dict[int, tuple[int, int]] = {}  # what the last merge of a token joins; of a byte, itself twice
        for t, i in ranks.items():
            cuts = [(max(x, y), x, y) for k in range(1, len(t)) if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None]
            self.halves[i] = (i, i) if len(t) == 1 else next(((x, y) for _, x, y in sorted(cuts) if self._apart(x, y, i)), (-1, -1))
        self.packed = {i: i.to_bytes(4, "little") for i in self.token}
        self.beside: dict[int, bool] = {}  # token a << 32 | token b
        self.forget()

    def forget(self) -> None:
        """Drops all states but the first."""
        self.states: list[bytes] = [_pack(((-1, 0, ()),))]
        self.numbers: dict[bytes, int] = {self.states[0]: 0}
        self.told: list[bytes] = [b""]  # what transitions tell: packed tokens
        self.told_at: dict[bytes, int] = {b"": 0}
        self.moves: dict[int, int] = {}  # 256 x state + byte: 256 x the next state, and above TOLD its place in told
        self.ends_as: dict[int, bytes] = {}  # 256 x state: what is still owed when the piece ends

    def _apart(self, a: int, b: int, whole: int) -> bool:
        """Whether merges of a rank below whole leave a and b apart, so that the merge into whole joins them."""
        return merge_by_rank(self.token[a] + self.token[b], {t: r for k in (self.token[a] + self.token[b],) for i in range(len(k)) for j in range(i + 1, len(k) + 1) if (r := self.ranks.get(t := k[i:j])) is not None and r < whole}) == [a, b]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: their bytes together encode to just the two."""
        if a < 0:
            return True
        ok = self.beside.get(a << 32 | b)
        if ok is None:
            if len(self.beside) > MOST_PAIRS:
                self.beside.clear()
            ok = self.beside[a << 32 | b] = self._holds(a, b)
        return ok

    def _holds(self, a: int, b: int) -> bool:
        """Undoes the later of the merges at the seam, again and again: the seam holds if none of the pairs that meet
        there would have been joined before the merge undone last."""
        token, ranks, halves = self.token, self.ranks, self.halves
        limit = 1 << 40
        while True:
            if ranks.get(token[a] + token[b], limit) < limit:
                return False
            if a > b and halves[a][1] != a or halves[b][0] == b:
                if halves[a][1] == a:
                    return True
                limit, a = a, halves[a][1]
            else:
                limit, b = b + 1, halves[b][0]

    def step(self, state: tuple, byte: int) -> tuple[tuple, tuple]:
        """The state after a byte and the tokens told: those that the hypotheses left have in common."""
        trie, ends, first = self.trie, self.ends, self.trie[0].get(byte)
        hyps, open_ = [], first is not None
        for last, node, owed in state:
            if (child := trie[node].get(byte)) is not None:
                if last >= 0 and (few := self.below[child]) is not None:
                    fits = sum([self.neighbours(last, t) for t in few])
                    if fits:  # else nothing that comes may stand there
                        hyps.append((-1 if fits == len(few) else last, child, owed))  # if all may, the states of all such last tokens are one
                else:
                    hyps.append((last, child, owed))
            if open_ and (t := ends[node]) >= 0 and self.neighbours(last, t):
                hyps.append((t, first, (*owed, t)))
                open_ = False  # what was read has one encoding, so no other hypothesis ends a token here
        if len(hyps) == 1:
            last, node, owed = hyps[0]
            return ((last, node, ()),), owed
        if not hyps:
            raise ValueError("the vocabulary lacks a byte")
        common = 0
        for same in zip(*[h[2] for h in hyps]):
            if same.count(same[0]) < len(same):
                break
            common += 1
        if not common:
            return tuple(hyps), ()
        return tuple([(last, node, owed[common:]) for last, node, owed in hyps]), hyps[0][2][:common]

    def finish(self, state: tuple) -> tuple:
        """What is still owed when the piece ends: one hypothesis ends a token that fits."""
        left = [(*owed, t) for last, node, owed in state if (t := self.ends[node]) >= 0 and self.neighbours(last, t)]
        if len(left) != 1:
            raise ValueError(f"{len(left)} encodings at the end of a piece")
        return left[0]

    def _move(self, at: int, byte: int) -> int:
        state, tokens = self.step(_unpack(self.states[at >> 8]), byte)
        to = _number(self.numbers, self.states, _pack(state))
        told = _number(self.told_at, self.told, b"".join([self.packed[t] for t in tokens]))
        move = self.moves[at | byte] = told << TOLD | to << 8
        return move

    def _end(self, at: int) -> bytes:
        owed = self.ends_as[at] = b"".join([self.packed[t] for t in self.finish(_unpack(self.states[at >> 8]))])
        return owed

    def stream(self, data: Iterable[int]) -> Iterator[bytes]:
        """The packed tokens of a piece, told as its bytes come."""
        at, moves, told = 0, self.moves, self.told
        for byte in data:
            move = moves.get(at | byte) or self._move(at, byte)
            at = move & STATE
            if move > STATE:
                yield told[move >> TOLD]
        if at:
            yield self.ends_as.get(at) or self._end(at)

    def encode_packed(self, piece: bytes) -> bytes:
        """The ids of a piece as little-endian unsigned 32-bit integers."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return self.packed[whole]
        if len(self.moves) > self.most:
            self.forget()
        at, out, find, told = 0, [], self.moves.get, self.told  # what stream does, without a generator for each piece
        for byte in piece:
            move = find(at | byte) or self._move(at, byte)
            at = move & STATE
            if move > STATE:
                out.append(told[move >> TOLD])
        if at:
            out.append(self.ends_as.get(at) or self._end(at))
        return b"".join(out)

    def encode(self, piece: bytes) -> list[int]:
        return np.frombuffer(self.encode_packed(piece), dtype="<u4").tolist()


class Encoder:
    """Texts to ids: each match of the pattern is a piece of its own; there are no special tokens."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.transducer, self.pattern, self.known = Transducer(load_ranks(path)), regex.compile(pattern), _Known(self)
        self.machine = TokenMachine(self.transducer.token)

    def encode_packed(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(self.known) > MOST_PIECES:
            self.known = _Known(self, self.known)
        return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.transducer.token.__getitem__, ids))


class _Known(dict):
    """Pieces and their packed ids; a piece that the table before this one knew is moved here when it comes again."""

    def __init__(self, encoder: Encoder, before: _Known | None = None):
        self.encoder, self.before = encoder, {} if before is None else before
        if before is not None:
            before.before = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.pop(piece, None)
        if ids is None:
            ids = self.encoder.transducer.encode_packed(piece.encode())
        if len(piece) <= 64:
            self[piece] = ids
        return ids


#: A state of the UTF-8 machine: bytes to come, the bits read, and what the next byte may be.
BETWEEN = (0, 0, 0x80, 0xBF)


def utf8_steps(state: tuple[int, int, int, int], chunk: bytes) -> tuple[tuple[int, int, int, int], str]:
    """The state after each byte of chunk was read, and the text told.

    A byte that can't go on or begin a character gives U+FFFD, one for each maximal part, as bytes.decode
    with errors="replace" does.
    """
    need, value, low, high = state
    out: list[str] = []
    for b in chunk:
        if need:
            if low <= b <= high:
                value, need, low, high = value << 6 | b & 63, need - 1, 0x80, 0xBF
                if not need:
                    out.append(chr(value))
                    value = 0
                continue
            out.append("�")
            need, value, low, high = BETWEEN
        if b < 0x80:
            out.append(chr(b))
        elif 0xC2 <= b <= 0xDF:
            need, value = 1, b & 31
        elif 0xE0 <= b <= 0xEF:
            need, value = 2, b & 15
            low, high = 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
        elif 0xF0 <= b <= 0xF4:
            need, value = 3, b & 7
            low, high = 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
        else:
            out.append("�")
    return (need, value, low, high), "".join(out)


class Utf8Decoder:
    """Characters from chunks of bytes: the bytes of an unfinished character wait for the next chunk."""

    def __init__(self) -> None:
        self.state = BETWEEN

    def feed(self, chunk: bytes) -> str:
        self.state, text = utf8_steps(self.state, chunk)
        return text

    def end(self) -> str:
        rest, self.state = "�" if self.state[0] else "", BETWEEN
        return rest


class TokenMachine:
    """The UTF-8 machine that reads tokens in place of bytes: where a token leads from a state, and the text told on the way, is
    found by stepping over its bytes when the two first meet, and remembered up to a limit."""

    def __init__(self, token: dict[int, bytes], most: int = MOST_STEPS):
        self.token, self.most = token, most
        self.forget()

    def forget(self) -> None:
        self.states, self.numbers = [BETWEEN], {BETWEEN: 0}
        self.moves: list[dict[int, tuple[int, str]]] = [{}]  # by state and token: the next state and the text
        self.kept = 0

    def _move(self, at: int, token: int) -> tuple[int, str]:
        state, text = utf8_steps(self.states[at], self.token[token])
        to = self.numbers.get(state)
        if to is None:
            to = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        self.kept += 1
        move = self.moves[at][token] = (to, text)
        return move

    def stream(self, ids: Sequence[int], at_once: int) -> Iterator[str]:
        """Text as ids come: what of it is complete after each at_once ids, then the end of an unfinished character."""
        state = BETWEEN
        for i in range(0, len(ids), at_once):
            if self.kept > self.most:
                self.forget()
            at, moves, out = self.numbers.get(state), self.moves, []
            if at is None:
                at = self.numbers[state] = len(self.states)
                self.states.append(state)
                moves.append({})
            for token in ids[i : i + at_once]:
                at, text = moves[at].get(token) or self._move(at, token)
                out.append(text)
            state = self.states[at]
            yield "".join(out)
        yield "�" if state[0] else ""


#: Ids that the decoder takes at once where a whole document's are at hand.
AT_ONCE = 1 << 14


def decode_stream(encoder: Encoder, ids: Sequence[int], at_once: int = 1) -> Iterator[str]:
    """Text as ids come, by the encoder's UTF-8 machine: what of it is complete after each at_once ids, then the end of an unfinished character."""
    return encoder.machine.stream(ids, at_once)


def encoder_of(path: str) -> Encoder:
    """A worker's encoder for the file at path, which each machine has."""
    return held(f"encoder {path}", lambda: Encoder(path))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) and whole (boolean: whether decode_stream makes the text of the ids again) for each row of docs
    (doc_id, text); null as empty: no ids. Texts come whole; rows repeat as they do in docs; other columns
    are not carried. An empty table gives no rows."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(path)
        for x in sliced(batches):
            ids = [np.frombuffer(encoder.encode_packed(t), dtype="<i4") for t in x["text"]]
            decoded = ["".join(decode_stream(encoder, y.tolist(), AT_ONCE)) for y in ids]
            yield pd.DataFrame({"doc_id": x["doc_id"].to_numpy(), "ids": ids, "whole": [d == (t or "") for d, t in zip(decoded, x["text"])]})

    return batched(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, ids array<int>, whole boolean")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what encode_documents gives, made where it is made."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(path)
        for x in batches:
            rows = []
            for doc_id, text in zip(x["doc_id"], x["text"]):
                packed, decoded = encoder.encode_packed(text), hashlib.sha256()
                for part in decode_stream(encoder, np.frombuffer(packed, dtype="<u4").tolist(), AT_ONCE):
                    decoded.update(part.encode())
                rows.append((doc_id, len(packed) // 4, hashlib.sha256(packed).hexdigest(), decoded.hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return batched(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
