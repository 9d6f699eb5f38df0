"""SentencePiece encoding of the merge type by a table of prefixes, and decoding.

The encoding of every prefix of a text ends with one token, and that token stands beside the last token of the prefix before
it just when the two encode to themselves together. So an automaton over all pieces (Aho and Corasick) reads a text once and
tells, place by place, the pieces that end there; the one that starts at the text's start, or that the last token of the
prefix before it may stand beside, is noted in the table. From the text's end the table gives the tokens backwards. Every
place is settled when it is read, so time follows the length of the text whatever it holds.

Two pieces may stand side by side if the merges over both, best score first and the leftmost of equals, end with just the two.
That is found by undoing merges at the seam, or by the definition where scores are shared, and remembered. Blanks become U+2581 and one is put before the text, as the model's normaliser does. A
text is cut where no piece reaches across (before a run of U+2581 that follows another character), so its words are looked up
once each. Characters that are no piece become the pieces of their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import groupby

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import batched, held, sliced, table, tidy

MODEL = "piece_bpe_32k.model"
#: The blank of the pieces.
BLANK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Words and verdicts on pairs that a worker remembers; beyond, they are forgotten and made again. Of words, so many and as many of the time before.
MOST_WORDS, MOST_PAIRS = 600_000, 400_000
#: Characters of the longest word remembered.
LONGEST_KEPT = 64


def fields(message: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        n = shift = 0
        while True:
            byte = message[i]
            i, n, shift = i + 1, n | (byte & 127) << shift, shift + 7
            if byte < 128:
                return n

    while i < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 2: -1, 5: 4}[kind]
        n = varint() if n < 0 else n
        value, i = message[i : i + n], i + n
        yield key >> 3, struct.unpack("<f", value)[0] if kind == 5 else value


def load_model(path: str) -> list[tuple[str, float, int]]:
    """Text, score and kind of each piece by id. Models of another type, or with a normaliser of another rule, are refused."""
    pieces, merges, rules = [], False, {}
    with open(path, "rb") as f:
        for number, value in fields(f.read()):
            if number == 1:
                piece = dict(fields(value))
                pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
            elif number == 2:
                merges = dict(fields(value)).get(3) == 2
            elif number == 3:
                rules = dict(fields(value))
    plain = not rules.get(2) and rules.get(3, 1) and not rules.get(4, 1) and rules.get(5, 1)
    if not merges or not plain or {k for *_, k in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError(f"{path}: only models of merges are known, with a blank put before, blanks kept, no other rule, and no pieces by the user")
    return pieces


def merge_by_score(text: str, score: dict[str, float], down_to: int = 1) -> list[str]:
    """The encoding by its definition: join the neighbours of the best score, leftmost first, while any joins and more than down_to parts are left."""
    parts = list(text)
    while len(parts) > down_to:
        best, at = max((score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == -np.inf:
            break
        parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
    return parts


class Pieces:
    """Encoder and decoder for a model's pieces."""

    def __init__(self, path: str):
        model = load_model(path)
        self.score = {t: s for t, s, k in model if k == NORMAL}
        self.number = {t: i for i, (t, _, k) in enumerate(model) if k == NORMAL}
        self.bytes = [i for _, i in sorted((int(t[3:5], 16), i) for i, (t, _, k) in enumerate(model) if k == BYTE)]
        order = {x: r for r, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {t: order[x] for t, x in self.score.items()}
        self.automaton = ahocorasick.Automaton()
        self.halves: dict[str, tuple[str, str]] = {}  # what the last merge of a token joins; of a character, itself twice
        for t in self.score:
            parts = merge_by_score(t, self.score, 2)
            if len(parts) < 3:  # merges never make the others
                self.automaton.add_word(t, t)
                self.halves[t] = (parts[0], parts[-1])
        self.automaton.make_automaton()
        shared = Counter(self.rank[t] for t in self.halves if len(t) > 1)
        self.tried: set[str] = set()  # tokens with merges of shared scores or not in falling order: their pairs are tried by the definition
        for t in sorted(self.halves, key=len):
            if len(t) > 1 and (shared[self.rank[t]] > 1 or any(len(x) > 1 and (x in self.tried or self.rank[x] >= self.rank[t]) for x in self.halves[t])):
                self.tried.add(t)
        across = any(a != BLANK and b == BLANK for t in self.score for a, b in zip(t, t[1:]))
        self.cut = re.compile(".+" if across else f"{BLANK}*[^{BLANK}]+|{BLANK}+", re.DOTALL)
        self.packed = _Ids(self)
        self.beside: dict[tuple[str, str], bool] = {}
        self.words = _Words(self)
        self.surface = [t.replace(BLANK, " ").encode() if k == NORMAL else bytes([int(t[3:5], 16)]) if k == BYTE else " \u2047 ".encode() if k == UNKNOWN else b"" for t, _, k in model]
        self.begins_blank = {i for i, (t, _, k) in enumerate(model) if k == NORMAL and t[0] == BLANK}
        self.control = {i for i, (*_, k) in enumerate(model) if k == CONTROL}
        self.single = set(self.bytes)

    def neighbours(self, a: str, b: str) -> bool:
        """Whether token b may follow token a: their characters together encode to just the two."""
        ok = self.beside.get((a, b))
        if ok is None:
            if len(self.beside) > MOST_PAIRS:
                self.beside.clear()
            plain = a not in self.tried and b not in self.tried
            ok = self.beside[a, b] = self._holds(a, b) if plain else merge_by_score(a + b, self.score) == [a, b]
        return ok

    def _holds(self, a: str, b: str) -> bool:
        """Undoes the later of the merges at the seam, again and again: the seam holds if none of the pairs that meet there would
        have been joined before the merge undone last. For tokens whose merges come in falling order of scores that no other has."""
        rank, halves, limit = self.rank, self.halves, 1 << 40
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            whole_a, whole_b = len(a) == 1, len(b) == 1
            if whole_a and whole_b:
                return True
            if whole_b or not whole_a and rank[a] > rank[b]:
                limit, a = rank[a], halves[a][1]  # a pair further right comes after an equal one
            else:
                limit, b = rank[b] + 1, halves[b][0]

    def last_tokens(self, word: str) -> list[str]:
        """The last token of each prefix, by the prefix's length; a character that no piece ends with is a token of its own."""
        table, find = ["", *word], self.beside.get
        settled = 0
        for end, token in self.automaton.iter(word):
            if end < settled:
                continue  # a prefix has one encoding
            start = end + 1 - len(token)
            if start:
                last = table[start]
                fits = find((last, token))
                if fits is None:
                    fits = self.neighbours(last, token)
                if not fits:
                    continue
            table[end + 1] = token
            settled = end + 1
        return table

    def tokens(self, word: str) -> list[str]:
        """The tokens of a word, recovered backwards from the table of its prefixes."""
        table, at, out = self.last_tokens(word), len(word), []
        while at:
            out.append(table[at])
            at -= len(table[at])
        out.reverse()
        return out

    def encode_packed(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if len(self.words) > MOST_WORDS:
            self.words = _Words(self, self.words)
        return b"".join(map(self.words.__getitem__, self.cut.findall(BLANK + text.replace(" ", BLANK))))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<i4").tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: byte pieces in a row are read as UTF-8, with U+FFFD for each byte that is no part of a character;
        the blank that encoding puts before a text is left out."""
        out = list(map(self.surface.__getitem__, ids))
        first = next((k for k, i in enumerate(ids) if i not in self.control), None)
        if first is not None and ids[first] in self.begins_blank:
            out[first] = out[first][1:]
        if self.control.isdisjoint(ids):
            try:
                return b"".join(out).decode()  # pieces that aren't bytes are whole characters
            except UnicodeDecodeError:
                pass
        rows = groupby(zip(ids, out), lambda x: x[0] in self.single)
        return b"".join([_characters(b"".join([x for _, x in row])) if single else b"".join([x for _, x in row]) for single, row in rows]).decode()


class _Ids(dict):
    """Tokens and their packed ids: a piece has one, any other character those of its bytes, which are not kept."""

    def __init__(self, pieces: Pieces):
        super().__init__((t, struct.pack("<i", i)) for t, i in pieces.number.items())
        self.bytes = pieces.bytes

    def __missing__(self, character: str) -> bytes:
        return b"".join([struct.pack("<i", self.bytes[b]) for b in character.encode()])


class _Words(dict):
    """Words and their packed ids; a word that the table before this one knew is moved here when it comes again."""

    def __init__(self, pieces: Pieces, before: dict[str, bytes] | None = None):
        self.pieces, self.before = pieces, {} if before is None else before
        if before is not None:
            before.before = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.pop(word, None)
        if ids is None:
            ids = b"".join(map(self.pieces.packed.__getitem__, self.pieces.tokens(word)))
        if len(word) <= LONGEST_KEPT:
            self[word] = ids
        return ids


def _characters(row: bytes) -> bytes:
    """The bytes if they are UTF-8; else with U+FFFD for each byte that is no part of a character."""
    out, i = [], 0
    while i < len(row):
        for n in (1, 2, 3, 4):
            try:
                row[i : i + n].decode()
            except UnicodeDecodeError:
                continue
            out.append(row[i : i + n])
            i += n
            break
        else:
            out.append("�".encode())
            i += 1
    return b"".join(out)


def pieces_of(path: str) -> Pieces:
    """A worker's encoder for the file at path, which each machine has."""
    return held(f"pieces {path}", lambda: Pieces(path))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded (string) for each row of docs (doc_id, text); null as empty: no ids. Texts come whole;
    rows repeat as they do in docs; other columns, whatever their names, are not carried. An empty table gives no rows."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = pieces_of(path)
        for x in sliced(batches):
            ids = [np.frombuffer(coder.encode_packed(t), dtype="<i4") for t in x["text"]]
            yield pd.DataFrame({"doc_id": x["doc_id"].to_numpy(), "ids": ids, "decoded": [coder.decode(y.tolist()) for y in ids]})

    return batched(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256: digests of what encode_documents gives,
    made where it is made. Rows as there."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = pieces_of(path)
        for x in sliced(batches):
            rows = []
            for doc_id, text in zip(x["doc_id"], x["text"]):
                ids = coder.encode(text)
                told, decoded = hashlib.sha256(",".join(map(str, ids)).encode()), hashlib.sha256(coder.decode(ids).encode())
                rows.append((doc_id, len(ids), told.hexdigest(), decoded.hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return batched(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
