"""The encoder of pieces against the sentencepiece library and against merges by their definition."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tests.conftest import SF

from brindle.llm import pieces
from brindle.llm.queries import QUERIES

PATH = public_tokenizers.path(pieces.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def ours():
    return pieces.Pieces(PATH)


ODD = ["", " ", "   ", "     a", "\n", "\x00a", "▁", "▁▁a ▁", "a\tb\r\n", "日本語テキスト", "𝔘𝔫𝔦", "é" * 50, "<0x0A>", "<s>", "</s> <unk>", "a" * 3000, " " * 2000 + "x", "ﬀ ①", "​  x", "👩‍👩‍👧", "ab" * 900, "ing" * 700]


def drawn(seed, many):
    r = random.Random(seed)
    parts = ["a", "b", "t", "h", "e", " ", "  ", "▁", "\n", "é", "ß", "日", "🙂", "\x01", "the", "ing", "1", ".", ",", "-", "́"]
    for _ in range(many):
        yield "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
        yield "".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(1, 0xD7FF), r.randint(0xE000, 0x1FFFF)])) for _ in range(r.randint(0, 40)))


def test_encodes_and_decodes_as_the_library(library, ours):
    for text in [*ODD, *drawn(1, 1500)]:
        ids = library.encode(text)
        assert ours.encode(text) == ids, text[:60]
        assert ours.decode(ids) == library.decode(ids), text[:60]


def test_decodes_any_ids_as_the_library(library, ours):
    r = random.Random(2)
    for _ in range(4000):
        ids = [r.choice([r.randint(0, 2), r.randint(3, 258), r.randint(3, 258), r.randint(259, 31999), 259, 260, 261]) for _ in range(r.randint(0, 12))]
        assert ours.decode(ids) == library.decode(ids), ids


def test_table_holds_the_last_token_of_each_prefix(ours):
    for word in ["▁international", "▁▁▁▁the▁", "▁zzéüing", "日本語▁"]:
        table = ours.last_tokens(word)
        for n in range(1, len(word) + 1):
            assert table[n] == pieces.merge_by_score(word[:n], ours.score)[-1]


def test_neighbours_are_what_merges_leave(ours):
    r, tokens = random.Random(3), sorted(ours.halves)
    for _ in range(3000):
        a, b = r.choice(tokens), r.choice(tokens)
        assert ours.neighbours(a, b) == (pieces.merge_by_score(a + b, ours.score) == [a, b]), (a, b)


def test_forgotten_words_and_pairs_come_again(library, monkeypatch):
    monkeypatch.setattr(pieces, "MOST_WORDS", 5)
    monkeypatch.setattr(pieces, "MOST_PAIRS", 7)
    small = pieces.Pieces(PATH)
    for text in drawn(4, 100):
        assert small.encode(text) == library.encode(text)


def test_other_models_are_refused(tmp_path):
    piece = lambda t, kind: bytes([10, len(t) + 4, 10, len(t)]) + t + bytes([24, kind])
    for kind, trainer in ((4, b"\x12\x02\x18\x02"), (1, b"\x12\x02\x18\x01")):  # a piece by the user; no merges
        path = tmp_path / f"m{kind}"
        path.write_bytes(piece(b"ab", kind) + trainer)
        with pytest.raises(ValueError):
            pieces.load_model(str(path))


def test_odd_rows(spark, library):
    rows = [(1, None, 5), (None, "a b", 6), (2, "", 7), (3, "the the", 8), (3, "the the", 8), (4, "x" * 200_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long").selectExpr("*", "1 AS decoded", "2 AS n_tokens")
    got = pieces.encode_documents(df, PATH).collect()
    assert sorted((r["doc_id"] or 0, tuple(r["ids"]), r["decoded"]) for r in got) == sorted((i or 0, tuple(library.encode(t or "")), t or "") for i, t, _ in rows)
    digests = {(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in pieces.encoding_digests(df, PATH).collect()}
    assert digests == {(i, len(library.encode(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows}
    assert pieces.encode_documents(df.limit(0), PATH).collect() == [] == pieces.encoding_digests(df.limit(0), PATH).collect()


def test_query_agrees_with_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_pieces"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
