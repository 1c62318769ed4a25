"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from lodestone.llm import piece_bpe, queries


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _texts(library, seed, n):
    rng = random.Random(seed)
    pieces = [library.id_to_piece(rng.randrange(32000)) for _ in range(4000)]
    signs = " \n\t.,ab'sré中　\x85😀19  \r\x1c▁▁the ing\x00￾<s></s><unk><0x41>"
    out = ["", " ", "▁", "\x00", "a" * 5000, " " * 4000, "-" * 3000, "\n" * 500, "ab" * 2000]
    out += ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]
    out += ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(n)]
    out += [" " * rng.randrange(60) + rng.choice(pieces) + " " * rng.randrange(60) + rng.choice("中aéx\n") for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000), rng.randrange(32, 127)])) for _ in range(rng.randrange(30))) for _ in range(n)]
    return out


def test_encodes_and_decodes_as_the_library(path, library):
    own = piece_bpe.Codec(path)
    for text in _texts(library, 3, 1500):
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids), text


def test_small_tables_give_the_same(path, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "MAX_PAIRS", 50)
    own = piece_bpe.Codec(path, max_words=20, max_ids=100)
    texts = _texts(library, 5, 150)
    for k in range(0, len(texts), 7):
        ids, lengths = own.encode_all(texts[k : k + 7])
        want = library.encode(texts[k : k + 7], add_bos=True, add_eos=True)
        assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want


def test_decodes_any_ids_as_the_library(path, library):
    own, rng = piece_bpe.codec(path), random.Random(8)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(3), rng.randrange(3, 259), rng.randrange(131, 259), rng.randrange(259, 32000), 29871]) for _ in range(rng.randrange(9))]
        assert own.decode(ids) == library.decode(ids), ids


def test_last_piece_of_every_prefix_is_that_of_its_encoding(path):
    """The table's claim, by merging each prefix."""
    graph, rng = piece_bpe.codec(path).graph, random.Random(2)
    for _ in range(300):
        word = "▁" * rng.randrange(4) + "".join(rng.choice("aeinorstéß中") for _ in range(rng.randrange(1, 14)))
        last = graph.last_pieces(word)
        assert last[1:] == [graph.merged(word[:k])[-1] for k in range(1, len(word) + 1)]
        assert graph.encode(word) == graph.merged(word)


def test_pieces_with_inner_spaces_are_found_in_whole_texts(path):
    """A vocabulary whose pieces reach over a word's start takes each text as one word."""
    own = piece_bpe.Codec(path)
    own.graph = piece_bpe.PieceGraph({"a▁": -1.0, "▁a": -2.0, "a▁b": -3.0, "aa": -4.0})
    assert own.graph.encode("▁a▁b") == ["▁", "a▁b"] and own.graph.encode("▁aa▁a") == ["▁a", "a▁", "a"]


def test_query_on_rows_with_nulls_repeats_and_bad_bytes(spark, path, library):
    rows = [(1, "it's"), (1, "it's"), (2, None), (3, ""), (4, "中 " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "'y' AS __text")
    docs = docs.union(docs.sparkSession.sql("SELECT 5L, cast(X'61FF62' AS string), 'x', 'y'"))
    got = piece_bpe.encode(docs, path, digests=True)
    found = sorted((r.doc_id, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded_sha256) for r in got.collect())
    want = []
    for k, text in [*rows, (5, "a�b")]:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((k, len(ids), tuple(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert found == sorted(want)
    back = {r.doc_id: r.text for r in piece_bpe.decode(got, path).collect()}
    assert back == {1: "it's", 2: "", 3: "", 4: "中 " * 3000, 5: "a�b"}
