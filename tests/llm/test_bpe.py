"""op11 against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessella.llm import bpe
from tessella.llm.lexicon import Lexicon, compile_lexicon

PATH = bpe.vocabulary_path()
ODD = [
    "", " ", "\n", "a", " a", "  a", "a  ", "a \n", "\t\tx", "don't we'll I've you're he'd I'm 'tis 's' 'sabc it''s  's \n's !'s 1's", "''s 're've 'l 'lx 'r e '", "x1 2y ３４ ½ Ⅷ", "é̀ à", "日本語 テキスト", "🙂🙂 a🙂b", " x  y z", "a\u0085b ​ c﻿",
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "  <|endoftext|>  x", "<|endoftext", "aaaa aaaaaaaaaa bbbbb", "x" * 700 + " " + "ab" * 500, "ᲉꟋ \U000105c0 \U0001fae9", "\x00\x01 \x1c\x1d \x7f", "'S 'LL", "= =  ==\n\n\n  x", "\r\n\r\n a\r\n",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def noise(rng, n):
    signs = "aabcdest'' \n\t.,;!1２é日🙂  lmrv"
    return "".join(rng.choice(signs) for _ in range(n))


def test_encoder_against_the_library(library):
    rng = random.Random(2)
    texts = ODD + [noise(rng, rng.randrange(1, 60)) for _ in range(800)]
    words = sorted({w for t in texts[:300] for w in (t[:5].encode(), (" " + t[1:4]).encode()) if w})
    lexicon = Lexicon(compile_lexicon(list(zip(words, (x.tolist() for x in bpe.vocabulary(PATH).merge(words)), strict=True)), bpe.vocabulary(PATH).size))
    for encode in (bpe.Encoder(PATH), bpe.Encoder(PATH, lexicon)):
        got = encode([t.encode() for t in texts])
        for t, x in zip(texts, got, strict=True):
            assert x.tolist() == ids(library, t), repr(t)
            assert encode.vocabulary.decode(x).decode("utf-8", "replace") == library.decode(x.tolist(), skip_special_tokens=False)
        for t in texts[:60]:
            assert encode([t.encode()])[0].tolist() == ids(library, t)


def test_classes_of_code_points(library):
    """Every class is the tokenizer's, for planes 0 and 1 in steps and all of the first blocks."""
    kind = bpe.classes(PATH)
    points = [*range(0x3100), *range(0x3100, 0x20000, 37)]
    points = np.array([c for c in points if not 0xD800 <= c < 0xE000], np.uint32)
    got = kind(points)
    for lead, want in (("a", bpe.LETTER), ("1", bpe.DIGIT), ("!", bpe.OTHER)):
        one = np.array([len(library.pre_tokenizer.pre_tokenize_str(lead + chr(c))) == 1 for c in points.tolist()])
        assert (one == (got == want)).all()


def test_merges_in_rounds_and_by_heap():
    v = bpe.vocabulary(PATH)
    assert v.in_rounds
    rng = random.Random(9)
    words = [bytes(rng.choice(b"abcehilnorstu aaa\xc3\xa9") for _ in range(rng.randrange(1, 90))) for _ in range(400)]
    assert [x.tolist() for x in v.merge(words)] == [v._by_heap(w) for w in words]


def test_transducer():
    rng = random.Random(4)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 8))) for _ in range(900)})
    outputs = [[rng.randrange(50) for _ in range(rng.choice([1, 1, 2, 5]))] for _ in words]
    lexicon = Lexicon(compile_lexicon(list(zip(words, outputs, strict=True)), 50))
    tried = words + [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 12))) for _ in range(900)]
    end = np.cumsum([len(w) for w in tried])
    got = lexicon.outputs(np.frombuffer(b"".join(tried) + b"x", np.uint8), end - [len(w) for w in tried], end)
    known = dict(zip(words, outputs, strict=True))
    for w, n in zip(tried, got.tolist(), strict=True):
        assert (lexicon.pool[lexicon.offset[n] : lexicon.offset[n + 1]].tolist() if n >= 0 else None) == known.get(w), w
    # Shared suffixes: words of equal ends and outputs need few states.
    many = Lexicon(compile_lexicon(sorted((f"{a}{b}{c}ending".encode(), [7]) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"), 50))
    assert len(many.base) < 20
    none = Lexicon(compile_lexicon([], 50))
    assert none.outputs(np.frombuffer(b"ab", np.uint8), np.array([0, 1]), np.array([1, 2])).tolist() == [-1, -1]
    with pytest.raises(ValueError):
        compile_lexicon([(b"b", [1]), (b"a", [2])], 50)


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_op11(spark, clashing, rows, library):
    got = bpe.encode_documents(clashing, PATH, words=300)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = sorted(((r[0], len(x), sha(np.array(x, "<u4").tobytes()), sha((r[1] or "").encode())) for r in rows for x in [ids(library, r[1])]), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_op11_long_texts_and_counts(spark, library, monkeypatch):
    rng = random.Random(6)
    long = " ".join(rng.choice(["alpha", "beta,", "don't", "gamma\n", "x1"]) for _ in range(400_000))
    solid = "".join(rng.choice("abcdefghij") for _ in range(150_000))
    df = spark.createDataFrame([(1, long), (2, solid), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode_documents(df, PATH).collect()}
    for d, t in ((1, long), (2, solid), (3, "")):
        x = ids(library, t)
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(x), sha(np.array(x, "<u4").tobytes()), sha(t.encode()))
    counts = {bytes(r["word"]): r["n"] for r in bpe.word_counts(df, PATH).collect()}
    assert counts[b" alpha"] + counts.get(b"alpha", 0) == long.split().count("alpha")


def test_op11_ids_and_texts(spark, docs, empty, rows):
    name = bpe.publish(spark, bpe.learn(docs, PATH, 100))
    encoded = bpe.encode(docs, PATH, name)
    back = sorted(((r["doc_id"], r["text"]) for r in bpe.decode(encoded, PATH).collect()), key=repr)
    assert back == sorted(((r[0], r[1] or "") for r in rows), key=repr)
    assert bpe.encode_documents(empty, PATH).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [0xE9 + 35])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(odd, PATH).collect()}[1] == ""
