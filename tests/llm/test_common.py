"""Hashing of words in bounded memory."""

import random
import sys

import numpy as np
import pyarrow as pa

from catalogspark.llm import common


def hashes(text):
    data, offsets = common.buffers(pa.array([text], pa.large_string()))
    starts, ends, _ = common.word_spans(data, offsets)
    return common.span_hashes(data, starts, ends)


def test_hashes_do_not_depend_on_the_place(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc\u00e9") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    alone = np.concatenate([hashes(w) for w in words])
    assert (hashes(" ".join(words)) == alone).all()
    assert len(set(alone.tolist())) == len(set(words))


def test_long_texts_and_words_keep_the_tables_small():
    """A text of 20 MB and a word of 10 MB: the tables stay as large as one piece."""
    long = "x" * 10_000_000
    got = hashes("word " + long + " word " + "more words " * 1_000_000)
    assert got[0] == got[2] and got[1] == hashes(long)[0] and got[1] != hashes(long[:-1])[0]
    assert len(got) == 2_000_003 and len(set(got.tolist())) == 4
    known = sys.modules["_catalogspark_worker"].powers
    assert len(known["up"]) == len(known["down"]) == common.PIECE_BYTES + 1


def test_a_word_longer_than_a_piece_is_hashed_like_a_short_one(monkeypatch):
    word = "abcdefgh" * 5
    whole = hashes(word)[0]
    monkeypatch.setattr(common, "PIECE_BYTES", 7)
    monkeypatch.setitem(sys.modules, "_catalogspark_worker", type(sys)("_catalogspark_worker"))
    assert hashes(word)[0] == whole and (hashes(f"a {word} bc d") == np.array([hashes(w)[0] for w in ("a", word, "bc", "d")])).all()
