import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catalogspark.llm import packing, queries


@pytest.fixture(scope="module")
def path():
    return queries.word_vocabulary()


@pytest.fixture(scope="module")
def whole(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(pieces, docs, whole, window):
    """Every id of every document in exactly one piece, sequences gapless and not too long."""
    wanted = sorted(zlib.crc32(whole(t).tobytes()) for t in docs)
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
        by_doc[p.doc_id].append(p)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    assert sum(p.length for p in pieces) == sum(len(whole(t)) for t in docs)
    return by_doc, wanted


def test_odd_rows(odd, whole, path):
    docs = odd.collect()
    pieces = packing.pack(odd, path, window=256, open_windows=4).collect()
    by_doc, _ = check(pieces, [r.text for r in docs], whole, 256)
    ids = {r.doc_id: whole(r.text) for r in docs if r.doc_id is not None}
    for doc, own in ids.items():
        repeats = sum(r.doc_id == doc for r in docs)
        assert all(p.doc_tokens == len(own) for p in by_doc[doc])
        assert sum(p.length for p in by_doc[doc]) == repeats * len(own)
        for p in by_doc[doc]:
            assert zlib.crc32(own[p.start:p.start + p.length].tobytes()) == p.ids_crc32


def test_unusual_texts_have_the_tokenizers_ids(spark, whole, path):
    texts = [
        "It's the END, isn't it?...", "A.B.C., d..", "<|endoftext|> x <|ENDOFTEXT|>.", "H̱at été ÉTÉ",
        "İstanbul ΣΑΣ ﬁne ½ ²x", " wide space\x85next\x1cfile", "汉字 かな. кот, КОТ.", "a​b 👍🏽 x_y 3.14 1,000",
        "ß ẞ µm ªº", "don't. can't, we'll. I'm", "x" * 300, ".", ",", "..", "a,", "É.", "9.", "_.", "ab\x00c",
    ]
    known = packing.WordIds(path)
    for text in texts:
        assert np.array_equal(np.frombuffer(known.of_text(text.encode()), "<u4"), whole(text)[:-1]), text


def test_forgetting_words_changes_nothing(path):
    known, small = packing.WordIds(path), packing.WordIds(path, limit=3)
    text = b"Some words, and some more words. Some words again"
    assert known.of_text(text) == small.of_text(text) == small.of_text(text)


def test_clashing_columns_and_empty_table(clashing, odd, no_docs, path):
    assert packing.pack(no_docs, path).count() == 0
    assert packing.pack(clashing, path).agg(F.sum("length")).first() == packing.pack(odd, path).agg(F.sum("length")).first()


def test_best_fit_and_fullest():
    windows = packing.Windows(10, 2)
    assert windows.place(6) == (0, 0, []) and windows.place(7) == (1, 0, [])
    assert windows.place(3) == (1, 7, [1])  # fits both; 1 is filled exactly and closes
    assert windows.place(5) == (2, 0, [])
    assert windows.place(8) == (3, 0, [0])  # none fits: the fullest goes
    assert windows.place(10) == (4, 0, [4])


def test_query_fills_its_windows(spark, corpus, whole):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").collect()
    pieces = queries.op1(spark, corpus).collect()
    check(pieces, [r.text for r in docs], whole, 2048)
    used = len({p.sequence_id for p in pieces})
    assert sum(p.length for p in pieces) / (2048 * used) > 0.95


def test_sequences_hold_their_pieces(odd, path):
    pieces = packing.pack(odd, path, window=512, with_ids=True).cache()
    by_id = defaultdict(list)
    for p in pieces.collect():
        by_id[p.sequence_id].append((p.offset, bytes(p.ids)))
    made = {r.sequence_id: bytes(r.ids) for r in packing.sequences(pieces).collect()}
    assert made == {k: b"".join(b for _, b in sorted(v)) for k, v in by_id.items()}


def test_known_words_are_bounded_by_bytes():
    from catalogspark.llm import queries

    known = packing.WordIds(queries.word_vocabulary(), limit=50_000)
    for i in range(3000):
        known.of_text(f"word{i} {'字' * 60}{i} x{i}".encode())
        assert known.bytes <= 50_000 + 2_000
        assert not any(len(w) > packing.LONG_WORD for w in known)
    assert known.of_text(("字" * 60).encode()) == known._ids(("字" * 60).encode())


def test_plain_new_words_take_the_short_way(path, whole, monkeypatch):
    """ASCII words, in any case and before a comma or full stop, are neither decoded to be told apart nor respelled."""
    known = packing.WordIds(path)
    known.letters = None
    for text in ("plain words, Here and THERE. zyxwvq Qqzzk, a. B", "", " ", "one"):
        assert np.array_equal(np.frombuffer(known.of_text(text.encode()), "<u4"), whole(text)[:-1]), text
