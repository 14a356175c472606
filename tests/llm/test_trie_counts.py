import pytest

from catalogspark.llm import queries, trie_counts

PIECES = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba", "c", "é", "bab", "▁c"]


def brute(text, scores, byte_score):
    """Best cut by trying all of them (short words only): score first, then fewer tokens."""
    def best(rest):
        if not rest:
            return 0.0, 0
        size = len(rest[0].encode())
        tail = best(rest[1:])
        options = [(tail[0] + size * byte_score, tail[1] + size)]
        for n in range(1, len(rest) + 1):
            if rest[:n] in scores:
                tail = best(rest[n:])
                options.append((tail[0] + scores[rest[:n]], tail[1] + 1))
        top = max(o[0] for o in options)
        return top, min(o[1] for o in options if abs(o[0] - top) <= 1e-9)

    return sum(best("▁" + w.decode())[1] for w in text.encode().split())


@pytest.mark.parametrize("max_nodes", [3, 10 ** 6])
def test_against_all_cuts(spark, max_nodes, monkeypatch):
    monkeypatch.setattr(trie_counts, "MAX_NODES", max_nodes)
    texts = ["ab aba abab c", "babab éé xaé", "", "abababab ab ab cab", "漢字 a\U0001f600b"]
    scores = trie_counts.piece_scores(PIECES)
    byte_score = trie_counts.Vocabulary(PIECES).byte_score
    trie = trie_counts.Trie(PIECES)
    for text in texts * 2:
        words, tokens = trie.counts([text.encode()])
        assert words == [len(text.split())] and tokens == [brute(text, scores, byte_score)]


def test_prefixes_are_shared():
    trie = trie_counts.Trie(PIECES)
    trie.insert([b"abab", b"abac"])
    # The root, the mark, a, b, a and two ends.
    assert trie.size == 7
    trie.insert([b"aba"])
    assert trie.size == 7


def test_odd_rows(odd, clashing, no_docs, spark):
    scores, vocabulary = trie_counts.piece_scores(PIECES), trie_counts.Vocabulary(PIECES)
    def expected(text):
        words = (text or "").encode().split()
        return len(words), sum(
            trie_counts.cut_directly("▁" + w.decode(), scores, vocabulary.longest, vocabulary.byte_score) for w in words
        )

    want = sorted(((r.doc_id, *expected(r.text)) for r in odd.collect()), key=str)
    for df in (odd, clashing):
        assert sorted(map(tuple, trie_counts.token_counts(df, PIECES, max_bytes=3000).collect()), key=str) == want
    assert trie_counts.token_counts(no_docs, PIECES).count() == 0


def test_query(spark, corpus):
    import public_tokenizers

    pieces = trie_counts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    scores, vocabulary = trie_counts.piece_scores(pieces), trie_counts.Vocabulary(pieces)
    found = {r.doc_id: r.n_tokens for r in queries.op10(spark, corpus).collect()}
    for r in spark.read.parquet(f"{corpus}/documents.parquet").limit(20).collect():
        assert found[r.doc_id] == sum(
            trie_counts.cut_directly("▁" + w.decode(), scores, vocabulary.longest, vocabulary.byte_score)
            for w in r.text.encode().split()
        )


def test_long_words_are_not_held(monkeypatch):
    """50,000 distinct words of 400 characters, and one of 300,000: nothing of them stays."""
    trie = trie_counts.Trie(["a", "ab", "b", trie_counts.MARK])
    monkeypatch.setattr(trie_counts, "cut_directly", lambda text, *_: len(text))
    for first in range(0, 50_000, 5_000):
        texts = [f"{i:06d}".encode() * 67 for i in range(first, first + 5_000)]
        assert trie.counts(texts)[1] == [403] * 5_000
    assert trie.counts([b"ab" * 150_000])[1] == [300_001]
    assert not trie.ends and trie.size == 1 and trie.bytes == 0


def test_held_words_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(trie_counts, "MAX_BYTES", 20_000)
    trie = trie_counts.Trie(["a", "b", "ab", trie_counts.MARK])
    for i in range(100):
        trie.counts([f"ab{i:05d}{j}".encode() for j in range(100)])
        assert trie.bytes <= 20_000 + 100 * 20 and len(trie.ends) <= 2_500


def test_long_cut_equals_the_plain_one():
    pieces = ["a", "ab", "ba", "b", "aab", trie_counts.MARK]
    trie = trie_counts.Trie(pieces)
    text = "abaab" * 80
    best = [(0.0, 0)]
    scores, byte = trie.scores, trie.vocabulary.byte_score
    word = trie_counts.MARK + text
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[end - 1][0] + size * byte, best[end - 1][1] + size)]
        options += [(best[i][0] + scores[word[i:end]], best[i][1] + 1) for i in range(max(0, end - 3), end) if word[i:end] in scores]
        top = max(o[0] for o in options)
        best.append(min((o for o in options if o[0] >= top - trie_counts.TIE), key=lambda o: o[1]))
    assert trie.counts([text.encode()])[1] == [best[-1][1]]
