import hashlib
import random
import time

import public_tokenizers as P
import tiktoken

from recallgrid.llm import bpe, pieces

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def library():
    words, _ = bpe.encoder(PATH)
    return words, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=words.ranks, special_tokens={})


def test_same_as_library():
    words, other = library()
    _, store = bpe.encoder(PATH)
    random.seed(3)
    letters = "ab'sStremdlv \n\t\r  .,!#123٣é漢字\U0001f600ß\u00a0\u2003\x1c\x85'"
    texts = ["".join(random.choices(letters, k=random.randint(0, 50))) for _ in range(3000)] + ["", "a" * 2000, "  " * 300, "''s", "don't 's 'S x''s \n's"]
    ids, at = store.ids(texts)
    for k, text in enumerate(texts):
        own = ids[at[k] : at[k + 1]]
        assert own.tolist() == other.encode_ordinary(text)
        assert words.decode(own).tobytes().decode() == text


def test_store_is_bounded():
    store = pieces.PieceEncoder(bpe.encoder(PATH)[0].encode, most=50)
    for k in range(20):
        store.ids([f" word{k}x{i}" for i in range(40)])
        assert len(store.known) <= 120


def test_queries(spark, edge, empty):
    _, other = library()
    rows = bpe.digests(edge, PATH).collect()
    texts = sorted((r.doc_id or -1, r.text or "") for r in edge.collect())
    expected = []
    for i, t in texts:
        ids = other.encode_ordinary(t)
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(expected)
    assert bpe.digests(empty, PATH).count() == 0
    round_trip = bpe.decode(bpe.encode(edge, PATH), PATH).collect()
    assert sorted((r.doc_id or -1, bytes(r.bytes).decode()) for r in round_trip) == texts


def test_long_pieces_by_chain():
    words, other = library()
    random.seed(4)
    for alphabet in ("ab", "etaoinshr", "éàñß", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"):
        for _ in range(60):
            piece = "".join(random.choices(alphabet, k=random.randint(2, 300))).encode()
            assert words._chain(piece).tolist() == other._core_bpe.encode_single_piece(piece)
    for long in ("".join(random.choices("abcdefghijklmnop", k=300_000)), "a" * 300_000):
        began = time.time()
        ids, at = bpe.encoder(PATH)[1].ids([long])
        assert time.time() - began < 20 and ids.tolist() == other._core_bpe.encode_single_piece(long.encode())


def test_texts_longer_than_a_round(monkeypatch):
    _, other = library()
    monkeypatch.setattr(pieces, "CHUNK", 50)
    text = "one two  three\n four's   five " * 30 + "x" * 500 + "  end "
    assert "".join(pieces.parts(text, 50)) == text and len(list(pieces.parts(text, 50))) > 10
    ids, at = bpe.encoder(PATH)[1].ids(["a b", text, ""])
    assert ids[at[1] : at[2]].tolist() == other.encode_ordinary(text) and at.tolist()[2:] == [len(ids), len(ids)]
