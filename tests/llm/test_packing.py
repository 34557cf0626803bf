import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from recallgrid.llm import packing as X

PATH = P.path("byte_bpe_50k.json")


def fewest(items, capacity):
    """Fewest bins, by trying all."""
    best = len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= items[k]}):
            rest = list(rooms)
            rest[rest.index(r)] -= items[k]
            go(k + 1, rest)
        go(k + 1, rooms + [capacity - items[k]])

    go(0, [])
    return best


def test_reduction_keeps_a_best_packing():
    random.seed(5)
    for _ in range(250):
        capacity = random.choice([10, 20, 31])
        items = sorted((random.randint(1, capacity) for _ in range(random.randint(1, 9))), reverse=True)
        fixed, left = X.reduced(Counter(items), capacity)
        used = list(itertools.chain.from_iterable(lengths * n for n, lengths in fixed))
        rest = list(itertools.chain.from_iterable([s] * n for s, n in left.items()))
        assert sorted(used + rest) == sorted(items) and all(sum(b) <= capacity for _, b in fixed)
        assert sum(n for n, _ in fixed) + (fewest(sorted(rest, reverse=True), capacity) if rest else 0) == fewest(items, capacity)


def test_slots_cover_every_piece():
    random.seed(6)
    counts = Counter(random.choice([1024, 700, 324, 10, 3, 1, random.randint(1, 1024)]) for _ in range(5000))
    taken, bins = Counter(), Counter()
    for size, low, high, base, copies, at in X.slots(counts, 1024):
        for k in range(high - low):
            taken[size] += 1
            bins[base + k // copies] += size
            assert at + (k % copies + 1) * size <= 1024
    assert taken == counts and max(bins.values()) <= 1024
    assert len(bins) <= sum(s * n for s, n in counts.items()) / 1024 * 1.02 + 2


def test_pieces_and_places(spark, edge, empty):
    rows = X.pack(edge, PATH).collect()
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    expected = []
    for r in edge.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        n, start, size = len(ids), 0, len(ids) % 1024 or 1024
        k = 0
        while start < n:
            expected.append((r.doc_id or -1, k, start, size, zlib.crc32(ids[start : start + size].tobytes())))
            start, size, k = start + size, 1024, k + 1
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(expected)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024
    assert X.pack(empty, PATH).count() == 0
    sequences = X.sequences(edge, PATH).collect()
    assert sum(len(s.ids) for s in sequences) == sum(x[3] for x in expected) and all(len(s.ids) == s.length for s in sequences)


def test_a_worker_asks_for_few_ids_at_a_time():
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    words, calls = X.WordIds(PATH), []

    class Counted:
        def __getattr__(self, name):
            def called(texts, **options):
                calls.append(len(texts))
                return getattr(library, name)(texts, **options)

            return called

    words.tokenizer = Counted()
    asked = [(" " + "".join(letters)).encode() for letters in itertools.islice(itertools.product("abcdefghijkl", repeat=4), 20_000)] + [b"\n\n", b"x"]
    ids, at, size = words(asked)
    assert max(calls) <= 8 and sum(calls) < 30  # sets of words, each of a thousand; 2 are asked alone
    for k in (0, 7, 999, 1000, 12_345, 19_999, 20_000, 20_001):
        assert ids[at[k] : at[k] + size[k]].tolist() == library.encode(asked[k].decode(), add_special_tokens=False).ids

    # a long text is cut into rounds too, to the same ids
    text = " ".join(f"word{k % 5000}, né" for k in range(120_000))
    assert len(text) > 2 * X.ROUND
    assert X.store(PATH).ids([text, "a b"])[0].tolist() == library.encode(text, add_special_tokens=False).ids + library.encode("a b", add_special_tokens=False).ids
