import random

import numpy as np

from recallgrid.llm import minhash


def brute(rows):
    """component_id of each row, from all pairs of full sets."""
    sets, root = [minhash.shingles(t or "") for _, t in rows], list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if minhash.alike(sets[i], sets[j]):
                root[top(i)] = top(j)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(top(k), []).append(rows[k][0])
    low = {k: min((i for i in ids if i is not None), default=None) for k, ids in groups.items()}
    return [(i, len(s), low[top(k)] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def held(spark, rows, documents=None):
    documents = spark.createDataFrame(rows, "doc_id long, text string") if documents is None else documents
    got = minhash.near_duplicates(documents).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def hub(n, first, words=400, changed=14, seed=3):
    """A text, and copies that are similar to it but mostly not to each other."""
    rng, base = random.Random(seed), [f"h{first}w{k}" for k in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in range(changed):
            w[(i * 7 + k * (words // changed)) % words] = f"x{first}n{i}k{k}"
        rows.append((first + i, " ".join(w)))
    rows.insert(rng.randrange(n), (first + n, " ".join(base)))
    return rows


def test_hub_families_stay_whole(spark, monkeypatch):
    rows = hub(60, 1000)
    sets = [minhash.shingles(t) for _, t in rows]
    near = [minhash.alike(sets[i], sets[j]) for i in range(len(rows)) for j in range(i)]
    assert sum(near) < 0.2 * len(near)  # the hub's links and few others
    monkeypatch.setattr(minhash, "PART", 8)  # many blocks of one bucket
    monkeypatch.setattr(minhash, "CHUNK", 4)
    alone = [(k, " ".join(random.Random(k).choices("abcdefghijklmnop", k=90))) for k in range(40)]
    held(spark, rows + hub(12, 3000, words=200, changed=5) + alone)


def test_large_family_and_similarities_around_the_limit(spark):
    rng, rows = random.Random(5), []
    base = [f"w{k}" for k in range(300)]
    for i in range(150):
        w = list(base)
        w[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(w)))
    for i in range(60):  # pairs from 0.6 to 1
        w = [f"p{i}w{k}" for k in range(120)]
        rows.append((1000 + 2 * i, " ".join(w)))
        for k in rng.sample(range(120), i % 12):
            w[k] = "changed"
        rows.append((1001 + 2 * i, " ".join(w)))
    held(spark, rows)


def test_edges(spark, edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    held(spark, rows, edge)
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.near_duplicates(empty).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    five = [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "a b c d e f g x y"), (4, "A\tB c\nd E f g"), (5, "é É"), (6, "É é"), (7, "ab c"), (8, "ab c"), (None, "ab c"), (9, None), (10, " ")]
    held(spark, five)


def test_signatures_and_bounds():
    x, y = (np.unique(np.random.default_rng(k).integers(0, 1 << 63, 1000, np.uint64)) for k in (1, 2))
    near, far = np.concatenate([x[:900], y[:100]]), np.concatenate([x[:300], y[:700]])
    sig = (minhash.minima([x, near, far]) >> np.uint64(24)).astype(np.uint8)
    match = lambda k: (sig[0] == sig[k]).mean()
    assert abs(match(1) - 900 / 1100) < 0.09 and abs(match(2) - 300 / 1700) < 0.09
    left, m = minhash.survivors(sig, sig, np.array([0, 0]), np.array([1, 2]))
    assert left.tolist() == [0] and m[0] == (sig[0] == sig[1]).sum()
    # at a similarity of exactly 0.8, batch after batch, hardly a pair is dropped
    rng = np.random.default_rng(9)
    matches = (rng.random((200_000, minhash.HASHES)) < 0.8 + 0.2 / 256).reshape(-1, len(minhash.LEAST), minhash.BATCH).sum(axis=2).cumsum(axis=1)
    assert (matches < minhash.LEAST).any(axis=1).mean() < 0.002
    assert (1 - 0.8**minhash.ROWS) ** minhash.BANDS < 1e-4


def test_long_set_is_hashed_in_parts(monkeypatch):
    sets = [np.arange(k, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for k in (5, 700, 1, 64, 300)]
    whole = minhash.minima(sets)
    monkeypatch.setattr(minhash, "BLOCK", 64)
    assert (minhash.minima(sets) == whole).all()


def test_shared_counts():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.uint64)) for n in (1, 5000, 300, 4000)]
    got = minhash.shared_counts(sets[:2], sets[1:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets[:2]]
